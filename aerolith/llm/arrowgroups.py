"""Reading sorted Arrow batches group by group, without a whole group in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Slices of ``batches`` whose key columns are constant: (key, slice, is it a new key).

    The batches must be sorted by ``keys``, so equal keys lie together; a key's rows may span batches.
    """
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(k) for k in keys]
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for c in cols:
            if n > 1:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], n)
        for s, e in zip(starts.tolist(), ends.tolist()):
            key = tuple(c[s].as_py() for c in cols)
            yield key, b.slice(s, e - s), key != last
            last = key


def flat(column: pa.Array) -> np.ndarray:
    """The values of a list column's rows, one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of ``values`` cut by ``lengths``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
