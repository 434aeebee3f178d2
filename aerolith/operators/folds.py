"""Ordered folds: decisions that depend on the decisions before them.

Plain windows cannot express these, for which rows belong to the history is itself the result. Rows
are sorted by group and order within partitions and streamed through a state of fixed size, so a
long group is never in memory as a whole; only small numbers of a row are read, never its points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, group: str, order: list[str], inputs: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], out: str, kind: str) -> DataFrame:
    """(group, *order, *inputs, out): ``out`` is what ``step(state, row)`` gives for each row in order.

    ``start`` makes the state of a group, ``step`` may change it; ``row`` has the ``inputs``. Rows
    with a null group form a group. Ties in ``order`` are taken in no fixed order, so give enough.
    """
    cols = [group, *[c for c in order if c != group], *[c for c in inputs if c not in order]]
    src = df.select(*cols).repartition(group).sortWithinPartitions(group, *order)
    where = [cols.index(c) for c in inputs]
    result = pa.bool_() if kind == "boolean" else pa.string() if kind == "string" else pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, first = None, None, True
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            done = []
            for r in range(b.num_rows):
                if first or rows[0][r] != at:
                    at, state, first = rows[0][r], start(), False
                done.append(step(state, tuple(rows[i][r] for i in where)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, type=result)], names=[*cols, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + f", `{out}` {kind}"
    return src.mapInArrow(run, schema)


class _Spread:
    """Running count, means and squared deviations of two measures."""

    __slots__ = ("m", "n", "q")

    def __init__(self) -> None:
        self.n, self.m, self.q = 0, [0.0, 0.0], [0.0, 0.0]

    def add(self, v: tuple[float, float]) -> None:
        self.n += 1
        for i in (0, 1):
            d = v[i] - self.m[i]
            self.m[i] += d / self.n
            self.q[i] += d * (v[i] - self.m[i])

    def over(self, v: tuple[float, float], z: float) -> bool:
        return all(v[i] > self.m[i] + z * math.sqrt(self.q[i] / (self.n - 1)) for i in (0, 1))


def outlier_gate(df: DataFrame, group: str, order: list[str], shift: str, turn: str, z: float, warmup: int = 4) -> DataFrame:
    """Adds ``rejected``: both measures lie over mean + z * sample deviation of the rows accepted before.

    The first max(3, warmup) rows are accepted; a row that did not move (shift null, NaN, 0 or less) is accepted
    and enters no history. A null turn counts as 0.
    """
    least = max(3, warmup)

    def step(s: _Spread, row: tuple) -> bool:
        v = (row[0] or 0.0, row[1] or 0.0)
        if not v[0] > 0:
            return False
        if s.n >= least and s.over(v, z):
            return True
        s.add(v)
        return False

    return ordered_fold(df, group, order, [shift, turn], _Spread, step, "rejected", "boolean")


def spaced(df: DataFrame, path: str, seq: str, xyz: tuple[str, str, str], spacing: float) -> DataFrame:
    """Adds ``kept``: at least ``spacing`` from the last kept point. The first point of a path is kept; keep the last by ``keep_last``."""
    def step(s: list, row: tuple) -> bool:
        if not s or math.dist(s[0], row) >= spacing:
            s[:] = [row]
            return True
        return False

    return ordered_fold(df, path, [seq], list(xyz), list, step, "kept", "boolean")


def rate_limited(df: DataFrame, group: str, ts: str, tie: str, interval: int) -> DataFrame:
    """Adds ``kept``: at least ``interval`` after the last kept row of the group."""
    def step(s: list, row: tuple) -> bool:
        if not s or row[0] - s[0] >= interval:
            s[:] = [row[0]]
            return True
        return False

    return ordered_fold(df.where(F.col(ts).isNotNull()), group, [ts, tie], [ts], list, step, "kept", "boolean")


def blocked(df: DataFrame, group: str, order: list[str], ready: str) -> DataFrame:
    """Adds ``emitted``: false from the first row that is not ready on, for a queue waits for its head."""
    def step(s: list, row: tuple) -> bool:
        if not row[0]:
            s.append(1)
        return not s

    return ordered_fold(df, group, order, [ready], list, step, "emitted", "boolean")
