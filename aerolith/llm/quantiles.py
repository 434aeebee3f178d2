"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch holds buffers of ``k`` sorted values; all values of a buffer have its weight. Collapses form
a tree: as soon as ``b`` buffers of one level are full, they become one of the next level. Their
values, each repeated by its weight, are laid out in order, and ``k`` evenly spaced ones stay with
the summed weight W. A collapse moves the rank of any value by at most W / 2, so the summed W / 2
of all collapses plus half the largest weight bounds the error of every answer; the sketch carries
that bound. Each level adds n / 2k, and there are log_b(n / k) levels: for a billion values, k = 1024
and b = 4 half a percent of the ranks at worst. Values not yet in a full buffer stay as they are.
Sketches of partitions, files or days merge by pooling their buffers level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.arrowgroups import flat, lists, runs

#: Values in a buffer, and buffers of a level that collapse into one of the next.
K = 1024
B = 4
#: Sketches that one merge takes in; more are merged as a tree.
FAN_IN = 64
#: Values that one partition's sketches may hold before they are passed on.
HELD = 4_000_000

_FIELDS = "n bigint, moved double, levels array<int>, weights array<bigint>, buffers array<double>, tail array<double>"


class Sketch:
    """The buffers of one group. ``moved`` is the summed output weight of all collapses."""

    __slots__ = ("k", "b", "n", "moved", "full", "tail", "tail_n", "odd")

    def __init__(self, k: int = K, b: int = B) -> None:
        self.k, self.b, self.n, self.moved = k, b, 0, 0.0
        self.full: list[tuple[int, int, np.ndarray]] = []
        self.tail: list[np.ndarray] = []
        self.tail_n = 0
        self.odd = False

    def add(self, values: np.ndarray) -> int:
        """Take in values of weight 1; returns the change in the number of values held."""
        before = self.tail_n + self.k * len(self.full)
        self.n += len(values)
        self._loose(values)
        self._shrink()
        return self.tail_n + self.k * len(self.full) - before

    def _loose(self, values: np.ndarray) -> None:
        self.tail.append(values)
        self.tail_n += len(values)
        if self.tail_n >= self.k:
            pool = np.concatenate(self.tail)
            whole = len(pool) // self.k * self.k
            for part in pool[:whole].reshape(-1, self.k):
                self.full.append((0, 1, np.sort(part)))
                self._shrink()
            self.tail, self.tail_n = [pool[whole:].copy()], len(pool) - whole

    def merge(self, n: int, moved: float, full: list[tuple[int, int, np.ndarray]], tail: np.ndarray) -> None:
        self.n += n
        self.moved += moved
        self.full.extend(full)
        self._loose(tail)
        self._shrink()

    def _shrink(self) -> None:
        while True:
            levels = [x[0] for x in self.full]
            ripe = [v for v in set(levels) if levels.count(v) >= self.b]
            if not ripe:
                return
            self._collapse(min(ripe))

    def _collapse(self, level: int) -> None:
        same = [x for x in self.full if x[0] == level]
        parts = same[: self.b]
        self.full = [x for x in self.full if x[0] != level] + same[self.b :]
        values = np.concatenate([v for _, _, v in parts])
        weights = np.repeat([w for _, w, _ in parts], self.k)
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        whole = sum(w for _, w, _ in parts)
        if whole % 2:
            offset = (whole + 1) // 2
        else:
            offset = whole // 2 + self.odd
            self.odd = not self.odd
        at = np.searchsorted(upto, np.arange(self.k, dtype=np.int64) * whole + offset)
        self.full.append((level + 1, whole, values[order[at]]))
        self.moved += whole

    def rank_error(self) -> float:
        return self.moved / 2 + (max((w for _, w, _ in self.full), default=1) - 1) / 2

    def quantiles(self, ps: list[float]) -> list[float]:
        """Interpolated between neighbours at rank p * (n - 1), exact as long as nothing collapsed."""
        tail = np.concatenate(self.tail) if self.tail else np.empty(0)
        values = np.concatenate([v for _, _, v in self.full] + [tail])
        weights = np.concatenate([np.full(self.k, w) for _, w, _ in self.full] + [np.ones(len(tail), dtype=np.int64)])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        out = []
        for p in ps:
            h = p * (self.n - 1)
            low = int(np.floor(h))
            i, j = (min(int(np.searchsorted(upto, r + 1)), len(values) - 1) for r in (low, min(low + 1, self.n - 1)))
            out.append(float(values[i] + (values[j] - values[i]) * (h - low)))
        return out


def _rows(keys: list[tuple[str, str]], spec: list[tuple[tuple, int, Sketch]]) -> pa.RecordBatch:
    """Sketches as a batch: key columns, part number, and the sketch's fields."""
    arrays = [pa.array([k[i] for k, _, _ in spec], type=pa.string()) for i in range(len(keys))]
    tails = [np.concatenate(s.tail) if s.tail else np.empty(0) for _, _, s in spec]
    counts = np.array([len(s.full) for _, _, s in spec])
    none = np.empty(0)
    arrays += [
        pa.array([p for _, p, _ in spec], type=pa.int64()),
        pa.array([s.n for _, _, s in spec], type=pa.int64()),
        pa.array([s.moved for _, _, s in spec], type=pa.float64()),
        lists(np.array([x[0] for _, _, s in spec for x in s.full], dtype=np.int32), counts, pa.int32()),
        lists(np.array([x[1] for _, _, s in spec for x in s.full], dtype=np.int64), counts, pa.int64()),
        lists(np.concatenate([x[2] for _, _, s in spec for x in s.full] or [none]), np.array([len(s.full) * s.k for _, _, s in spec]), pa.float64()),
        lists(np.concatenate(tails or [none]), np.array([len(t) for t in tails]), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "part", "n", "moved", "levels", "weights", "buffers", "tail"])


def _pack(keys: list[str], pairs: list, size: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pairs), size):
        yield _rows(keys, pairs[i : i + size])


def sketches(df: DataFrame, group: list[str], metrics: list[str], k: int = K, b: int = B) -> DataFrame:
    """Sketches per partition: (*group, metric, part, ...), several rows per group and metric.

    Group columns are taken as strings; null is a group of its own. Values that are null, NaN,
    infinite or negative are no values. Rows are sketched where they lie, before any shuffle.
    """
    keys = [*group, "metric"]
    src = df.select(*[F.col(g).cast("string").alias(g) for g in group], *[F.col(m).cast("double").alias(f"__{m}") for m in metrics], F.spark_partition_id().cast("bigint").alias("__part"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Sketch] = {}
        held, part = 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column("__part")[0].as_py()
            code = np.zeros(n, dtype=np.int64)
            names: list[tuple] = [()]
            for g in group:
                d = batch.column(g).dictionary_encode()
                ids = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                words = [*d.dictionary.to_pylist(), None]
                code, back = np.unique(code * len(words) + ids, return_inverse=True)
                names = [(*names[c // len(words)], words[c % len(words)]) for c in code.tolist()]
                code = back
            order = np.argsort(code, kind="stable")
            sorted_code = code[order]
            for m in metrics:
                v = batch.column(f"__{m}").fill_null(np.nan).to_numpy(zero_copy_only=False)[order]
                good = np.isfinite(v) & (v >= 0)
                v, c = v[good], sorted_code[good]
                starts = np.flatnonzero(np.diff(c, prepend=-1))
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(c)]):
                    key = (*names[c[s]], m)
                    if key not in found:
                        found[key] = Sketch(k, b)
                    held += found[key].add(v[s:e])
            if held > HELD:
                yield from _pack(keys, [(key, part, s) for key, s in found.items()])
                found, held = {}, 0
        yield from _pack(keys, [(key, part, s) for key, s in found.items()])

    schema = ", ".join(f"`{c}` string" for c in keys) + f", part bigint, {_FIELDS}"
    return src.mapInArrow(build, schema)


def _read(keys: list[str], batches: Iterator[pa.RecordBatch], k: int, b: int) -> Iterator[tuple[tuple, Sketch, int]]:
    """Merged sketches of batches sorted by ``keys``."""
    at, s, part = None, None, 0
    for key, rows, new in runs(batches, keys):
        if new:
            if s is not None:
                yield at, s, part
            at, s, part = key, Sketch(k, b), rows.column("part")[0].as_py()
        for r in range(rows.num_rows):
            one = rows.slice(r, 1)
            levels, weights = flat(one.column("levels")), flat(one.column("weights"))
            bufs = flat(one.column("buffers")).reshape(len(levels), -1) if len(levels) else []
            s.merge(
                one.column("n")[0].as_py(),
                one.column("moved")[0].as_py(),
                [(int(x), int(w), np.asarray(v)) for x, w, v in zip(levels, weights, bufs)],
                np.asarray(flat(one.column("tail"))),
            )
    if s is not None:
        yield at, s, part


def merge(parts: DataFrame, group: list[str], n_parts: int, k: int = K, b: int = B, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per group and metric. ``n_parts`` is above every part number of ``parts``.

    A tree: each round merges ``fan_in`` neighbouring parts of a group, so no task takes in more
    than ``fan_in`` sketches of one group at a time, however many partitions a hot group spans.
    """
    keys = [*group, "metric"]
    schema = parts.schema

    def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for key, s, part in _read([*keys, "part"], batches, k, b):
            done.append((key[:-1], part, s))
            if len(done) >= 256:
                yield from _pack(keys, done)
                done = []
        yield from _pack(keys, done)

    while True:
        n_parts = -(-n_parts // fan_in)
        lowered = parts.withColumn("part", F.floor(F.col("part") / fan_in).cast("bigint") if n_parts > 1 else F.lit(0).cast("bigint"))
        parts = lowered.repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInArrow(round_, schema)
        if n_parts <= 1:
            return parts


def percentiles(merged: DataFrame, group: list[str], ps: list[float], k: int = K, b: int = B) -> DataFrame:
    """Answers of merged sketches: (*group, metric, n, max_rank_error, qs), ``qs`` in the order of ``ps``.

    ``max_rank_error`` is the certified bound on how far, in ranks, an answer may be off. Groups
    without any value have no row.
    """
    keys = [*group, "metric"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, s.n, s.rank_error(), s.quantiles(ps)) for key, s, _ in _read(keys, iter([batch]), k, b) if s.n]
            if out:
                cols = [pa.array([o[0][i] for o in out], type=pa.string()) for i in range(len(keys))]
                cols += [pa.array([o[1] for o in out], type=pa.int64()), pa.array([o[2] for o in out], type=pa.float64()), pa.array([o[3] for o in out], type=pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "n", "max_rank_error", "qs"])

    schema = ", ".join(f"`{c}` string" for c in keys) + ", n bigint, max_rank_error double, qs array<double>"
    return merged.mapInArrow(answer, schema)


def group_percentiles(df: DataFrame, group: list[str], metrics: list[str], ps: list[float], k: int = K, b: int = B) -> DataFrame:
    """Percentiles of ``metrics`` per ``group``: sketch each partition, merge as a tree, answer.

    A repeated row counts as often as it is stored. Ties are values like others. An empty table
    gives no rows. Columns of ``df`` other than the named ones are not read.
    """
    parts = sketches(df, group, metrics, k, b)
    return percentiles(merge(parts, group, df.rdd.getNumPartitions(), k, b), group, ps, k, b)
