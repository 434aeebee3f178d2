"""Matching records by nearest time: a stateful streaming join.

Both sides of an entity are buffered in state. A left row goes out with its nearest right rows once
the watermark has passed its tolerance horizon (its time plus the tolerance), for then no nearer
right row can come; right rows that no present or future left row can reach are evicted.

State is kept per entity and time shard, not per entity: an entity with a third of all rows is
spread over as many tasks as it is long. A right row within the tolerance of a shard's border is
also sent to the neighbouring shard, so no pair is lost. Only (time, id) of a row are kept.

Each source has its own watermark and the slowest one counts, so a source that is read faster than
another makes no row of the other late. The watermark stays ``lateness`` behind; rows that are later
still would be dropped by it, so a bounded run counts them and goes again with more patience if
there were any.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolith.runtime import path_handle, shared_dir

#: Length of a time shard.
SHARD_NS = 300_000_000_000
#: The time of the row that closes a bounded stream: later than any data (year 2261).
CLOSE_NS = 9_180_000_000_000_000_000
LEFT = 0
#: The stream's clock in microseconds is half the time in microseconds plus this. So every 64-bit time in ns
#: lies between 1970, where a watermark starts, and 2262, where batches' timestamps end.
CLOCK_ZERO = 4_611_686_018_427_388

_PAIR = np.dtype([("ts", "<i8"), ("id", "<i8")])
OUTPUT = "left_id bigint, side int, right_id bigint, left_ts bigint, right_ts bigint"
_STATE = T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.ArrayType(T.BinaryType()))])


@dataclass(frozen=True)
class Side:
    """A right side: its number from 1, its name in the result, and its tolerance."""

    number: int
    name: str
    tolerance_ns: int


def _pairs(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", dtype=_PAIR)


def _tidy(a: np.ndarray) -> np.ndarray:
    """Sorted by time, then id; of rows with one time only that with the smallest id is ever nearest."""
    if len(a) < 2:
        return a
    a = a[np.lexsort((a["id"], a["ts"]))]
    return a[np.append(True, a["ts"][1:] != a["ts"][:-1])]


def nearest(left_ts: np.ndarray, right: np.ndarray, tolerance: int) -> np.ndarray:
    """Index into ``right`` (tidy) of the nearest row within the tolerance, or -1. Ties: the earlier."""
    out = np.full(len(left_ts), -1, dtype=np.int64)
    if not len(right) or not len(left_ts):
        return out
    ts = right["ts"]
    after = np.searchsorted(ts, left_ts, side="left")
    before = after - 1
    far = np.iinfo(np.int64).max
    gap_b = np.where(before >= 0, left_ts - ts[np.maximum(before, 0)], far)
    gap_a = np.where(after < len(ts), ts[np.minimum(after, len(ts) - 1)] - left_ts, far)
    pick = np.where(gap_b <= gap_a, before, after)
    good = np.minimum(gap_b, gap_a) <= tolerance
    out[good] = pick[good]
    return out


def joiner(sides: list[Side]):
    """The function that holds one entity and shard."""
    widest = max(s.tolerance_ns for s in sides)

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            raw_left, raw_right = state.get
            left, right = _pairs(raw_left), [_pairs(r) for r in raw_right]
        else:
            left, right = _pairs(None), [_pairs(None) for _ in sides]
        came = False
        for b in batches:
            came = came or len(b) > 0
            kind, ts, ids = b["side"].to_numpy(), b["ts"].to_numpy(), b["id"].to_numpy()

            def new(number: int) -> np.ndarray:
                pick = kind == number
                a = np.empty(int(pick.sum()), dtype=_PAIR)
                a["ts"], a["id"] = ts[pick], ids[pick]
                return a

            left = np.concatenate([left, new(LEFT)])
            right = [np.concatenate([r, new(s.number)]) for r, s in zip(right, sides)]
        right = [_tidy(r) for r in right]
        now = state.getCurrentWatermarkMs()
        mark = (now * 1000 - CLOCK_ZERO) * 2000 if now > 0 else None
        if mark is not None and len(left):
            due = left["ts"] + widest < mark
            ready, left = left[due], left[~due]
            ready = np.unique(ready)
            for s, r in zip(sides, right):
                at = nearest(ready["ts"], r, s.tolerance_ns)
                hit = at >= 0
                if hit.any():
                    yield pd.DataFrame({"left_id": ready["id"][hit], "side": np.int32(s.number), "right_id": r["id"][at[hit]], "left_ts": ready["ts"][hit], "right_ts": r["ts"][at[hit]]})
        if mark is not None:
            # A left row still to come is not older than the watermark; a waiting one may be.
            oldest = min(mark, int(left["ts"].min())) if len(left) else mark
            right = [r[r["ts"] >= oldest - s.tolerance_ns] for r, s in zip(right, sides)]
        if not len(left) and not any(len(r) for r in right):
            if state.exists:
                state.remove()
            return
        state.update((left.tobytes(), [r.tobytes() for r in right]))
        wake = int(left["ts"].min()) + widest if len(left) else max(int(r["ts"].max()) + s.tolerance_ns for r, s in zip(right, sides) if len(r))
        state.setTimeoutTimestamp(max((wake // 2000 + CLOCK_ZERO) // 1000 + 2, now + 1))

    return hold


COLUMNS = ["entity", "shard", "side", "ts", "id", "event_time"]


def side_rows(df: DataFrame, side: Side | None, entity: Column, ts_ns: Column, row_id: Column, shard_ns: int = SHARD_NS) -> DataFrame:
    """Rows of one side as (entity, shard, side, ts, id, event_time); right rows near a border in both shards.

    Rows without entity, time or id have no partner and are left out.
    """
    return several_sides(df, [] if side is None else [side], F.lit(side.number if side else LEFT), entity, ts_ns, row_id, shard_ns)


def several_sides(df: DataFrame, sides: list[Side], number: Column, entity: Column, ts_ns: Column, row_id: Column, shard_ns: int = SHARD_NS) -> DataFrame:
    """As ``side_rows`` of a table that holds several right sides; rows whose ``number`` is null are of none."""
    d = df.select(entity.cast("string").alias("entity"), ts_ns.alias("ts"), row_id.cast("bigint").alias("id"), number.cast("int").alias("side"))
    d = d.where(F.col("entity").isNotNull() & F.col("ts").isNotNull() & F.col("id").isNotNull() & F.col("side").isNotNull())

    def shard(t: str) -> str:
        return f"(({t}) - pmod({t}, {shard_ns}L)) div {shard_ns}L"

    if sides:
        reach = "case side " + " ".join(f"when {s.number} then {s.tolerance_ns}L" for s in sides) + " else 0L end"
        d = d.withColumn("shard", F.explode(F.expr(f"sequence({shard(f'ts - {reach}')}, {shard(f'ts + {reach}')})")))
    else:
        d = d.withColumn("shard", F.expr(shard("ts")))
    return d.withColumn("event_time", F.timestamp_micros(F.expr(f"ts div 2000L + {CLOCK_ZERO}L"))).select(*COLUMNS)


def join_stream(sources: DataFrame | list[DataFrame], sides: list[Side], lateness_ns: int = 0) -> DataFrame:
    """The streaming join of ``side_rows`` of one or more sources: (left_id, side, right_id, left_ts, right_ts).

    A left row without any partner within the tolerance has no row. Rows later than ``lateness_ns``
    behind the newest event of the slowest source are too late and dropped by the watermark, so it
    must cover the sources' delays wherever the stream runs in several batches.
    """
    late = f"{-(-lateness_ns // 2_000_000)} milliseconds"
    rows = functools.reduce(DataFrame.union, [r.select(*COLUMNS).withWatermark("event_time", late) for r in (sources if isinstance(sources, list) else [sources])])
    return rows.groupBy("entity", "shard").applyInPandasWithState(joiner(sides), OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def match_bounded(spark: SparkSession, sources: DataFrame | list[DataFrame], sides: list[Side], lateness_ns: int = 0, seen: dict | None = None) -> DataFrame:
    """Run the streaming join over all that the sources hold now, to the end, and read the result.

    Once the sources are read, in as many batches as their limit per trigger makes of them, the
    stream is closed by one more row in each, later than all data: it moves the watermark past every
    horizon, so the last left rows go out too and all state is evicted. If the watermark dropped any
    row as too late, the run is repeated with four times the lateness, so the result is always whole.
    A left row written again gives one row. Checkpoint, state and result lie in the shared folder.
    ``seen``, if given, gets the number of ``batches``, the peak of groups and bytes in state, and of
    ``runs``.
    """
    seen = {} if seen is None else seen
    seen |= {"runs": 0}
    sources = sources if isinstance(sources, list) else [sources]
    while True:
        base = shared_dir(spark, "nearest-time")
        dropped = _run(spark, sources, sides, lateness_ns, base, seen)
        seen["runs"] += 1
        if not dropped:
            break
        lateness_ns = 4 * max(lateness_ns, SHARD_NS)
    names = F.create_map(*[x for s in sides for x in (F.lit(s.number), F.lit(s.name))])
    out = spark.read.schema(OUTPUT).parquet(f"{base}/out")
    return out.dropDuplicates(["left_id", "side"]).select("left_id", names[F.col("side")].alias("side"), "right_id", "left_ts", "right_ts")


def _run(spark: SparkSession, sources: list[DataFrame], sides: list[Side], lateness_ns: int, base: str, seen: dict) -> int:
    """One run into ``base``; returns how many rows the watermark dropped."""
    closing = spark.range(1).select(
        F.lit("").alias("entity"), F.lit(-1).cast("bigint").alias("shard"), F.lit(-1).alias("side"), F.lit(CLOSE_NS).cast("bigint").alias("ts"), F.lit(-1).cast("bigint").alias("id"),
        F.timestamp_micros(F.lit(CLOSE_NS // 2000 + CLOCK_ZERO)).alias("event_time"),
    )
    fs, folder = path_handle(spark, f"{base}/closing")
    fs.mkdirs(folder)
    end = spark.readStream.schema(closing.schema).parquet(f"{base}/closing").select(*COLUMNS)
    stream = join_stream([r.select(*COLUMNS).union(end) for r in sources], sides, lateness_ns)

    def run() -> int:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        ran = [p for p in query.recentProgress if p["stateOperators"]]
        state = [p["stateOperators"][0] for p in ran]
        seen["batches"] = max(seen.get("batches", 0), sum(p["numInputRows"] > 0 for p in ran))
        for name, field in (("groups", "numRowsTotal"), ("bytes", "memoryUsedBytes")):
            seen[name] = max([seen.get(name, 0), *[o[field] for o in state]])
        return sum(o["numRowsDroppedByWatermark"] for o in state)

    dropped = run()
    if not dropped:
        closing.write.mode("append").parquet(f"{base}/closing")
        run()
    return dropped
