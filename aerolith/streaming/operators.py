"""Stateful streaming operators: delayed emission, gates, dedup, and bounded runs of a stream."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolith.runtime import path_handle, shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str], batches: int | None = None) -> DataFrame:
    """A table as a stream of its present files, in about so many batches of even bytes; a stream wants a folder, so a lone file is picked out of its own."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).select(*columns).schema)
    fs, p = path_handle(spark, path)
    if batches:
        reader = reader.option("maxBytesPerTrigger", max(1, -(-fs.getContentSummary(p).getLength() // batches)))
    return reader.parquet(path) if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", p.getName()).parquet(sf_dir)


def closing_source(spark: SparkSession, schema: str) -> tuple[DataFrame, str]:
    """A stream that is empty until its folder, which is given too, gets rows: what ends a bounded run."""
    where = shared_dir(spark, "closing")
    fs, folder = path_handle(spark, where)
    fs.mkdirs(folder)
    return spark.readStream.schema(schema).parquet(where), where


def run_bounded(stream: DataFrame, purpose: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", closing: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Run a stream over all that its sources hold now and read the result back.

    Checkpoint and result lie in the shared folder. ``closing``: rows that are written to the folder
    of a closing source once all else is read, and the run that takes them in. With ``each``, every batch also goes to that
    callback, before it is stored under its number, so a batch that runs again overwrites itself.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)

    def store(batch: DataFrame, number: int) -> None:
        each(batch, number)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    def run() -> None:
        writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True)
        query = (writer.format("parquet").option("path", f"{base}/out") if each is None else writer.foreachBatch(store)).start()
        query.awaitTermination()

    run()
    if closing:
        closing[0].write.mode("append").parquet(closing[1])
        run()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def first_seen(points: DataFrame, keys: list[str]) -> DataFrame:
    """Stateful dedup: a row for each key when it first comes. State grows with the keys, as in a map that only grows."""
    return points.select(*keys).dropDuplicates(keys)


def gate(stream: DataFrame, group: str, z: float, warmup: int) -> DataFrame:
    """The outlier gate as a stream over (group, ord, id, s, t): (group, id, rejected).

    A batch's rows of a group are taken by (ord, id); order across batches is that of arrival.
    State: count, means and squared deviations of the accepted rows.
    """
    least = max(3, warmup)

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, m0, q0, m1, q1 = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ord", "id"], kind="stable")
        out = []
        for s, t in zip(rows["s"].fillna(0.0).tolist(), rows["t"].fillna(0.0).tolist()):
            bad = False
            if s > 0:
                bad = n >= least and s > m0 + z * math.sqrt(q0 / (n - 1)) and t > m1 + z * math.sqrt(q1 / (n - 1))
                if not bad:
                    n += 1
                    d0, d1 = s - m0, t - m1
                    m0, m1 = m0 + d0 / n, m1 + d1 / n
                    q0, q1 = q0 + d0 * (s - m0), q1 + d1 * (t - m1)
            out.append(bad)
        state.update((n, m0, q0, m1, q1))
        yield pd.DataFrame({group: key[0], "id": rows["id"].to_numpy(), "rejected": out})

    kind = dict(stream.dtypes)[group]
    return stream.groupBy(group).applyInPandasWithState(hold, f"`{group}` {kind}, id bigint, rejected boolean", "n bigint, m0 double, q0 double, m1 double, q1 double", "append", GroupStateTimeout.NoTimeout)


def delayed(stream: DataFrame, group: str, delay_ms: int) -> DataFrame:
    """(group, frame, ts_ms): queued frames go out, oldest first, once the newest state is ``delay_ms`` later.

    ``stream`` has (group, ts_ms, frame); rows with a null frame are states, which only move time
    on. Frames still waiting when the stream ends stay in state until a state or ``flush`` row comes:
    a row whose frame is -1 sends all of its group that is waiting then. State is the waiting queue and
    the newest time; rows are taken in a record batch at a time, and what is due leaves at once.
    """
    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, ts, ids = state.get if state.exists else (None, [], [])
        queue = list(zip(ts, ids))
        heapq.heapify(queue)
        for rows in batches:
            known = rows["frame"].notna()
            new = rows[known & (rows["frame"] >= 0)]
            for item in zip(new["ts_ms"].astype("int64").tolist(), new["frame"].astype("int64").tolist()):
                heapq.heappush(queue, item)
            states = rows.loc[~known, "ts_ms"]
            if len(states):
                newest = int(states.max()) if newest is None else max(newest, int(states.max()))
            out = []
            while queue and ((rows["frame"] == -1).any() or (newest is not None and newest - queue[0][0] >= delay_ms)):
                out.append(heapq.heappop(queue))
            if out:
                yield pd.DataFrame({group: key[0], "frame": [o[1] for o in out], "ts_ms": [o[0] for o in out]})
        queue.sort()
        state.update((newest, [q[0] for q in queue], [q[1] for q in queue]))

    kind = dict(stream.dtypes)[group]
    return stream.groupBy(group).applyInPandasWithState(hold, f"`{group}` {kind}, frame bigint, ts_ms bigint", "newest bigint, ts array<bigint>, ids array<bigint>", "append", GroupStateTimeout.NoTimeout)


def behind(stream: DataFrame, group: str, count: int) -> DataFrame:
    """(group, id, ord): rows go out once ``count`` newer ones of their group exist; the newest ``count`` stay in state.

    A row written again counts once as long as it waits; later it goes out again.
    """
    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for rows in batches:
            all_ = sorted({*kept, *zip(rows["ord"].tolist(), rows["id"].tolist())})
            out, kept = all_[: max(0, len(all_) - count)], all_[max(0, len(all_) - count) :]
            if out:
                yield pd.DataFrame({group: key[0], "id": [o[1] for o in out], "ord": [o[0] for o in out]})
        state.update(([k[0] for k in kept], [k[1] for k in kept]))

    kind = dict(stream.dtypes)[group]
    return stream.groupBy(group).applyInPandasWithState(hold, f"`{group}` {kind}, id bigint, ord bigint", "ords array<bigint>, ids array<bigint>", "append", GroupStateTimeout.NoTimeout)


def blocked_queue(stream: DataFrame, group: str, sensors: int) -> DataFrame:
    """(group, id, ord): queued rows go out in order once each of the ``sensors`` has a reading at or after them.

    ``stream``: (group, ord, id, sensor); ``sensor`` is null for queued rows and else a number from 0.
    The first row that is not ready holds up all behind it. State is the queue and each sensor's
    newest reading.
    """
    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ords, ids, newest = state.get if state.exists else ([], [], [None] * sensors)
        queue, newest = list(zip(ords, ids)), list(newest)
        heapq.heapify(queue)
        for rows in batches:
            waits = rows["sensor"].isna()
            for item in zip(rows.loc[waits, "ord"].astype("int64").tolist(), rows.loc[waits, "id"].astype("int64").tolist()):
                heapq.heappush(queue, item)
            for n, top in rows[~waits].groupby("sensor")["ord"].max().items():
                newest[int(n)] = int(top) if newest[int(n)] is None else max(newest[int(n)], int(top))
            ready = min(newest) if None not in newest else None
            out = []
            while queue and ready is not None and queue[0][0] <= ready:
                out.append(heapq.heappop(queue))
            if out:
                yield pd.DataFrame({group: key[0], "id": [o[1] for o in out], "ord": [o[0] for o in out]})
        queue.sort()
        state.update(([q[0] for q in queue], [q[1] for q in queue], newest))

    kind = dict(stream.dtypes)[group]
    return stream.groupBy(group).applyInPandasWithState(hold, f"`{group}` {kind}, id bigint, ord bigint", "ords array<bigint>, ids array<bigint>, newest array<bigint>", "append", GroupStateTimeout.NoTimeout)


#: A row of this time (year 2100) ends a bounded stream of event times.
END_NS = 4_102_444_800_000_000_000
_ROW = "entity string, shard bigint, ns bigint, id bigint, event_time timestamp"


def bracket_rows(df: DataFrame, reading: bool, reach_ns: int, shard_ns: int = 300_000_000_000) -> DataFrame:
    """(entity, shard, ns, id, event_time) of (entity, ns, id); readings, without id, near a border go to both shards."""
    def shard(t: str) -> str:
        return f"(({t}) - pmod({t}, {shard_ns}L)) div {shard_ns}L"

    near = f"sequence({shard(f'ns - {reach_ns}L')}, {shard(f'ns + {reach_ns}L')})" if reading else f"array({shard('ns')})"
    d = df.select(F.col("entity").cast("string").alias("entity"), "ns", (F.lit(None) if reading else F.col("id")).cast("bigint").alias("id")).dropna(subset=["entity", "ns"])
    return d.select("entity", F.explode(F.expr(near)).alias("shard"), "ns", "id", F.timestamp_micros(F.expr(f"greatest(0L, least(ns, {END_NS - 1}L)) div 1000L")).alias("event_time"))


def bracketing(sources: list[DataFrame], reach_ns: int, late: str) -> DataFrame:
    """(id, before, after): of each queued row how far the readings next before and after it lie, -1 beyond ``reach_ns``.

    Sources: streams of ``bracket_rows``, each with its own watermark. A row goes out once the watermark
    has passed its reach, for then no nearer reading can come; readings that no waiting or coming row
    can reach are dropped from the buffer. State is held per entity and shard.
    """
    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw = state.get if state.exists else (b"", b"", b"")
        ts, ids, seen = ([np.frombuffer(r, dtype="<i8")] for r in raw)
        for rows in batches:
            asks = rows["id"].notna().to_numpy()
            at = rows["ns"].to_numpy(dtype="int64")
            ts.append(at[asks])
            ids.append(rows.loc[asks, "id"].to_numpy(dtype="int64"))
            seen.append(at[~asks])
        ts, ids, seen = np.concatenate(ts), np.concatenate(ids), np.unique(np.concatenate(seen))
        now = state.getCurrentWatermarkMs()
        mark = now * 1_000_000
        due = ts + reach_ns < mark
        if due.any():
            t = ts[due]
            a, z = np.searchsorted(seen, t, side="right") - 1, np.searchsorted(seen, t, side="left")
            before = np.where(a >= 0, t - seen[np.maximum(a, 0)], reach_ns + 1) if len(seen) else np.full(len(t), reach_ns + 1)
            after = np.where(z < len(seen), seen[np.minimum(z, len(seen) - 1)] - t, reach_ns + 1) if len(seen) else np.full(len(t), reach_ns + 1)
            yield pd.DataFrame({"id": ids[due], "before": np.where(before <= reach_ns, before, -1), "after": np.where(after <= reach_ns, after, -1)})
        ts, ids = ts[~due], ids[~due]
        oldest = min(mark, int(ts.min())) if len(ts) else mark
        seen = seen[seen >= oldest - reach_ns]
        if not len(ts) and not len(seen):
            if state.exists:
                state.remove()
            return
        state.update((ts.tobytes(), ids.tobytes(), seen.tobytes()))
        wake = (int(ts.min()) if len(ts) else int(seen.max())) + reach_ns
        state.setTimeoutTimestamp(max(wake // 1_000_000 + 1, now + 1))

    rows = functools.reduce(DataFrame.union, [s.withWatermark("event_time", late) for s in sources])
    return rows.groupBy("entity", "shard").applyInPandasWithState(hold, "id bigint, before bigint, after bigint", "ts binary, ids binary, seen binary", "append", GroupStateTimeout.EventTimeTimeout)


def ring(stream: DataFrame, group: str, size: int) -> DataFrame:
    """(group, id, ord): after each batch the newest ``size`` rows of the groups that it touched; update mode."""
    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for rows in batches:
            kept = sorted(heapq.nlargest(size, kept + list(zip(rows["ord"].tolist(), rows["id"].tolist()))))
        state.update(([k[0] for k in kept], [k[1] for k in kept]))
        yield pd.DataFrame({group: key[0], "id": [k[1] for k in kept], "ord": [k[0] for k in kept]})

    kind = dict(stream.dtypes)[group]
    return stream.groupBy(group).applyInPandasWithState(hold, f"`{group}` {kind}, id bigint, ord bigint", "ords array<bigint>, ids array<bigint>", "update", GroupStateTimeout.NoTimeout)


def minutes(stream: DataFrame, ts: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per event-time window and keys, sent when the watermark has passed the window."""
    w = F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
