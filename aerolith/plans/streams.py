"""Streaming queries, run to the end of their sources, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.timeunits import TO_NS_SQL, to_ns, usable_reading, usable_sql
from aerolith.operators.voxel import cell, explode_points
from aerolith.plans.aggregates import IJK
from aerolith.plans.book import POINTS, Book
from aerolith.plans.joins import SENSORS, _asof
from aerolith.plans.scalar import scans
from aerolith.plans.windows import GATE, Z80
from aerolith.runtime import table
from aerolith.streaming import operators as T

book = Book()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = T.stream_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.withColumn("ord", F.unix_micros(F.col("ts").cast("timestamp")))


@book.query("str_t08_stateful_dedup", f"WITH {POINTS} SELECT DISTINCT recording, {IJK.format('2.0')} FROM pt")
def t08(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels of a stream of frames, each once."""
    f = T.stream_table(spark, sf, "lidar_frame", ["file_id", "recording", "points"])
    p = explode_points(f, "file_id", "recording").select("recording", *[cell(F.col(a), 2.0).alias(i) for a, i in zip("xyz", "ijk")])
    return T.run_bounded(T.first_seen(p, ["recording", "i", "j", "k"]), "stream-voxels")


@book.query("str_t09_stateful_gate", f"WITH RECURSIVE {GATE} SELECT user_id, event_id AS id, rejected FROM g")
def t09(spark: SparkSession, sf: str) -> DataFrame:
    """The outlier gate over a stream of events."""
    e = _events(spark, sf).select("user_id", "ord", F.col("event_id").alias("id"), F.col("value").alias("s"), (F.col("value") % 97).alias("t"))
    return T.run_bounded(T.gate(e, "user_id", Z80, 7), "stream-gate")


_DELAY = f"""sc AS (SELECT vehicle, scan_id, {TO_NS_SQL.format('lidar_ts')} // 1000000 AS ms FROM scan_buffer WHERE vehicle IS NOT NULL AND lidar_ts IS NOT NULL GROUP BY ALL),
nw AS (SELECT vehicle, max({TO_NS_SQL.format('ts_ns')} // 1000000) AS newest FROM sensor_sample WHERE sensor = 'state' AND vehicle IS NOT NULL AND ts_ns IS NOT NULL GROUP BY vehicle)"""


#: About so many batches make up what the tables hold.
BATCHES = 4


def _scan_rows(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    sc = T.stream_table(spark, sf, "scan_buffer", ["scan_id", "vehicle", "lidar_ts", *more], BATCHES)
    return sc.where("lidar_ts is not null").withColumn("ns", to_ns(F.col("lidar_ts")))


def _reading_rows(spark: SparkSession, sf: str) -> DataFrame:
    st = T.stream_table(spark, sf, "sensor_sample", ["vehicle", "sensor", "ts_ns", "v"], BATCHES)
    return st.where("vehicle is not null and ts_ns is not null").withColumn("ns", to_ns(F.col("ts_ns")))


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    a = _scan_rows(spark, sf).where("vehicle is not null").select("vehicle", F.expr("ns div 1000000").alias("ts_ms"), F.col("scan_id").alias("frame"))
    b = _reading_rows(spark, sf).where("sensor = 'state'").select("vehicle", F.expr("ns div 1000000").alias("ts_ms"), F.lit(None).cast("bigint").alias("frame"))
    return a.union(b)


@book.query("str_t01_t02_delayed_frames", f"WITH {_DELAY} SELECT sc.vehicle, scan_id AS frame, ms AS ts_ms FROM sc JOIN nw USING (vehicle) WHERE newest - ms >= 500")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    """Scans go out once a state is half a second later; the rest waits in state. Scans written again count once."""
    return T.run_bounded(T.delayed(_queue(spark, sf), "vehicle", 500), "stream-delay").distinct()


@book.query("str_t06_flushed_frames", f"WITH {_DELAY} SELECT sc.vehicle, scan_id AS frame, ms AS ts_ms FROM sc")
def t06(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a flush at the end: once all is read, a closing row for each vehicle sends every scan that still waits."""
    end, where = T.closing_source(spark, "vehicle string, ts_ms bigint, frame bigint")
    vehicles = table(spark, sf, "scan_buffer").where("vehicle is not null").select("vehicle", F.lit(0).cast("bigint").alias("ts_ms"), F.lit(-1).cast("bigint").alias("frame")).distinct()
    return T.run_bounded(T.delayed(_queue(spark, sf).union(end), "vehicle", 500), "stream-flush", closing=(vehicles, where)).distinct()


@book.query("str_t03_count_delay", f"WITH s AS (SELECT DISTINCT recording, scan_id, {TO_NS_SQL.format('lidar_ts')} AS ns FROM scan_buffer WHERE lidar_ts IS NOT NULL AND recording IS NOT NULL) SELECT recording, scan_id FROM (SELECT *, lead(ns, 3) OVER (PARTITION BY recording ORDER BY ns, scan_id) AS later FROM s) WHERE later IS NOT NULL")
def t03(spark: SparkSession, sf: str) -> DataFrame:
    """Scans go out as three newer ones have come; the newest three of a recording stay in state."""
    sc = _scan_rows(spark, sf, "recording").where("recording is not null").select("recording", F.col("ns").alias("ord"), F.col("scan_id").alias("id"))
    return T.run_bounded(T.behind(sc, "recording", 3), "stream-count").select("recording", F.col("id").alias("scan_id")).distinct()


_USABLE = f"({usable_sql('sensor', 'v')} OR (sensor = 'state' AND len(v) = 7))"


@book.query("str_t04_blocked_queue", f"""WITH s AS (SELECT DISTINCT vehicle, scan_id, {TO_NS_SQL.format('lidar_ts')} AS ns FROM scan_buffer WHERE lidar_ts IS NOT NULL AND vehicle IS NOT NULL),
nw AS (SELECT vehicle, sensor, max({TO_NS_SQL.format('ts_ns')}) AS top FROM sensor_sample WHERE vehicle IS NOT NULL AND ts_ns IS NOT NULL AND {_USABLE} GROUP BY vehicle, sensor),
rd AS (SELECT vehicle, min(top) AS ready FROM nw GROUP BY vehicle HAVING count(*) = 3) SELECT vehicle, scan_id FROM s JOIN rd USING (vehicle) WHERE ns <= ready""")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    """A scan waits until all sensors of its vehicle have a later reading, and all scans behind it wait with it."""
    sc = _scan_rows(spark, sf).where("vehicle is not null").select("vehicle", F.col("ns").alias("ord"), F.col("scan_id").alias("id"), F.lit(None).cast("int").alias("sensor"))
    state = (F.col("sensor") == "state") & (F.size("v") == 7)
    names = F.create_map(*[x for n, s in enumerate(SENSORS) for x in (F.lit(s), F.lit(n))])
    rd = _reading_rows(spark, sf).where(usable_reading(F.col("sensor"), F.col("v")) | F.coalesce(state, F.lit(False)))
    rd = rd.select("vehicle", F.col("ns").alias("ord"), F.lit(None).cast("bigint").alias("id"), names[F.col("sensor")].alias("sensor"))
    out = T.run_bounded(T.blocked_queue(sc.union(rd), "vehicle", len(SENSORS)), "stream-blocked")
    return out.select("vehicle", F.col("id").alias("scan_id")).distinct()


NEAR_NS, FAR_NS = 10_000_000, 20_000_000


@book.query("str_t05_dropped_counts", f"WITH {_asof(('state',))} SELECT recording, count(*) AS n, CAST(count_if(state_bid IS NULL OR state_aid IS NULL OR least(ns - state_bns, state_ans - ns) > {NEAR_NS} OR greatest(ns - state_bns, state_ans - ns) > {FAR_NS}) AS BIGINT) AS dropped FROM j WHERE vehicle IS NOT NULL GROUP BY recording")
def t05(spark: SparkSession, sf: str) -> DataFrame:
    """How many scans of a recording are dropped for a poor bracket of states, found by event time; passed readings leave the buffer (T2)."""
    end, where = T.closing_source(spark, T._ROW)
    asks = T.bracket_rows(_scan_rows(spark, sf).select(F.col("vehicle").alias("entity"), "ns", F.col("scan_id").alias("id")), False, FAR_NS)
    states = _reading_rows(spark, sf).where("sensor = 'state' and size(v) = 7").select(F.col("vehicle").alias("entity"), "ns")
    stream = T.bracketing([asks.union(end), T.bracket_rows(states, True, FAR_NS).union(end)], FAR_NS, "12 hours")
    last = spark.range(1).select(F.lit("").alias("entity"), F.lit(-1).cast("bigint").alias("shard"), F.lit(T.END_NS).alias("ns"), F.lit(None).cast("bigint").alias("id"), F.timestamp_micros(F.lit(T.END_NS // 1000)).alias("event_time"))
    gaps = T.run_bounded(stream, "stream-bracket", closing=(last, where)).dropDuplicates(["id"])
    bad = (F.col("before") < 0) | (F.col("after") < 0) | (F.least("before", "after") > NEAR_NS)
    per = gaps.join(scans(spark, sf).select(F.col("scan_id").alias("id"), "recording"), "id")
    return per.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("dropped"))


@book.query("str_t10_batch_callback", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t10(spark: SparkSession, sf: str) -> DataFrame:
    """Events through a callback per batch, which here only checks that it is called; then counted."""
    seen: list[int] = []
    out = T.run_bounded(_events(spark, sf).select("event_id", "event_type"), "stream-callback", lambda batch, number: seen.append(number))
    if not seen:
        raise RuntimeError("the callback was never called")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@book.query("str_t11_ring_buffer", "SELECT user_id, event_id AS id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    """The newest five events of each user, kept in state."""
    e = _events(spark, sf).select("user_id", "ord", F.col("event_id").alias("id"))
    return T.run_bounded(T.ring(e, "user_id", 5), "stream-ring", lambda batch, number: None, mode="update").select("user_id", "id")


@book.query("str_t15_backlog", f"WITH {_DELAY} SELECT sc.vehicle, count(*) AS queued, CAST(count_if(coalesce(newest - ms >= 500, false)) AS BIGINT) AS sent FROM sc LEFT JOIN nw USING (vehicle) GROUP BY sc.vehicle")
def t15(spark: SparkSession, sf: str) -> DataFrame:
    """Queued and sent scans per vehicle, the counters of a combined collect and drain step."""
    sent = t01(spark, sf).groupBy("vehicle").agg(F.count(F.lit(1)).alias("sent"))
    sc = table(spark, sf, "scan_buffer").where("vehicle is not null and lidar_ts is not null").select("vehicle", "scan_id").distinct().groupBy("vehicle").agg(F.count(F.lit(1)).alias("queued"))
    return sc.join(sent, "vehicle", "left").select("vehicle", "queued", F.coalesce("sent", F.lit(0)).alias("sent"))


@book.query("src_s14_lidar_stream", f"SELECT DISTINCT scan_id, {TO_NS_SQL.format('lidar_ts')} AS ns FROM scan_buffer WHERE lidar_ts IS NOT NULL")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """Scans as a stream, their times brought to nanoseconds by size."""
    return T.run_bounded(_scan_rows(spark, sf).select("scan_id", "ns"), "stream-scans").distinct()


@book.query("src_s16_sensor_streams", f"SELECT sensor, count(*) AS n, min({TO_NS_SQL.format('ts_ns')}) AS first_ns, max({TO_NS_SQL.format('ts_ns')}) AS last_ns FROM sensor_sample WHERE vehicle IS NOT NULL AND ts_ns IS NOT NULL GROUP BY sensor")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    """A stream per sensor of the high-rate poll, in several batches, and what came of each."""
    r = _reading_rows(spark, sf).select("sensor", "ns")
    one = [r.where(F.col("sensor") == s) for s in SENSORS]
    out = T.run_bounded(one[0].union(one[1]).union(one[2]), "stream-sensors")
    return out.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"))


QUERIES, SQL = book.queries, book.sql
