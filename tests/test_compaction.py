import os

import pytest
from pyspark.sql import functions as F

from aerolith.operators import compaction
from aerolith.operators.compaction import ReconcileError, compact

SCHEMA = "file_id long, recording string, frame_id long, points array<struct<x: float, y: float>>, orientation struct<w: double, x: double>, n_bytes long, note string"


def run(spark, data, tmp_path, **how):
    df = spark.createDataFrame(data, SCHEMA)
    return compact(df, f"file://{tmp_path}/live", ["recording", "frame_id", "points", "orientation"], "file_id", ["recording", "frame_id"], "n_bytes", **how)


def groups(done):
    return sorted((r["kept_id"], r["file_id"]) for r in done.membership.collect())


def test_nulls_empties_and_members_differ(spark, tmp_path):
    p = [(1.0, 2.0)]
    data = [
        (1, "r", 1, p, (1.0, 0.0), 10, "a"), (2, "r", 1, p, (1.0, 0.0), 11, "b"), (3, "r", 1, None, (1.0, 0.0), 10, "a"), (4, "r", 1, [], (1.0, 0.0), 10, "a"), (5, "r", 1, None, (1.0, 0.0), None, "a"),
        (6, "r", 1, [(None, 1.0)], None, 10, "a"), (7, "r", 1, [(1.0, None)], None, 10, "a"), (8, None, None, None, None, -5, None), (9, None, None, None, None, 10, None),
        (10, "r", 2, [(0.0, 1.0)], None, 10, "a"), (11, "r", 2, [(-0.0, 1.0)], None, 10, "a"), (12, "r", 3, [(float("nan"), 1.0)], None, 10, "a"), (13, "r", 3, [(float("nan"), 1.0)], None, 10, "a"),
    ]
    done = run(spark, data, tmp_path)
    assert groups(done) == [(1, 1), (1, 2), (3, 3), (3, 5), (4, 4), (6, 6), (7, 7), (8, 8), (8, 9), (10, 10), (10, 11), (12, 12), (12, 13)]
    assert sorted(r["file_id"] for r in done.records.collect()) == [1, 3, 4, 6, 7, 8, 10, 12]
    assert done.records.where("file_id = 1").first()["note"] == "a"


def test_files_by_size_are_sorted_and_swapped(spark, tmp_path):
    data = [(i, f"r{i % 3}", i, None, None, 1000, "x") for i in range(60)]
    done = run(spark, data, tmp_path, target_bytes=15_000)
    assert done.n_files == 4
    files = [f for f in os.listdir(f"{tmp_path}/live/records") if f.endswith(".parquet")]
    assert 2 <= len(files) <= 4
    for f in files:
        keys = [(r["recording"], r["frame_id"]) for r in spark.read.parquet(f"file://{tmp_path}/live/records/{f}").collect()]
        assert keys == sorted(keys)
    again = run(spark, data[:10], tmp_path)
    assert again.records.count() == 10 and sorted(os.listdir(tmp_path)) == ["live"]


def test_failed_reconciliation_leaves_the_live_folder(spark, tmp_path, monkeypatch):
    data = [(i, "r", i, None, None, 1, "x") for i in range(5)]
    run(spark, data, tmp_path)
    whole = compaction.fingerprint
    calls = []

    def broken(df, columns):  # the last of three calls looks at the written files
        calls.append(1)
        return whole(df, columns) if len(calls) < 3 else F.lit("same")

    monkeypatch.setattr(compaction, "fingerprint", broken)
    with pytest.raises(ReconcileError):
        run(spark, [*data[:3], data[0]], tmp_path)
    assert spark.read.parquet(f"file://{tmp_path}/live/records").count() == 5


def test_rows_written_again_and_shared_ids(spark, tmp_path):
    a, b, null = (1, "r", 1, None, None, 1, "x"), (1, "r", 2, None, None, 1, "x"), (None, "r", 1, None, None, 1, "x")
    done = run(spark, [a, a, b, null, null, (2, "r", 9, None, None, 1, "x")], tmp_path)
    assert sorted((r["file_id"], r["frame_id"]) for r in done.records.collect()) == [(1, 1), (1, 2), (2, 9)]
    assert done.membership.count() == 6


@pytest.mark.parametrize("few", [0, 10**6])
def test_many_copies_are_not_broadcast(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(compaction, "FEW", few)
    done = run(spark, [(i, "r", i // 3, None, None, 1, "x") for i in range(30)], tmp_path)
    assert sorted(r["file_id"] for r in done.records.collect()) == list(range(0, 30, 3))


def test_empty_and_clashing_names(spark, tmp_path):
    done = run(spark, [], tmp_path)
    assert done.records.count() == 0 and done.membership.count() == 0
    df = spark.range(3).select(F.col("id").alias("file_id"), F.lit(1).alias("__fp"), F.lit(2).alias("kept_id"), F.lit(3).alias("__n"))
    done = compact(df, f"file://{tmp_path}/x", ["__fp"], "file_id", ["kept_id"])
    assert done.records.columns == df.columns and groups(done) == [(0, 0), (0, 1), (0, 2)]


def test_hot_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "HOT_SHARE", 3)
    df = spark.range(120_000).select(F.col("id").alias("file_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("frame_id"))
    done = compact(df, f"file://{tmp_path}/hot", ["frame_id"], "file_id", ["frame_id"])
    assert done.records.count() == 60_001 and done.membership.where("kept_id = 0").count() == 60_000
