import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import packing as P


@pytest.mark.parametrize("capacity", [1, 7, 512, 2048])
def test_best_fit(capacity):
    rng = np.random.default_rng(capacity)
    sizes = np.minimum(capacity, np.maximum(1, rng.lognormal(3, 1, 4000).astype(int)))
    where, final = P.best_fit(sizes, capacity)
    used = np.bincount(where, weights=sizes, minlength=len(final))
    assert (used <= np.array(final)).all() and used.sum() == sizes.sum()
    assert set(final) <= set(P.permitted(capacity))
    # At the least number of full containers, first-fit decreasing needs at most 11/9 of it and one more.
    assert len(final) <= math.ceil(sizes.sum() / capacity) * 11 / 9 + 8
    assert all(min(s for s in P.permitted(capacity) if s >= u) == f for u, f in zip(used, final))


def test_lengths_are_chosen_together(monkeypatch):
    """Large items and few small ones: several lengths pay; where small ones abound, full containers stay as full."""
    rng = np.random.default_rng(5)
    scarce = np.concatenate([rng.integers(200, 500, 5000), rng.integers(1, 60, 8000)])
    plenty = np.minimum(512, np.maximum(1, rng.lognormal(5, 1, 20_000).astype(int)))

    def cost(final):
        return sum(f + P.OPENING for f in final)

    joint = {n: P.best_fit(s, 512)[1] for n, s in (("scarce", scarce), ("plenty", plenty))}
    monkeypatch.setattr(P, "EIGHTHS", (8,))
    plain = {n: P.best_fit(s, 512)[1] for n, s in (("scarce", scarce), ("plenty", plenty))}
    assert len(set(joint["scarce"])) >= 3
    assert cost(joint["scarce"]) < 0.97 * cost(plain["scarce"]) and cost(joint["plenty"]) <= 1.001 * cost(plain["plenty"])
    assert scarce.sum() / sum(joint["scarce"]) >= 0.99 and plenty.sum() / sum(joint["plenty"]) >= 0.999
    assert plenty.sum() / (512 * len(joint["plenty"])) >= 0.99


def test_last_container_shrinks():
    where, final = P.best_fit(np.array([100, 20]), 1024)
    assert where.tolist() == [0, 0] and final == [128]


def items(spark, data):
    return spark.createDataFrame(data, "profile_id int, doc_id long, n_tokens long, container_id string")


def test_whole_or_split_and_empty_items(spark):
    data = [(1, 1, 5, "c"), (1, 2, 10, "c"), (1, 3, 27, "c"), (1, 4, 0, "c"), (1, 5, None, "c"), (9, 6, 5, "c"), (1, None, 3, "c"), (1, 1, 5, "c")]
    rows = P.pack(items(spark, data), {1: 10}).collect()
    got = sorted(((r["doc_id"] or -1, r["piece"], r["start"], r["n_tokens"]) for r in rows if r["container_id"]))
    assert got == [(-1, 0, 0, 3), (1, 0, 0, 5), (1, 0, 0, 5), (2, 0, 0, 10), (3, 0, 0, 10), (3, 1, 10, 10), (3, 2, 20, 7)]
    assert sorted(r["doc_id"] for r in rows if r["container_id"] is None) == [4, 5, 6]
    boxes = {}
    for r in rows:
        if r["container_id"]:
            boxes.setdefault(r["container_id"], [0, r["container_length"]])[0] += r["n_tokens"]
    assert all(u <= n <= 10 for u, n in boxes.values()) and len(boxes) == 5


def test_shards_hold_everything_once(spark):
    df = spark.range(5000).select(F.lit(1).alias("profile_id"), F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("n_tokens"))
    out = P.pack(df, {1: 256}, shard_items=600)
    assert out.count() == out.select("doc_id").distinct().count() == 5000
    b = out.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.first("container_length").alias("c"))
    assert b.where("n > c").count() == 0
    assert b.agg(F.sum("n") / F.sum("c")).first()[0] > 0.98


def test_empty(spark):
    assert P.pack(items(spark, []), {1: 10}).count() == 0
    assert [r["container_id"] for r in P.pack(items(spark, [(1, 1, 5, "c")]), {}).collect()] == [None]


@pytest.mark.skipif(not os.path.isdir(P.TOKENIZERS), reason="no public tokenizers")
def test_counts(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("x" * 3000,)], "t string")
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"):
        n = [r[0] for r in df.select(P.token_counts(F.col("t"), name)).collect()]
        assert n[0] >= 2 and n[1:3] == [0, 0] and n[3] > 10
