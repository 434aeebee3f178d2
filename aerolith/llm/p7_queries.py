"""Problem 7: posts packed into containers of each profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.packing import pack, token_counts
from aerolith.runtime import table, written


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, int]]:
    """Every post under every profile; each tokenizer reads each text once. pack_profile has 4 rows and does not grow."""
    profiles = table(spark, sf_dir, "pack_profile").where("profile_id is not null and tokenizer is not null and capacity > 0").select("profile_id", "tokenizer", "capacity").collect()
    docs = table(spark, sf_dir, "documents")
    if not profiles:
        return spark.createDataFrame([], "profile_id int, doc_id bigint, n_tokens bigint"), {}
    names = sorted({p["tokenizer"] for p in profiles})
    counts = docs.select("doc_id", *[token_counts(F.col("text"), n).alias(n) for n in names])
    counts = written(counts, "token-counts")
    rows = F.array(*[F.struct(F.lit(p["profile_id"]).cast("int").alias("profile_id"), F.col(p["tokenizer"]).alias("n_tokens")) for p in profiles])
    items = counts.select("doc_id", F.explode(rows).alias("p")).select("p.profile_id", "doc_id", "p.n_tokens")
    return items, {p["profile_id"]: p["capacity"] for p in profiles}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(*_items(spark, sf_dir))


def p7_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profile: tokens, containers, their summed lengths, and the used part of them and of full containers."""
    items, capacities = _items(spark, sf_dir)
    boxes = pack(items, capacities).where("container_id is not null").groupBy("profile_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.first("container_length").alias("len"))
    cap = F.create_map(*[x for p, c in capacities.items() for x in (F.lit(p), F.lit(c))])
    return boxes.groupBy("profile_id").agg(
        F.sum("n").alias("tokens"),
        F.count(F.lit(1)).alias("containers"),
        F.sum("len").alias("length"),
        F.round(F.sum("n") / F.sum("len"), 6).alias("used"),
        F.round(F.sum("n") / F.sum(cap[F.col("profile_id")]), 6).alias("used_of_capacity"),
    )


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profile: posts, containers over their length or the capacity, posts split though they fit, and posts whose pieces do not add up."""
    items, capacities = _items(spark, sf_dir)
    packed = written(pack(items, capacities), "packed")
    cap = F.create_map(*[x for p, c in capacities.items() for x in (F.lit(p), F.lit(c))]) if capacities else F.lit(None)
    boxes = packed.where("container_id is not null").groupBy("profile_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.max("container_length").alias("len"))
    over = boxes.groupBy("profile_id").agg(F.count_if((F.col("n") > F.col("len")) | (F.col("len") > cap[F.col("profile_id")])).alias("over"))
    pieces = packed.groupBy("profile_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("got"))
    posts = items.join(pieces, ["profile_id", "doc_id"], "left")
    split = (F.col("pieces") > 1) & (F.col("n_tokens") <= cap[F.col("profile_id")])
    lost = F.coalesce("got", F.lit(-1)) != F.coalesce("n_tokens", F.lit(0))
    per = posts.groupBy("profile_id").agg(F.count(F.lit(1)).alias("posts"), F.count_if(split).alias("split"), F.count_if(lost).alias("lost"))
    return per.join(over, "profile_id", "left").select("profile_id", "posts", F.coalesce("over", F.lit(0)).alias("over"), "split", "lost")


QUERIES = {"p7_packed": p7_packed, "p7_use": p7_use, "p7_invariants": p7_invariants}
SQL = {
    "p7_invariants": """SELECT profile_id, count(*) AS posts, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS lost
  FROM pack_profile, documents WHERE profile_id IS NOT NULL AND tokenizer IS NOT NULL AND capacity > 0 GROUP BY profile_id""",
}
