"""Problem 6: the corpus as token ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.prefix_bpe import token_ids, vocabulary
from aerolith.runtime import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text"), "byte_bpe_50k").alias("ids"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the ids of each document spell its text again, byte by byte; null and empty texts have none."""

    @F.arrow_udf("string")
    def spelled(ids: pa.Array) -> pa.Array:
        signs = {i: t.encode("latin-1") for t, i in vocabulary("byte_bpe_50k").tokens.items()}
        return pa.array([b"".join(signs[i] for i in row).decode("utf-8", "surrogatepass") for row in ids.to_pylist()], type=pa.string())

    d = table(spark, sf_dir, "documents").select("doc_id", "text", token_ids(F.col("text"), "byte_bpe_50k").alias("ids"))
    return d.select("doc_id", (spelled(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"), (F.size("ids") == 0).alias("none"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
SQL = {"p6_round_trip": "SELECT doc_id, true AS same, coalesce(text, '') = '' AS none FROM documents"}
