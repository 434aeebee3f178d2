"""As-of joins in both directions, split over time shards.

The rows of both sides lie in (entity, shard) partitions. Within a shard windows find the nearest
row before and after; what lies beyond a shard's border comes from a prefix scan over shard
summaries in two levels. So an entity with a third of all rows is spread over its shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_NS = 60_000_000_000
BLOCK_SHARDS = 1024


def carry_over_shards(b: DataFrame, entity: str, kinds: list[str]) -> DataFrame:
    """Per (entity, __shard) and kind the last value of earlier shards and the first of later ones.

    ``b``: one row per (entity, __block, __shard) with first_<kind> and last_<kind>, null where a
    shard has none of the kind; the result has prev_<kind> and next_<kind>.
    """
    tops = []
    for k in kinds:
        tops.append(F.min_by(f"first_{k}", F.when(F.col(f"first_{k}").isNotNull(), F.col("__shard"))).alias(f"bf_{k}"))
        tops.append(F.max_by(f"last_{k}", F.when(F.col(f"last_{k}").isNotNull(), F.col("__shard"))).alias(f"bl_{k}"))
    # What follows is taken in reverse order: a frame that grows is linear, one that shrinks is quadratic in Spark.
    before = (Window.unboundedPreceding, -1)
    over, over_back = (Window.partitionBy(entity).orderBy(o).rowsBetween(*before) for o in (F.asc("__block"), F.desc("__block")))
    inner, inner_back = (Window.partitionBy(entity, "__block").orderBy(o).rowsBetween(*before) for o in (F.asc("__shard"), F.desc("__shard")))
    blocks = b.groupBy(entity, "__block").agg(*tops).select(
        entity, "__block",
        *[F.last(f"bl_{k}", True).over(over).alias(f"bp_{k}") for k in kinds],
        *[F.last(f"bf_{k}", True).over(over_back).alias(f"bn_{k}") for k in kinds],
    )
    within = b.select(
        entity, "__block", "__shard",
        *[F.last(f"last_{k}", True).over(inner).alias(f"ip_{k}") for k in kinds],
        *[F.last(f"first_{k}", True).over(inner_back).alias(f"in_{k}") for k in kinds],
    )
    return within.join(blocks, [entity, "__block"]).select(
        entity, "__shard", *[F.coalesce(f"ip_{k}", f"bp_{k}").alias(f"prev_{k}") for k in kinds], *[F.coalesce(f"in_{k}", f"bn_{k}").alias(f"next_{k}") for k in kinds]
    )


def bracket(left: DataFrame, right: DataFrame, entity: str, ts: str, kind: Column, kinds: list[str], value: Column, tie: Column, shard_ns: int = SHARD_NS) -> DataFrame:
    """Each left row with the right rows just before and after it, for every kind at once.

    Adds before_<kind> and after_<kind>: structs (ts, v) or null. A right row at the left row's time
    counts as before; of several right rows at one time the one with the largest ``tie`` is last
    and that with the smallest first. ``kind`` gives the right rows' kind, as text. Rows with a null
    entity or time match nothing: such left rows keep null structs. Left rows that are repeated stay
    repeated. Empty sides give no rows, or null structs. Left columns must not start with ``__``.
    """
    shard = F.expr(f"(__ts - pmod(__ts, {shard_ns}L)) div {shard_ns}L")
    r = right.select(F.col(entity).alias("__e"), F.col(ts).alias("__ts"), kind.alias("__kind"), F.struct(F.col(ts).alias("ts"), value.alias("v")).alias("__r"), tie.alias("__tie"))
    r = r.where(F.col("__e").isNotNull() & F.col("__ts").isNotNull() & F.col("__kind").isin(kinds))
    payload = F.struct(*[F.col(c) for c in left.columns])
    all_left = left.select(F.col(entity).alias("__e"), F.col(ts).alias("__ts"), payload.alias("__l"))
    whole = F.col("__e").isNotNull() & F.col("__ts").isNotNull()
    both = r.unionByName(all_left.where(whole), allowMissingColumns=True).withColumn("__shard", shard).withColumn("__block", F.floor(F.col("__shard") / BLOCK_SHARDS))
    # These filters are what joins infer for some branches only; with them all branches share one exchange.
    both = both.where(F.col("__e").isNotNull() & F.col("__shard").isNotNull() & F.col("__block").isNotNull()).repartition("__e", "__shard")
    mine = {k: F.when(F.col("__kind") == k, F.col("__r")) for k in kinds}
    first = [F.min_by("__r", F.when(F.col("__kind") == k, F.struct("__ts", "__tie"))).alias(f"first_{k}") for k in kinds]
    last = [F.max_by("__r", F.when(F.col("__kind") == k, F.struct("__ts", "__tie"))).alias(f"last_{k}") for k in kinds]
    summary = both.groupBy("__e", "__block", "__shard").agg(*first, *last)
    carry = carry_over_shards(summary, "__e", kinds)
    shards = Window.partitionBy("__e", "__shard")
    left_last = F.col("__l").isNotNull()
    w = shards.orderBy(F.asc("__ts"), left_last.asc(), F.asc_nulls_first("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    back = shards.orderBy(F.desc("__ts"), left_last.desc(), F.desc_nulls_last("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.last(mine[k], True).over(w).alias(f"b_{k}") for k in kinds]
    ahead = [F.last(mine[k], True).over(back).alias(f"a_{k}") for k in kinds]
    at = both.select("__e", "__shard", "__l", *seen, *ahead).where(F.col("__l").isNotNull()).join(carry, ["__e", "__shard"])
    out = at.select("__l.*", *[F.coalesce(f"b_{k}", f"prev_{k}").alias(f"before_{k}") for k in kinds], *[F.coalesce(f"a_{k}", f"next_{k}").alias(f"after_{k}") for k in kinds])
    return out.unionByName(all_left.where(~whole).select("__l.*"), allowMissingColumns=True)
