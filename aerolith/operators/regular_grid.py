"""Irregular readings onto a regular grid.

The method: cut each source into time shards, summarise the first and last reading of each shard,
carry these summaries over shard borders in both directions by a prefix scan, then fill every shard
by itself. Shards without any reading are filled by themselves too: they come out of the carried
summaries as rows of their own and are spread over all tasks before they are filled, so a gap of
years is as many pieces of work as it has shards. No step needs a whole source in one task: a source
that holds a third of all rows has as many shards as it is long, and the prefix scan runs over shard
summaries in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots in a shard, and shards in a block of the prefix scan.
SHARD_SLOTS = 512
BLOCK_SHARDS = 1024


def carried(summaries: DataFrame, source: str) -> DataFrame:
    """Each shard's summary with ``__before``, the last reading of the source's shard before, and ``__after``, the first of the next one.

    ``summaries``: one row per (source, __block, __shard) with ``__first`` and ``__last``. A scan in two
    levels: blocks of shards are summarised and scanned first, then the shards within each block.
    """
    blocks = summaries.groupBy(source, "__block").agg(F.min_by("__first", "__shard").alias("__f"), F.max_by("__last", "__shard").alias("__l"))
    over_blocks = Window.partitionBy(source).orderBy("__block")
    blocks = blocks.select(source, "__block", F.lag("__l").over(over_blocks).alias("__block_before"), F.lead("__f").over(over_blocks).alias("__block_after"))
    within = Window.partitionBy(source, "__block").orderBy("__shard")
    inner = summaries.withColumns({"__in_before": F.lag("__last").over(within), "__in_after": F.lead("__first").over(within)})
    both = inner.join(blocks, [source, "__block"])
    return both.select(source, "__shard", "__first", "__last", F.coalesce("__in_before", "__block_before").alias("__before"), F.coalesce("__in_after", "__block_after").alias("__after"))


def border_pieces(shards: DataFrame, source: str, step: int) -> DataFrame:
    """What no pair of readings of one shard bounds, as pieces of one shard each: (source, __from, __until, __at, __next).

    Of each shard the slots before its first reading and after its last one, and every shard without
    a reading. ``__at`` is the reading before a piece, ``__next`` the one after it.
    """
    begin = F.col("__shard") * step
    head = shards.where(F.col("__before").isNotNull()).select(source, F.col("__shard").alias("__piece"), begin.alias("__from"), (F.col("__first.__slot") - 1).alias("__until"), F.col("__before").alias("__at"), F.col("__first").alias("__next"))
    after = shards.where(F.col("__after").isNotNull()).withColumn("__to", F.expr(f"(__after.__slot - pmod(__after.__slot, {step}L)) div {step}L"))
    tail = after.select(source, F.col("__shard").alias("__piece"), (F.col("__last.__slot") + 1).alias("__from"), (begin + (step - 1)).alias("__until"), F.col("__last").alias("__at"), F.col("__after").alias("__next"))
    # Empty shards in two steps, so an array holds one entry per BLOCK_SHARDS shards of the gap, or BLOCK_SHARDS entries.
    block = F.lit(BLOCK_SHARDS).cast("bigint")
    gaps = after.where(F.col("__to") > F.col("__shard") + 1).withColumn("__b", F.explode(F.sequence(F.col("__shard") + 1, F.col("__to") - 1, block)))
    gaps = gaps.repartition(source, "__b").withColumn("__piece", F.explode(F.sequence(F.col("__b"), F.least(F.col("__b") + (BLOCK_SHARDS - 1), F.col("__to") - 1))))
    empty = gaps.select(source, "__piece", (F.col("__piece") * step).alias("__from"), (F.col("__piece") * step + (step - 1)).alias("__until"), F.col("__last").alias("__at"), F.col("__after").alias("__next"))
    pieces = head.unionByName(tail).unionByName(empty).where(F.col("__from") <= F.col("__until"))
    return pieces.repartition(source, "__piece").drop("__piece")


def regular_grid(
    readings: DataFrame,
    source: str,
    ts_ns: Column,
    value: Column,
    order: list[Column],
    period_ns: int = 100_000_000,
    fill: str = "previous",
    max_fill: int | None = None,
    shard_slots: int = SHARD_SLOTS,
) -> DataFrame:
    """One row per source and period from its first to its last reading.

    Result: (source, slot, value, status, age). ``slot`` is floor(ts_ns / period_ns). A slot with
    readings takes the last of them by (ts_ns, *order), status ``measured``, age 0. A slot without
    takes the nearest earlier slot's value (``fill="previous"``) or lies on the line between both
    neighbours (``fill="linear"``, for arrays of double of equal length, else as previous), status
    ``filled``; where the gap so far is longer than ``max_fill`` slots the value is null and the
    status ``missing``. ``age`` counts the slots since the last measured one.

    Rows with a null source or time are no readings. Repeated rows and ties change nothing: the
    last by ``order`` counts, and equal rows are alike. An empty table gives an empty grid.
    Other columns of ``readings`` are not read, so their names cannot clash.
    """
    slots = (
        readings.select(F.col(source).alias("__source"), ts_ns.alias("__ts"), value.alias("__value"), F.struct(*order).alias("__order"))
        .where(F.col("__source").isNotNull() & F.col("__ts").isNotNull())
    )
    # Integer division that rounds down also for negative times.
    slot = F.expr(f"(__ts - pmod(__ts, {int(period_ns)}L)) div {int(period_ns)}L")
    slots = slots.withColumn("__slot", slot).withColumn("__shard", F.expr(f"(__slot - pmod(__slot, {int(shard_slots)}L)) div {int(shard_slots)}L"))
    # One exchange for all that follows: the slots' aggregate, the shards' summaries, the windows within shards.
    # The filters say what the joins below would infer for some branches only; with them all branches read the
    # same exchange, and Spark reuses it.
    slots = slots.withColumn("__block", F.floor(F.col("__shard") / BLOCK_SHARDS))
    slots = slots.where(F.col("__slot").isNotNull() & F.col("__shard").isNotNull() & F.col("__block").isNotNull())
    slots = (
        slots.repartition("__source", "__shard")
        .groupBy("__source", "__block", "__shard", "__slot")
        .agg(F.max_by("__value", F.struct("__ts", "__order")).alias("__value"))
    )
    reading = F.struct("__slot", "__value")
    summary = slots.groupBy("__source", "__block", "__shard").agg(F.min_by(reading, "__slot").alias("__first"), F.max_by(reading, "__slot").alias("__last"))
    in_shard = Window.partitionBy("__source", "__shard").orderBy("__slot")
    step = int(shard_slots)
    inner = slots.withColumn("__next", F.lead(reading).over(in_shard)).select("__source", F.col("__slot").alias("__from"), F.coalesce(F.col("__next.__slot") - 1, "__slot").alias("__until"), reading.alias("__at"), "__next")
    pieces = inner.unionByName(border_pieces(carried(summary, "__source"), "__source", step))
    steps = pieces.select("__source", F.col("__at.__slot").alias("__slot"), F.col("__at.__value").alias("__value"), "__next", F.explode(F.sequence("__from", "__until")).alias("slot"))
    age = F.col("slot") - F.col("__slot")
    status = F.when(age == 0, "measured").when(F.lit(max_fill is None) | (age <= F.lit(max_fill or 0)), "filled").otherwise("missing")
    filled = F.col("__value")
    if fill == "linear":
        part = age / (F.col("__next.__slot") - F.col("__slot"))
        line = F.zip_with("__value", F.col("__next.__value"), lambda a, b: a + (b - a) * part)
        filled = F.when((age > 0) & (F.size("__value") == F.size(F.col("__next.__value"))), line).otherwise(F.col("__value"))
    elif fill != "previous":
        raise ValueError(f"fill is previous or linear, not {fill}")
    return steps.select(
        F.col("__source").alias(source),
        "slot",
        F.when(status != "missing", filled).alias("value"),
        status.alias("status"),
        age.cast("bigint").alias("age"),
    )
