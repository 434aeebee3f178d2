"""Far too many small files: consolidate records into fewer files of good size.

The method: find the records stored more than once, range-partition the rest by clustering keys
with sampled boundaries and a target size, write sorted files to a staging folder, reconcile the
counts, and only then swap the folders by rename. A failed run leaves the live folder as it was.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.runtime import HOT_SHARE, path_handle, salted_join

TARGET_BYTES = 256 * 1024 * 1024
#: So many copies (an id and a print of 32 bytes each) may be broadcast.
FEW = 200_000


class ReconcileError(RuntimeError):
    """The written files do not hold every record exactly once; the live folder is untouched."""


@dataclass
class Compacted:
    """A finished compaction: the folder, its records, and which record each file became."""

    path: str
    records: DataFrame
    membership: DataFrame
    n_files: int


def _exact(c: Column, t: T.DataType) -> Column:
    """``c`` with -0.0 as 0.0 at any depth, as equality has it, so that equal values print alike."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit(0).cast(t)).otherwise(c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _exact(x, t.elementType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_exact(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    return c


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns' JSON with explicit nulls: null, empty, and null members all differ."""
    whole = F.struct(*[_exact(F.col(c), df.schema[c].dataType).alias(c) for c in columns])
    return F.unhex(F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256))


def swap_in(spark: SparkSession, staging: str, live: str) -> None:
    """Make ``staging`` the live folder by rename; the former live folder goes only after that."""
    fs, new = path_handle(spark, staging)
    _, old = path_handle(spark, live)
    _, aside = path_handle(spark, live + ".old")
    if fs.exists(aside):
        fs.delete(aside, True)
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise ReconcileError(f"cannot move {live} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise ReconcileError(f"cannot move {staging} into place")
    if had:
        fs.delete(aside, True)


def compact(
    source: DataFrame,
    live: str,
    record: list[str],
    file_id: str,
    cluster_by: list[str],
    size: str | None = None,
    target_bytes: int = TARGET_BYTES,
) -> Compacted:
    """Write the records of ``source`` (one row per tiny file) once each into ``live``.

    Two rows are the same record if all ``record`` columns are exactly equal; null equals null,
    null arrays differ from empty ones, 0.0 equals -0.0 and NaN equals NaN. The row with the
    smallest ``file_id`` is kept, whole, with every other column it has; of rows written again under
    one id one is kept. Rows with null in any column are ordinary rows; a null ``file_id`` counts as
    larger than all others. ``size`` names
    the bytes of a row; null or negative counts as the mean, and without it rows count as 1 KiB.
    An empty source gives one empty file. Other columns may have any names.

    Only (fingerprint, file_id) is shuffled to find copies, with a partial minimum first, so a
    record that holds a third of all rows costs no more than others.
    """
    spark = source.sparkSession
    staging = live + ".staging"
    ids = source.select(F.col(file_id).alias("file_id"), fingerprint(source, record).alias("__fp"))
    # Fingerprints are written once: they are read for the groups, the membership and the records.
    ids.write.parquet(f"{staging}/_prints")
    ids = spark.read.parquet(f"{staging}/_prints")
    kept = ids.groupBy("__fp").agg(F.min("file_id").alias("kept_id"), F.count(F.lit(1)).alias("__n"))
    n_records, n_rows, most = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0)), F.max("__n")).first()
    hot = [r[0] for r in kept.where(F.col("__n") * HOT_SHARE > F.lit(n_rows)).select("__fp").collect()] if n_rows > 100_000 and most * HOT_SHARE > n_rows else []
    members = salted_join(ids, kept.drop("__n"), "__fp", F.col("file_id"), hot)
    members.select("file_id", "kept_id", "__fp").write.parquet(f"{staging}/_members")
    members = spark.read.parquet(f"{staging}/_members")
    members.select("file_id", "kept_id").write.parquet(f"{staging}/membership")

    # Mostly few rows are copies: then these are taken out by a broadcast of a checked size, and the records
    # meet only the exchange that sorts them. Rows are told apart by id, and where ids repeat by their print too.
    tag = uuid.uuid4().hex
    fp, rid = f"__fp_{tag}", f"__id_{tag}"
    copied = ~F.col("file_id").eqNullSafe(F.col("kept_id"))
    held, n_ids, n_copies = members.agg(F.count(F.lit(1)), F.count_distinct("file_id"), F.count_if(copied)).first()
    unique = n_ids == n_rows
    copies = members.where(copied).select(F.col("__fp").alias(f"{fp}_r"), F.col("file_id").alias(rid))
    some = F.broadcast(copies) if n_copies <= FEW else copies
    if unique:
        records = source.join(some.drop(f"{fp}_r"), F.col(file_id) == F.col(rid), "left_anti")
    else:
        same = (F.col(fp) == F.col(f"{fp}_r")) & F.col(file_id).eqNullSafe(F.col(rid))
        records = source.withColumn(fp, fingerprint(source, record)).join(some, same, "left_anti").dropDuplicates([fp]).drop(fp)
    if size:
        # The mean size of all rows stands for that of the records: one scan of one column.
        known, n_known = source.agg(F.sum(F.when(F.col(size) >= 0, F.col(size))), F.count(F.when(F.col(size) >= 0, 1))).first()
        total = (known or 0) / max(1, n_known) * n_records
    else:
        total = 1024 * n_records
    n_files = max(1, math.ceil(total / target_bytes))
    records.repartitionByRange(n_files, *cluster_by).sortWithinPartitions(*cluster_by).write.parquet(f"{staging}/records")

    back = spark.read.parquet(f"{staging}/records")
    told = F.col(file_id) if unique else fingerprint(back, record)
    stored = back.select(told.alias("one")).agg(F.count(F.lit(1)), F.count_distinct("one")).first()
    if not (stored[0] == stored[1] == n_records and held == n_rows):
        raise ReconcileError(f"{n_rows} rows, {held} assigned to {n_records} records, {stored[0]} written, {stored[1]} different")
    for part in ("_prints", "_members"):
        fs, p = path_handle(spark, f"{staging}/{part}")
        fs.delete(p, True)
    swap_in(spark, staging, live)
    return Compacted(live, spark.read.parquet(f"{live}/records"), spark.read.parquet(f"{live}/membership"), n_files)
