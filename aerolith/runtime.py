"""Session helpers shared by all operators: tables, shared folders, hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in HOT_SHARE rows, so there can never be
#: more than HOT_SHARE hot keys: the list may travel to the driver and in a plan.
HOT_SHARE = 200
#: A hot key is spread over this many salts.
SALTS = 32


def build_session(app: str = "aerolith", cpus: int | str = "*", **conf) -> SparkSession:
    """A session with the settings that every plan of this package assumes."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name``; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, as in tests on
    one machine, a temporary folder is made and set, so that checkpoint() works too; a cluster,
    whose executors would each write to a disk of their own, is refused instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir() or ""
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="aerolith-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/aerolith/{purpose}-{uuid.uuid4().hex}"


def path_handle(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_sort(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts both: for exploded rows and packed cells, which Spark sizes by the bytes they come from and would collect on the driver for a broadcast."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by ``keys``: for small rows with long work each, which adaptive execution would put in few tasks by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def hot_values(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """The non-null values of ``key`` that hold more than 1/share of the rows: fewer than ``share``.

    One aggregation with partial counts; only the bounded list comes to the driver.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    rows = counts.where(F.col(key).isNotNull() & (F.col("__n") * share > F.lit(total))).select(key).collect()
    return [r[0] for r in rows]


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, hot: list, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join on ``key`` where a few listed keys of ``big`` hold much of it.

    Rows of ``big`` with a hot key get one of ``salts`` salts by the hash of ``spread``; the rows
    of ``small`` with a hot key are repeated once per salt. All other keys keep salt 0, so the
    repeated rows number at most len(hot) * salts * (rows of small per key). ``how``: inner or left.
    """
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    b = big.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    s = small.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return b.join(s, [key, "__salt"], how).drop("__salt")
