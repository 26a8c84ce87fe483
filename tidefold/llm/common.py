"""What the operators of this package share: working storage, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: the class `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the setting is absent and all run on one machine (tests, a laptop) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tidefold-")
    spark.sparkContext.setCheckpointDir(base)
    return shared_dir(spark)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidefold/{label}-{uuid.uuid4().hex}"
    atexit.register(drop_dir, spark, path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends here, and losing an executor loses no part of it."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """`df` as a table in the shared folder, dealt into buckets by `keys`, so that joins and aggregates on just these don't shuffle it again.

    And the same as plain files, for joins with hot keys: Spark splits these only where it shuffles both sides.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path, name = new_dir(spark, label), f"tidefold_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null and blank texts."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RUN))


def where_late(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that a condition holds for, filtered where it stands.

    A plain filter is pushed below the projections it needs and their expressions are written into it, also into
    lambdas, which would then do for each element what was meant to be done once for a row.
    """
    keep = "__keep"
    while keep in df.columns:
        keep += "_"
    flagged = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias(keep))
    return flagged.where(F.col(keep).isNotNull()).drop(keep)
