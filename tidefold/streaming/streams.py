"""Continuous maintenance: op streams into state tables, triggers, windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.values import matches
from tidefold.sources.scratch import delete

Fold = Callable[[DataFrame], DataFrame]


def source(spark: SparkSession, path: str, schema, files_a_trigger: int | None = None) -> DataFrame:
    """A folder (or file) of parquet as a stream."""
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path)


def maintain(stream: DataFrame, partial: Fold, merge: Fold, state_dir: str, checkpoint: str, interval: str | None = None, keep: int = 2):
    """Keeps `merge` of all batches' `partial`s as versions under `state_dir`, one a batch.

    A batch writes a version under its own number from the one before; a batch that runs again overwrites its own
    version, so each operation counts once. Of the versions the last `keep` stay: two at least, for a batch may run again.
    """
    if keep < 2:
        raise ValueError("keep must be at least 2")
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        new = partial(batch)
        if number:
            old = spark.read.parquet(f"{state_dir}/v{number - 1}")
            new = merge(old.unionByName(new))
        new.write.mode("overwrite").parquet(f"{state_dir}/v{number}")
        if number >= keep:
            delete(spark, f"{state_dir}/v{number - keep}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def latest(spark: SparkSession, state_dir: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(state_dir)
    names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    return spark.read.parquet(f"{state_dir}/v{max(int(n[1:]) for n in names if n.startswith('v'))}")


@dataclass(frozen=True)
class Trigger:
    """An operation `op` on a source object whose key and bucket match makes `target_op` on the target object."""

    key: str
    op: str
    target_key: str
    target_op: str
    bucket: str = ".*"
    target_bucket: str | None = None


def fired(ops: DataFrame, triggers: list[Trigger]) -> DataFrame:
    """The operations that `ops` (key, bucket, op, ...) cause, one for each rule that an operation meets."""
    out = None
    for t in triggers:
        hit = ops.where(matches(F.col("key"), t.key) & matches(F.col("bucket"), t.bucket) & (F.col("op") == t.op))
        bucket = F.col("bucket") if t.target_bucket is None else F.lit(t.target_bucket)
        hit = hit.withColumn("op", F.lit(t.target_op)).withColumn("key", F.lit(t.target_key)).withColumn("bucket", bucket)
        out = hit if out is None else out.unionByName(hit)
    return ops.limit(0) if out is None else out


def with_triggers(partial: Fold, triggers: list[Trigger]) -> Fold:
    """A fold that also counts what each batch's operations cause."""
    return lambda batch: partial(batch.unionByName(fired(batch, triggers)))


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], *aggregates) -> DataFrame:
    return events.groupBy(F.window(ts, width), *by).agg(*aggregates)


def sliding(events: DataFrame, ts: str, width: str, slide: str, by: list[str], *aggregates) -> DataFrame:
    return events.groupBy(F.window(ts, width, slide), *by).agg(*aggregates)


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], *aggregates) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap), *by).agg(*aggregates)
