"""Op-logs derived from the `events` table: pure functions of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLICAS = [0, 1, 2]


def operations(events: DataFrame) -> DataFrame:
    """Events with the replica that took each, its timestamp there, and its clock.

    Replicas take turns, so a replica's timestamp is a function of the id. An operation has seen its own replica's operations,
    and the next replica's but for the last two.
    """
    replica = F.pmod("event_id", F.lit(3)).cast("smallint")
    ts = F.expr("event_id div 3 + 1")
    seen = F.create_map(replica, ts)
    other = F.pmod(F.col("event_id") + 1, F.lit(3)).cast("smallint")
    clk = F.when(ts > 2, F.map_concat(seen, F.create_map(other, ts - 2))).otherwise(seen)
    return events.select("*", replica.alias("replica"), ts.alias("op_ts"), clk.alias("clk"))


def counters(events: DataFrame) -> DataFrame:
    """key = user; an error takes away, all else adds, 1 or the event's value."""
    rows = operations(events)
    op = F.when(F.col("event_type") == "error", "dec").otherwise("inc")
    return rows.select(F.col("user_id").alias("key"), op.alias("op"), F.lit(1).cast("bigint").alias("long_val"), F.col("value").alias("dbl_val"), "replica", F.col("op_ts").alias("ts"), "event_id", "clk")


def averages(events: DataFrame) -> DataFrame:
    """key = event type; adds floor(value * 100)."""
    rows = operations(events)
    return rows.select(F.col("event_type").alias("key"), F.lit("add_value").alias("op"), F.floor(F.col("value") * 100).alias("long_val"), F.lit(1).cast("bigint").alias("n_adds"), "replica", F.col("op_ts").alias("ts"), "event_id", "clk")


def clamps(events: DataFrame) -> DataFrame:
    """key = user; every third operation is a minimum, the others maxima."""
    rows = averages(events).drop("key").join(events.select("event_id", F.col("user_id").alias("key")), "event_id")
    return rows.withColumn("op", F.when(F.col("event_id") % 3 == 0, "min").otherwise("max"))


def elements(events: DataFrame) -> DataFrame:
    """key = user, elem = event type; an error removes of the user what its clock covers, all else adds."""
    rows = operations(events)
    op = F.when(F.col("event_type") == "error", "rem").otherwise("add")
    return rows.select(F.col("user_id").alias("key"), op.alias("op"), F.col("event_type").alias("elem"), F.col("event_id").cast("string").alias("tag"), F.lit(None).cast("array<string>").alias("observed"), "replica", F.col("op_ts").alias("ts"), "clk", "event_id")


def overwrites(events: DataFrame) -> DataFrame:
    """key = user % 8, map_key = user; each write overwrites the tag of the event three before it, an error only removes that."""
    rows = operations(events)
    op = F.when(F.col("event_type") == "error", "rem").otherwise("add")
    old = F.array((F.col("event_id") - 3).cast("string"), (F.col("event_id") - 6).cast("string"))
    return rows.select((F.col("user_id") % 8).alias("key"), F.col("user_id").cast("string").alias("map_key"), op.alias("op"), F.col("event_type").alias("elem"), F.col("event_id").cast("string").alias("tag"), old.alias("observed"), "replica", F.col("op_ts").alias("ts"))


def entries(events: DataFrame) -> DataFrame:
    """key = user % 4, map_key = user; an error at replica 0 removes the entry, all else updates it by 1."""
    rows = operations(events)
    op = F.when((F.col("event_type") == "error") & (F.col("replica") == 0), "rem").otherwise("upd")
    return rows.select((F.col("user_id") % 4).alias("key"), F.col("user_id").cast("string").alias("map_key"), op.alias("op"), F.lit(1).cast("bigint").alias("long_val"), "clk", "replica", F.col("op_ts").alias("ts"))


def flags(events: DataFrame) -> DataFrame:
    """key = user; views disable, all else enables."""
    rows = operations(events)
    op = F.when(F.col("event_type") == "view", "disable").otherwise("enable")
    return rows.select(F.col("user_id").alias("key"), op.alias("op"), F.col("event_id").cast("string").alias("tag"), F.lit(None).cast("array<string>").alias("observed"), "replica", F.col("op_ts").alias("ts"), "clk", "event_id")


def writes(events: DataFrame) -> DataFrame:
    """key = user; the register takes the event's type, at its time."""
    return events.select(F.col("user_id").alias("key"), F.col("event_type").alias("elem"), F.col("ts").alias("ts"), F.col("event_id").alias("replica"), F.lit("set").alias("op"))


def scores(events: DataFrame) -> DataFrame:
    """One board; id = user, score = floor(value * 100); an error removes what its clock covers of the user."""
    rows = operations(events)
    op = F.when(F.col("event_type") == "error", "topk_rem").otherwise("topk_add")
    return rows.select(F.lit("board").alias("key"), op.alias("op"), F.col("user_id").alias("id"), F.floor(F.col("value") * 100).alias("score"), F.lit(None).cast("binary").alias("bin_val"), "replica", F.col("op_ts").alias("ts"), "clk")


def running_sums(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "topsum_sub").otherwise("topsum_add")
    return events.select(F.lit("board").alias("key"), op.alias("op"), F.col("user_id").alias("id"), F.floor(F.col("value") * 100).alias("score"))


def hours(events: DataFrame) -> DataFrame:
    """key = event type; a counter array by hour of the day."""
    return events.select(F.col("event_type").alias("key"), F.lit("inc").alias("op"), F.hour("ts").alias("pos"), F.lit(1).cast("bigint").alias("long_val"), "event_id")


def rights(events: DataFrame) -> DataFrame:
    """key = user; purchases and errors take, signups pass rights on, every eleventh operation asks for rights, all else gives."""
    rows = operations(events)
    op = F.when(F.col("event_id") % 11 == 0, "rebalance").when(F.col("event_type").isin("purchase", "error"), "dec").when(F.col("event_type") == "signup", "transfer").otherwise("inc")
    return rows.select(F.col("user_id").alias("key"), op.alias("op"), (F.floor("value").cast("bigint") + 1).alias("long_val"), F.lit(0).cast("bigint").alias("n_adds"), ((F.col("event_id") + 1) % 3).alias("id"), "replica", "event_id")
