"""Vector clocks as maps from replica to timestamp. An absent replica counts as 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zipped(a: Column, b: Column, test) -> Column:
    pairs = F.map_zip_with(a, b, lambda _, x, y: test(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    return F.map_values(pairs)


def lower_or_equal(a: Column, b: Column) -> Column:
    return F.forall(_zipped(a, b, lambda x, y: x <= y), lambda ok: ok)


def higher_or_equal(a: Column, b: Column) -> Column:
    return lower_or_equal(b, a)


def equal(a: Column, b: Column) -> Column:
    return F.forall(_zipped(a, b, lambda x, y: x == y), lambda ok: ok)


def lower(a: Column, b: Column) -> Column:
    return lower_or_equal(a, b) & ~equal(a, b)


def higher(a: Column, b: Column) -> Column:
    return lower(b, a)


def concurrent(a: Column, b: Column) -> Column:
    return ~lower_or_equal(a, b) & ~higher_or_equal(a, b)


def compare(a: Column, b: Column) -> Column:
    """`equal`, `lower`, `higher` or `concurrent`."""
    return F.when(equal(a, b), "equal").when(lower_or_equal(a, b), "lower").when(higher_or_equal(a, b), "higher").otherwise("concurrent")


def merged(a: Column, b: Column) -> Column:
    """The pointwise maximum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, y), F.coalesce(y, x)))


def merge_all(df: DataFrame, by: list[str], clock: str, out: str) -> DataFrame:
    """Per group the pointwise maximum of all its clocks, combined before the shuffle."""
    flat = df.select(*by, F.explode(clock).alias("__r", "__t"))
    tops = flat.groupBy(*by, "__r").agg(F.max("__t").alias("__t"))
    return tops.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__r", "__t")))).alias(out))


def first_difference(a: Column, b: Column) -> Column:
    """The smallest replica at which two clocks differ: struct(replica, of a, of b), null if none."""
    pairs = F.map_entries(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("a"), F.coalesce(y, F.lit(0)).alias("b"))))
    apart = F.filter(pairs, lambda e: e["value"]["a"] != e["value"]["b"])
    return F.array_min(F.transform(apart, lambda e: F.struct(e["key"].alias("replica"), e["value"]["a"].alias("a"), e["value"]["b"].alias("b"))))


def total_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by cause where one clock covers the other, else by the smallest replica at which they differ."""
    d = first_difference(a, b)
    return F.when(equal(a, b), 0).when(lower_or_equal(a, b), -1).when(higher_or_equal(a, b), 1).when(d["a"] < d["b"], -1).otherwise(1)


def at(clock: Column, replica: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, replica), F.lit(0))


def advanced(clock: Column, replica: Column, by: int = 1) -> Column:
    """The clock with one replica's timestamp moved on."""
    return updated(clock, replica, at(clock, replica) + by)


def updated(clock: Column, replica: Column, to: Column) -> Column:
    return F.map_concat(F.map_filter(clock, lambda k, _: k != replica), F.create_map(replica, to))


def without(clock: Column, replica: Column) -> Column:
    return F.map_filter(clock, lambda k, _: k != replica)


def compare_but_self(a: Column, b: Column, self_replica: Column) -> Column:
    """The comparison that leaves one replica out."""
    return compare(without(a, self_replica), without(b, self_replica))


def stable(df: DataFrame, replicas: list[int], clock: str) -> DataFrame:
    """One row a replica: the timestamp of it that every one of `df`'s clocks covers; what is below is settled."""
    each = [F.min(at(F.col(clock), F.lit(r).cast("smallint"))).alias(f"r{r}") for r in replicas]
    wide = df.agg(*each)
    rows = [wide.select(F.lit(r).cast("smallint").alias("replica"), F.col(f"r{r}").alias("ts")) for r in replicas]
    return reduce(DataFrame.unionByName, rows)
