"""Sets, maps, registers and flags: conflict resolution by tags, clocks or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import clocks
from tidefold.model import OBJECT


def unremoved(adds: DataFrame, removes: DataFrame, by: list[str], tag: str = "tag", observed: str = "observed") -> DataFrame:
    """The additions whose tag no remove has observed: an anti join of tags, no pairing of additions and removes."""
    seen = removes.select(*by, F.explode(observed).alias(tag)).distinct()
    on = by + [tag]
    other = seen.select(*[F.col(c).alias(f"__{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return adds.join(other, same, "left_anti")


def uncovered(adds: DataFrame, removes: DataFrame, by: list[str], replica: str = "replica", ts: str = "ts", clock: str = "clk") -> DataFrame:
    """The additions that no remove's clock covers; a group's removes count by their merged clock, one entry a replica."""
    seen = removes.select(*by, F.explode(clock).alias("__r", "__t")).groupBy(*by, "__r").agg(F.max("__t").alias("__t"))
    other = seen.select(*[F.col(c).alias(f"__{c}") for c in by], "__r", "__t")
    same = F.col(replica) == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return adds.join(other, same & (F.col(ts) <= F.col("__t")), "left_anti")


def _split(ops: DataFrame, add: str, rem: str) -> tuple[DataFrame, DataFrame]:
    return ops.where(F.col("op") == add), ops.where(F.col("op") == rem)


def add_wins_set(ops: DataFrame, by: list[str] = OBJECT, whole: bool = False) -> DataFrame:
    """by, elem: elements with an addition that no remove of the element observed (or, if `whole`, of the object).

    Removes carry the tags they observed; ones without tags carry a clock.
    """
    adds, rems = _split(ops, "add", "rem")
    of = by if whole else [*by, "elem"]
    left = unremoved(adds, rems.where("observed is not null"), of)
    return uncovered(left, rems.where("observed is null and clk is not null"), of).select(*by, "elem").distinct()


def lookup(elements: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """`wanted` (by, elem) with `present`."""
    return wanted.join(elements.select(*by, "elem").distinct().withColumn("__p", F.lit(True)), [*by, "elem"], "left").withColumn("present", F.coalesce("__p", F.lit(False))).drop("__p")


def cardinality(elements: DataFrame, by: list[str]) -> DataFrame:
    return elements.groupBy(*by).agg(F.countDistinct("elem").alias("n_elems"))


def with_pending(elements: DataFrame, pending: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """A set as its own transaction sees it: the last pending operation on each element decides, of equal ones an addition."""
    last = pending.groupBy(*by, "elem").agg(F.max_by("op", F.struct(F.col(order), F.col("op") == "add")).alias("__op"))
    kept = elements.select(*by, "elem").join(last, [*by, "elem"], "left_anti")
    return kept.unionByName(last.where(F.col("__op") == "add").select(*by, "elem"))


def observed_map(ops: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """by, map_key, value: additions overwrite the tags they observed; of values that are left, the smallest shows."""
    adds, _ = _split(ops, "add", "rem")
    gone = ops.where(F.col("op").isin("add", "rem") & F.col("observed").isNotNull())
    left = unremoved(adds, gone, [*by, "map_key"])
    return left.groupBy(*by, "map_key").agg(F.min("elem").alias("value"))


def grow_only_map(ops: DataFrame, by: list[str] = OBJECT, order: tuple[str, ...] = ("ts", "replica")) -> DataFrame:
    """by, map_key, value: the latest write of each entry; entries never go, whatever asks for it."""
    return last_writer(ops.where("op = 'add'"), [*by, "map_key"], "elem", order)


def as_maps(entries: DataFrame, by: list[str]) -> DataFrame:
    """by, entries: each object as one map."""
    return entries.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("map_key", "value")))).alias("entries"))


def remove_wins(ops: DataFrame, by: list[str] = OBJECT, clock: str = "clk") -> DataFrame:
    """The updates of a map's entries that know of every remove of their entry: ones concurrent with a remove lose."""
    upds, rems = _split(ops, "upd", "rem")
    of = [*by, "map_key"]
    known = clocks.merge_all(rems, of, clock, "__rem").select(*[F.col(c).alias(f"__{c}") for c in of], "__rem")
    same = F.lit(True)
    for c in of:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = upds.join(known, same, "left")
    return joined.where(F.col("__rem").isNull() | clocks.lower_or_equal(F.col("__rem"), F.col(clock))).drop("__rem", *[f"__{c}" for c in of])


def since_reset(ops: DataFrame, by: list[str] = OBJECT, order: str = "ts") -> DataFrame:
    """The operations after each object's last `reset`."""
    last = ops.where("op = 'reset'").groupBy(*by).agg(F.max(order).alias("__reset"))
    return ops.join(last, by, "left").where(F.col("__reset").isNull() | (F.col(order) > F.col("__reset"))).drop("__reset")


def last_writer(ops: DataFrame, by: list[str] = OBJECT, value: str = "elem", order: tuple[str, ...] = ("ts", "replica")) -> DataFrame:
    """by, value: of the latest write, ties by replica."""
    return ops.groupBy(*by).agg(F.max_by(F.col(value), F.struct(*order)).alias("value"))


def last_flag(ops: DataFrame, by: list[str] = OBJECT, order: tuple[str, ...] = ("ts", "replica")) -> DataFrame:
    return ops.groupBy(*by).agg(F.max_by(F.col("op") == "enable", F.struct(*order)).alias("value"))


def _flag(ops: DataFrame, by: list[str], add: str, rem: str, found: Column) -> DataFrame:
    adds, rems = _split(ops, add, rem)
    left = uncovered(unremoved(adds, rems.where("observed is not null"), by), rems.where("observed is null and clk is not null"), by)
    held = left.select(*by).distinct().withColumn("__held", F.lit(True))
    return ops.select(*by).distinct().join(held, by, "left").select(*by, found.alias("value"))


def enable_wins(ops: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """by, value: true if an enable is left that no disable observed."""
    return _flag(ops, by, "enable", "disable", F.col("__held").isNotNull())


def disable_wins(ops: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """by, value: true unless a disable is left that no enable observed; true at first."""
    return _flag(ops, by, "disable", "enable", F.col("__held").isNull())
