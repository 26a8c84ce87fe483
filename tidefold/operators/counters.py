"""Folds whose operations commute: counters, averages, extremes. Each is one partial and one final aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.model import OBJECT

#: Operations that one step of an ordered fold takes together.
CHUNK = 4096


def _signed(inc: str, dec: str, amount: str):
    return F.when(F.col("op") == inc, F.col(amount)).when(F.col("op") == dec, -F.col(amount))


def counter(ops: DataFrame, by: list[str] = OBJECT, amount: str = "long_val") -> DataFrame:
    """by, value: increments less decrements, in 64 bits."""
    return ops.groupBy(*by).agg(F.coalesce(F.sum(_signed("inc", "dec", amount)), F.lit(0)).cast("bigint").alias("value"))


def counter_float(ops: DataFrame, by: list[str] = OBJECT, amount: str = "dbl_val") -> DataFrame:
    return ops.groupBy(*by).agg(F.coalesce(F.sum(_signed("inc", "dec", amount)), F.lit(0.0)).alias("value"))


def pair_counter(ops: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """by, first, second: an integer and a float, moved together or alone (a null payload leaves its part)."""
    return ops.groupBy(*by).agg(
        F.coalesce(F.sum(_signed("inc", "dec", "long_val")), F.lit(0)).cast("bigint").alias("first"),
        F.coalesce(F.sum(_signed("inc", "dec", "dbl_val")), F.lit(0.0)).alias("second"),
    )


def average(ops: DataFrame, by: list[str] = OBJECT, amount: str = "long_val") -> DataFrame:
    """by, sum, n_adds, value: null if nothing was added. `add_value` counts once, `add_multiple` brings its count."""
    n = F.when(F.col("op") == "add_multiple", F.col("n_adds")).otherwise(F.lit(1))
    total = ops.where(F.col("op").isin("add_value", "add_multiple")).groupBy(*by).agg(F.sum(amount).alias("sum"), F.sum(n).alias("n_adds"))
    return total.withColumn("value", F.try_divide(F.col("sum").cast("double"), F.col("n_adds")))


def merge_averages(parts: DataFrame, by: list[str]) -> DataFrame:
    """The average of averages' states."""
    total = parts.groupBy(*by).agg(F.sum("sum").alias("sum"), F.sum("n_adds").alias("n_adds"))
    return total.withColumn("value", F.try_divide(F.col("sum").cast("double"), F.col("n_adds")))


def extreme(ops: DataFrame, kind: str, by: list[str] = OBJECT, amount: str = "long_val") -> DataFrame:
    """by, value: the largest (`max`) or smallest (`min`) value added, null if none."""
    of = F.when(F.col("op") == kind, F.col(amount))
    return ops.groupBy(*by).agg((F.max(of) if kind == "max" else F.min(of)).alias("value"))


def max_min(ops: DataFrame, by: list[str] = OBJECT, amount: str = "long_val", order: list[str] | None = None) -> DataFrame:
    """by, value of objects that take both `max` and `min` operations, applied in order.

    Each operation clamps the value from below or above, and a run of clamps is one clamp, so runs of CHUNK
    operations are folded first and then the few that are left: no array grows with the object's log.
    """
    order = order or ["ts", "replica"]
    rows = ops.where(F.col("op").isin("max", "min") & F.col(amount).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    step = F.struct(F.col("__n").alias("n"), F.when(F.col("op") == "max", F.col(amount)).alias("lo"), F.when(F.col("op") == "min", F.col(amount)).alias("hi"), F.col(amount).alias("first"))
    chunks = rows.groupBy(*by, F.floor(F.col("__n") / CHUNK).alias("__c")).agg(F.sort_array(F.collect_list(step)).alias("s"))
    kind = dict(ops.dtypes)[amount]

    def clamp(acc, x):
        lo = F.when(x["hi"].isNull(), F.greatest(acc["lo"], x["lo"])).otherwise(F.least(F.greatest(acc["lo"], x["lo"]), x["hi"]))
        hi = F.when(x["lo"].isNull(), F.least(acc["hi"], x["hi"])).otherwise(F.greatest(F.least(acc["hi"], x["hi"]), x["lo"]))
        lo = F.when(acc["lo"].isNull() & x["lo"].isNull(), F.lit(None)).otherwise(lo)
        hi = F.when(acc["hi"].isNull() & x["hi"].isNull(), F.lit(None)).otherwise(hi)
        return F.struct(lo.cast(kind).alias("lo"), hi.cast(kind).alias("hi"), F.coalesce(acc["first"], x["first"]).cast(kind).alias("first"))

    none = F.struct(*[F.lit(None).cast(kind).alias(c) for c in ("lo", "hi", "first")])
    parts = chunks.select(*by, F.col("__c").alias("n"), F.aggregate("s", none, clamp).alias("r"))
    whole = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "r.lo", "r.hi", "r.first"))).alias("s"))
    done = whole.select(*by, F.aggregate("s", none, clamp).alias("r"))
    # The first operation sets an unset value, whatever it is.
    value = F.least(F.greatest(F.col("r.first"), F.coalesce("r.lo", "r.first")), F.coalesce("r.hi", F.greatest("r.first", F.coalesce("r.lo", "r.first"))))
    return done.select(*by, value.alias("value"))
