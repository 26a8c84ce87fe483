"""Ranks over groups of any size, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one (group, bucket) holds on average, and the bounds on the number of buckets.
BUCKET_ROWS, MAX_BITS = 256, 17


def bucket_bits(rows: int) -> int:
    """How many bits of a hash split `rows` rows into buckets of about BUCKET_ROWS."""
    return min(MAX_BITS, max(1, (max(rows, 1) // BUCKET_ROWS).bit_length()))


def top_bits(hashed: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash, as a number in the order of the unsigned hash."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def ranked(df: DataFrame, groups: list[str], bucket: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """Adds the row's 0-based `rank` in its group by (bucket, order) and the group's `total`.

    Rows meet only within a (group, bucket); counts of the buckets, which are few, give
    the rank of each bucket's first row. Null groups count as a group.
    """
    keys = [*groups, bucket]
    over = Window.partitionBy(*groups) if groups else Window.partitionBy()
    count = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = count.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys],
        F.coalesce(before, F.lit(0)).alias("__start"),
        F.sum("__n").over(over).alias("__total"),
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.join(starts, same)
        .withColumn(rank, F.col("__start") + inside - 1)
        .withColumn(total, F.col("__total"))
        .drop("__start", "__total", *[f"__s_{k}" for k in keys])
    )
