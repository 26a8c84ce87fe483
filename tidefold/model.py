"""The data model: objects, operations, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An object's identity. The same key with another type or bucket is another object.
OBJECT = ["key", "crdt_type", "bucket"]

#: Vector clock: the last timestamp seen of each replica.
CLOCK = T.MapType(T.ShortType(), T.LongType())

#: One operation of an object's log.
OPS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("crdt_type", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("map_key", T.StringType()),
        T.StructField("elem", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("score", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("long_val", T.LongType()),
        T.StructField("dbl_val", T.DoubleType()),
        T.StructField("n_adds", T.LongType()),
        T.StructField("bin_val", T.BinaryType()),
        T.StructField("replica", T.ShortType()),
        T.StructField("ts", T.LongType()),
        T.StructField("clk", CLOCK),
        T.StructField("tag", T.StringType()),
        T.StructField("observed", T.ArrayType(T.StringType())),
        T.StructField("txn_id", T.StringType()),
    ]
)


def shaped(df: DataFrame, schema: T.StructType = OPS) -> DataFrame:
    """`df` with all columns of `schema`, in its order and types; absent ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def row_key(*columns: str) -> Column:
    """The key of a table's row: its primary key's values joined by `_`."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])
