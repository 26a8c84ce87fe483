"""Base tables, regional loads, snapshots and logs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.model import OPS, row_key, shaped
from tidefold.sources.scratch import delete

#: The column names and types of the standard `.tbl` files, in their order; `#` marks the primary key.
TBL = {
    "region": "r_regionkey# int, r_name string, r_comment string",
    "nation": "n_nationkey# int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey# bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "customer": "c_custkey# bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey# bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "partsupp": "ps_partkey# bigint, ps_suppkey# bigint, ps_availqty int, ps_supplycost double, ps_comment string",
    "orders": "o_orderkey# bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey# bigint, l_partkey# bigint, l_suppkey# bigint, l_linenumber# int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_commitdate timestamp_ntz, l_receiptdate timestamp_ntz, l_shipinstruct string, l_shipmode string, l_comment string",
}


def primary_key(name: str) -> list[str]:
    return [c.split("#")[0].strip() for c in TBL[name].split(",") if "#" in c]


def load(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, form: str = "parquet") -> DataFrame:
    """A base table from parquet, or from a `|`-separated `.tbl` file; only the columns asked for are read."""
    if form == "parquet":
        df = spark.read.parquet(f"{path}/{name}.parquet")
    elif form == "tbl":
        df = spark.read.schema(TBL[name].replace("#", "")).option("sep", "|").csv(f"{path}/{name}.tbl")
    else:
        raise ValueError(f"unknown form {form}")
    return df.select(*columns) if columns else df


def keyed(df: DataFrame, key: list[str], columns: list[str], nested: bool = False) -> DataFrame:
    """(key, row): rows under their joined key, each a struct, or with `nested` a map from column to its text."""
    if nested:
        row = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    else:
        row = F.struct(*columns)
    return df.select(row_key(*key).alias("key"), row.alias("row"))


def nations(spark: SparkSession, path: str) -> DataFrame:
    """n_nationkey, region: 25 rows."""
    return load(spark, path, "nation").join(load(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))


def with_region(spark: SparkSession, path: str, name: str) -> DataFrame:
    """customer, supplier or orders with the `region` whose server holds the row."""
    n = F.broadcast(nations(spark, path))  # a nation a row, fixed
    if name == "orders":
        cust = with_region(spark, path, "customer").select("c_custkey", "region")
        return load(spark, path, name).join(cust, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    of = {"customer": "c_nationkey", "supplier": "s_nationkey"}[name]
    return load(spark, path, name).join(n, F.col(of) == F.col("n_nationkey")).drop("n_nationkey")


def everywhere(spark: SparkSession, path: str, name: str = "part") -> DataFrame:
    """A table that every region's server holds: a row for each region, with `loader`, the region whose server loads its slice for all."""
    regions = load(spark, path, "region", ["r_name"]).orderBy("r_name").collect()  # a region a row, fixed
    names = F.array(*[F.lit(r["r_name"]) for r in regions])
    key = F.col(primary_key(name)[0])
    return load(spark, path, name).withColumn("loader", F.get(names, F.pmod(key, F.lit(len(regions))).cast("int"))).withColumn("region", F.explode(names))


def lines_by_region(spark: SparkSession, path: str) -> DataFrame:
    """lineitem with `region`, once for the order's region and once more for the supplier's if that is another."""
    orders = with_region(spark, path, "orders").select("o_orderkey", F.col("region").alias("__o"))
    supp = with_region(spark, path, "supplier").select("s_suppkey", F.col("region").alias("__s"))
    rows = load(spark, path, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.withColumn("region", F.explode(F.array_distinct(F.array("__o", "__s")))).drop("o_orderkey", "s_suppkey", "__o", "__s")


def save_regional(df: DataFrame, path: str) -> None:
    """A folder for each region; a read of one region opens that folder only."""
    df.write.mode("overwrite").partitionBy("region").parquet(path)


def save_view(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """A built view as a table, local ones by their partition columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_ops(ops: DataFrame, path: str) -> None:
    """Operations onto the log, foldered by bucket."""
    shaped(ops).write.mode("append").partitionBy("bucket").parquet(path)


def read_ops(spark: SparkSession, path: str, buckets: list[str] | None = None) -> DataFrame:
    """The log, of some buckets if named: the others' folders aren't opened."""
    df = spark.read.schema(OPS).parquet(path)
    return df if buckets is None else df.where(F.col("bucket").isin(buckets))


def export_state(state: DataFrame, path: str, buckets: list[str] | None = None) -> None:
    """A snapshot of objects' states for a joining server."""
    df = state if buckets is None else state.where(F.col("bucket").isin(buckets))
    df.write.mode("overwrite").partitionBy("bucket").parquet(path)


def import_state(spark: SparkSession, path: str, buckets: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df if buckets is None else df.where(F.col("bucket").isin(buckets))


def reset(spark: SparkSession, path: str, views: list[str] = ()) -> None:
    """Drops views and empties a log's folder."""
    for v in views:
        spark.catalog.dropTempView(v)
    delete(spark, path)


@dataclass
class Settings:
    """What a deployment sets; keyword arguments override a file's `key = value` lines."""

    data: str = ""
    queries: list[str] = field(default_factory=list)
    buckets: list[str] = field(default_factory=lambda: ["*"])
    top_k: int = 100
    use_top_sum: bool = False
    is_global: bool = True

    @classmethod
    def load(cls, text: str = "", **over) -> Settings:
        read = dict(x.split("=", 1) for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#"))
        values = {}
        for f in fields(cls):
            raw = {k.strip(): v.strip() for k, v in read.items()}.get(f.name)
            if raw is not None:
                kind = type(getattr(cls(), f.name))
                values[f.name] = raw.split() if kind is list else raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**values | over)
