"""Sharding by proportional stratified interleaving, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm import ranking


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def _row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of all of a row; maps, which have no hash, by their text."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(f.name))) if _holds_map(f.dataType) else F.col(f.name) for f in df.schema])


def sharded(df: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Adds `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard) to every row.

    The rows of each source are shuffled by a seeded hash of the id and the row and ranked; all rows are
    then ordered by fractional rank, (rank + 1/2) / rows of the source, and cut into equal
    runs. So shards differ by one row at most, and each holds every source in its share of
    the corpus, give or take a row or two. A source of any size is ranked in buckets of the
    hash, so none meets in one task.

    Null sources form one source; rows with null or repeated ids are told apart by the rest of the row; equal rows each get a slot, in an
    order that can't be settled (they can't be told apart). Long texts are only hashed. An empty table
    gives an empty table. Columns named `shard` or `slot` are replaced, others kept, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = df.drop("shard", "slot")
    n = df.count()
    bits = ranking.bucket_bits(n)
    spread = 1 << bits
    whole = _row_hash(df, seed + 1)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(source_col).alias("src"), F.xxhash64(F.lit(seed), F.col(id_col), whole).alias("h"), F.col(id_col).alias("id"), whole.alias("tie"))
    rows = rows.withColumn("b", ranking.top_bits(F.col("h"), bits))
    rows = ranking.ranked(rows, ["src"], "b", [F.col("h"), F.col("id"), F.col("tie")], "r", "of")
    rows = rows.withColumn("at", (2 * F.col("r") + 1) / (2 * F.col("of")))
    rows = rows.withColumn("f", F.least(F.floor(F.col("at") * spread), F.lit(spread - 1)).cast("int"))
    rows = ranking.ranked(rows, [], "f", [F.col("at"), F.xxhash64("src"), F.col("src"), F.col("r")], "p", "all")
    # In integers: the shard s begins at ceil(s * all / shards).
    shard = F.expr(f"(p * {shards}L) div all").cast("int")
    start = F.expr(f"(((p * {shards}L) div all) * all + {shards - 1}L) div {shards}L")
    return rows.select("row.*", shard.alias("shard"), (F.col("p") - start).cast("long").alias("slot"))
