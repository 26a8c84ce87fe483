"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage of STAGES takes (spark, docs, sf_dir) and returns a DataFrame; `run` applies them to `documents`, each
stage's result written to the shared folder and read again as the next one's docs. All but the last return the
columns of documents; a stage that changes texts keeps `n_chars` true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import decontam, lines, packing, quality, simhash
from tidefold.llm.common import SPACE, table, where_late, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filtered(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; one that is left without words goes."""
    out = lines.deduplicated(docs)
    left = F.btrim("kept_text", F.lit(SPACE)) != ""
    return where_late(out, left | (F.col("n_removed") == 0)).select("doc_id", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds __key, which tells documents apart: the id, null ones last, and a hash of the text."""
    return docs.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")))


def having(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of keyed `docs` joined by `how`, left_semi or left_anti, with a written table of __key."""
    there = keys.select(F.col("__key.doc_id").alias("__id"), F.col("__key.th").alias("__th"))
    return docs.join(there, F.col("__key.doc_id").eqNullSafe(F.col("__id")) & (F.col("__key.th") == F.col("__th")), how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id, of equal ids by a hash of the text; rows equal in id and text are one."""
    docs = keyed(docs)
    found = written(simhash.near_copies(docs, id_col="__key"), "near")
    first = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    first = written(first, "first")
    kept = having(docs, first, "left_semi")
    if not first.where("__n > 1").isEmpty():
        kept = kept.dropDuplicates(["__key"])
    return kept.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    docs = keyed(docs)
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("doc_id").alias("__key")).distinct()
    return having(docs, written(found, "found"), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Token ids can't be made in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
