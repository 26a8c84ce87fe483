"""The thin queries of the operators over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import chat, decontam, licenses, lines, packing, quality, sharding, simhash, substrings, tokenfiles
from tidefold.llm import oracles
from tidefold.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id long, turn long, role string, text string"
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    talks = table(spark, sf_dir, "conversations").selectExpr(*[f"cast({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", ")])
    return chat.read_back(written(chat.formatted(chat.as_replies(talks.unionByName(extra))), "chat"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("n_passages")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return sharding.sharded(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clustered(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(words))) AS i, words FROM w WHERE len(words) > 0),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM p WHERE i + 2 <= len(words)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM rep) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_uniq,
         coalesce(cov.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       (n_lines - n_uniq)::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR n_words < 50 OR n_symbols * 10 > n_words * 2 OR capitals * 100 > letters * 40
            OR letters * 100 < word_chars * 50 OR word_chars < n_words * 2 OR word_chars > n_words * 25
            OR (n_lines - n_uniq) * 100 > n_lines * 60) AS kept
FROM f
"""

QUERIES: dict[str, Query] = {
    "op1_chat": op1_chat,
    "op2_licenses": op2_licenses,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_token_files": op6_token_files,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
}

ORACLE: dict[str, str] = {
    "op1_chat": oracles.OP1,
    "op2_licenses": oracles.OP2,
    "op3_line_dedup": oracles.OP3,
    "op4_decontamination": oracles.OP4,
    "op7_substring_dedup": oracles.OP7,
    "op8_quality_rules": OP8_SQL,
}
