"""The pipeline's stages on small and odd documents, and its queries' SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidefold.llm import queries

PATH = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def good(spark, d):
    return [tuple(r) for r in spark.read.parquet(f"{PATH}/documents.parquet").where(f"doc_id = {d}").collect()]


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no tables here")
def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, PATH)
        assert out.dtypes == docs.dtypes, name
        ids = [r["doc_id"] for r in out.collect()]
        assert len(ids) == len(set(ids)) > 0.5 * docs.count()
        docs = corpus_pipeline.written(out, "t")
    assert corpus_pipeline.run(spark, PATH).select("doc_id").distinct().count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no tables here")
def test_decisions_take_effect(spark):
    base = " ".join(f"word{k}" for k in range(80))
    near = base.replace("word79", "other")
    item = spark.read.parquet(f"{PATH}/benchmark.parquet").orderBy("item_id").first()["text"]
    leak = " ".join(f"x{k}" for k in range(60)) + " " + item
    rows = [(1, base, "en", "s", len(base)), (2, f"{base}\n{base} more", "en", "s", 9), (3, None, None, None, None), (4, "### $$$ " * 60, "en", "s", 1), (5, leak, "en", "s", len(leak)), (6, near, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = lambda f, d: sorted(r["doc_id"] for r in f(spark, d, PATH).collect())
    assert kept(corpus_pipeline.quality_rules, docs) == [1, 5, 6]  # 2 says everything twice
    clean = docs.where("doc_id in (1, 2, 5, 6)")
    assert kept(corpus_pipeline.line_dedup, clean) == [1, 5]
    assert kept(corpus_pipeline.decontamination, clean) == [1, 2, 6]
    twice = docs.where("doc_id = 1").unionAll(docs.where("doc_id = 1"))
    copies = twice.unionAll(spark.createDataFrame([(9, base, "en", "s", 1)], SCHEMA))
    assert kept(corpus_pipeline.near_dedup, copies) == [1]


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no tables here")
def test_documents_are_told_apart_by_id_and_text(spark):
    text = lambda p: " ".join(f"{p}{k}" for k in range(80))
    item = spark.read.parquet(f"{PATH}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (7, text("c").upper()), (8, text("a").upper()), (9, text("e"))]
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    got = lambda f, rows: [(r["doc_id"], r["text"].lower()) for r in f(spark, frame(rows), PATH).collect()]
    by = lambda x: str(x)
    assert sorted(got(corpus_pipeline.near_dedup, rows), key=by) == sorted([(None, text("b")), (7, text("c")), (7, text("d")), (8, text("a")), (9, text("e"))], key=by)
    leak = [(None, f"{text('f')} {item}"), (None, text("b")), (7, f"{text('g')} {item}"), (7, text("d"))]
    assert sorted(got(corpus_pipeline.decontamination, leak), key=by) == sorted([(None, text("b")), (7, text("d"))], key=by)


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no tables here")
def test_stages_on_empty_and_null_rows(spark):
    text = " ".join(f"word{k}" for k in range(80))
    none, nulls = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, text, None, None, None), (None, text, None, None, None), (2, "", "en", "s", 0)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, PATH).count() == 0, name
        out = stage(spark, nulls, PATH)
        rows = out.collect()
        if name == "packing":
            assert len(rows) == 5 and sum(r["length"] for r in rows if r["doc_tokens"] > 1) == 2 * max(r["doc_tokens"] for r in rows)
        else:
            assert out.dtypes == none.dtypes and [r["text"] for r in rows].count(text) == (1 if name == "near_dedup" else 2), name


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(PATH):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    rows = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, PATH).select(*names).collect()) == rows
