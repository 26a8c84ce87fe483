"""Tables, transactions, the catalog, storage and streams."""

import pytest
from pyspark.sql import functions as F

from tidefold.functions import values
from tidefold.operators import counters
from tidefold.plans import views
from tidefold.plans.catalog import Catalog, Declared
from tidefold.plans.tables import All, Compare, Table
from tidefold.plans.transactions import Transaction, read_objects
from tidefold.sources import tables as src
from tidefold.streaming import streams

PATH = "/root/testdata/sf0.001"

LOG = "key string, crdt_type string, bucket string, op string, long_val long"


def counts(df):
    return {r["key"]: r["value"] for r in df.collect()}


def fold(ops):
    return counters.counter(ops, ["key"])


def test_key_lists_and_nulls(spark):
    t = Table(spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, v string"), ("k",))
    assert {r["k"] for r in t.except_keys([1]).collect()} == {2, None}
    assert t.get_many([]).count() == 0 and t.except_key(2).count() == 2
    assert t.where(Compare("v", "eq", "a")).count() == 1
    assert t.where(All((Compare("v", "gt", 1),))).count() == 0
    with pytest.raises(ValueError):
        t.where(Compare("v", "like", "a"))


def test_transaction_reads_its_own_writes_and_aborts(spark, tmp_path):
    log = spark.createDataFrame([("a", "COUNTER", "b1", "inc", 1)], LOG)
    more = spark.createDataFrame([("a", "COUNTER", "b1", "inc", 5)], LOG)
    txn = Transaction(log)
    txn.update(more)
    assert counts(txn.read(fold)) == {"a": 6} and counts(fold(log)) == {"a": 1}
    path = str(tmp_path / "log")
    assert counts(fold(txn.commit(path))) == {"a": 6}
    assert counts(fold(src.read_ops(spark, path, ["b1"]))) == {"a": 5}
    with pytest.raises(RuntimeError):
        txn.update(more)
    other = Transaction(log)
    other.update(more)
    assert counts(fold(other.abort())) == {"a": 1}
    assert counts(read_objects(log, [("a", "COUNTER", "b1"), ("a", "AVG", "b1")], fold)) == {"a": 1}


def test_snapshots_and_reset(spark, tmp_path):
    state = spark.createDataFrame([("a", "b1", 1), ("b", "b2", 2)], "key string, bucket string, value long")
    path = str(tmp_path / "state")
    src.export_state(state, path)
    assert counts(src.import_state(spark, path, ["b2"])) == {"b": 2}
    src.reset(spark, path)
    assert not (tmp_path / "state").exists()


def test_catalog_defaults_and_invariants(spark):
    cat = Catalog(spark)
    cat.create_table("acc", [Declared("id", "INTEGER"), Declared("n", "COUNTER", 3, "n >= 0")], ["id"])
    cat.insert("acc", spark.createDataFrame([(1,)], "id long"))
    assert [tuple(r) for r in cat.select("acc").collect()] == [(1, 3)]
    with pytest.raises(Exception, match="n >= 0"):
        cat.insert("acc", spark.createDataFrame([(2, -1)], "id long, n long")).collect()
    with pytest.raises(Exception, match="n >= 0"):
        cat.update("acc", {"n": "-9"})
    assert [tuple(r) for r in cat.select("acc").collect()] == [(1, 3)]
    cat.insert("acc", spark.createDataFrame([(k, 100 - k) for k in range(2, 60)], "id long, n long"))
    cat.update("acc", {"n": "n + 1"}, "id = 1")
    cat.delete("acc", "id = 59")
    assert cat.select("acc").count() == 58 and cat.select("acc", ["n"], "id = 1").collect()[0][0] == 4
    index = cat.create_index("acc_by_n", "acc", ["n"])
    assert [r["n"] for r in index.collect()] == sorted(r["n"] for r in cat.select("acc").collect())
    assert "Exchange" not in index.where("n < 50")._jdf.queryExecution().executedPlan().toString()
    cat.create_view("rich", "SELECT id FROM acc WHERE n > 90")
    assert spark.table("rich").count() == cat.select("acc", where="n > 90").count() > 0
    with pytest.raises(ValueError):
        cat.select("acc", ["nope"])
    cat.drop("acc")


def test_upserts_of_equal_time_go_to_the_larger_replica(spark):
    t = Table(spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), ("k",))
    ops = spark.createDataFrame([(1, "a", "upd", 5, 1, {1: 5}), (1, "b", "upd", 5, 2, {2: 5}), (1, "c", "upd", 5, 0, {0: 5})], "k int, v string, op string, ts long, replica short, clk map<short,long>")
    for n in (1, 3):
        assert {tuple(r) for r in t.applied(ops.repartition(n), ["v"]).collect()} == {(1, "b"), (2, "old")}


def test_settings_and_tbl(spark, tmp_path):
    s = src.Settings.load("top_k = 5\nbuckets = R1 R2\n# x = 1\nuse_top_sum = true", data="d")
    assert (s.top_k, s.buckets, s.use_top_sum, s.data) == (5, ["R1", "R2"], True, "d")
    (tmp_path / "region.tbl").write_text("0|AFRICA|none|\n1|ASIA|none|\n")
    assert src.load(spark, str(tmp_path), "region", ["r_name"], "tbl").count() == 2
    assert src.primary_key("lineitem") == ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def test_stream_counts_each_file_once(spark, tmp_path):
    data = spark.createDataFrame([("a", "inc", 1), ("a", "dec", 3), ("b", "inc", 2)], "key string, op string, long_val long")
    for _ in range(3):
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), data.schema, 1)
    merge = lambda b: b.groupBy("key").agg(F.sum("value").alias("value"))
    run = lambda: streams.maintain(stream, fold, merge, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    run()
    run()
    assert counts(streams.latest(spark, str(tmp_path / "state"))) == {"a": -6, "b": 6}
    assert sorted(x.name for x in (tmp_path / "state").iterdir()) == ["v1", "v2"]  # older versions are gone


def test_view_kept_by_a_stream_of_files_equals_the_batch_one(spark, tmp_path):
    tables = views.reader(spark, PATH)
    lines = tables("lineitem")
    for part in lines.randomSplit([1.0, 1.0, 1.0, 1.0], seed=3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), lines.schema, 1)
    partial = lambda batch: views.q5_state(lambda name: batch if name == "lineitem" else tables(name))
    streams.maintain(stream, partial, views.q5_merged, str(tmp_path / "state"), str(tmp_path / "check"), keep=3).awaitTermination()
    got = views.q5_shown(streams.latest(spark, str(tmp_path / "state")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in views.q5(tables).collect()} and len(list((tmp_path / "state").iterdir())) == 3


def test_triggers_fire_by_pattern(spark):
    ops = spark.createDataFrame([("u1", "b", "inc"), ("v1", "b", "inc"), ("u2", "b", "dec")], "key string, bucket string, op string")
    got = streams.fired(ops, [streams.Trigger("u[0-9]+", "inc", "total", "dec")])
    assert [tuple(r) for r in got.collect()] == [("total", "b", "dec")]
    assert ops.where(values.matches(F.col("key"), "u1")).count() == 1
