"""Folds on small logs with known results, and convergence whatever the order of delivery."""

import random

from pyspark.sql import functions as F

from tidefold.functions import clocks, values
from tidefold.model import OPS, shaped
from tidefold.operators import arrays, counters, ordered, sets, topk

KEY = ["key"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def board(spark, ops):
    return spark.createDataFrame([("b", *o, None) for o in ops], "key string, op string, id long, score long, replica short, ts long, clk map<short,long>, bin_val binary")


def test_remove_takes_only_what_it_has_seen(spark):
    ops = [("topk_add", 0, 100, 666, 1, None), ("topk_add", 0, 20, 666, 2, None), ("topk_add", 0, 50, 777, 1, None), ("topk_rem", 0, None, 777, 2, {666: 1, 777: 1})]
    assert rows(topk.topk_removable(board(spark, ops), KEY).select("id", "score")) == [(0, 20)]


def test_concurrent_addition_survives_in_any_order(spark):
    ops = [("topk_add", 0, 100, 666, 1, None), ("topk_add", 0, 110, 777, 1, None), ("topk_rem", 0, None, 777, 2, {777: 1})]
    for seed in range(3):
        random.Random(seed).shuffle(ops)
        assert rows(topk.topk_removable(board(spark, ops), KEY).select("id", "score")) == [(0, 100)]


def test_topk_keeps_ties_and_topsum_cuts_them(spark):
    ops = [("topk_add", i, s, 0, i, None) for i, s in [(1, 5), (2, 5), (3, 4), (4, 9)]]
    assert rows(topk.topk(board(spark, ops), KEY, 2).select("id", "score")) == [(1, 5), (2, 5), (4, 9)]
    sums = [("topsum_add", 1, 5, 0, 1, None), ("topsum_add", 2, 5, 0, 2, None), ("topsum_sub", 3, 4, 0, 3, None), ("topsum_add", 4, 9, 0, 4, None)]
    assert rows(topk.topsum(board(spark, sums), KEY, 2).select("id", "score")) == [(2, 5), (4, 9)]


def test_set_add_wins_and_map_remove_wins(spark):
    ops = spark.createDataFrame([("k", "add", "x", "t1", None), ("k", "rem", "x", None, ["t1"]), ("k", "add", "x", "t2", None), ("k", "add", "y", "t3", None), ("k", "rem", "y", None, ["t3"])], "key string, op string, elem string, tag string, observed array<string>")
    ops = ops.withColumns({"replica": F.lit(0).cast("short"), "ts": F.lit(1).cast("long"), "clk": F.lit(None).cast("map<short,long>")})
    assert rows(sets.add_wins_set(ops, KEY)) == [("k", "x")]
    log = spark.createDataFrame([("k", "upd", "e", {0: 1}), ("k", "rem", "e", {1: 1}), ("k", "upd", "e", {0: 2, 1: 1}), ("k", "upd", "f", {0: 3})], "key string, op string, map_key string, clk map<short,long>")
    left = sets.remove_wins(log, KEY)
    assert rows(left.groupBy("map_key").count()) == [("e", 1), ("f", 1)]


def test_null_keys_are_keys(spark):
    log = spark.createDataFrame([(None, "upd", "e", {0: 1}), (None, "rem", "e", {1: 1})], "key string, op string, map_key string, clk map<short,long>")
    assert sets.remove_wins(log, KEY).count() == 0


def test_flags(spark):
    ops = spark.createDataFrame([("a", "enable", "1", None), ("a", "disable", None, ["0"]), ("b", "enable", "2", None), ("b", "disable", "3", ["2"])], "key string, op string, tag string, observed array<string>")
    ops = ops.withColumns({"replica": F.lit(0).cast("short"), "ts": F.lit(1).cast("long"), "clk": F.lit(None).cast("map<short,long>")})
    assert rows(sets.enable_wins(ops, KEY)) == [("a", True), ("b", False)]
    assert rows(sets.disable_wins(ops, KEY)) == [("a", False), ("b", False)]


def test_register_ties_go_to_the_larger_replica(spark):
    ops = spark.createDataFrame([("k", "x", 5, 1), ("k", "y", 5, 2), ("k", "z", 4, 3)], "key string, elem string, ts long, replica int")
    assert rows(sets.last_writer(ops, KEY)) == [("k", "y")]


def test_mixed_extremes_follow_their_order(spark):
    rng, data = random.Random(5), []
    want = {}
    for k in range(8):
        state = None
        for ts in range(60):
            op, v = rng.choice(["max", "min"]), rng.randrange(-50, 50)
            data.append((k, op, v, ts))
            state = v if state is None else max(state, v) if op == "max" else min(state, v)
        want[k] = state
    rng.shuffle(data)
    ops = spark.createDataFrame(data, "key int, op string, long_val long, ts long")
    old, counters.CHUNK = counters.CHUNK, 7
    try:
        assert dict(rows(counters.max_min(ops, KEY, order=["ts"]))) == want
    finally:
        counters.CHUNK = old


def test_bounded_counter_refuses_beyond_rights(spark):
    data = [("k", "bound", 0, 10, None, 0, 1), ("k", "dec", 5, 0, None, 0, 2), ("k", "dec", 1, 0, None, 0, 3), ("k", "transfer", 2, 0, 0, 1, 4), ("k", "dec", 1, 0, None, 0, 5), ("k", "inc", 4, 0, None, 1, 6), ("k", "transfer", 5, 0, 0, 1, 7)]
    ops = spark.createDataFrame(data, "key string, op string, long_val long, n_adds long, id long, replica short, ts long")
    out = ordered.bounded_counter(ops, KEY, ["ts"], [0, 1]).collect()[0]
    assert (out["value"], out["bound"], out["refused"], out["rights"]) == (8, 0, 2, {0: 1, 1: 7})


def test_bounded_counter_is_exact_and_rebalances(spark):
    big = (1 << 53) + 1
    data = [("k", "bound_strict", 0, 11, None, 0, 1), ("k", "inc", big, 0, None, 1, 2), ("k", "inc", None, None, None, 1, 3), ("k", "rebalance", None, None, None, 0, 4), ("k", "rebalance", None, None, None, 1, 5)]
    ops = spark.createDataFrame(data, "key string, op string, long_val long, n_adds long, id long, replica short, ts long")
    out = ordered.bounded_counter(ops, KEY, ["ts"], [0, 1]).collect()[0]
    assert (out["value"], out["bound"], out["rights"]) == (big + 11, 1, {0: 5 + big // 2, 1: 5 + big - big // 2})


def test_array_totals_are_exact(spark):
    data = [("k", "inc", 0, (1 << 53) + 1, 1), ("k", "inc_all", None, 1, 2), ("k", "inc", 1, None, 3), ("n", "inc_all", None, 4, 1), (None, "inc", 1, 5, 1), (None, "dec_all", None, 2, 2)]
    got = {r["key"]: r["counts"] for r in ordered.counter_array(spark.createDataFrame(data, "key string, op string, pos int, long_val long, ts long"), KEY, ["ts"]).collect()}
    assert got == {"k": [(1 << 53) + 2, 0], "n": [], None: [-2, 3]}


def test_partitions_cover_their_range(spark):
    for n in (1, 3, 16):
        got = spark.range(5000).select(values.partition_of(n, F.col("id")).alias("p")).groupBy("p").count().collect()
        assert {r["p"] for r in got} == set(range(n)) and max(r["count"] for r in got) < 1.3 * 5000 / n


def test_map_that_only_grows(spark):
    ops = spark.createDataFrame([("k", "add", "e", "x", 1, 0), ("k", "add", "e", "y", 2, 0), ("k", "add", "e", "z", 2, 1), ("k", "rem", "e", None, 9, 0)], "key string, op string, map_key string, elem string, ts long, replica int")
    assert rows(sets.grow_only_map(ops, KEY)) == [("k", "e", "z")]


def test_pending_operations_of_equal_time(spark):
    held = spark.createDataFrame([("k", "x")], "key string, elem string")
    pending = spark.createDataFrame([("k", "y", "rem", 1), ("k", "y", "add", 1), ("k", "x", "rem", 1)], "key string, elem string, op string, ts long")
    assert rows(sets.with_pending(held, pending, KEY)) == [("k", "y")]


def test_array_operations_on_all_positions(spark):
    data = [("k", "inc", 2, 1, 1), ("k", "inc_all", None, 10, 2), ("k", "set_size", 5, None, 3), ("k", "dec_all", None, 1, 4)]
    ops = spark.createDataFrame(data, "key string, op string, pos int, long_val long, ts long")
    assert ordered.counter_array(ops, KEY, ["ts"]).collect()[0]["counts"] == [9, 9, 10, -1, -1]
    some = ops.where("op in ('inc', 'set_size')")
    assert arrays.counter_array(some, KEY).collect()[0]["counts"] == [0, 0, 1, 0, 0]


def test_averages_merge_and_empty_is_null(spark):
    ops = spark.createDataFrame([("a", "add_value", 3, None), ("a", "add_multiple", 9, 3), ("b", "add_multiple", 0, 0)], "key string, op string, long_val long, n_adds long")
    assert rows(counters.average(ops, KEY)) == [("a", 12, 4, 3.0), ("b", 0, 0, None)]


def test_clocks(spark):
    df = spark.createDataFrame([({0: 1, 1: 2}, {0: 1}), ({0: 1}, {0: 1, 1: 0}), ({0: 2}, {1: 1}), ({0: 1}, {0: 3})], "a map<short,long>, b map<short,long>")
    got = df.select(clocks.compare(F.col("a"), F.col("b")), clocks.total_order(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("higher", 1), ("equal", 0), ("concurrent", 1), ("lower", -1)]


def test_shape_numbers_and_patterns(spark):
    df = spark.createDataFrame([("k", "12"), ("k", "1.5"), ("k", "no")], "key string, v string")
    assert shaped(df).schema == OPS
    assert [r[0] for r in df.select(values.number(F.col("v"))).collect()] == [12.0, 1.5, None]
    assert values.literal_op("COUNTER", "4") == ("inc", 4) and values.literal_op("BOOLEAN", "true")[0] == "enable"
