"""Causal delivery against a queue in plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from tidefold import catalogue
from tidefold.sources import eventlog
from tidefold.streaming import causal, streams

SCHEMA = "site string, replica short, ts long, clk map<short,long>, note string"


def let_through(ops):
    """Timestamps applied by (site, replica)."""
    queue, clock, moved = {(s, r, t): c or {} for s, r, t, c, _ in reversed(ops) if r is not None and t is not None}, {}, True
    while moved:
        moved = False
        for (s, r, t), deps in queue.items():
            if t == clock.get((s, r), 0) + 1 and all(clock.get((s, k), 0) >= v for k, v in deps.items() if k != r):
                clock[s, r], moved = t, True
    return clock, queue


def delivered(spark, tmp_path, batches):
    (tmp_path / "in").mkdir()
    stream = streams.source(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    for i, ops in enumerate(batches):
        spark.createDataFrame(ops, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        causal.deliver(stream, "site", "replica", "ts", "clk", ["site", "replica", "ts", "note"], str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
        got = causal.delivered(stream, str(tmp_path / "state")).orderBy("seq").collect()
        clock, queue = let_through([op for b in batches[: i + 1] for op in b])
        places, seen = {}, {}
        for row in got:
            s, r, t = row["site"], row["replica"], row["ts"]
            places.setdefault(s, []).append(row["seq"])
            assert t == seen.get((s, r), 0) + 1
            assert all(seen.get((s, k), 0) >= v for k, v in queue[s, r, t].items() if k != r)
            seen[s, r] = t
        assert seen == clock
        assert all(p == list(range(1, len(p) + 1)) for p in places.values())
    return got


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(causal, "BLOCK", 4)


def test_operation_that_comes_again_is_applied_once_and_blocks_nothing(spark, tmp_path, small_blocks):
    ops = [("a", 0, t, None, "") for t in (1, 2, 2, 3, 4, 5, 6)]
    got = delivered(spark, tmp_path, [ops, [("a", 0, 3, {}, ""), ("a", 0, 7, {0: 7}, ""), ("a", None, 1, {}, ""), ("a", 1, None, {}, "")]])
    assert [r["ts"] for r in got] == [1, 2, 3, 4, 5, 6, 7]


def test_lower_timestamps_with_gaps_in_batches(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    ops = [(s, r, t, {k: rng.randrange(max(1, t - 4), t) for k in range(3) if k != r and t > 2} | {r: t}, f"{r}.{t}") for s in ("a", None) for r in range(3) for t in range(1, 30)]
    rng.shuffle(ops)
    late = [op for op in ops if op[1:3] in ((1, 9), (2, 21))]
    rest = [op for op in ops if op not in late]
    delivered(spark, tmp_path, [rest[:100], rest[100:], late])


def test_clocks_of_any_timestamps(spark, tmp_path, small_blocks):
    """Replicas run at different rates, so clocks name higher timestamps; clocks don't cover what they stand on."""
    rng, ops, clock = random.Random(8), [], [0, 0, 0, 0]
    for _ in range(120):
        r = rng.choices(range(4), [1, 2, 9, 20])[0]
        clock[r] += 1
        k = rng.randrange(4)
        ops.append(("a", r, clock[r], {r: clock[r], k: clock[k]} if rng.random() < 0.6 else {r: clock[r]}, ""))
    rng.shuffle(ops)
    delivered(spark, tmp_path, [ops[:70], ops[70:118], ops[118:]])


def test_operations_that_wait_for_each_other_never_come(spark, tmp_path, small_blocks):
    ops = [("a", r, t, {}, "") for r in range(3) for t in range(1, 7)]
    ops[3], ops[8] = ("a", 0, 4, {1: 3}, ""), ("a", 1, 3, {0: 4}, "")
    ops[14] = ("a", 2, 3, {0: 5}, "")
    got = delivered(spark, tmp_path, [ops])
    assert len(got) == 3 + 2 + 2


def test_places_are_those_of_one_window(spark, small_blocks):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 50).alias("k"), "id")
    got = causal.places(df, ["g"], ["k", "id"], "place").collect()
    for g in (0, 1):
        rows = sorted((r["k"], r["id"], r["place"]) for r in got if r["g"] == g)
        assert [r[2] for r in rows] == list(range(1, 51))


def test_query_keeps_no_queue_in_python(spark, monkeypatch, tmp_path):
    """Its queue is in tables: the fold by site in Python held all of a site's operations."""

    def refuse(*_, **__):
        raise AssertionError("a site's queue in a Python worker")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", refuse)
    monkeypatch.setattr(causal, "BLOCK", 64)
    spark.range(1000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["causal_buffer"](spark, str(tmp_path))
    assert got.where("in_order").count() == got.count() == 1000 * len(eventlog.REPLICAS)
