"""Views, streams and event-time windows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidefold.operators import counters
from tidefold.plans.views import VIEWS, q5_merged, q5_shown, q5_state, reader
from tidefold.queries.base import ORACLE, QUERIES, query
from tidefold.queries.folds import SIGN
from tidefold.sources import eventlog as log
from tidefold.sources.scratch import scratch
from tidefold.streaming import causal, streams

REV = "l_extendedprice * (1 - l_discount)"
MONEY = f"sum(round({REV}, 4)::DECIMAL(18, 4))::DOUBLE"

VIEW_SQL = {
    "q1": f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(round(l_extendedprice, 4)::DECIMAL(18, 4))::DOUBLE AS sum_base_price, {MONEY} AS sum_disc_price, sum(round({REV} * (1 + l_tax), 6)::DECIMAL(18, 6))::DOUBLE AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL",
    "q3": f"SELECT l_orderkey, o_orderdate, {MONEY} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10",
    "q5": f"SELECT r_name, n_name, year(o_orderdate)::INT AS o_year, {MONEY} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.06::DOUBLE - 0.011::DOUBLE AND 0.06::DOUBLE + 0.011::DOUBLE AND l_quantity < 24",
    "q7": f"SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate)::INT AS l_year, {MONEY} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name GROUP BY ALL",
    "q8": f"SELECT year(o_orderdate)::INT AS o_year, round(sum(CASE WHEN s.n_name = 'NATION_3' THEN {REV} ELSE 0 END) / sum({REV}), 6) AS mkt_share FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE p_type = 'ECONOMY' AND c.n_regionkey = (SELECT n_regionkey FROM nation WHERE n_name = 'NATION_3') GROUP BY ALL",
    "q10": f"SELECT c_custkey, c_name, {MONEY} AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20",
    "q14": f"SELECT strftime(l_shipdate, '%Y-%m') AS month, round(100.0::DOUBLE * sum(CASE WHEN p_type = 'PROMO' THEN {REV} ELSE 0 END) / sum({REV}), 4) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "q15": f"WITH s AS (SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, l_suppkey, {MONEY} AS total_revenue FROM lineitem GROUP BY ALL) SELECT quarter, s_suppkey, s_name, total_revenue FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY total_revenue DESC, l_suppkey) AS p FROM s) JOIN supplier ON l_suppkey = s_suppkey WHERE p = 1",
    "q18": "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum_qty FROM (SELECT l_orderkey, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 300) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100",
    "q13v": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1",
    "q17v": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)",
    "q19v": f"SELECT p_brand, {MONEY} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 15 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 16 AND 50 AND l_quantity BETWEEN 20 AND 30) GROUP BY 1",
    "q22v": "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') GROUP BY 1",
    "local_to_global": "SELECT l_returnflag, sum(l_quantity) AS sum_qty, count(*) AS n, max(l_quantity) AS max_qty, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY 1",
}

for _name, _view in VIEWS.items():
    query(VIEW_SQL[_name], _name)(_view)

COUNT_SQL = f"SELECT user_id AS key, sum({SIGN})::BIGINT AS value FROM events GROUP BY user_id"


def _registered(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _events(spark: SparkSession, path: str):
    """The events as a stream; a pattern, for the table may be one file, which no stream reads by name."""
    return streams.source(spark, f"{path}/events.parque[t]", spark.read.parquet(f"{path}/events.parquet").schema)


@_registered("stream_equals_batch", COUNT_SQL)
def stream_equals_batch(spark: SparkSession, path: str):
    """The counter fold, maintained by a stream."""
    at = scratch(spark, "stream")
    partial = lambda b: counters.counter(log.counters(b), ["key"])
    merge = lambda b: b.groupBy("key").agg(F.sum("value").cast("bigint").alias("value"))
    streams.maintain(_events(spark, path), partial, merge, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return streams.latest(spark, f"{at}/state")


@_registered("trigger_fire", "SELECT 'errors' AS key, count(*) AS value FROM events WHERE event_type = 'error' UNION ALL SELECT 'u' || user_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT FROM events GROUP BY user_id")
def trigger_fire(spark: SparkSession, path: str):
    """Each decrement of a user's counter increments the counter of errors."""
    at = scratch(spark, "trigger")
    ops = lambda b: log.counters(b).select(F.concat(F.lit("u"), F.col("key")).alias("key"), "op", "long_val", F.lit("b").alias("bucket"))
    rules = [streams.Trigger("u[0-9]+", "dec", "errors", "inc")]
    fold = streams.with_triggers(lambda b: counters.counter(b, ["key"]), rules)
    merge = lambda b: b.groupBy("key").agg(F.sum("value").cast("bigint").alias("value"))
    streams.maintain(_events(spark, path), lambda b: fold(ops(b)), merge, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return streams.latest(spark, f"{at}/state")


@_registered("q5_stream", VIEW_SQL["q5"])
def q5_stream(spark: SparkSession, path: str):
    """The revenue view, maintained by a stream of lines over the tables they refer to."""
    at, tables = scratch(spark, "q5"), reader(spark, path)
    lines = streams.source(spark, f"{path}/lineitem.parque[t]", tables("lineitem").schema)
    partial = lambda batch: q5_state(lambda name: batch if name == "lineitem" else tables(name))
    streams.maintain(lines, partial, q5_merged, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return q5_shown(streams.latest(spark, f"{at}/state"))


@_registered("causal_buffer", "SELECT site, event_id, replica, event_id // 3 + 1 AS op_ts, true AS in_order, event_id // 3 + 1 > 2 AS waits FROM (SELECT event_id, (event_id % 3)::SMALLINT AS replica FROM events), (SELECT unnest([0, 1, 2])::SMALLINT AS site)")
def causal_buffer(spark: SparkSession, path: str):
    """Operations of a stream, delivered at each replica's site in an order that respects their clocks.

    `in_order`: all of the own replica's earlier operations, and the one of the next replica that the clock names (`waits`), came before.
    """
    at = scratch(spark, "causal")
    sites = F.explode(F.array(*[F.lit(r).cast("smallint") for r in log.REPLICAS]))
    ops = log.operations(_events(spark, path)).select(sites.alias("site"), "event_id", "replica", "op_ts", "clk")
    causal.deliver(ops, "site", "replica", "op_ts", "clk", ["site", "event_id", "replica", "op_ts"], f"{at}/state", f"{at}/checkpoint").awaitTermination()
    rows = causal.places(causal.delivered(ops, f"{at}/state"), ["site", "replica"], ["seq"], "before").withColumn("own", F.col("before") == F.col("op_ts"))
    seen = rows.select("site", F.col("replica").alias("__r"), F.col("op_ts").alias("__t"), F.col("seq").alias("__s"))
    rows = rows.withColumns({"__r": ((F.col("replica") + 1) % 3).cast("smallint"), "__t": F.when(F.col("op_ts") > 2, F.col("op_ts") - 2)}).join(seen, ["site", "__r", "__t"], "left")
    return rows.select("site", "event_id", "replica", "op_ts", (F.col("own") & (F.col("__t").isNull() | (F.col("__s") < F.col("seq")))).alias("in_order"), F.col("__t").isNotNull().alias("waits"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS begins, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def window_tumbling(t):
    out = streams.tumbling(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select("event_type", F.unix_micros("window.start").alias("begins"), "n", "total")


@query("SELECT epoch_us(b - to_minutes(30 * k)) AS begins, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, unnest([0, 1]) AS k FROM events) GROUP BY ALL")
def window_sliding(t):
    out = streams.sliding(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "30 minutes", [], F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_micros("window.start").alias("begins"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS begins, count(*) AS n FROM s GROUP BY user_id, k"""
)
def window_session(t):
    out = streams.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "10 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("begins"), "n")
