"""Object folds over op-logs derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.functions import clocks, tags, values
from tidefold.operators import arrays, counters, ordered, sets, topk
from tidefold.plans.transactions import Transaction, as_of, read_objects
from tidefold.queries.base import query
from tidefold.sources import eventlog as log
from tidefold.sources import tables as store
from tidefold.sources.scratch import scratch

OPS = """ops AS (SELECT *, event_id % 3 AS replica, event_id // 3 + 1 AS op_ts, (event_id + 1) % 3 AS other FROM events),
cl AS (SELECT *, CASE WHEN replica = 0 THEN op_ts WHEN other = 0 AND op_ts > 2 THEN op_ts - 2 ELSE 0 END AS c0,
  CASE WHEN replica = 1 THEN op_ts WHEN other = 1 AND op_ts > 2 THEN op_ts - 2 ELSE 0 END AS c1,
  CASE WHEN replica = 2 THEN op_ts WHEN other = 2 AND op_ts > 2 THEN op_ts - 2 ELSE 0 END AS c2 FROM ops)"""
SEEN = "CASE a.replica WHEN 0 THEN r.m0 WHEN 1 THEN r.m1 ELSE r.m2 END"
REM = "(SELECT user_id AS u, max(c0) AS m0, max(c1) AS m1, max(c2) AS m2 FROM cl WHERE event_type = '{}' GROUP BY user_id)"
SIGN = "CASE WHEN event_type = 'error' THEN -1 ELSE 1 END"
KEY = ["key"]


@query(f"SELECT user_id AS key, sum({SIGN})::BIGINT AS value FROM events GROUP BY user_id")
def counter(t):
    return counters.counter(log.counters(t("events")), KEY)


@query(f"SELECT user_id AS key, round(sum({SIGN} * value), 2) AS value FROM events GROUP BY user_id")
def counter_float(t):
    return counters.counter_float(log.counters(t("events")), KEY).withColumn("value", F.round("value", 2))


@query(f"SELECT user_id AS key, sum({SIGN})::BIGINT AS first, round(sum({SIGN} * value), 2) AS second FROM events GROUP BY user_id")
def pair_counter(t):
    return counters.pair_counter(log.counters(t("events")), KEY).withColumn("second", F.round("second", 2))


@query("SELECT event_type AS key, round(sum(floor(value * 100))::DOUBLE / count(*), 6) AS value FROM events GROUP BY event_type")
def avg_value(t):
    return counters.average(log.averages(t("events")), KEY).select("key", F.round("value", 6).alias("value"))


@query("SELECT event_type AS key, sum(floor(value * 100)::BIGINT)::BIGINT AS sum, count(*) AS n_adds FROM events GROUP BY event_type")
def avg_full(t):
    return counters.average(log.averages(t("events")), KEY).select("key", "sum", "n_adds")


@query("SELECT event_type AS key, sum(floor(value * 100)::BIGINT)::BIGINT AS sum, count(*) AS n_adds FROM events GROUP BY event_type")
def avg_merged(t):
    rows = log.averages(t("events"))
    parts = counters.average(rows, ["key", "replica"])
    return counters.merge_averages(parts, KEY).select("key", "sum", "n_adds")


@query("SELECT event_type AS key, max(floor(value * 100)::BIGINT) AS value FROM events GROUP BY event_type")
def max_value(t):
    return counters.extreme(log.averages(t("events")).withColumn("op", F.lit("max")), "max", KEY)


@query("SELECT event_type AS key, min(floor(value * 100)::BIGINT) AS value FROM events GROUP BY event_type")
def min_value(t):
    return counters.extreme(log.averages(t("events")).withColumn("op", F.lit("min")), "min", KEY)


@query(
    """WITH RECURSIVE x AS (SELECT user_id, event_id, floor(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, n, v AS s FROM x WHERE n = 1
      UNION ALL SELECT x.user_id, x.n, CASE WHEN x.event_id % 3 = 0 THEN least(f.s, x.v) ELSE greatest(f.s, x.v) END FROM f JOIN x ON x.user_id = f.user_id AND x.n = f.n + 1)
    SELECT user_id AS key, arg_max(s, n) AS value FROM f GROUP BY user_id"""
)
def max_min(t):
    return counters.max_min(log.clamps(t("events")), KEY, order=["event_id"])


def _rights(k: int) -> str:
    return f"""r{k} + CASE WHEN op = 'inc' AND rep = {k} THEN amt WHEN op = 'dec' AND rep = {k} AND amt <= mine THEN -amt
      WHEN op = 'transfer' AND amt <= mine // 2 THEN (dest = {k})::BIGINT * amt - (rep = {k})::BIGINT * amt
      WHEN op = 'rebalance' AND mine < v // 3 // 2 THEN (rep = {k})::BIGINT * ask - (richest = {k})::BIGINT * ask ELSE 0 END AS r{k}"""


@query(
    f"""WITH RECURSIVE x AS (
      SELECT user_id AS u, event_id % 3 AS rep, (event_id + 1) % 3 AS dest, floor(value)::BIGINT + 1 AS amt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
        CASE WHEN event_id % 11 = 0 THEN 'rebalance' WHEN event_type IN ('purchase', 'error') THEN 'dec' WHEN event_type = 'signup' THEN 'transfer' ELSE 'inc' END AS op FROM events),
    f AS (
      SELECT DISTINCT u, 0::BIGINT AS n, 0::BIGINT AS v, 0::BIGINT AS r0, 0::BIGINT AS r1, 0::BIGINT AS r2, 0::BIGINT AS refused FROM x
      UNION ALL
      SELECT u, n, v + CASE WHEN op = 'inc' THEN amt WHEN op = 'dec' AND amt <= mine THEN -amt ELSE 0 END, {_rights(0)}, {_rights(1)}, {_rights(2)},
        refused + ((op = 'dec' AND amt > mine) OR (op = 'transfer' AND amt > mine // 2))::BIGINT
      FROM (SELECT *, least((greatest(r0, r1, r2) - mine) // 2, v - mine) AS ask, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS richest
        FROM (SELECT x.u, x.n, f.v, f.r0, f.r1, f.r2, f.refused, x.op, x.amt, x.rep, x.dest, CASE x.rep WHEN 0 THEN f.r0 WHEN 1 THEN f.r1 ELSE f.r2 END AS mine FROM f JOIN x ON x.u = f.u AND x.n = f.n + 1)))
    SELECT u AS key, arg_max(v, n) AS value, arg_max(refused, n) AS refused, arg_max(r0, n) AS rights_0, arg_max(r1, n) AS rights_1, arg_max(r2, n) AS rights_2 FROM f GROUP BY u"""
)
def bounded_counter(t):
    out = ordered.bounded_counter(log.rights(t("events")), KEY, ["event_id"], log.REPLICAS)
    return out.select("key", "value", "refused", *[F.col("rights")[F.lit(r)].alias(f"rights_{r}") for r in log.REPLICAS])


LEFT = f"WITH {OPS} SELECT DISTINCT a.user_id AS key, a.event_type AS elem FROM cl a LEFT JOIN {REM.format('error')} r ON a.user_id = r.u WHERE a.event_type <> 'error' AND (r.u IS NULL OR a.op_ts > {SEEN})"


@query(LEFT)
def orset(t):
    return sets.add_wins_set(log.elements(t("events")), KEY, whole=True)


@query(f"SELECT key, count(*) AS n_elems FROM ({LEFT}) GROUP BY key")
def set_cardinality(t):
    return sets.cardinality(sets.add_wins_set(log.elements(t("events")), KEY, whole=True), KEY)


@query(f"WITH s AS ({LEFT}) SELECT u.key, 'purchase' AS elem, EXISTS (SELECT 1 FROM s WHERE s.key = u.key AND s.elem = 'purchase') AS present FROM (SELECT DISTINCT user_id AS key FROM events) u")
def orset_lookup(t):
    wanted = t("events").select(F.col("user_id").alias("key"), F.lit("purchase").alias("elem")).distinct()
    return sets.lookup(sets.add_wins_set(log.elements(t("events")), KEY, whole=True), wanted, KEY)


@query(
    """WITH a AS (SELECT *, event_id >= 5000 AS late FROM events), s AS (SELECT DISTINCT user_id, event_type FROM a WHERE NOT late AND event_type <> 'error'),
    p AS (SELECT user_id, event_type, arg_max(value < 50, event_id) AS keep FROM a WHERE late AND event_type <> 'error' GROUP BY ALL)
    SELECT user_id AS key, event_type AS elem FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id AND p.event_type = s.event_type)
    UNION ALL SELECT user_id, event_type FROM p WHERE keep"""
)
def set_with_pending(t):
    """A set as a transaction sees it that adds elements of small value and removes the others."""
    e = t("events").where("event_type <> 'error'")
    held = e.where("event_id < 5000").select(F.col("user_id").alias("key"), F.col("event_type").alias("elem")).distinct()
    mine = e.where("event_id >= 5000").select(F.col("user_id").alias("key"), F.col("event_type").alias("elem"), F.when(F.col("value") < 50, "add").otherwise("rem").alias("op"), "event_id")
    return sets.with_pending(held, mine, KEY, "event_id")


ORMAP = """WITH r AS (SELECT user_id, unnest([event_id - 3, event_id - 6]) AS tag FROM events)
SELECT a.user_id % 8 AS key, a.user_id::VARCHAR AS map_key, min(a.event_type) AS value FROM events a
WHERE a.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = a.user_id AND r.tag = a.event_id) GROUP BY ALL"""


@query(ORMAP)
def ormap(t):
    return sets.observed_map(log.overwrites(t("events")), KEY)


@query(f"SELECT key, count(*) AS n, bool_or(map_key = '5') AS has_5, max(CASE WHEN map_key = '5' THEN value END) AS value_5 FROM ({ORMAP}) GROUP BY key")
def ormap_reads(t):
    m = sets.as_maps(sets.observed_map(log.overwrites(t("events")), KEY), KEY)
    return m.select("key", F.size(F.map_keys("entries")).cast("bigint").alias("n"), F.map_contains_key("entries", F.lit("5")).alias("has_5"), F.try_element_at("entries", F.lit("5")).alias("value_5"))


@query(
    f"""WITH {OPS}, r AS (SELECT user_id AS u, max(c0) AS m0, max(c1) AS m1, max(c2) AS m2 FROM cl WHERE event_type = 'error' AND replica = 0 GROUP BY user_id)
    SELECT a.user_id % 4 AS key, a.user_id::VARCHAR AS map_key, count(*) AS value FROM cl a LEFT JOIN r ON a.user_id = r.u
    WHERE NOT (a.event_type = 'error' AND a.replica = 0) AND (r.u IS NULL OR (a.c0 >= r.m0 AND a.c1 >= r.m1 AND a.c2 >= r.m2)) GROUP BY ALL"""
)
def rrmap_remove_wins(t):
    left = sets.remove_wins(log.entries(t("events")), KEY).withColumn("op", F.lit("inc"))
    return counters.counter(left, ["key", "map_key"])


@query("SELECT e.user_id AS key, sum(1)::BIGINT AS value FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY user_id) r ON e.user_id = r.user_id WHERE r.m IS NULL OR e.event_id > r.m GROUP BY e.user_id")
def reset_object(t):
    ops = t("events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "signup", "reset").otherwise("inc").alias("op"), F.lit(1).cast("bigint").alias("long_val"), F.col("event_id").alias("ts"))
    return counters.counter(sets.since_reset(ops, KEY), KEY)


@query("SELECT user_id AS key, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY user_id")
def lww_register(t):
    return sets.last_writer(log.writes(t("events")), KEY)


@query("SELECT user_id AS key, arg_max(event_type <> 'view', struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY user_id")
def lww_flag(t):
    rows = log.writes(t("events")).withColumn("op", F.when(F.col("elem") == "view", "disable").otherwise("enable"))
    return sets.last_flag(rows, KEY)


@query(f"WITH {OPS} SELECT u.key, EXISTS (SELECT 1 FROM cl a LEFT JOIN {REM.format('view')} r ON a.user_id = r.u WHERE a.user_id = u.key AND a.event_type <> 'view' AND (r.u IS NULL OR a.op_ts > {SEEN})) AS value FROM (SELECT DISTINCT user_id AS key FROM events) u")
def ew_flag(t):
    return sets.enable_wins(log.flags(t("events")), KEY)


@query(
    f"""WITH {OPS}, e AS (SELECT user_id AS u, max(c0) AS m0, max(c1) AS m1, max(c2) AS m2 FROM cl WHERE event_type <> 'view' GROUP BY user_id)
    SELECT u.key, NOT EXISTS (SELECT 1 FROM cl a LEFT JOIN e r ON a.user_id = r.u WHERE a.user_id = u.key AND a.event_type = 'view' AND (r.u IS NULL OR a.op_ts > {SEEN})) AS value FROM (SELECT DISTINCT user_id AS key FROM events) u"""
)
def dw_flag(t):
    return sets.disable_wins(log.flags(t("events")), KEY)


BEST = "SELECT user_id AS id, max(floor(value * 100)::BIGINT) AS score FROM events WHERE event_type <> 'error' GROUP BY user_id"


@query(f"SELECT id, score FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS p FROM ({BEST})) WHERE p <= 10", "topk")
def topk_(t):
    return topk.topk(log.scores(t("events")), KEY, 10).select("id", "score")


@query("SELECT id, score FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS p FROM (SELECT user_id AS id, max(floor(value / 10)::BIGINT) AS score FROM events WHERE event_type <> 'error' GROUP BY user_id)) WHERE p <= 5")
def topk_ties(t):
    return topk.topk(log.scores(t("events")).withColumn("score", F.floor(F.col("score") / 1000)), KEY, 5).select("id", "score")


@query(f"SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS p FROM ({BEST})) WHERE p <= 3")
def topk_get_n(t):
    return topk.get_n(topk.topk(log.scores(t("events")), KEY, 10), KEY, 3).select("id", "score")


@query(f"SELECT id, score FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS p FROM ({BEST})) WHERE p <= 10 AND score >= 9900")
def topk_above(t):
    return topk.get_above(topk.topk(log.scores(t("events")), KEY, 10), 9900).select("id", "score")


@query(
    f"""WITH {OPS}, l AS (SELECT a.user_id AS id, max(floor(a.value * 100)::BIGINT) AS score FROM cl a LEFT JOIN {REM.format('error')} r ON a.user_id = r.u
      WHERE a.event_type <> 'error' AND (r.u IS NULL OR a.op_ts > {SEEN}) GROUP BY a.user_id)
    SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS p FROM l) WHERE p <= 10"""
)
def topk_rmv(t):
    return topk.topk_removable(log.scores(t("events")), KEY, 10).select("id", "score")


TOPSUM = f"SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS p FROM (SELECT user_id AS id, sum({SIGN} * floor(value * 100)::BIGINT)::BIGINT AS score FROM events GROUP BY user_id)) WHERE p <= 10"


@query(TOPSUM)
def topsum(t):
    return topk.topsum(log.running_sums(t("events")), KEY, 10).select("id", "score")


@query(f"SELECT * FROM ({TOPSUM}) WHERE score >= 100000")
def topsum_above(t):
    return topk.get_above(topk.topsum(log.running_sums(t("events")), KEY, 10), 100000).select("id", "score")


@query("SELECT l_suppkey AS id, sum(l_quantity::BIGINT)::BIGINT AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, id DESC LIMIT 20")
def topsum_suppliers(t):
    ops = t("lineitem").select(F.lit("q").alias("key"), F.lit("topsum_add").alias("op"), F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("bigint").alias("score"))
    return topk.topsum(ops, KEY, 20).select("id", "score")


@query(f"WITH b AS ({TOPSUM}) SELECT user_id AS id, floor(value * 100)::BIGINT AS score, floor(value * 100)::BIGINT >= (SELECT min(score) FROM b) OR (SELECT count(*) FROM b) < 10 AS replicate FROM events")
def topk_replicate(t):
    ops = log.running_sums(t("events"))
    return topk.with_threshold(topk.topsum(ops, KEY, 10), ops, KEY, 10).select("id", "score", "replicate")


HOURS = "SELECT event_type AS key, list(n ORDER BY pos) AS counts FROM (SELECT k.event_type, p.pos, count(e.event_id) AS n FROM (SELECT event_type, max(hour(ts)) AS top FROM events GROUP BY 1) k JOIN (SELECT unnest(range(24)) AS pos) p ON p.pos <= k.top LEFT JOIN events e ON e.event_type = k.event_type AND hour(e.ts) = p.pos GROUP BY ALL) GROUP BY 1"


def _hours(t):
    return arrays.counter_array(log.hours(t("events")), KEY)


@query(HOURS)
def counter_array(t):
    return _hours(t)


@query(f"SELECT key, coalesce(counts[4], 0) AS value FROM ({HOURS})")
def array_single(t):
    return _hours(t).select("key", arrays.single(F.col("counts"), 3).alias("value"))


@query(f"SELECT key, [coalesce(counts[1], 0), coalesce(counts[6], 0), coalesce(counts[40], 0)] AS value FROM ({HOURS})")
def array_sub(t):
    return _hours(t).select("key", arrays.sub(F.col("counts"), [0, 5, 39]).alias("value"))


@query(f"SELECT key, list_concat(counts[1:2], counts[4:]) AS value FROM ({HOURS})")
def array_except(t):
    return _hours(t).select("key", arrays.except_position(F.col("counts"), 2).alias("value"))


@query(f"SELECT key, list_concat(list_concat(counts[1:1], counts[5:6]), counts[10:]) AS value FROM ({HOURS})")
def array_except_range(t):
    return _hours(t).select("key", arrays.except_ranges(F.col("counts"), [1, 3, 6, 8]).alias("value"))


@query(
    """WITH o AS (SELECT event_type AS k, event_id AS e, hour(ts) AS pos, event_id % 97 = 0 AS every FROM events),
    p AS (SELECT k, unnest(range(max(pos) + 1)) AS p FROM o WHERE NOT every GROUP BY k),
    b AS (SELECT p.k, p.p, min(o.e) AS born, count(*) FILTER (o.pos = p.p) AS own FROM p JOIN o ON o.k = p.k AND NOT o.every AND o.pos >= p.p GROUP BY ALL)
    SELECT k AS key, list(own + (SELECT count(*) FROM o WHERE o.k = b.k AND o.every AND o.e > b.born) ORDER BY p) AS counts FROM b GROUP BY k"""
)
def counter_array_all(t):
    """Operations on all positions, in order."""
    ops = log.hours(t("events")).withColumn("op", F.when(F.col("event_id") % 97 == 0, "inc_all").otherwise("inc"))
    return ordered.counter_array(ops, KEY, ["event_id"])


def _rows(t):
    item = t("lineitem")
    return arrays.MultiArray(
        item.select(
            F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("key"),
            F.array("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint")).alias("ints"),
            F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("floats"),
            F.array(F.encode("l_returnflag", "UTF-8"), F.encode("l_linestatus", "UTF-8")).alias("data"),
            F.array(F.col("l_quantity").cast("bigint")).alias("sums"),
            F.array(F.col("l_linenumber").cast("bigint")).alias("counts"),
        )
    )


LKEY = "l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS key"


@query(f"SELECT {LKEY}, l_suppkey AS ints, l_extendedprice AS floats, 0::BIGINT AS sums, '' AS data FROM lineitem")
def multi_pos(t):
    """Two positions that there are, two beyond the end."""
    return _rows(t).position(ints=2, floats=1, sums=7, data=2).withColumn("data", F.decode("data", "UTF-8"))


@query(f"SELECT {LKEY}, [l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT] AS ints, [l_quantity::BIGINT] AS sums FROM lineitem")
def multi_full(t):
    return _rows(t).full("ints", "sums")


@query(f"SELECT {LKEY}, [l_partkey, l_suppkey] AS ints, [l_discount, l_tax] AS floats FROM lineitem")
def multi_range(t):
    return _rows(t).range(ints=(1, 3), floats=(2, 9))


@query(f"SELECT {LKEY}, [l_linenumber::BIGINT, l_orderkey, 0] AS ints FROM lineitem")
def multi_sub(t):
    return _rows(t).sub(ints=[3, 0, 9])


@query(f"SELECT {LKEY}, [l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT] AS ints, [l_extendedprice, l_discount] AS floats, [l_linenumber::BIGINT, l_partkey] AS swapped FROM lineitem")
def multi_custom(t):
    rows = _rows(t)
    return arrays.MultiArray(rows.df.withColumn("swapped", F.col("ints"))).custom(ints=[-1], floats=[1, 3], data=[], swapped=[3, 1])


@query(f"SELECT {LKEY}, [l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT] AS ints FROM lineitem WHERE l_discount > 0.08")
def multi_cond(t):
    return _rows(t).where("floats", 2, "gt", 0.08, "ints")


@query(f"SELECT {LKEY}, l_returnflag AS flag FROM lineitem WHERE l_suppkey <= 10")
def multi_data_cond(t):
    return _rows(t).where("ints", 2, "leq", 10, "data").select("key", F.decode(F.get("data", F.lit(0)), "UTF-8").alias("flag"))


@query(f"SELECT {LKEY}, l_returnflag AS flag FROM lineitem WHERE l_quantity::BIGINT / l_linenumber::DOUBLE >= 25")
def multi_avg_cond(t):
    return _rows(t).where_average(0, "geq", 25).select("key", F.decode(F.get("data", F.lit(0)), "UTF-8").alias("flag"))


@query(f"SELECT {LKEY}, l_linestatus AS status, l_partkey AS int_value FROM lineitem")
def multi_data_int(t):
    return _rows(t).data_and_int(1).select("key", F.decode(F.get("data", F.lit(1)), "UTF-8").alias("status"), "int_value")


@query(
    """WITH p AS (SELECT user_id AS key, event_id % 3 AS pos, count(*) AS i, round(sum(value), 2) AS f, arg_max(event_type, event_id) AS d FROM events GROUP BY ALL)
    SELECT key, list(i ORDER BY pos) AS ints, list(f ORDER BY pos) AS floats, arg_max(d, pos) AS last FROM (SELECT k.key, q.pos, coalesce(p.i, 0) AS i, coalesce(p.f, 0.0) AS f, p.d
      FROM (SELECT key, max(pos) AS top FROM p GROUP BY key) k JOIN (SELECT unnest(range(3)) AS pos) q ON q.pos <= k.top LEFT JOIN p ON p.key = k.key AND p.pos = q.pos) GROUP BY key"""
)
def multi_updates(t):
    e = t("events").select(F.col("user_id").alias("key"), (F.col("event_id") % 3).cast("int").alias("pos"), "value", "event_type", F.col("event_id").alias("ts"), F.lit(0).cast("smallint").alias("replica"))
    none = lambda k: F.lit(None).cast(k)
    rows = None
    for op, i, f, d in (("inc_int", F.lit(1).cast("bigint"), none("double"), none("binary")), ("inc_float", none("bigint"), F.col("value"), none("binary")), ("set_data", none("bigint"), none("double"), F.encode("event_type", "UTF-8"))):
        part = e.select("key", "pos", "ts", "replica", F.lit(op).alias("op"), none("string").alias("elem"), i.alias("long_val"), f.alias("dbl_val"), none("bigint").alias("n_adds"), d.alias("bin_val"))
        rows = part if rows is None else rows.unionByName(part)
    out = arrays.multi_array(rows, KEY)
    return out.select("key", "ints", F.transform("floats", lambda x: F.round(x, 2)).alias("floats"), F.decode(F.element_at("data", -1), "UTF-8").alias("last"))


@query(
    """WITH p AS (SELECT user_id AS key, unnest(range(event_id % 3 + 1)) AS pos FROM events UNION ALL SELECT user_id, unnest([0, 4]) FROM events WHERE event_type = 'view'),
    n AS (SELECT key, pos, count(*) AS n FROM p GROUP BY ALL)
    SELECT k.key, list(coalesce(n.n, 0) + CASE WHEN q.pos < 2 THEN 10 * (q.pos + 1) ELSE 0 END ORDER BY q.pos) AS ints
    FROM (SELECT key, greatest(max(pos), 5) AS top FROM n GROUP BY key) k JOIN (SELECT unnest(range(6)) AS pos) q ON q.pos <= k.top LEFT JOIN n ON n.key = k.key AND n.pos = q.pos GROUP BY k.key"""
)
def multi_spread(t):
    """Whole rows to begin with, ranges and lists of positions incremented, a size set."""
    e = t("events").select(F.col("user_id").alias("key"), "event_id", "event_type", F.col("event_id").alias("ts"), F.lit(0).cast("smallint").alias("replica"))
    none = lambda k: F.lit(None).cast(k)
    ops = e.select("key", "ts", "replica", F.lit("inc_int").alias("op"), none("string").alias("elem"), none("double").alias("dbl_val"), none("bigint").alias("n_adds"), none("binary").alias("bin_val"), "event_id", "event_type")
    one = F.array(F.lit(1).cast("bigint"))
    ranges = arrays.spread(ops, F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), one)
    some = arrays.spread(ops.where("event_type = 'view'"), F.array(F.lit(0), F.lit(4)), F.array_repeat(F.lit(1).cast("bigint"), 2))
    keys = e.groupBy("key").agg(F.min("ts").alias("ts")).withColumn("replica", F.lit(0).cast("smallint"))
    first = arrays.initial(keys.withColumns({"ints": F.array(F.lit(10).cast("bigint"), F.lit(20).cast("bigint")), "floats": none("array<double>"), "data": none("array<binary>"), "sums": none("array<bigint>"), "counts": none("array<bigint>")}), KEY)
    sizes = keys.select("key", "ts", "replica", F.lit("set_size").alias("op"), F.lit("ints").alias("elem"), F.lit(6).alias("pos"), none("bigint").alias("long_val"), none("double").alias("dbl_val"), none("bigint").alias("n_adds"), none("binary").alias("bin_val"))
    drop = lambda x: x.drop("event_id", "event_type")
    return arrays.multi_array(drop(ranges).unionByName(drop(some)).unionByName(first).unionByName(sizes), KEY).select("key", "ints")


@query("SELECT user_id % 8 AS key, event_type AS map_key, arg_max(event_id::VARCHAR, event_id) AS value FROM events GROUP BY ALL")
def gmap(t):
    """A map that only grows: its removes do nothing."""
    ops = t("events").select((F.col("user_id") % 8).alias("key"), F.col("event_type").alias("map_key"), F.lit("add").alias("op"), F.col("event_id").cast("string").alias("elem"), F.col("event_id").alias("ts"), F.lit(0).alias("replica"))
    return sets.grow_only_map(ops.unionByName(ops.withColumn("op", F.lit("rem"))), KEY)


PAIRS = f"WITH {OPS}, x AS (SELECT a.event_id, a.c0 AS a0, a.c1 AS a1, a.c2 AS a2, b.c0 AS b0, b.c1 AS b1, b.c2 AS b2 FROM cl a JOIN cl b ON b.event_id = a.event_id + 4)"


def _pairs(t):
    ops = log.operations(t("events"))
    return ops.select("event_id", F.col("clk").alias("a")).join(ops.select((F.col("event_id") - 4).alias("event_id"), F.col("clk").alias("b")), "event_id")


@query(
    f"""{PAIRS} SELECT event_id, CASE WHEN a0 = b0 AND a1 = b1 AND a2 = b2 THEN 'equal' WHEN a0 <= b0 AND a1 <= b1 AND a2 <= b2 THEN 'lower'
    WHEN a0 >= b0 AND a1 >= b1 AND a2 >= b2 THEN 'higher' ELSE 'concurrent' END AS cmp FROM x"""
)
def clock_compare(t):
    return _pairs(t).select("event_id", clocks.compare(F.col("a"), F.col("b")).alias("cmp"))


@query(
    f"""{PAIRS} SELECT event_id, CASE WHEN a0 <= b0 AND a1 <= b1 AND a2 <= b2 THEN -1 WHEN a0 >= b0 AND a1 >= b1 AND a2 >= b2 THEN 1
    WHEN a0 <> b0 THEN CASE WHEN a0 < b0 THEN -1 ELSE 1 END WHEN a1 <> b1 THEN CASE WHEN a1 < b1 THEN -1 ELSE 1 END ELSE CASE WHEN a2 < b2 THEN -1 ELSE 1 END END AS o FROM x"""
)
def clock_total_order(t):
    return _pairs(t).select("event_id", clocks.total_order(F.col("a"), F.col("b")).alias("o"))


@query(f"{PAIRS} SELECT event_id, greatest(a0, b0) AS m0, greatest(a1, b1) AS m1, greatest(a2, b2) AS m2 FROM x")
def clock_merge(t):
    m = clocks.merged(F.col("a"), F.col("b"))
    return _pairs(t).select("event_id", *[clocks.at(m, F.lit(r).cast("smallint")).alias(f"m{r}") for r in log.REPLICAS])


@query(f"WITH {OPS} SELECT user_id, max(c0) AS m0, max(c1) AS m1, max(c2) AS m2 FROM cl GROUP BY user_id")
def clock_merge_all(t):
    m = clocks.merge_all(log.operations(t("events")), ["user_id"], "clk", "m")
    return m.select("user_id", *[clocks.at(F.col("m"), F.lit(r).cast("smallint")).alias(f"m{r}") for r in log.REPLICAS])


@query(f"WITH {OPS} SELECT event_id, c0 + (replica = 0)::INT AS n0, c1 + (replica = 1)::INT AS n1, c2 + (replica = 2)::INT AS n2 FROM cl")
def clock_next(t):
    ops = log.operations(t("events")).select("event_id", clocks.advanced(F.col("clk"), F.col("replica")).alias("n"))
    return ops.select("event_id", *[clocks.at(F.col("n"), F.lit(r).cast("smallint")).alias(f"n{r}") for r in log.REPLICAS])


@query(
    f"""{PAIRS} SELECT event_id, CASE WHEN a1 = b1 AND a2 = b2 THEN 'equal' WHEN a1 <= b1 AND a2 <= b2 THEN 'lower' WHEN a1 >= b1 AND a2 >= b2 THEN 'higher' ELSE 'concurrent' END AS cmp FROM x"""
)
def clock_compare_but_self(t):
    return _pairs(t).select("event_id", clocks.compare_but_self(F.col("a"), F.col("b"), F.lit(0).cast("smallint")).alias("cmp"))


@query(f"WITH {OPS} SELECT replica, CASE replica WHEN 0 THEN (SELECT min(c0) FROM l) WHEN 1 THEN (SELECT min(c1) FROM l) ELSE (SELECT min(c2) FROM l) END AS ts FROM (SELECT unnest([0, 1, 2])::SMALLINT AS replica), (SELECT 1) q".replace("WITH ops", "WITH RECURSIVE ops").replace(" FROM ops)", " FROM ops), l AS (SELECT max(c0) AS c0, max(c1) AS c1, max(c2) AS c2 FROM cl GROUP BY replica)", 1))
def stable_clock(t):
    known = clocks.merge_all(log.operations(t("events")), ["replica"], "clk", "m")
    return clocks.stable(known, log.REPLICAS, "m")


@query(f"WITH {OPS} SELECT user_id AS key, sum({SIGN})::BIGINT AS value FROM cl WHERE c0 <= 1000 AND c1 <= 900 AND c2 <= 1100 GROUP BY user_id")
def read_as_of(t):
    return counters.counter(as_of(log.counters(t("events")), {0: 1000, 1: 900, 2: 1100}), KEY)


@query(f"SELECT user_id AS key, sum({SIGN} * CASE WHEN event_id % 10 = 9 THEN 2 ELSE 1 END)::BIGINT AS value FROM events GROUP BY user_id")
def read_your_writes(t):
    """A transaction that has written every tenth operation once more."""
    ops = log.counters(t("events"))
    txn = Transaction(ops, "t1")
    txn.update(ops.where("event_id % 10 = 9"))
    return txn.read(lambda x: counters.counter(x, KEY))


@query(
    """WITH g AS (SELECT user_id AS key, list(DISTINCT event_id) FILTER (event_type <> 'error') AS held, list(DISTINCT event_id - 3) FILTER (event_type = 'view') AS seen FROM events GROUP BY user_id),
    s AS (SELECT key, coalesce(held, []) AS held, coalesce(seen, []) AS seen FROM g)
    SELECT key, len(list_distinct(list_concat(held, [-1::BIGINT])))::INT AS added, len(list_distinct(list_concat(held, seen)))::INT AS n_all,
      len(list_filter(held, lambda x: NOT list_contains(seen, x)))::INT AS n_left, list_sort(list_filter(held, lambda x: list_contains(seen, x))) AS gone FROM s"""
)
def tag_sets(t):
    """A user's tags of additions, and those that views have observed."""
    e = t("events")
    both = e.groupBy(F.col("user_id").alias("key")).agg(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("held"), F.collect_set(F.when(F.col("event_type") == "view", F.col("event_id") - 3)).alias("seen"))
    left, gone = tags.taken(F.col("held"), F.col("seen"))
    return both.select("key", F.size(tags.with_tag(F.col("held"), F.lit(-1).cast("bigint"))).alias("added"), F.size(tags.with_all(F.col("held"), F.col("seen"))).alias("n_all"), F.size(left).alias("n_left"), F.sort_array(gone).alias("gone"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS n FROM events")
def register_number(t):
    return t("events").select("event_id", values.number(F.regexp_extract("props", "[0-9]+", 0)).alias("n"))


@query("SELECT event_id, (event_id // 3 + 1) * 65536 + event_id % 3 AS packed FROM events")
def packed_order(t):
    ops = log.operations(t("events"))
    return ops.select("event_id", values.packed(F.col("op_ts"), F.col("replica")).alias("packed"))


@query("SELECT event_id FROM events WHERE regexp_full_match(event_type, 'c.*|.*up')")
def key_pattern(t):
    return t("events").where(values.matches(F.col("event_type"), "c.*|.*up")).select("event_id")


def _objects(t):
    """Counters as objects: key = user, bucket by user."""
    ops = log.counters(t("events"))
    bucket = F.concat(F.lit("R"), (F.col("key") % 5).cast("string"))
    return ops.select(F.col("key").cast("string").alias("key"), F.lit("COUNTER").alias("crdt_type"), bucket.alias("bucket"), "op", "long_val", "dbl_val", "replica", "ts", "clk")


OBJECTS = f"SELECT user_id::VARCHAR AS key, 'COUNTER' AS crdt_type, 'R' || user_id % 5 AS bucket, sum({SIGN})::BIGINT AS value FROM events GROUP BY user_id"


@query(f"SELECT * FROM ({OBJECTS}) WHERE key IN ('1', '7', '12') AND bucket IN ('R1', 'R2')")
def static_read(t):
    """Several objects of one snapshot; one asked for in a bucket that doesn't hold it."""
    keys = [("1", "COUNTER", "R1"), ("7", "COUNTER", "R2"), ("12", "COUNTER", "R2"), ("1", "COUNTER", "R3")]
    return read_objects(_objects(t), keys, counters.counter)


@query("SELECT event_id // 3 + 1 AS ts, (event_id % 3)::SMALLINT AS replica FROM events WHERE user_id = 7")
def raw_object(t):
    return _objects(t).where("key = '7' AND crdt_type = 'COUNTER' AND bucket = 'R2'").select("ts", "replica")


@query(f"SELECT * FROM ({OBJECTS}) WHERE bucket IN ('R1', 'R4')")
def bucket_read(t):
    """A log written by bucket and read back from two of its folders."""
    ops = _objects(t)
    path = scratch(ops.sparkSession, "log")
    store.append_ops(ops, path)
    return counters.counter(store.read_ops(ops.sparkSession, path, ["R1", "R4"]))


@query(f"SELECT * FROM ({OBJECTS}) WHERE bucket = 'R3'")
def snapshot_import(t):
    """A joining server's copy of one bucket's states."""
    state = counters.counter(_objects(t))
    path = scratch(state.sparkSession, "state")
    store.export_state(state, path)
    return store.import_state(state.sparkSession, path, ["R3"]).select(*state.columns)


@query("SELECT event_id, least(greatest(value, 20.0), 80.0) AS v, to_json({'k': event_type}) AS shown FROM events")
def value_functions(t):
    return t("events").select("event_id", values.bounded(F.col("value"), F.lit(20.0), F.lit(80.0)).alias("v"), values.shown(F.struct(F.col("event_type").alias("k"))).alias("shown"))
