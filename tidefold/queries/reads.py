"""Table reads, predicates, aggregates over keyed tables, loads and writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.model import row_key
from tidefold.plans.catalog import Catalog, Declared
from tidefold.plans import views
from tidefold.plans.tables import All, Anything, Compare, Table, Variable, aggregate_states
from tidefold.queries.base import query
from tidefold.sources import tables as src
from tidefold.sources.scratch import scratch

CUST, ORD = ("c_custkey",), ("o_orderkey",)


def _cust(t):
    return Table(t("customer"), CUST)


def _ord(t):
    return Table(t("orders"), ORD)


@query("SELECT * FROM customer")
def full_scan(t):
    return _cust(t).scan()


@query("SELECT o_orderkey FROM orders")
def get_keys(t):
    return _ord(t).keys()


@query("SELECT count(*) > 0 AS present FROM customer WHERE c_custkey = 42")
def has_key(t):
    return _cust(t).has_key(42)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def get_value(t):
    return _cust(t).get(42, ["c_name", "c_acctbal"])


@query("SELECT * FROM customer WHERE c_custkey IN (1, 5, 9, 999999)")
def get_values(t):
    return _cust(t).get_many([1, 5, 9, 999999])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 7 = 3")
def get_values_by_table(t):
    keys = t("orders").where("o_custkey % 7 = 3").select("o_orderkey")
    return _ord(t).get_many(keys, ["o_totalprice"])


@query("SELECT c_custkey, CASE WHEN c_custkey IN (1, 2) THEN c_name END AS c_name, CASE WHEN c_custkey IN (2, 3) THEN c_acctbal END AS c_acctbal FROM customer WHERE c_custkey IN (1, 2, 3)")
def get_values_each(t):
    return _cust(t).get_each({1: ["c_name"], 2: ["c_name", "c_acctbal"], 3: ["c_acctbal"]})


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def get_all_values(t):
    return _ord(t).project("o_totalprice", "o_orderdate")


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (0, 3, 24)")
def except_keys(t):
    return Table(t("nation"), ("n_nationkey",)).except_keys([0, 3, 24])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def except_keys_by_table(t):
    return _ord(t).except_keys(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_custkey"])


@query("SELECT * FROM nation WHERE n_nationkey <> 7")
def except_single(t):
    return Table(t("nation"), ("n_nationkey",)).except_key(7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey = 1 AND o_totalprice > 10) OR (o_orderkey = 2 AND o_orderstatus = 'F') OR (o_orderkey = 3 AND o_custkey >= 0)")
def cond_each(t):
    return _ord(t).where_each({1: Compare("o_totalprice", "gt", 10), 2: Compare("o_orderstatus", "eq", "F"), 3: Compare("o_custkey", "geq", 0)}, ["o_custkey"])


@query("SELECT * FROM orders WHERE o_custkey <= 100")
def cond_int(t):
    return _ord(t).where(Compare("o_custkey", "leq", 100))


@query("SELECT * FROM lineitem WHERE l_discount >= 0.09")
def cond_float(t):
    return Table(t("lineitem"), ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).where(Compare("l_discount", "geq", 0.09))


@query("SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'")
def cond_string(t):
    return _cust(t).where(Compare("c_mktsegment", "neq", "BUILDING"))


@query("SELECT c_custkey FROM customer WHERE encode(c_mktsegment) <> encode('BUILDING')")
def cond_bytes(t):
    rows = Table(t("customer").withColumn("seg", F.encode("c_mktsegment", "UTF-8")), CUST)
    return rows.where(Compare("seg", "neq", b"BUILDING"), ["c_custkey"])


@query("SELECT c_custkey, c_acctbal < 0 AS owes FROM customer WHERE c_acctbal < 0")
def cond_bool(t):
    return Table(t("customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("owes")), CUST).where(Compare("owes", "eq", True))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
def cond_map_and(t):
    return _ord(t).where(All((Compare("o_orderstatus", "eq", "O"), Compare("o_totalprice", "gt", 200000.0), Anything("o_custkey"))))


def _counted(named):
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, rows in named.items()])


@query(
    """SELECT 'string > 5' AS name, 0::BIGINT AS n UNION ALL SELECT 'string > text', 0 UNION ALL SELECT 'number = text', 0 UNION ALL SELECT 'number = true', 0
    UNION ALL SELECT 'string = text', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'number > 5', count(*) FROM customer WHERE c_acctbal > 5"""
)
def cond_type_mismatch(t):
    """A value of another kind, or a comparison that a kind hasn't, finds nothing; the same with the right kind does."""
    cust = _cust(t)
    return _counted({name: cust.where(Compare(*test)) for name, test in {
        "string > 5": ("c_mktsegment", "gt", 5), "string > text": ("c_mktsegment", "gt", "BUILDING"), "number = text": ("c_acctbal", "eq", "5"), "number = true": ("c_acctbal", "eq", True),
        "string = text": ("c_mktsegment", "eq", "BUILDING"), "number > 5": ("c_acctbal", "gt", 5)}.items()})


SYMBOLS = {"eq": "=", "neq": "<>", "lt": "<", "leq": "<=", "gt": ">", "geq": ">="}
CASES = [("orders", "o_custkey", 100, op) for op in SYMBOLS] + [("lineitem", "l_discount", 0.05, op) for op in SYMBOLS] + [("customer", "c_mktsegment", "BUILDING", op) for op in ("eq", "neq")]


@query(" UNION ALL ".join(f"SELECT '{f} {op}' AS name, count(*) AS n FROM {table} WHERE {f} {SYMBOLS[op]} {v!r}" for table, f, v, op in CASES))
def cond_all_operators(t):
    return _counted({f"{f} {op}": Table(t(table), ()).where(Compare(f, op, v)) for table, f, v, op in CASES})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def all_cond(t):
    return _ord(t).where(Compare("o_totalprice", "gt", 300000), ["o_totalprice"])


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (1, 2, 3) AND o_totalprice < 5000")
def except_cond(t):
    return _ord(t).except_where([1, 2, 3], Compare("o_totalprice", "lt", 5000))


@query("SELECT * FROM orders WHERE o_orderkey <> 5 AND o_orderstatus = 'F'")
def except_single_cond(t):
    return _ord(t).except_key_where(5, Compare("o_orderstatus", "eq", "F"))


def _rounded(df):
    return df.select(*[F.round(c, 2).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _agg(name, kind, field, sql_rows, read):
    columns = "round(sum({0})::DOUBLE / count({0}), 2) AS value, round(sum({0})::DOUBLE, 2) AS value_sum, count({0}) AS value_count" if kind == "avg" else ("round(sum({0}), 2) AS value" if kind == "sum" else f"{kind}({{0}}) AS value")
    query(f"SELECT {columns.format(field)} FROM {sql_rows}", name)(lambda t: _rounded(read(t)))


_agg("agg_sum", "sum", "o_totalprice", "orders", lambda t: _ord(t).aggregate("sum", "o_totalprice"))
_agg("agg_avg", "avg", "o_totalprice", "orders", lambda t: _ord(t).aggregate("avg", "o_totalprice"))
_agg("agg_max", "max", "o_totalprice", "orders", lambda t: _ord(t).aggregate("max", "o_totalprice"))
_agg("agg_min", "min", "o_totalprice", "orders", lambda t: _ord(t).aggregate("min", "o_totalprice"))
_agg("agg_by_keys", "sum", "o_totalprice", "orders WHERE o_orderkey IN (1, 2, 3, 4)", lambda t: _ord(t).aggregate("sum", "o_totalprice", keys=[1, 2, 3, 4]))
_agg("agg_cond", "avg", "o_totalprice", "orders WHERE o_orderstatus = 'F'", lambda t: _ord(t).aggregate("avg", "o_totalprice", predicate=Compare("o_orderstatus", "eq", "F")))
_agg("agg_cond_keys", "max", "o_totalprice", "orders WHERE o_orderkey IN (1, 2, 3, 4) AND o_totalprice > 100", lambda t: _ord(t).aggregate("max", "o_totalprice", [1, 2, 3, 4], Compare("o_totalprice", "gt", 100)))
_agg("agg_empty", "min", "o_totalprice", "orders WHERE o_totalprice < 0", lambda t: _ord(t).aggregate("min", "o_totalprice", predicate=Compare("o_totalprice", "lt", 0)))


@query("SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS value FROM lineitem")
def agg_nested_key(t):
    rows = t("lineitem").select("l_orderkey", F.create_map(F.col("l_returnflag"), F.col("l_quantity")).alias("row"))
    return _rounded(Table(rows.select("l_orderkey", F.try_element_at("row", F.lit("R")).alias("of")), ("l_orderkey",)).aggregate("sum", "of"))


@query("SELECT round(sum(coalesce(CASE WHEN l_returnflag = 'R' THEN l_quantity END, 0))::DOUBLE / count(*), 2) AS value, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE, 2) AS value_sum, count(*) AS value_count FROM lineitem")
def agg_missing_as_zero(t):
    rows = t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("of"))
    return _rounded(Table(rows, ("l_orderkey",)).aggregate("avg", "of", missing_as_zero=True))


@query("SELECT round(max(v), 2) AS value FROM (SELECT sum(o_totalprice) AS v FROM orders UNION ALL SELECT sum(c_acctbal) FROM customer)")
def aggregate_of_states(t):
    return _rounded(aggregate_states([_ord(t).aggregate("sum", "o_totalprice"), _cust(t).aggregate("sum", "c_acctbal")], "max"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)")
def process_read(t):
    mean = t("orders").agg((1.9 * F.avg("o_totalprice")).alias("floor"))
    return _ord(t).process(mean, lambda x: x.where(Compare("o_totalprice", "gt", Variable("floor")), ["o_totalprice"]))


@query("SELECT l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS key, l_quantity, l_discount FROM lineitem")
def row_build(t):
    rows = src.keyed(t("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["l_quantity", "l_discount"])
    return rows.select("key", "row.*")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def row_build_nested(t):
    rows = src.keyed(t("nation"), ["n_nationkey"], ["n_name", "n_regionkey"], nested=True)
    return rows.select("key", F.col("row")["n_name"].alias("name"), F.col("row")["n_regionkey"].alias("region"))


REGIONS = "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _path(name: str, sql: str):
    """Registers a query of (spark, path)."""
    from tidefold.queries.base import ORACLE, QUERIES

    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


@_path("region_load", f"SELECT c_custkey, r_name AS region FROM customer JOIN ({REGIONS}) ON c_nationkey = n_nationkey")
def region_load(spark, path):
    return src.with_region(spark, path, "customer").select("c_custkey", "region")


@_path("replicated_load", "SELECT region, loader, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM (SELECT *, list_extract((SELECT list(r_name ORDER BY r_name) FROM region), (p_partkey % 5 + 1)::INT) AS loader FROM part), (SELECT r_name AS region FROM region) GROUP BY ALL")
def replicated_load(spark, path):
    """Every region holds the whole table, each slice of it loaded by one region for all."""
    return src.everywhere(spark, path).groupBy("region", "loader").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("bigint").alias("sizes"))


@_path("regional_save", f"SELECT c_custkey, c_name FROM customer JOIN ({REGIONS}) ON c_nationkey = n_nationkey WHERE r_name = (SELECT min(r_name) FROM region)")
def regional_save(spark, path):
    """Customers saved by region, and one region's folder read."""
    at = scratch(spark, "regional")
    src.save_regional(src.with_region(spark, path, "customer"), at)
    first = src.load(spark, path, "region").agg(F.min("r_name")).collect()[0][0]
    return spark.read.parquet(at).where(F.col("region") == first).select("c_custkey", "c_name")


@_path("view_saved", "SELECT l_returnflag, sum(l_quantity) AS sum_qty, count(*) AS n, max(l_quantity) AS max_qty, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY 1")
def view_saved(spark, path):
    """The regions' local views, saved by region, loaded again and merged to the global one."""
    at = scratch(spark, "view")
    local = src.save_view(views.local_parts(views.reader(spark, path)), at, ["r_name"])
    return views.merged_parts(local)


@_path(
    "multi_region_load",
    f"""WITH n AS ({REGIONS}), x AS (
      SELECT l.*, a.r_name AS o, b.r_name AS s FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN n a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN n b ON s_nationkey = b.n_nationkey)
    SELECT region, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM (SELECT o AS region, l_quantity FROM x UNION ALL SELECT s, l_quantity FROM x WHERE s <> o) GROUP BY region""",
)
def multi_region_load(spark, path):
    return src.lines_by_region(spark, path).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"))


@query(
    """WITH up AS (SELECT o_orderkey AS k, o_totalprice * 2 AS p FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0)
    SELECT o_orderkey, coalesce(up.p, o_totalprice) AS o_totalprice FROM orders LEFT JOIN up ON o_orderkey = k WHERE o_orderkey % 10 <> 0"""
)
def table_upsert_delete(t):
    """Every fifth order is doubled, every tenth removed at the same time: removes win."""
    orders = t("orders")
    clk = lambda r, n: F.create_map(F.lit(r).cast("smallint"), F.lit(n).cast("bigint"))
    ups = orders.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("upd").alias("op"), F.lit(1).cast("bigint").alias("ts"), clk(0, 1).alias("clk"))
    rems = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit("rem").alias("op"), F.lit(1).cast("bigint").alias("ts"), clk(1, 1).alias("clk"))
    return Table(orders.select("o_orderkey", "o_totalprice"), ORD).applied(ups.unionByName(rems), ["o_totalprice"])


@query("SELECT c_custkey::BIGINT AS id, c_name AS name, 'none' AS tier, 0::BIGINT AS points FROM customer WHERE c_acctbal >= 0")
def sql_insert_defaults(t):
    cust = t("customer").where("c_acctbal >= 0")
    cat = Catalog(cust.sparkSession)
    cat.create_table("members", [Declared("id", "INTEGER"), Declared("name", "VARCHAR"), Declared("tier", "VARCHAR", "none"), Declared("points", "COUNTER", 0, "points >= 0")], ["id"])
    cat.insert("members", cust.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return cat.select("members")


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 2")
def sql_update_delete(t):
    cat = Catalog(t("nation").sparkSession)
    cat.create_table("places", [Declared("id", "INTEGER"), Declared("name", "VARCHAR"), Declared("region", "INTEGER")], ["id"])
    cat.insert("places", t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    cat.update("places", {"name": "'moved'"}, "region = 1")
    cat.delete("places", "region = 2")
    return cat.select("places", ["id", "name"])


@query("SELECT DISTINCT n_regionkey::VARCHAR || '_' || n_nationkey::VARCHAR AS key FROM nation")
def key_concat(t):
    return t("nation").select(row_key("n_regionkey", "n_nationkey").alias("key")).distinct()
