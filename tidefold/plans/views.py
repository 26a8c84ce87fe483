"""Analytical views over the star schema, as pipelines. Revenue is summed exactly, as decimals."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]


def reader(spark: SparkSession, path: str) -> Tables:
    return lambda name: spark.read.parquet(f"{path}/{name}.parquet")


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money_state(amount, digits: int = 4):
    """The exact sum, a decimal, of amounts that have so many decimals.

    Amounts are added as integers, in two parts of which neither overflows below 10^12 rows; decimals only come in at the end.
    """
    units = F.rint(amount * 10.0**digits).cast("bigint")
    part = lambda x: F.sum(x).cast("decimal(20,0)")
    whole = part(F.shiftright(units, 20)) * F.lit(Decimal(1 << 20)) + part(units.bitwiseAND(F.lit((1 << 20) - 1)))
    return (whole * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(38,{digits})")


def money(amount, digits: int = 4):
    """The sum of amounts that have so many decimals, whatever the order of addition."""
    return money_state(amount, digits).cast("double")


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


def nation_regions(t: Tables) -> DataFrame:
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


def q1(t: Tables, until: str = "2001-06-01") -> DataFrame:
    disc = revenue()
    return (
        t("lineitem").where(F.col("l_shipdate") <= _day(until)).groupBy("l_returnflag", "l_linestatus").agg(
            F.sum("l_quantity").alias("sum_qty"),
            money(F.col("l_extendedprice")).alias("sum_base_price"),
            money(disc).alias("sum_disc_price"),
            money(disc * (1 + F.col("l_tax")), 6).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


def q3(t: Tables, segment: str = "BUILDING", day: str = "1998-03-15", k: int = 10) -> DataFrame:
    cust = t("customer").where(F.col("c_mktsegment") == segment).select("c_custkey")
    orders = t("orders").where(F.col("o_orderdate") < _day(day)).select("o_orderkey", "o_custkey", "o_orderdate")
    items = t("lineitem").where(F.col("l_shipdate") > _day(day)).select("l_orderkey", revenue().alias("r"))
    return (
        items.join(orders.join(cust, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_orderkey", "o_orderdate").agg(money(F.col("r")).alias("revenue"))
        .orderBy(F.col("revenue").desc(), "o_orderdate", "l_orderkey").limit(k)
    )


def q5(t: Tables) -> DataFrame:
    """Revenue by region, nation and order year of sales within the customer's own nation."""
    return q5_shown(q5_state(t))


def q5_merged(states: DataFrame) -> DataFrame:
    return states.groupBy("r_name", "n_name", "o_year").agg(F.sum("revenue").cast("decimal(38,4)").alias("revenue"))


def q5_shown(state: DataFrame) -> DataFrame:
    return state.withColumn("revenue", F.col("revenue").cast("double"))


def q5_state(t: Tables) -> DataFrame:
    """The view's state, exact, so that states of parts of the lines can be merged."""
    nations = nation_regions(t).select("n_nationkey", "n_name", "r_name")
    supp = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name", "r_name")
    orders = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
    bought = orders.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_year", "c_nationkey")
    items = t("lineitem").select("l_orderkey", "l_suppkey", revenue().alias("r")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return (
        items.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .groupBy("r_name", "n_name", "o_year").agg(money_state(F.col("r")).alias("revenue"))
    )


def q6(t: Tables, year: int = 1997, discount: float = 0.06, quantity: int = 24) -> DataFrame:
    d = F.col("l_discount")
    rows = t("lineitem").where((F.col("l_shipdate") >= _day(f"{year}-01-01")) & (F.col("l_shipdate") < _day(f"{year + 1}-01-01")) & d.between(discount - 0.011, discount + 0.011) & (F.col("l_quantity") < quantity))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * d), 2).alias("revenue"))


def q7(t: Tables) -> DataFrame:
    """Volume shipped between each two nations by year."""
    nation = t("nation").select("n_nationkey", "n_name")
    supp = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supp_nation"))
    cust = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cust_nation"))
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation")
    items = t("lineitem").select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("l_year"), revenue().alias("r"))
    return (
        items.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .where("supp_nation <> cust_nation").groupBy("supp_nation", "cust_nation", "l_year").agg(money(F.col("r")).alias("revenue"))
    )


def q8(t: Tables, nation: str = "NATION_3", kind: str = "ECONOMY") -> DataFrame:
    """A nation's share of its region's purchases of one kind of part, by year."""
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    home = n.where(F.col("n_name") == nation).select(F.col("n_regionkey").alias("home"))
    within = n.join(F.broadcast(home), F.col("n_regionkey") == F.col("home")).select(F.col("n_nationkey").alias("cn"))
    cust = t("customer").join(within, F.col("c_nationkey") == F.col("cn")).select("c_custkey")
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    supp = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supp_nation"))
    part = t("part").where(F.col("p_type") == kind).select("p_partkey")
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", revenue().alias("r"))
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    own = F.sum(F.when(F.col("supp_nation") == nation, F.col("r")).otherwise(0.0))
    return rows.groupBy("o_year").agg(F.round(F.try_divide(own, F.sum("r")), 6).alias("mkt_share"))


def q10(t: Tables, begin: str = "1997-10-01", end: str = "1998-01-01", k: int = 20) -> DataFrame:
    orders = t("orders").where((F.col("o_orderdate") >= _day(begin)) & (F.col("o_orderdate") < _day(end))).select("o_orderkey", "o_custkey")
    items = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", revenue().alias("r"))
    sums = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(money(F.col("r")).alias("revenue"))
    cust = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sums.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(F.col("revenue").desc(), "c_custkey").limit(k)


def q14(t: Tables) -> DataFrame:
    """Share of promotional parts in revenue, by month of shipping."""
    part = t("part").select("p_partkey", (F.col("p_type") == "PROMO").alias("promo"))
    items = t("lineitem").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), revenue().alias("r"))
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("month").agg(F.round(F.try_divide(100.0 * F.sum(F.when(F.col("promo"), F.col("r")).otherwise(0.0)), F.sum("r")), 4).alias("promo_revenue"))


def q15(t: Tables) -> DataFrame:
    """The best supplier of each quarter."""
    items = t("lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), revenue().alias("r"))
    sums = items.groupBy("y", "q", "l_suppkey").agg(money(F.col("r")).alias("total_revenue"))
    best = sums.groupBy("y", "q").agg(F.max(F.struct("total_revenue", (-F.col("l_suppkey")).alias("s"))).alias("b"))
    best = best.select(F.concat("y", F.lit("Q"), "q").alias("quarter"), (-F.col("b.s")).alias("l_suppkey"), "b.total_revenue")
    return best.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("quarter", "s_suppkey", "s_name", "total_revenue")


def q18(t: Tables, quantity: int = 300, k: int = 100) -> DataFrame:
    sums = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty")).where(F.col("sum_qty") > quantity)
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty").orderBy(F.col("o_totalprice").desc(), "o_orderdate", "o_orderkey").limit(k)


def q13v(t: Tables) -> DataFrame:
    """How many customers have how many orders."""
    per = t("customer").select("c_custkey").join(t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left")
    return per.groupBy(F.coalesce("n", F.lit(0)).alias("c_count")).agg(F.count(F.lit(1)).alias("custdist"))


def q17v(t: Tables, brand: str = "Brand#11") -> DataFrame:
    """Yearly revenue lost without small orders of a brand's parts."""
    part = t("part").where(F.col("p_brand") == brand).select("p_partkey")
    items = t("lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    mean = items.groupBy("p_partkey").agg((0.5 * F.avg("l_quantity")).alias("low"))
    return items.join(mean, "p_partkey").where("l_quantity < low").agg(F.round(F.sum("l_extendedprice") / 7.0, 2).alias("avg_yearly"))


def q19v(t: Tables) -> DataFrame:
    """Revenue by brand under alternative conditions on size and quantity."""
    part = t("part").select("p_partkey", "p_brand", "p_size")
    items = t("lineitem").select("l_partkey", "l_quantity", revenue().alias("r"))
    size, qty = F.col("p_size"), F.col("l_quantity")
    test = (size.between(1, 5) & qty.between(1, 11)) | (size.between(6, 15) & qty.between(10, 20)) | (size.between(16, 50) & qty.between(20, 30))
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).where(test).groupBy("p_brand").agg(money(F.col("r")).alias("revenue"))


def q22v(t: Tables, since: str = "2001-01-01") -> DataFrame:
    """By nation, customers without orders since a day whose balance is above the mean of the positive ones."""
    cust = t("customer")
    mean = cust.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = cust.crossJoin(F.broadcast(mean)).where("c_acctbal > mean")
    idle = rich.join(t("orders").where(F.col("o_orderdate") >= _day(since)).select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal"))


def local_parts(t: Tables) -> DataFrame:
    """Per region and returnflag, mergeable partial states of the lines sold to its customers."""
    cust = t("customer").join(nation_regions(t), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")
    items = t("lineitem").select("l_orderkey", "l_returnflag", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return items.groupBy("r_name", "l_returnflag").agg(F.sum("l_quantity").alias("sum"), F.count(F.lit(1)).alias("n_adds"), F.max("l_quantity").alias("top"))


def local_to_global(t: Tables) -> DataFrame:
    """The global view as the merge of the regions' local ones."""
    return merged_parts(local_parts(t))


def merged_parts(parts: DataFrame) -> DataFrame:
    whole = parts.groupBy("l_returnflag").agg(F.sum("sum").alias("sum_qty"), F.sum("n_adds").alias("n"), F.max("top").alias("max_qty"))
    return whole.withColumn("avg_qty", F.round(F.col("sum_qty") / F.col("n"), 6))


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {f.__name__: f for f in (q1, q3, q5, q6, q7, q8, q10, q14, q15, q18, q13v, q17v, q19v, q22v, local_to_global)}
