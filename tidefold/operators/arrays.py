"""Counter arrays and rows of typed arrays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.functions.values import packed
from tidefold.model import OBJECT


def counter_array(ops: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """by, counts: a dense array of the sums by position. Positions without operations hold 0.

    Operations inc, dec (pos, long_val) and set_size (pos) commute; those on all positions need the ordered fold.
    """
    delta = F.when(F.col("op") == "inc", F.col("long_val")).when(F.col("op") == "dec", -F.col("long_val")).otherwise(F.lit(0))
    at = F.when(F.col("op") == "set_size", F.col("pos") - 1).otherwise(F.col("pos"))
    sums = ops.groupBy(*by, at.alias("pos")).agg(F.sum(delta).alias("n")).where("pos >= 0")
    blank = sums.groupBy(*by).agg(F.max("pos").alias("top")).select(*by, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("pos"), F.lit(0).cast("bigint").alias("n"))
    cells = sums.unionByName(blank).groupBy(*by, "pos").agg(F.sum("n").alias("n"))
    return cells.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("counts"))


def single(array: Column, pos: int) -> Column:
    """The value at a position, 0 beyond the end."""
    return F.coalesce(F.get(array, F.lit(pos)), F.lit(0))


def sub(array: Column, positions: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: F.coalesce(F.get(array, p), F.lit(0)))


def except_position(array: Column, pos: int) -> Column:
    return F.filter(array, lambda _, i: i != pos)


def except_ranges(array: Column, ranges: list[int]) -> Column:
    """Without the inclusive ranges given as start, end, start, end ..."""
    inside = lambda i: [i.between(a, b) for a, b in zip(ranges[::2], ranges[1::2], strict=True)]

    def outside(_, i):
        out = F.lit(False)
        for x in inside(i):
            out = out | x
        return ~out

    return F.filter(array, outside)


def span(array: Column, begin: int, end: int) -> Column:
    """[begin, end), cut to what there is."""
    return F.slice(array, begin + 1, max(end - begin, 0))


def custom(array: Column, positions: list[int] | None) -> Column | None:
    """What an index list asks for: nothing if absent; all if one negative; one; a range if two, ascending; else those positions."""
    if not positions:
        return None
    if len(positions) == 1:
        return array if positions[0] < 0 else sub(array, positions)
    if len(positions) == 2 and positions[1] > positions[0]:
        return span(array, *positions)
    return sub(array, positions)


def compared(value: Column, op: str, other) -> Column:
    return {"eq": value == other, "neq": value != other, "lt": value < other, "leq": value <= other, "gt": value > other, "geq": value >= other}[op]


def _value(df: DataFrame, name: str, pos: Column) -> Column:
    """An array's value at a position; 0, or empty data, beyond its end."""
    kind = df.schema[name].dataType.elementType
    none = F.lit(bytearray()) if isinstance(kind, T.BinaryType) else F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    return F.coalesce(F.get(F.col(name), pos), none)


@dataclass(frozen=True)
class MultiArray:
    """A table of rows with the arrays ints, floats, data, sums and counts."""

    df: DataFrame

    def full(self, *names: str) -> DataFrame:
        return self.df.select("key", *(names or ("ints", "floats", "data", "sums", "counts")))

    def position(self, **at: int) -> DataFrame:
        """The value of each named array at a position, as the array's name; 0 or empty beyond its end."""
        return self.df.select("key", *[_value(self.df, n, F.lit(p)).alias(n) for n, p in at.items()])

    def range(self, **at: tuple[int, int]) -> DataFrame:
        return self.df.select("key", *[span(F.col(n), *r).alias(n) for n, r in at.items()])

    def sub(self, **at: list[int]) -> DataFrame:
        return self.df.select("key", *[F.array(*[_value(self.df, n, F.lit(p)) for p in ps]).alias(n) for n, ps in at.items()])

    def custom(self, **at: list[int]) -> DataFrame:
        return self.df.select("key", *[c.alias(n) for n, ps in at.items() if (c := custom(F.col(n), ps)) is not None])

    def where(self, array: str, pos: int, op: str, value, *names: str) -> DataFrame:
        """The named arrays of rows whose array holds, at a position, a value that compares so; no value, no row."""
        return self.df.where(compared(F.get(F.col(array), F.lit(pos)), op, value)).select("key", *(names or ("ints", "floats", "data", "sums", "counts")))

    def where_average(self, pos: int, op: str, value, *names: str) -> DataFrame:
        mean = F.try_divide(F.get(F.col("sums"), F.lit(pos)).cast("double"), F.get(F.col("counts"), F.lit(pos)))
        return self.df.where(compared(mean, op, value)).select("key", *(names or ("data",)))

    def data_and_int(self, pos: int) -> DataFrame:
        return self.df.select("key", "data", F.get("ints", F.lit(pos)).alias("int_value"))


def multi_array(ops: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """by, ints, floats, data, sums, counts from the operations of rows' arrays.

    inc_int, inc_float (pos, long_val or dbl_val), inc_avg (pos, long_val, n_adds) add up; set_data (pos, bin_val) keeps the
    latest by (ts, replica); set_size (elem: the array, pos: its size) pads. Numbers pad with 0, data with null.
    """
    of = {"inc_int": "ints", "inc_float": "floats", "inc_avg": "sums", "set_data": "data"}
    array = F.col("elem")
    for op, name in of.items():
        array = F.when(F.col("op") == op, name).otherwise(array)
    pos = F.when(F.col("op") == "set_size", F.col("pos") - 1).otherwise(F.col("pos"))
    real = F.col("op") != "set_size"
    cells = ops.withColumn("__a", array).groupBy(*by, "__a", pos.alias("__p")).agg(
        F.sum(F.when(real, F.col("long_val"))).alias("i"),
        F.sum(F.when(real, F.col("dbl_val"))).alias("f"),
        F.sum(F.when(real, F.col("n_adds"))).alias("n"),
        F.max_by(F.col("bin_val"), F.when(F.col("op") == "set_data", packed(F.col("ts"), F.col("replica")))).alias("d"),
    )
    cell = F.struct("i", "f", "n", "d")
    whole = cells.groupBy(*by).agg(*[x for a in ("ints", "floats", "data", "sums") for x in (F.map_from_entries(F.collect_list(F.when(F.col("__a") == a, F.struct("__p", cell)))).alias(f"m_{a}"), F.max(F.when(F.col("__a") == a, F.col("__p"))).alias(f"top_{a}"))])

    def dense(a: str, field: str, pad) -> Column:
        keys = F.when(F.col(f"top_{a}").isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(f"top_{a}")))
        return F.transform(keys, lambda p: F.coalesce(F.try_element_at(F.col(f"m_{a}"), p)[field], pad) if pad is not None else F.try_element_at(F.col(f"m_{a}"), p)[field])

    return whole.select(*by, dense("ints", "i", F.lit(0)).alias("ints"), dense("floats", "f", F.lit(0.0)).alias("floats"), dense("data", "d", None).alias("data"), dense("sums", "i", F.lit(0)).alias("sums"), dense("sums", "n", F.lit(0)).alias("counts"))


def spread(ops: DataFrame, positions: Column, changes: Column, value: str = "long_val") -> DataFrame:
    """Operations on several positions as one for each: `positions` and `changes` are arrays; a single change serves all positions.

    A range, both ends included, is `F.sequence(begin, end)`.
    """
    each = F.transform(positions, lambda p, k: F.struct(p.cast("int").alias("p"), F.get(changes, F.when(F.size(changes) == 1, F.lit(0)).otherwise(k)).alias("v")))
    rows = ops.drop("pos", value).withColumn("__each", F.explode(each))
    return rows.withColumns({"pos": F.col("__each.p"), value: F.col("__each.v")}).drop("__each")


def initial(rows: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """Whole rows (by, ts, replica, ints, floats, data, sums, counts) as the operations that make them, so that later ones add to them."""
    none = lambda kind: F.lit(None).cast(kind)
    held = [*by, "ts", "replica"]
    parts = []
    for op, array, column in (("inc_int", F.col("ints"), "long_val"), ("inc_float", F.col("floats"), "dbl_val"), ("set_data", F.col("data"), "bin_val"), ("inc_avg", F.arrays_zip("sums", "counts"), "")):
        x = rows.select(*held, F.posexplode(array).alias("pos", "v"))
        value = {column: F.col("v")} if column else {"long_val": F.col("v.sums"), "n_adds": F.col("v.counts")}
        kinds = {"long_val": "bigint", "dbl_val": "double", "n_adds": "bigint", "bin_val": "binary"}
        parts.append(x.select(*held, F.lit(op).alias("op"), none("string").alias("elem"), "pos", *[value.get(c, none(k)).cast(k).alias(c) for c, k in kinds.items()]))
    return reduce(DataFrame.unionByName, parts)
