"""Keyed tables: typed partial reads, predicates, aggregates and writes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.operators import sets

#: Keys given as a list become literals up to this number, a joined table above it.
LITERAL_KEYS = 1000

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
SIX = ("eq", "neq", "lt", "leq", "gt", "geq")


@dataclass(frozen=True)
class Variable:
    """A value that a process read has found: the column of its one row."""

    name: str


@dataclass(frozen=True)
class Compare:
    """field op value. A value of another kind than the field's drops the row; it is no error."""

    field: str
    op: str
    value: object

    def column(self, schema: T.StructType) -> Column:
        if self.op not in SIX:
            raise ValueError(f"unknown comparison {self.op}")
        kind = schema[self.field].dataType
        number, text, data, flag = (isinstance(kind, k) for k in (NUMBERS, T.StringType, T.BinaryType, T.BooleanType))
        v = self.value
        if isinstance(v, Variable):
            v = F.col(v.name)
        elif isinstance(v, bool):
            if not flag or self.op not in ("eq", "neq"):
                return F.lit(False)
        elif isinstance(v, (int, float)):
            if not number:
                return F.lit(False)
        elif isinstance(v, str):
            if not text or self.op not in ("eq", "neq"):
                return F.lit(False)
        elif isinstance(v, bytes):
            if not (data or text) or self.op not in ("eq", "neq"):
                return F.lit(False)
            v = v if data else v.decode()
        a = F.col(self.field)
        return {"eq": a == v, "neq": a != v, "lt": a < v, "leq": a <= v, "gt": a > v, "geq": a >= v}[self.op]

    def fields(self) -> list[str]:
        return [self.field]


@dataclass(frozen=True)
class Anything:
    """Always true; names a field that a conjunction is to return."""

    field: str

    def column(self, schema: T.StructType) -> Column:
        return F.lit(True)

    def fields(self) -> list[str]:
        return [self.field]


@dataclass(frozen=True)
class All:
    """All of the parts hold."""

    parts: tuple

    def column(self, schema: T.StructType) -> Column:
        return reduce(lambda a, b: a & b, [p.column(schema) for p in self.parts], F.lit(True))

    def fields(self) -> list[str]:
        return list(dict.fromkeys(f for p in self.parts for f in p.fields()))


@dataclass(frozen=True)
class Table:
    """Rows by key. The key may be several columns; reads return them with what they ask for."""

    df: DataFrame
    key: tuple[str, ...]

    def _select(self, df: DataFrame, columns: Iterable[str] | None) -> DataFrame:
        return df if columns is None else df.select(*dict.fromkeys([*self.key, *columns]))

    def _among(self, keys, inside: bool) -> DataFrame:
        """Rows whose key is, or isn't, among `keys`: a frame with the key's columns, or a list of keys."""
        if not isinstance(keys, DataFrame):
            keys = [k if isinstance(k, tuple) else (k,) for k in keys]
            if len(self.key) == 1 and len(keys) <= LITERAL_KEYS:
                found = F.col(self.key[0]).isin([k[0] for k in keys]) if keys else F.lit(False)
                return self.df.where(found if inside else ~F.coalesce(found, F.lit(False)))
            schema = T.StructType([self.df.schema[k] for k in self.key])
            keys = self.df.sparkSession.createDataFrame(keys, schema)
        return self.df.join(keys.select(*self.key).distinct(), list(self.key), "left_semi" if inside else "left_anti")

    def _is(self, key) -> Column:
        key = key if isinstance(key, tuple) else (key,)
        return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(self.key, key, strict=True)])

    def scan(self) -> DataFrame:
        return self.df

    def keys(self) -> DataFrame:
        return self.df.select(*self.key)

    def has_key(self, key) -> DataFrame:
        """One row, `present`."""
        return self.df.where(self._is(key)).limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))

    def get(self, key, columns: Iterable[str] | None = None) -> DataFrame:
        return self._select(self.df.where(self._is(key)), columns)

    def get_many(self, keys, columns: Iterable[str] | None = None) -> DataFrame:
        return self._select(self._among(keys, True), columns)

    def get_each(self, reads: dict) -> DataFrame:
        """Each key with the columns read of it; columns that a key doesn't ask for are null."""
        columns = list(dict.fromkeys(c for cs in reads.values() for c in cs))
        wanted = {c: [k for k, cs in reads.items() if c in cs] for c in columns}
        rows = self._among(list(reads), True)
        return rows.select(*self.key, *[F.when(reduce(lambda a, b: a | b, [self._is(k) for k in ks]), F.col(c)).alias(c) for c, ks in wanted.items()])

    def project(self, *columns: str) -> DataFrame:
        return self._select(self.df, columns)

    def where(self, predicate, columns: Iterable[str] | None = None) -> DataFrame:
        """Rows that the predicate holds for; a conjunction returns the fields that it names."""
        rows = self.df.where(predicate.column(self.df.schema))
        return self._select(rows, columns or (predicate.fields() if isinstance(predicate, All) else None))

    def where_each(self, predicates: dict, columns: Iterable[str] | None = None) -> DataFrame:
        """Of the named keys, those that their own predicate holds for."""
        tests = [self._is(k) & p.column(self.df.schema) for k, p in predicates.items()]
        return self._select(self.df.where(reduce(lambda a, b: a | b, tests)), columns)

    def except_keys(self, keys, columns: Iterable[str] | None = None) -> DataFrame:
        return self._select(self._among(keys, False), columns)

    def except_key(self, key, columns: Iterable[str] | None = None) -> DataFrame:
        return self._select(self.df.where(~F.coalesce(self._is(key), F.lit(False))), columns)

    def except_where(self, keys, predicate, columns: Iterable[str] | None = None) -> DataFrame:
        return self._select(self._among(keys, False).where(predicate.column(self.df.schema)), columns)

    def except_key_where(self, key, predicate, columns: Iterable[str] | None = None) -> DataFrame:
        return self._select(self.except_key(key).where(predicate.column(self.df.schema)), columns)

    def aggregate(self, kind: str, field: str, keys=None, predicate=None, missing_as_zero: bool = False, out: str = "value") -> DataFrame:
        """One row: sum, avg (with its sum and count), max or min of a field, of some keys, under a predicate.

        A null counts as nothing, or, with `missing_as_zero`, as a row with 0. Nothing to aggregate gives null.
        """
        rows = self.df if keys is None else self._among(keys, True)
        rows = rows if predicate is None else rows.where(predicate.column(self.df.schema))
        value = F.coalesce(F.col(field), F.lit(0)) if missing_as_zero else F.col(field)
        return rows.agg(*_aggregates(kind, value, out))

    def process(self, before: DataFrame, after) -> DataFrame:
        """A read that uses another's result: `before`'s one row is at hand in `after(table)` as columns."""
        row = before.limit(1)
        return after(Table(self.df.crossJoin(F.broadcast(row)), self.key))

    def applied(self, ops: DataFrame, values: list[str], clock: str = "clk") -> DataFrame:
        """The table after a log of upserts and removes (op, key columns, values, ts, clk, and replica if there are several): removes win
        over what they are concurrent with, and of the upserts that are left the latest gives the row, of equal ones the larger replica's."""
        log = ops.withColumn("map_key", F.concat_ws("_", *[F.col(k).cast("string") for k in self.key])).withColumn("__o", F.lit(0))
        left = sets.remove_wins(log, ["__o"], clock)
        old = self.df.select(*self.key, *values, F.lit(-1).cast("bigint").alias("ts"), F.lit(-1).cast("bigint").alias("__r"))
        replica = F.col("replica").cast("bigint") if "replica" in ops.columns else F.lit(0).cast("bigint")
        gone = log.where("op = 'rem'").select(*self.key).distinct()
        old = old.join(gone, list(self.key), "left_anti")
        both = old.unionByName(left.select(*self.key, *values, F.col("ts").cast("bigint").alias("ts"), replica.alias("__r")))
        return both.groupBy(*self.key).agg(F.max_by(F.struct(*values), F.struct("ts", "__r")).alias("__v")).select(*self.key, "__v.*")


def _aggregates(kind: str, value: Column, out: str) -> list[Column]:
    if kind == "avg":
        total, n = F.sum(value), F.count(value)
        return [F.try_divide(total.cast("double"), n).alias(out), total.cast("double").alias(f"{out}_sum"), n.alias(f"{out}_count")]
    return [{"sum": F.sum, "max": F.max, "min": F.min}[kind](value).alias(out)]


def aggregate_states(states: list[DataFrame], kind: str, field: str = "value", out: str = "value") -> DataFrame:
    """One aggregate over the states of several objects."""
    return reduce(DataFrame.unionByName, [s.select(field) for s in states]).agg(*_aggregates(kind, F.col(field), out))
