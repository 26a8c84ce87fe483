"""Declared tables: types, defaults, invariants, views and indexes, on Spark's own SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.functions.values import NATIVE_OF, object_type
from tidefold.sources.scratch import delete, scratch


@dataclass(frozen=True)
class Declared:
    """A column: its SQL type, default, and an invariant as SQL over the row."""

    name: str
    sql_type: str
    default: object = None
    invariant: str | None = None

    @property
    def native(self) -> T.DataType:
        return NATIVE_OF.get(self.sql_type.upper(), T.StringType())

    @property
    def object_type(self) -> str:
        return object_type(self.sql_type)


@dataclass
class Catalog:
    """Tables by name. `policy` says what wins when an upsert and a remove are concurrent.

    A table lies in a folder of the shared place: an INSERT appends files, an UPDATE or DELETE writes a new version, so plans
    don't grow with the number of statements. A statement that breaks an invariant fails and changes nothing.
    """

    spark: SparkSession
    tables: dict[str, tuple[list[Declared], list[str], str]] = field(default_factory=dict)
    paths: dict[str, list[str] | None] = field(default_factory=dict)

    def create_table(self, name: str, columns: list[Declared], key: list[str], policy: str = "remove_wins") -> DataFrame:
        if policy not in ("remove_wins", "add_wins"):
            raise ValueError(f"unknown policy {policy}")
        missing = [k for k in key if k not in [c.name for c in columns]]
        if missing:
            raise ValueError(f"unknown key columns {missing}")
        self.tables[name] = (columns, key, policy)
        self.paths[name] = None
        schema = T.StructType([T.StructField(c.name, c.native, c.name not in key, {"object_type": c.object_type, "policy": policy}) for c in columns])
        df = self.spark.createDataFrame([], schema)
        df.createOrReplaceTempView(name)
        return df

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows` appended: absent columns get their defaults; a row that breaks an invariant fails the statement."""
        columns, _, _ = self.tables[name]
        unknown = [c for c in rows.columns if c not in [d.name for d in columns]]
        if unknown:
            raise ValueError(f"unknown columns {unknown} of {name}")
        full = self._checked(name, rows.select(*[self._value(rows, c).alias(c.name) for c in columns]))
        staged = self._written(name, full)  # a failing row fails here, before the table has any of it
        self.paths[name] = [*(self.paths[name] or []), staged]
        return self._shown(name)

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        for c in self.tables[name][0]:
            if c.invariant:
                rows = rows.where(F.assert_true(F.coalesce(F.expr(c.invariant), F.lit(False)), F.lit(f"{name}.{c.name}: {c.invariant}")).isNull())
        return rows

    def _written(self, name: str, rows: DataFrame) -> str:
        path = scratch(self.spark, name)
        rows.write.parquet(path)
        return path

    def _shown(self, name: str) -> DataFrame:
        df = self.spark.read.schema(self.spark.table(name).schema).parquet(*self.paths[name])
        df.createOrReplaceTempView(name)
        return df

    def _replaced(self, name: str, rows: DataFrame) -> DataFrame:
        old, self.paths[name] = self.paths[name] or [], [self._written(name, rows)]
        out = self._shown(name)
        for path in old:
            delete(self.spark, path)
        return out

    def _value(self, rows: DataFrame, c: Declared) -> Column:
        if c.name not in rows.columns:
            return F.lit(c.default).cast(c.native)
        value = F.col(c.name).cast(c.native)
        return value if c.default is None else F.coalesce(value, F.lit(c.default).cast(c.native))

    def update(self, name: str, assignments: dict[str, str], where: str = "true") -> DataFrame:
        old = self.spark.table(name)
        hit = F.coalesce(F.expr(where), F.lit(False))
        out = old.select(*[F.when(hit, F.expr(assignments[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c, t in old.dtypes])
        return self._replaced(name, self._checked(name, out))

    def delete(self, name: str, where: str = "true") -> DataFrame:
        return self._replaced(name, self.spark.table(name).where(~F.coalesce(F.expr(where), F.lit(False))))

    def create_view(self, name: str, sql: str) -> DataFrame:
        df = self.spark.sql(sql)
        df.createOrReplaceTempView(name)
        return df

    def create_index(self, name: str, table: str, columns: list[str]) -> DataFrame:
        """A copy of the table, written in the order of the index's columns: a read of a range of them skips the files and row groups beside it."""
        df = self.spark.table(table).repartitionByRange(*columns).sortWithinPartitions(*columns)
        out = self.spark.read.schema(df.schema).parquet(self._written(name, df))
        out.createOrReplaceTempView(name)
        return out

    def select(self, name: str, columns: list[str] | None = None, where: str = "true") -> DataFrame:
        df = self.spark.table(name).where(where)
        unknown = [c for c in columns or [] if c not in df.columns]
        if unknown:
            raise ValueError(f"unknown columns {unknown} of {name}")
        return df.select(*columns) if columns else df

    def drop(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.tables.pop(name, None)
        for path in self.paths.pop(name, None) or []:
            delete(self.spark, path)
