"""Causal delivery: the operations of a stream in an order that respects their clocks, by tables, so that no task holds a site's queue."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidefold.functions import clocks
from tidefold.sources.scratch import delete

#: So many timestamps of one replica (or places in an order) are sorted together; blocks' totals join them.
BLOCK = 1 << 16

#: By site the timestamp that each replica has reached there.
Reach = dict[object, dict[int, int]]


def _block(of: str) -> Column:
    return F.expr(f"`{of}` div {BLOCK}").cast("bigint")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined by keys of which nulls are equal."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(right, on, how).drop(*[f"__right_{k}" for k in keys])


def places(df: DataFrame, by: list[str], order: list[str], place: str) -> DataFrame:
    """Adds the row's `place`, from 1, in its group by `order`, whose first column is an integer from 0. Rows meet only within a block of it."""
    keys = [*by, "__block"]
    df = df.withColumn("__block", _block(order[0]))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(before, F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return _same(df.withColumn(place, inside), starts, keys).withColumn(place, F.col("__start") + F.col(place)).drop("__block", "__start")


class _Delivery:
    """One batch of a stream's operations; the arguments are those of `deliver`."""

    def __init__(self, batch: DataFrame, number: int, by: str, replica: str, ts: str, deps: str, columns: list[str], at: str):
        self.spark, self.batch, self.number, self.at = batch.sparkSession, batch, number, at
        self.by, self.replica, self.ts, self.deps, self.columns = by, replica, ts, deps, columns
        self.site = batch.schema[by].dataType
        self.r, self.t = F.col(replica).cast("bigint"), F.col(ts).cast("bigint")
        #: What an operation names of other replicas.
        self.named = F.filter(F.map_entries(F.col(deps).cast("map<bigint,bigint>")), lambda e: e["key"] != self.r)

    def with_reach(self, ops: DataFrame, **reaches: Reach) -> DataFrame:
        """Each site's timestamps, one a replica, beside its operations; a site's clock is all that is sent to every task."""
        for name, reach in reaches.items():
            ops = _same(ops, F.broadcast(self.frame(name, reach)), [self.by], "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<bigint,bigint>")))
        return ops

    def frame(self, name: str, reach: Reach) -> DataFrame:
        """Made from Arrow, so that no Python worker is started for it."""
        of = T.StructType([T.StructField(self.by, self.site), T.StructField(name, T.MapType(T.LongType(), T.LongType()))])
        sites, maps = list(reach), [list(clock.items()) for clock in reach.values()]
        arrow = to_arrow_schema(of)
        return self.spark.createDataFrame(pa.Table.from_arrays([pa.array(sites, arrow.field(0).type), pa.array(maps, arrow.field(1).type)], schema=arrow), of)

    def version(self, name: str, number: int) -> str:
        return f"{self.at}/{name}/v{number}"

    def run(self) -> None:
        self.applied: Reach = {}
        ops = self.batch.select(*self.columns, self.deps)
        if self.number:
            ops = ops.unionByName(self.spark.read.parquet(self.version("held", self.number - 1)).select(*self.columns, self.deps))
            self.applied = {row[0]: row[1] for row in self.spark.read.parquet(self.version("clock", self.number - 1)).collect()}
        new = self.with_reach(ops, __applied=self.applied).where(F.col(self.replica).isNotNull() & (self.t > clocks.at(F.col("__applied"), self.r)))
        before = F.lag(self.t).over(Window.partitionBy(self.by, self.replica, _block(self.ts)).orderBy(self.ts))
        once = new.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") < self.t))
        once.drop("__applied").write.mode("overwrite").parquet(self.version("held", self.number))
        self.held = self.spark.read.parquet(self.version("held", self.number))

        reach, forward = self.settled(self.unbroken())
        out = self.inside(reach, __applied=self.applied)
        if forward:
            reach, out = self.ordered(reach)
        else:  # an operation names lower timestamps only, so (ts, replica) is an order, and reaches give places in it
            behind = lambda e: F.col(self.ts) - F.when(e["key"] > self.r, 1).otherwise(0)
            count = lambda n, e: n + F.least(F.greatest(behind(e), clocks.at(F.col("__applied"), e["key"])), e["value"])
            out = out.withColumn("seq", F.aggregate(F.map_entries("__reach"), F.lit(0).cast("bigint"), count))
        out.select(*self.columns, "seq").write.mode("overwrite").parquet(self.version("out", self.number))
        self.frame("clock", reach).coalesce(1).write.mode("overwrite").parquet(self.version("clock", self.number))
        delete(self.spark, f"{self.at}/closing")
        if self.number >= 2:  # the version before stays, for a batch may run again
            for name in ("held", "clock"):
                delete(self.spark, self.version(name, self.number - 2))

    def inside(self, reach: Reach, **more: Reach) -> DataFrame:
        return self.with_reach(self.held, __reach=reach, **more).where(self.t <= clocks.at(F.col("__reach"), self.r))

    def unbroken(self) -> Reach:
        """How far each replica's operations have come without a gap."""
        gap = F.min(F.when(F.col("__before") < self.t - 1, F.struct(self.t.alias("ts"), "__before")))
        blocks = self.held.groupBy(self.by, self.r.alias("__r"), _block(self.ts).alias("__block"))
        blocks = blocks.agg(F.min(self.t).alias("first"), F.max(self.t).alias("last"), gap["__before"].alias("stop"))
        over = Window.partitionBy(self.by, "__r").orderBy("__block")
        first = F.col("first") == F.coalesce(F.lag("last").over(over), clocks.at(F.col("__applied"), F.col("__r"))) + 1
        broken = ~first | F.lag("stop").over(over).isNotNull()
        blocks = self.with_reach(blocks, __applied=self.applied).withColumn("broken", broken)
        blocks = blocks.withColumn("breaks", F.sum(F.col("broken").cast("int")).over(over)).where("breaks = 0")
        reach = {site: dict(clock) for site, clock in self.applied.items()}
        for site, r, last in blocks.groupBy(self.by, "__r").agg(F.max(F.coalesce("stop", "last"))).collect():
            reach.setdefault(site, {})[r] = last
        return reach

    def settled(self, reach: Reach) -> tuple[Reach, bool]:
        """`reach`, cut until it has all that its operations name; and whether one of them names a timestamp that isn't below its own."""
        while True:
            lacks = F.exists(self.named, lambda e: e["value"] > clocks.at(F.col("__reach"), e["key"]))
            forward = F.exists(self.named, lambda e: e["value"] >= self.t)
            found = self.inside(reach).groupBy(self.by, self.r).agg(F.min(F.when(lacks, self.t)), F.bool_or(forward)).collect()
            for site, r, stop, _ in found:
                if stop is not None:
                    reach[site][r] = stop - 1
            if all(row[2] is None for row in found):
                return reach, any(row[3] for row in found)

    def ordered(self, reach: Reach) -> tuple[Reach, DataFrame]:
        """Reach and operations with `seq` where clocks name any timestamps.

        `need`: how many operations of each replica must come before. It is closed by looking up the needs of what it names, which doubles its
        reach each time. Operations that need themselves never come; of the others the sum of needs grows along each dependency.
        """
        ids = sorted({r for clock in reach.values() for r in clock})
        need = [f"__n{i}" for i in range(len(ids))]
        named = F.map_from_entries(self.named)
        first = {n: F.when(self.r == k, self.t - 1).otherwise(F.greatest(clocks.at(named, F.lit(k).cast("bigint")), clocks.at(F.col("__applied"), F.lit(k).cast("bigint")))) for n, k in zip(need, ids, strict=True)}
        rows = self.inside(reach, __applied=self.applied).withColumns(first).select(self.by, self.r.alias("__r"), self.t.alias("__t"), *need)
        tops = [F.max(n).alias(n) for n in need]
        total = lambda df: df.agg(F.sum(sum((F.col(n) for n in need), F.lit(0)).cast("decimal(38,0)"))).collect()[0][0]
        rows, was, number = self.running(rows, need, 0), None, 0
        while (now := total(rows)) != was:
            was, number = now, number + 1
            pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(n).alias("v")) for n, k in zip(need, ids, strict=True)]))
            asks = rows.select(self.by, "__r", "__t", pairs.alias("__p")).where("__p.k <> __r")
            asks = asks.select(self.by, F.col("__r").alias("__ask_r"), F.col("__t").alias("__ask_t"), F.col("__p.k").alias("__r"), F.col("__p.v").alias("__t"))
            got = _same(asks, rows, [self.by, "__r", "__t"]).select(self.by, F.col("__ask_r").alias("__r"), F.col("__ask_t").alias("__t"), *need)
            rows = self.running(rows.unionByName(got).groupBy(self.by, "__r", "__t").agg(*tops), need, number)
        own = F.coalesce(*[F.when(F.col("__r") == k, F.col(n)) for n, k in zip(need, ids, strict=True)])
        for site, r, stop in rows.where(own >= F.col("__t")).groupBy(self.by, "__r").agg(F.min("__t")).collect():
            reach[site][r] = stop - 1
        lacks = F.lit(False)
        for n, k in zip(need, ids, strict=True):
            lacks = lacks | (F.col(n) > clocks.at(F.col("__reach"), F.lit(k).cast("bigint")))
        rest = self.with_reach(rows, __reach=reach).where(F.col("__t") <= clocks.at(F.col("__reach"), F.col("__r")))
        for site, r, stop in rest.where(lacks).groupBy(self.by, "__r").agg(F.min("__t")).collect():
            reach[site][r] = stop - 1
        rows = self.with_reach(rows, __reach=reach).where(F.col("__t") <= clocks.at(F.col("__reach"), F.col("__r")))
        rows = places(rows.withColumn("__sum", sum((F.col(n) for n in need), F.lit(0))), [self.by], ["__sum", "__r"], "__place")
        at = self.held.withColumns({"__r": self.r, "__t": self.t})
        out = _same(at, rows.select(self.by, "__r", "__t", "__place"), [self.by, "__r", "__t"])
        start = F.aggregate(F.map_values("__applied"), F.lit(0).cast("bigint"), lambda n, v: n + v)
        return reach, self.with_reach(out, __applied=self.applied).withColumn("seq", start + F.col("__place"))

    def running(self, rows: DataFrame, need: list[str], number: int) -> DataFrame:
        """Each need the largest so far in its replica's order; written, so that the next round starts from a table."""
        rows, keys = rows.withColumn("__block", _block("__t")), [self.by, "__r", "__block"]
        over = Window.partitionBy(self.by, "__r").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy(*keys).agg(*[F.max(n).alias(f"{n}_top") for n in need])
        blocks = blocks.select(*keys, *[F.max(f"{n}_top").over(over).alias(f"{n}_top") for n in need])
        inside = Window.partitionBy(*keys).orderBy("__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = _same(rows.withColumns({n: F.max(n).over(inside) for n in need}), blocks, keys)
        rows = rows.select(self.by, "__r", "__t", *[F.greatest(n, f"{n}_top").alias(n) for n in need])
        at = self.version("closing", number)
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)


def deliver(stream: DataFrame, by: str, replica: str, ts: str, deps: str, columns: list[str], at: str, checkpoint: str, interval: str | None = None):
    """Operations of a stream as each `by` (a receiving site) may apply them, with `seq`, their place there; `delivered` reads them.

    An operation waits until its replica's earlier ones (from 1, without a gap) and all that its clock `deps` names have been applied; one that
    comes again is applied once, one without a replica or timestamp never, and a null clock names nothing. A batch writes under its own number,
    from the queue and the clocks that the one before left under `at`, so it may run again.
    """
    put = lambda batch, number: _Delivery(batch, number, by, replica, ts, deps, columns, at).run()
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def delivered(stream: DataFrame, at: str) -> DataFrame:
    """What `deliver` has let through so far."""
    return stream.sparkSession.read.parquet(f"{at}/out/v*")
