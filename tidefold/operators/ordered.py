"""Folds whose order counts: by window sums where the order can be taken apart, else one streamed pass over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are Python objects at once.
SLICE = 4096


def ordered_fold(ops: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], object], finish: Callable[[object], tuple], schema: str) -> DataFrame:
    """by and the columns of `schema`: `finish` of the state that `step` builds from each object's rows in order.

    Rows are dealt by object and sorted in their partitions, by Spark, which spills; a task holds a batch of rows and
    one state, however long an object's log is. Values come as Arrow has them: 64-bit integers stay exact, nulls are None, maps are pairs.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spread = ops.repartition(*by).sortWithinPartitions(*by, *order)
    whole = T.StructType([ops.schema[c] for c in by] + T.StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(whole)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                for row in batch.slice(first, SLICE).to_pylist():
                    at = tuple(row[c] for c in by)
                    if current != at:
                        if current is not None:
                            out.append((*current, *finish(state)))
                        current, state = at, start()
                    state = step(state, row)
                if len(out) > SLICE:
                    yield table(out)
                    out = []
        if current is not None:
            out.append((*current, *finish(state)))
        if out:
            yield table(out)

    return spread.mapInArrow(run, whole)


def bounded_counter(ops: DataFrame, by: list[str], order: list[str], replicas: list[int]) -> DataFrame:
    """by, value, bound, rights (a map by replica), refused.

    `bound` (long_val: bound, n_adds: initial value) shares out what is above the bound, the first replicas getting the
    remainder; `bound_strict` the same for a value that must stay above it; `inc` gives its replica rights; `dec` is refused beyond its
    replica's rights; `transfer` (id: to replica) is refused beyond half the giver's rights; `rebalance`, by a replica with less than half
    an even share, moves half the difference from the richest (of equal ones the smallest id). A null amount counts as 0.
    """

    def start():
        return {"value": 0, "bound": 0, "rights": dict.fromkeys(replicas, 0), "refused": 0}

    def step(s, row):
        r, n, op, rights = row["replica"], row["long_val"] or 0, row["op"], s["rights"]
        rights.setdefault(r, 0)
        if op in ("bound", "bound_strict"):
            s["bound"], s["value"] = n + (op == "bound_strict"), row["n_adds"] or 0
            share, rest = divmod(s["value"] - s["bound"], len(rights))
            for k, x in enumerate(sorted(rights)):
                rights[x] += share + (k < rest)
        elif op == "inc":
            rights[r] += n
            s["value"] += n
        elif op == "dec":
            if n > rights[r]:
                s["refused"] += 1
            else:
                rights[r] -= n
                s["value"] -= n
        elif op == "transfer":
            if n > rights[r] // 2:
                s["refused"] += 1
            else:
                rights[r] -= n
                rights[row["id"]] = rights.get(row["id"], 0) + n
        elif op == "rebalance":
            left = s["value"] - s["bound"]
            if rights[r] < left // len(rights) // 2:
                richest = min(rights, key=lambda x: (-rights[x], x))
                n = min((rights[richest] - rights[r]) // 2, left - rights[r])
                rights[richest] -= n
                rights[r] += n
        return s

    return ordered_fold(ops, by, order, start, step, lambda s: (s["value"], s["bound"], list(s["rights"].items()), s["refused"]), "value long, bound long, rights map<int,long>, refused long")


def counter_array(ops: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, counts, where some operations touch all positions the array has by then.

    inc, dec (pos, long_val); inc_all, dec_all (long_val); set_size (pos). The array grows with zeros as needed. A position gets its own
    operations and the total of those on all positions, less that total as it stood when the position came to be.
    """
    op, n = F.col("op"), F.coalesce("long_val", F.lit(0))
    size = F.when(op == "set_size", F.col("pos")).when(op.isin("inc", "dec"), F.col("pos") + 1).cast("long")
    every = F.when(op == "inc_all", n).when(op == "dec_all", -n).otherwise(F.lit(0)).cast("long")
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ops.select(*by, "pos", F.when(op == "inc", n).when(op == "dec", -n).alias("own"), size.alias("size"), *[c for c in dict.fromkeys(order) if c not in (*by, "pos")], every.alias("every"))
    rows = rows.select(*by, "pos", "own", "every", F.coalesce(F.max("size").over(before), F.lit(0)).alias("had"), F.coalesce(F.max("size").over(past), F.lit(0)).alias("has"), F.sum("every").over(past).alias("then"))
    own = rows.where("own is not null").groupBy(*by, F.col("pos").cast("long").alias("p")).agg(F.sum("own").alias("n"))
    born = rows.where("has > had").select(*by, F.explode(F.sequence(F.col("had"), F.col("has") - 1)).alias("p"), (-F.col("then")).alias("n"))
    total = rows.groupBy(*by).agg(F.sum("every").alias("total"))
    cells = own.unionByName(born).groupBy(*by, "p").agg(F.sum("n").alias("n"))
    whole = cells.select(*by, "p", "n", F.lit(None).cast("long").alias("total")).unionByName(total.select(*by, F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("n"), "total"))
    whole = whole.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "n")))).alias("cells"), F.max("total").alias("total"))
    return whole.select(*by, F.transform("cells", lambda x: x["n"] + F.col("total")).alias("counts"))
