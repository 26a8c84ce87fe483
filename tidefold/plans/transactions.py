"""Transactions over an op-log: atomic batches, reads of one snapshot, own writes, reads at a clock."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import clocks
from tidefold.model import OBJECT, shaped

Fold = Callable[[DataFrame], DataFrame]


def as_of(ops: DataFrame, clock: Column | dict[int, int], column: str = "clk") -> DataFrame:
    """The operations whose clock is covered by a clock."""
    if isinstance(clock, dict):
        clock = F.create_map(*[x for k, v in clock.items() for x in (F.lit(k).cast("smallint"), F.lit(v).cast("bigint"))])
    return ops.where(clocks.lower_or_equal(F.col(column), clock))


def read_objects(ops: DataFrame, keys: list[tuple[str, str, str]], fold: Fold) -> DataFrame:
    """Some objects' states, (key, type, bucket) each, of one snapshot."""
    wanted = ops.sparkSession.createDataFrame(keys, "key string, crdt_type string, bucket string")
    return fold(ops.join(F.broadcast(wanted), OBJECT, "left_semi"))


class Transaction:
    """Operations that become visible together. Reads see the snapshot at the start and the transaction's own writes."""

    def __init__(self, log: DataFrame, txn_id: str | None = None):
        self.snapshot, self.pending, self.txn_id, self.open = log, None, txn_id or uuid.uuid4().hex, True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")

    def update(self, ops: DataFrame) -> None:
        self._check()
        new = ops.withColumn("txn_id", F.lit(self.txn_id))
        self.pending = new if self.pending is None else self.pending.unionByName(new, allowMissingColumns=True)

    def read(self, fold: Fold) -> DataFrame:
        self._check()
        return fold(self.snapshot if self.pending is None else self.snapshot.unionByName(self.pending, allowMissingColumns=True))

    def commit(self, path: str | None = None) -> DataFrame:
        """The log with the writes; with `path`, they are appended to the log's table there in one job: all or
        none where the store renames files atomically, as HDFS does; on others readers may see part of a job that is under way."""
        self._check()
        self.open = False
        if self.pending is None:
            return self.snapshot
        if path:
            shaped(self.pending).write.mode("append").partitionBy("bucket").parquet(path)
        return self.snapshot.unionByName(self.pending, allowMissingColumns=True)

    def abort(self) -> DataFrame:
        self._check()
        self.open, self.pending = False, None
        return self.snapshot
