"""Leaderboards: the best K ids by score, with ties, removes or running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators.sets import uncovered

K = 100


def _best(df: DataFrame, by: list[str], k: int, ties: bool) -> DataFrame:
    """Spark cuts each partition to its own best k before the shuffle, so a board is K rows a task."""
    place = [F.col("score").desc()] if ties else [F.col("score").desc(), F.col("id").desc()]
    rank = F.rank() if ties else F.row_number()
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("__p", rank.over(over.orderBy(*place))).where(F.col("__p") <= k).drop("__p")


def topk(ops: DataFrame, by: list[str], k: int = K, ties: bool = True) -> DataFrame:
    """by, id, score, data: each id's best score; the best k, and by default all that tie with the k-th."""
    adds = ops.where("op = 'topk_add'")
    best = adds.groupBy(*by, "id").agg(F.max("score").alias("score"), F.max_by("bin_val", F.struct("score", "ts", "replica")).alias("data"))
    return _best(best, by, k, ties)


def topk_removable(ops: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """by, id, score, data: removes (clk) take the additions they cover; of an id's others the best counts; exactly k."""
    left = uncovered(ops.where("op = 'topk_add'"), ops.where("op = 'topk_rem'"), [*by, "id"])
    best = left.groupBy(*by, "id").agg(F.max("score").alias("score"), F.max_by("bin_val", F.struct("score", "ts", "replica")).alias("data"))
    return _best(best, by, k, ties=False)


def topsum(ops: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """by, id, score: ids' running sums of additions less subtractions; exactly the best k."""
    delta = F.when(F.col("op") == "topsum_add", F.col("score")).when(F.col("op") == "topsum_sub", -F.abs("score"))
    sums = ops.groupBy(*by, "id").agg(F.sum(delta).alias("score")).where("score is not null")
    return _best(sums, by, k, ties=False)


def get_n(board: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n, ties by the larger id."""
    return _best(board, by, n, ties=False)


def get_above(board: DataFrame, value: int) -> DataFrame:
    """Those on the board with a score of `value` or more."""
    return board.where(F.col("score") >= value)


def with_threshold(board: DataFrame, candidates: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """`candidates` with `replicate`: whether each could enter the board, so must leave its replica."""
    floor = board.groupBy(*by).agg(F.min("score").alias("__floor"), F.count(F.lit(1)).alias("__n"))
    out = candidates.join(floor, by, "left") if by else candidates.crossJoin(F.broadcast(floor))  # without groups, one row
    return out.withColumn("replicate", F.col("__n").isNull() | (F.col("__n") < k) | (F.col("score") >= F.col("__floor"))).drop("__floor", "__n")
