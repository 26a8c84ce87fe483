"""Near copies by Jaccard similarity of word shingles: MinHash bands for candidates, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import components
from tidefold.llm.common import written

#: Words of a shingle, the least similarity of a link in percent.
SHINGLE, PERCENT = 5, 80

#: A band holds ROWS minima. A pair of similarity s shares none of them with probability (1 - s^ROWS)^BANDS: 1.2e-7 at 0.8.
ROWS, BANDS = 5, 40

#: Nodes of a key beyond which it is thinned before its sets are held, and the parts that its nodes are dealt into for that.
HOT, PARTS = 4096, 64

#: Shingles whose permutations are held at once.
AT_ONCE = 2048

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct runs of `size` words, sorted; a shorter text is one run. Words are lowered in A-Z and parted by ASCII white space."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in split), np.uint64, len(split))
    k = min(size, len(split))
    n = len(split) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of the minima of a set of shingles; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        part = _FACTORS[:, None] * found[None, at : at + AT_ONCE] + _OFFSETS[:, None]
        least = np.minimum(least, part.min(axis=1))
    least = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[:, j])
    return out.view(np.int64)


def node(found: np.ndarray) -> int:
    """The hash of a set of shingles."""
    return int(_mixed(found).sum(dtype=np.uint64).view(np.int64))


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (places in `sets`) that span the same components as all pairs of Jaccard similarity percent / 100 or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owners = np.repeat(np.arange(n), sizes)
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which))
    begins, posted = ends - np.bincount(which), owners[order]
    mine = np.split(which, np.cumsum(sizes)[:-1])
    rest, links = np.ones(n, bool), []
    for first in range(n):
        if not rest[first]:
            continue
        rest[first] = False
        open_ = [first]
        while open_ and rest.any():
            x = open_.pop()
            both = np.bincount(np.concatenate([posted[begins[w] : ends[w]] for w in mine[x]]), minlength=n)
            near = np.flatnonzero(rest & ((100 + percent) * both >= percent * (sizes[x] + sizes)))
            rest[near] = False
            links += [(x, int(y)) for y in near]
            open_ += near.tolist()
    return links


def _met(spread: DataFrame) -> DataFrame:
    """Of distinct (key, node): key, node, n of the keys that n > 1 nodes share; keys that the same nodes share are taken once.

    With a column `group`, keys whose nodes are all of one group are left out.
    """
    n = F.count(F.lit(1))
    apart = (F.count("group") < n) | (F.min("group") < F.max("group")) if "group" in spread.columns else F.lit(True)
    several = spread.groupBy("key").agg(n.alias("n"), apart.alias("apart")).where("n > 1 and apart").select("key", "n")
    shared = written(spread.join(several, "key").select("key", "node", "n"), "shared")
    of = shared.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    taken = of.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return shared.join(taken.select("key"), "key", "left_semi")


def _thinned(met: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (key, node) of keys that many nodes share: the (key, node) still to be compared, and links (a, b) found already.

    All nodes of a key are compared with its first, in parallel, and those near it linked to it. One minus the similarity is a metric, so
    such a node at distance d from the first can only link to nodes within d + t of it, t being a link's largest distance: if all the nodes
    that aren't near the first are farther away than that, it has no more links to give. Of a large group of copies of one text nothing is left.
    """
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, sizes = [], []
            for a, b in zip(batch.column(3), batch.column(4), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both.append(len(np.intersect1d(a, b, assume_unique=True)))
                sizes.append(len(a) + len(b))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(both, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "node", "first", "both", "sizes"])

    first = met.groupBy("key").agg(F.min("node").alias("first"))
    first = first.join(known.select(F.col("node").alias("first"), F.col("set").alias("first_set")), "first").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = met.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")).join(known, "node").join(first, ["key", "part"])
    rows = written(rows.select("key", "node", "first", "set", "first_set").mapInArrow(compared, "key long, node long, first long, both long, sizes long"), "compared")
    near = (100 + percent) * F.col("both") >= percent * F.col("sizes")
    rows = rows.select("key", "node", "first", near.alias("near"), (1 - F.col("both") / (F.col("sizes") - F.col("both"))).alias("far"))
    least = rows.where("not near").groupBy("key").agg(F.min("far").alias("least"))
    left = rows.join(least, "key").where(~F.col("near") | (F.col("far") >= F.col("least") - (1 - percent / 100) - 1e-9))
    return left.select("key", "node"), rows.where("near and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def _parted(met: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(key, node) of narrower keys: nodes of a key that can link share one of them.

    Sets of similarity p share p of the larger at least. So in any order of a key's shingles, each of the two has one of those that they share
    among its first |set| - p |set| + 1. Rarest first, the shingles of a template that thousands of texts are filled into come last.
    """
    sets = met.select("key", "node").join(known, "node")
    rows = sets.select("key", "node", F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("set"), F.lit(8)), lambda i: F.substring("set", i, F.lit(8)))).alias("shingle"))
    rows = written(rows, "shingles")
    of = rows.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("c"))
    lists = rows.join(of, ["key", "shingle"]).groupBy("key", "node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("all"))
    n = F.size("all")
    first = F.explode(F.slice("all", F.lit(1), n - F.expr(f"cast((size(all) * {percent}L + 99) div 100 as int)") + 1)).alias("x")
    return lists.select("key", "node", first).where("x.c > 1").select(F.xxhash64("key", "x.shingle").alias("key"), "node")


def _held(met: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (key, node, n): the (key, node) whose sets a task compares, and links (a, b) found on the way.

    Keys of more than HOT nodes are thinned, those still so large go by narrower keys, and those of them that are too large are thinned.
    """
    few, many = F.col("n") <= HOT, met.where(F.col("n") > HOT)
    held, links = met.where(few), met.select(F.col("key").alias("a"), F.col("node").alias("b")).limit(0)
    for narrow in (True, False):
        if many.isEmpty():
            break
        left, found = _thinned(many.select("key", "node"), known, percent)
        left, links = written(_met(left), "left"), links.unionByName(found)
        if narrow:
            held, many = held.unionByName(left.where(few)), left.where(~few)
            if not many.isEmpty():
                left = written(_met(_parted(many, known, percent)), "parted")
                held, many = held.unionByName(left.where(few)), left.where(~few)
        else:
            held = held.unionByName(left)
    return held.select("key", "node"), links


def _grouped(nodes: DataFrame, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, group, n: the components of 2 to HOT nodes that `joined` makes of the nodes' fingerprints `fp`."""
    prints = written(nodes.where("fp is not null").select("fp").distinct(), "prints")
    root = joined(prints).select(F.col("node").alias("fp"), "root")
    of = nodes.where("fp is not null").select("node", "fp").join(root, "fp", "left").select("node", F.coalesce("root", "fp").alias("group"))
    n = of.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= HOT))
    return written(of.join(n, "group").select("node", "group", "n"), "groups")


def clustered(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    print_of: Callable[[np.ndarray], int] | None = None,
    joined: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Per row: doc_id, component_id (the smallest id that links reach, itself included).

    Texts with the same set of shingles are one node, so copies of any number cost one row each; nodes whose sets have a
    Jaccard similarity of percent / 100 or more link. Nodes that share the key of a band are compared exactly, and links span
    the components among them by absorbing whole neighbourhoods, so links grow with the nodes and not with their square.
    Keys that the same nodes share are taken once. A key's sets are held in one task, 8 bytes a shingle; where more than HOT nodes share a
    key, `_held` first takes out those that can link to nothing but copies of the key's first node, and parts the rest by rare shingles.

    With `print_of`, a set's fingerprint, and `joined`, which joins them to components, the nodes of a component of up to HOT are compared
    first of all, as those of one key; of the bands' keys only those that reach beyond one such component are taken.

    Null and empty texts are one node; null ids never name a component that has another id; repeated rows are given each; very long
    texts are read whole; an empty table gives an empty table. Other columns of `docs`, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__t"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys = [], [], []
            for t in batch.column(1):
                found = shingles(t.as_py(), shingle)
                nodes.append(node(found))
                prints.append(print_of(found) if print_of and len(found) else None)
                keys.append(bands(found))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            prints = pa.array(prints, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), prints, lists], names=["doc_id", "node", "fp", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = [shingles(t.as_py(), shingle) for t in batch.column(1)[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in part], pa.int64()), pa.array([s.tobytes() for s in part], pa.binary())], names=["node", "set"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list) -> pa.RecordBatch | None:
            found = forest([np.frombuffer(s, np.uint64) for _, s in held], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[x[k]][0] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]) if found else None

        last, held = None, []
        for batch in batches:
            for key, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != last:
                    if (out := links(held)) is not None:
                        yield out
                    last, held = key, []
                held.append((n, s.as_py()))
        if (out := links(held)) is not None:
            yield out

    table = written(rows.mapInArrow(signed, f"doc_id {kind}, node long, fp long, keys array<long>"), "signed")
    nodes = written(table.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    if joined:
        groups = _grouped(nodes, joined)
        spread = nodes.select("node", "keys").join(groups.select("node", "group"), "node", "left").select("node", "group", F.explode("keys").alias("key"))
        met = written(_met(spread).unionByName(groups.select(F.col("group").alias("key"), "node", "n")), "met")
    else:
        met = written(_met(nodes.select("node", F.explode("keys").alias("key"))), "met")
    one = written(nodes.join(met.select("node").distinct(), "node").select(F.col("least").alias("__least")), "one")
    there = rows.join(one, F.col("doc_id") == F.col("__least"), "left_semi")
    known = written(there.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]), "sets")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    held, found = _held(met, known, percent)
    grouped = held.join(known, "node").select("key", "node", "set").repartition(parts, "key").sortWithinPartitions("key")
    root = components.roots(grouped.mapInArrow(linked, "a long, b long").unionByName(found).distinct())
    rooted = nodes.join(root, nodes["node"] == root["node"], "left").select(nodes["node"], "least", F.coalesce("root", nodes["node"]).alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
