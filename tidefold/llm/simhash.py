"""SimHash near-dedup by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import components, golay, minhash
from tidefold.llm.common import written

#: Words of a shingle, the seed of their hash, differing bits of a link, shingles counted at once.
SHINGLE, SEED, BITS, AT_ONCE = 4, 42, 4, 1 << 16

#: The fingerprint's segments: first bit and width.
SEGMENTS = ((0, 23), (23, 23), (46, 18))

#: Keys that one task of the join takes, about.
TASK_KEYS = 2_000_000


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 for a text without words."""
    words = text.lower().split()  # of bytes: lowers A-Z and parts at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)]
        counts += _counts(np.array(part, "<u8"))
    return _majority(counts, len(starts))


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles, given by their hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        counts += _counts(hashes[at : at + AT_ONCE])
    return _majority(counts, len(hashes))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__t")).mapInArrow(run, f"doc_id {kind}, fp long")


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): fingerprints within 4 bits share a key.

    The bits fall into three segments. If one of them is free of errors, one of the other two has at most 2: the first is taken as it is and
    the second by its nearby codewords. If all have errors, two have exactly 1: of those, one is decoded and the other taken by its
    nearby codewords, both ways, so that the word that is decoded here is a neighbour there.
    """
    parts = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    exact = [golay.decoded(p) for p in parts]
    near = [golay.nearby(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    rows, out, table = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, index = near[j]
                rows.append(row)
                out.append((table << 40) | (parts[i][row] << 12) | index)
                table += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        row, index = near[j]
        rows.append(row)
        out.append((table << 40) | (exact[i][row] << 12) | index)
        row, index = near[i]
        other = index != exact[i][row]  # the pair of both decoded words is there already
        rows.append(row[other])
        out.append(((table << 40) | (index << 12) | exact[j][row])[other])
        table += 1
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            row, key = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the same components among distinct fingerprints as all links within `bits` do."""
    left, right, rest = [], [], fps
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            x = open_.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                open_.extend(found)
    return left, right


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: the links within each key, verified, as few as span its components."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS
        left, right = [fp[two][ok]], [fp[two + 1][ok]]
        for s, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = forest(fp[s : s + n])
            left += a
            right += b
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"]) if len(pairs) else None

    held, last = [], None  # batches of the key that may go on, put together once it ends
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(k):
            continue
        if last is None or last == k[-1]:
            held.append((k, f))
            last = k[-1]
            continue
        cut = int(np.searchsorted(k, k[-1]))
        held.append((k[:cut], f[:cut]))
        if (out := links(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))) is not None:
            yield out
        held, last = [(k[cut:], f[cut:])], k[-1]
    if held and (out := links(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))) is not None:
        yield out


def joined(prints: DataFrame) -> DataFrame:
    """Of a written table of distinct fingerprints `fp`: node, root, of those that links within BITS bits join."""
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-61 * prints.count() // TASK_KEYS))
    spread = prints.select("fp").mapInArrow(_keyed, "key long, fp long")
    met = spread.repartition(parts, "key").sortWithinPartitions("key")
    return components.roots(met.mapInArrow(_linked, "a long, b long").distinct())


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach, itself included).

    Equal fingerprints are one node, so copies of any number cost one row each; nodes within 4 bits link. All keys of all nodes
    are joined by sorting; within a key, however many share it, a spanning set of the verified links is found by absorbing
    whole neighbourhoods, so links grow with the nodes and not with their square; a key's nodes are 8 bytes each in its task.

    Null and empty texts have fingerprint zero, linked like any other. Null ids never name a component that has another id; repeated
    rows are given each; very long texts are read whole, some shingles at once; an empty table gives an empty table. Other columns of
    `docs`, whatever their names, aren't read.
    """
    table = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = joined(nodes)
    rooted = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = minhash.SHINGLE, percent: int = minhash.PERCENT) -> DataFrame:
    """Per row: doc_id, component_id, where texts link whose sets of `shingle`-word shingles have a Jaccard similarity of percent / 100.

    The sets' fingerprints are joined as op9's are, by Golay indices, within 4 bits; the texts of a component are compared exactly. Fingerprints
    of 64 bits don't meet all such pairs: at 0.8 they differ in some 10 bits, and keys that meet 10 errors meet unrelated texts as well (the README
    has figures). So what lies in different components is compared, exactly too, where it shares a band of the shingles' minima.
    """
    return minhash.clustered(docs, id_col, text_col, shingle, percent, print_of, joined)
