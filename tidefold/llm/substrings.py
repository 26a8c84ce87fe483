"""Substring dedup: Rabin-Karp hashes of all fixed-length word windows, counted in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import written

#: Words of a chunk, whose windows are hashed together; bytes of text for each bucket of hashes, about.
CHUNK_WORDS, BUCKET_BYTES = 1 << 20, 16 << 20

#: Two odd multipliers: the first's hash is kept whole, the second's picks the bucket.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

#: Kinds of rows in the first shuffle.
HASHES, DOCS, HITS = 0, 1, 2
ROWS = "bucket long, chunk long, kind int, wide boolean, a binary, b binary"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Hasher:
    """Rolling hashes modulo 2^64 of all windows of a run of at most `most` words, by prefix sums."""

    def __init__(self, width: int, most: int):
        self.width = width
        self.up = [_powers(b, most + 1) for b in BASES]
        self.down = [_powers(pow(b, -1, 1 << 64), most + 1) for b in BASES]

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """The sum of word[i + j] * base^-j over a window's j, for each start i."""
        n = len(words)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.down[k][:n], out=sums[1:])
        return (sums[self.width :] - sums[: n + 1 - self.width]) * self.up[k][: n + 1 - self.width]


def _packed(positions: np.ndarray) -> tuple[bytes, bool]:
    """Ascending positions as differences, and whether these take 32 bits."""
    steps = np.diff(positions, prepend=0)
    wide = bool(len(steps) and steps.max() > 0xFFFF)
    return steps.astype(np.uint32 if wide else np.uint16).tobytes(), wide


def _unpacked(data: bytes, wide: bool) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32 if wide else np.uint16), dtype=np.int64)


def _hashed(width: int, buckets: int):
    """Per chunk: its documents; the windows found twice within it; each other hash once, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width, 2 * CHUNK_WORDS)
        task, chunks = TaskContext.get().partitionId(), 0
        digest = xxhash.xxh3_64_intdigest

        def row(bucket: int, kind: int, a: bytes, b: bytes, wide: bool = False):
            return (bucket, (task << 32) + chunks, kind, wide, a, b)

        def flushed(runs: list[np.ndarray], docs: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
            words = np.concatenate(runs)
            lengths = np.array([len(x) for x in runs])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            full, pick = hasher.windows(words, 0), hasher.windows(words, 1)
            valid = np.zeros(len(words), bool)
            for s, n in zip(starts, lengths, strict=True):
                valid[s : s + n - width + 1] = True
            at = np.flatnonzero(valid[: len(full)])
            full = full[at]
            bucket = ((pick[at] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(full, kind="stable")
            same = full[order][1:] == full[order][:-1]
            twice, first = np.zeros(len(at), bool), np.ones(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            first[order[1:][same]] = False
            keys = np.array(docs, dtype=np.int64)
            # What only passes through the buckets' tasks is dealt out by a hash: tasks all number their chunks from 0.
            through = buckets + xxhash.xxh3_64_intdigest(f"{task} {chunks}") % buckets
            yield row(through, DOCS, keys[:, :2].tobytes(), np.stack([keys[:, 2], keys[:, 3], starts], 1).astype(np.int64).tobytes())
            if twice.any():
                data, wide = _packed(at[twice])
                yield row(through, HITS, b"", data, wide)
            at, full, bucket = at[first], full[first], bucket[first]
            order = np.argsort(bucket, kind="stable")
            filled, edges = np.unique(bucket[order], return_index=True)  # a chunk has at most as many rows as windows, however many buckets there are
            for k, part in zip(filled.tolist(), np.split(order, edges[1:]), strict=True):
                data, wide = _packed(at[part])
                yield row(k, HASHES, full[part].tobytes(), data, wide)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            names = ["bucket", "chunk", "kind", "wide", "a", "b"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        runs, docs, held = [], [], 0
        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().split()
                step = CHUNK_WORDS
                for lo in range(0, max(len(words) - width + 1, 0), step):
                    piece = words[lo : lo + step + width - 1]
                    runs.append(np.fromiter(map(digest, piece), np.uint64, len(piece)))
                    docs.append((k1, k2, lo, len(piece) - width + 1))
                    held += len(piece)
                    if held >= CHUNK_WORDS - width:
                        yield table(list(flushed(runs, docs)))
                        runs, docs, held = [], [], 0
                        chunks += 1
        if runs:
            yield table(list(flushed(runs, docs)))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's hashes, the positions, by chunk, of those that come from two chunks or more."""
    hashes, origin = [], []
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "wide", "a", "b")), strict=True))
        passed = [r for r in rows if r[1] != HASHES]
        if passed:
            yield _rows(passed)
        for chunk, _, wide, a, b in (r for r in rows if r[1] == HASHES):
            hashes.append(np.frombuffer(a, np.uint64))
            origin.append((chunk, wide, b))
    if not hashes:
        return
    whole = np.concatenate(hashes)
    order = np.argsort(whole)
    same = whole[order][1:] == whole[order][:-1]
    found = np.zeros(len(whole), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    out, at = [], 0
    for (chunk, wide, b), part in zip(origin, hashes, strict=True):
        mask = found[at : at + len(part)]
        at += len(part)
        if mask.any():
            data, wide = _packed(_unpacked(b, wide)[mask])
            out.append((chunk, HITS, wide, b"", data))
    if out:
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "kind", "wide", "a", "b"])


def _merged(width: int):
    """Of a chunk: its documents' maximal runs of words that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, keys, places = [], None, None
        for batch in batches:
            for kind, wide, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "wide", "a", "b")), strict=True):
                if kind == DOCS:
                    keys, places = np.frombuffer(a, np.int64).reshape(-1, 2), np.frombuffer(b, np.int64).reshape(-1, 3)
                else:
                    hits.append(_unpacked(b, wide))
        if not hits:
            return
        at = np.unique(np.concatenate(hits))
        doc = np.searchsorted(places[:, 2], at, side="right") - 1
        word = at - places[doc, 2] + places[doc, 0]
        opens = np.ones(len(at), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + width)
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(at)) - 1
        spans: dict[int, tuple[list[int], list[int]]] = {}
        for d, s, e in zip(doc[begin].tolist(), word[begin].tolist(), (word[end] + width).tolist(), strict=True):
            x = spans.setdefault(d, ([], []))
            x[0].append(s)
            x[1].append(e)
        ids = keys[list(spans)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([x[0] for x in spans.values()], pa.list_(pa.int64())), pa.array([x[1] for x in spans.values()], pa.list_(pa.int64()))],
            names=["k1", "k2", "begins", "ends"],
        )

    return run


def spans(docs: DataFrame, width: int = 35) -> DataFrame:
    """Per document (k1, k2, text binary) with repeated windows: k1, k2, and the spans of words they cover.

    Each chunk of words sends each window hash once, whatever its count, with its position: so a window that a
    third of the corpus repeats costs a few bytes a chunk. A bucket's hashes meet in one task, 16 MB of text's worth; hashes agree
    in 64 bits and, independently, in their bucket, so false matches stay below one in ten million million windows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = 4 * max(-(-total // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select("k1", "k2", "text").mapInArrow(_hashed(width, buckets), ROWS)
    found = rows.groupBy("bucket").applyInArrow(_counted, "chunk long, kind int, wide boolean, a binary, b binary")
    merged = found.groupBy("chunk").applyInArrow(_merged(width), "k1 long, k2 long, begins array<long>, ends array<long>")
    return merged.groupBy("k1", "k2").agg(F.collect_set(F.struct("begins", "ends")).alias("parts"))


def _applied(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, parts in zip(batch.column(1), batch.column(2), strict=True):
                words, parts = text.as_py().split(), parts.as_py()
                n = len(words)
                cuts = sorted((b, e) for p in parts or () for b, e in zip(p["begins"], p["ends"], strict=True))
                if cuts:
                    rest, at = [], 0
                    for b, e in cuts:
                        if b > at:
                            rest += words[at:b]
                        at = max(at, e)
                    words = rest + words[at:]
                joined = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and `kept`, the words left joined by single spaces (or their SHA-256).

    A word goes if a window of `width` words that covers it has the same words as a window that starts anywhere
    else, in the same document or another. Windows are judged on the input. Null and empty texts, and texts shorter than a window, keep all they have;
    repeated rows repeat each other and so lose their windows; very long texts go in several chunks; an empty table gives an empty
    table. Other columns of `docs`, whatever their names, aren't read.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(7), text, F.col(id_col)).alias("k2"), text.cast("binary").alias("text"))
    cut = written(spans(rows, width), "spans")
    joined = rows.join(cut, ["k1", "k2"], "left").select("doc_id", "text", "parts")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_applied(digest), f"doc_id {kind}, n_words long, n_removed long, kept string")
