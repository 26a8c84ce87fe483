"""Packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm import ranking, tokens
from tidefold.llm.common import written


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, packs of that kind), longest length first.

    Each length, from the longest, goes to the packs with the most room left, as many packs of one kind at once
    as there are pieces; a new pack opens only when no pack has room. The work grows with the number of distinct
    lengths and kinds, not with the number of pieces.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, pack: tuple[int, ...], count: int) -> None:
        if room not in by_room:
            by_room[room] = {}
            heapq.heappush(rooms, -room)
        by_room[room][pack] = by_room[room].get(pack, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not by_room[-rooms[0]]:
                del by_room[-heapq.heappop(rooms)]
            room = -rooms[0] if rooms else -1
            if room < length:  # new packs, each filled before the next one opens
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    put(size - each * length, (length,) * each, full)
                if rest:
                    put(size - rest * length, (length,) * rest, 1)
                break
            pack, count = by_room[room].popitem()
            used = min(left, count)
            if count > used:
                by_room[room][pack] = count - used
            put(room - length, (*pack, length), used)
            left -= used
    return sorted((pack, n) for kinds in by_room.values() for pack, n in kinds.items())


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of a length, by rank, go."""
    out, taken, sequence = [], {}, 0
    for pack, count in packs:
        offset = 0
        for length in pack:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + count, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, and with `with_ids` its ids. A document is cut into runs of `size` ids and a rest."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(tokenizer).encode_array, np.array([end_id], "<u4")
        for batch in rows:
            for first, texts in tokens.batches(batch.column(1)):
                ids, ends = encode(texts)
                ids = np.insert(ids, ends, end)  # after each document's own
                totals = np.diff(ends, prepend=0) + 1
                begins = np.cumsum(totals) - totals
                n = -(-totals // size)
                doc = np.repeat(np.arange(len(totals)), n)
                starts = size * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
                lengths = np.minimum(totals[doc] - starts, size)
                at = begins[doc] + starts
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), lengths.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(first + doc)), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals[doc]))]
                if with_ids:  # pieces lie one after the other
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids).

    Every document is tokenized once, closed by `end_id`, and cut into full sequences and a rest; the lengths are
    packed by their histogram, at most `size` numbers, and the packing is joined back to the pieces by their rank
    within their length. A null or empty text has the end id alone. Very long texts are encoded alone, whole. Repeated rows are
    packed each; null ids are kept; an empty table packs into none. Other columns of `docs`, whatever their names, aren't read.
    """
    table = written(pieces(docs, id_col, text_col, size, tokenizer or tokens.default_path(), end_id, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    places = spark.createDataFrame(slots(patterns(histogram, size)), "__l long, __from long, __to long, __seq long, __off long")
    rows = table.withColumn("__h", F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"))
    rows = rows.withColumn("__b", ranking.top_bits(F.col("__h"), ranking.bucket_bits(sum(histogram.values()))))
    rows = ranking.ranked(rows, ["length"], "__b", [F.col(c) for c in ("__h", "doc_id", "start", "ids_crc32")], "__r", "__n_of")
    here = (F.col("length") == F.col("__l")) & (F.col("__r") >= F.col("__from")) & (F.col("__r") < F.col("__to"))
    # The places are kinds of packs, bounded by `size` and the distinct lengths, never by the documents.
    return rows.join(F.broadcast(places), here).select(*table.columns, (F.col("__seq") + F.col("__r") - F.col("__from")).alias("sequence_id"), F.col("__off").alias("offset"))


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, tokenizer: str | None = None, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """Per sequence: sequence_id, ids, n_tokens and parts (doc_id, start, offset, length, in order of the offset): what a trainer reads.

    `ids` are the pieces' ids and then `pad_id` up to `size`; a sequence whose n_tokens is a power of two isn't padded.
    """
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    whole = packed(docs, id_col, text_col, size, tokenizer, end_id, with_ids=True).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("p"))
    n = F.col("n_tokens").cast("int")
    pad = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(size) - n)
    return whole.select(
        "sequence_id",
        F.concat(F.flatten(F.transform("p", lambda x: x["ids"])), F.array_repeat(F.lit(pad_id), pad)).alias("ids"),
        "n_tokens",
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("parts"),
    )
