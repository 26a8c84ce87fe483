"""Token-id files: an independent zstandard frame for each document, a seek table at the end.

A file is a sequence of zstandard frames in the public seekable layout. Each document's ids, little-endian
unsigned 32-bit integers, make one frame, or several if it has more than FRAME_IDS; each frame carries its own
checksum. The last frame before the seek table is the index: a JSON head, then the ids' counts. The seek table is
a skippable frame with each frame's compressed size, size and checksum (low 32 bits of XXH64), so a reader finds
and decompresses the frames of the documents it wants and no others.

Spark's own text writer puts the bytes down, through the store's file system and commit protocol: a file's chunks are its rows,
and the layout's magic number, with which every file ends, is the separator of rows. A chunk that isn't the last ends with an
empty skippable frame whose last bytes are that number.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm import tokens
from tidefold.llm.common import new_dir, written

#: Fixed values of the public seekable layout.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
MAGIC = struct.pack("<I", SEEKABLE)

#: Ids in a frame at most; bytes of text for each file about, and what a document counts besides its text; bytes of a chunk about.
FRAME_IDS, FILE_BYTES, DOC_BYTES, CHUNK_BYTES = 1 << 20, 32 << 20, 64, 2 << 20


class Writer:
    """Writes documents in the order they come to a file object; `close` ends the file and returns (documents, ids)."""

    def __init__(self, out, level: int = 1):
        self.out, self.entries, self.ids, self.counts = out, [], [], []
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def _frame(self, data: bytes) -> None:
        frame = self.zstd.compress(data)
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id, ids: bytes) -> None:
        for k in range(0, len(ids), 4 * FRAME_IDS):
            self._frame(ids[k : k + 4 * FRAME_IDS])
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)

    def cut(self) -> None:
        """An empty skippable frame that ends with the magic number."""
        self.out.write(struct.pack("<IIIB", SKIPPABLE, 9, 0, CHECKSUMS) + MAGIC)
        self.entries.append(struct.pack("<III", 17, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        self._frame(json.dumps({"ids": self.ids, "counts": self.counts}).encode())
        table = b"".join(self.entries) + struct.pack("<IB", len(self.entries), CHECKSUMS) + MAGIC
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return len(self.ids), sum(self.counts)


class Reader:
    """Reads a file object that can seek; frames are verified against the seek table as they are read.

    `ids`, `counts`, `starts` tell of each document its id, its number of ids, and the number of ids before it.
    """

    def __init__(self, file):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a token-id file")
        file.seek(size - 9 - 12 * count)
        self.entries = list(struct.iter_unpack("<III", file.read(12 * count)))
        self.offsets = [0, *accumulate(e[0] for e in self.entries)]
        head = json.loads(self._frame(count - 1))
        self.ids, self.counts = head["ids"], head["counts"]
        self.starts = [0, *accumulate(self.counts)][: len(self.counts)]
        self.frames = [k for k, e in enumerate(self.entries[:-1]) if e[1]]  # skippable ones hold nothing
        self.first = [0, *accumulate(-(-n // FRAME_IDS) for n in self.counts)]

    def _frame(self, k: int) -> bytes:
        taken, size, checksum = self.entries[k]
        self.file.seek(self.offsets[k])
        out = self.zstd.decompress(self.file.read(taken), max_output_size=size)
        if len(out) != size or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return out

    def document(self, k: int) -> bytes:
        """The ids of the k-th document; no other document's frames are touched."""
        return b"".join(map(self._frame, self.frames[self.first[k] : self.first[k + 1]]))


class _Chunks:
    """What a writer has put and no row has taken yet."""

    def __init__(self):
        self.parts, self.size = [], 0

    def write(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def row(self) -> pa.RecordBatch:
        whole = b"".join(self.parts)
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_pydict({"chunk": pa.array([whole[: -len(MAGIC)]], pa.binary())})  # which Spark's writer adds


def _plain(kind: T.DataType, column: Column) -> Column:
    """An id as JSON can hold it: a number, or a text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        raise ValueError(f"ids of type {kind.simpleString()} have no order to be written in")
    return column.cast("string")


def write(docs: DataFrame, out_dir: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every document, in ascending order of the id, into the files of a new folder.

    The rows are dealt by ranges of (id, hash of the text), so no one id's copies are all a task sees, unless the texts are
    equal too; part numbers in the files' names follow the ranges. Null ids come first; a null or empty text has the end id alone;
    very long texts take several frames; repeated rows are written each; an empty table makes a file without documents.
    Other columns of `docs`, whatever their names, aren't read.
    """
    path = tokenizer or tokens.default_path()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("__text"), F.lit(0)) + DOC_BYTES)).collect()[0][0] or 0
    key = [F.col("__id"), F.xxhash64("__text")]
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), *key).sortWithinPartitions(*key)
    rows = rows.select(_plain(docs.schema[id_col].dataType, F.col("__id")), "__text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, out = tokens.encoder(path).encode_array, np.array([end_id], "<u4"), _Chunks()
        writer = Writer(out)
        for batch in batches:
            for first, texts in tokens.batches(batch.column(1)):
                ids, ends = encode(texts)
                view = memoryview(np.insert(ids, ends, end)).cast("B")  # after each document's own
                bounds = [0, *(4 * (ends + np.arange(1, len(ends) + 1))).tolist()]
                for doc_id, a, b in zip(batch.column(0).slice(first, len(ends)).to_pylist(), bounds, bounds[1:], strict=False):
                    writer.add(doc_id, view[a:b])
                    if out.size >= CHUNK_BYTES:
                        writer.cut()
                        yield out.row()
        writer.close()
        yield out.row()

    chunks = rows.mapInArrow(put, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    chunks.write.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(out_dir)


def _files(spark: SparkSession, out_dir: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out_dir)
    return files.select(F.regexp_extract("path", "part-([0-9]+)[^/]*$", 1).cast("int").alias("part"), "content")


def _readers(batch: pa.RecordBatch) -> Iterator[tuple[int, Reader]]:
    for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield part, Reader(pa.BufferReader(content.as_buffer()))


def _typed(kind: T.DataType) -> tuple[str, Column]:
    """The type of ids in the files, and the id as it was."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long", F.col("doc_id").cast(kind)
    return "string", F.unhex("doc_id") if isinstance(kind, T.BinaryType) else F.col("doc_id").cast(kind)


def read(spark: SparkSession, out_dir: str, id_type: T.DataType | None = None) -> DataFrame:
    """Per document, read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    held, doc_id = _typed(id_type or T.LongType())

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, r in _readers(batch):
                n = len(r.ids)
                sums = [zlib.crc32(r.document(k)) for k in range(n)]
                columns = [pa.array([part] * n, pa.int32()), pa.array(r.ids, pa.int64() if held == "long" else pa.string()), *(pa.array(x, pa.int64()) for x in (r.starts, r.counts, sums))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = written(_files(spark, out_dir).mapInArrow(get, f"part int, doc_id {held}, at long, n_tokens long, ids_crc32 long"), "read")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    sizes = sizes.select(F.col("part").alias("__part"), F.coalesce(before, F.lit(0)).alias("__base"))
    return rows.join(sizes, F.col("part") == F.col("__part")).select(doc_id.alias("doc_id"), (F.col("__base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes `docs` (doc_id, text) into a fresh folder of the shared place and reads it back."""
    out = new_dir(docs.sparkSession, "tokens")
    write(docs, out, tokenizer=tokenizer)
    return read(docs.sparkSession, out, docs.schema["doc_id"].dataType)


def documents(spark: SparkSession, out_dir: str, wanted: list, id_type: T.DataType | None = None) -> DataFrame:
    """doc_id, ids of the wanted documents; of the files only their frames are decompressed."""
    held, doc_id = _typed(id_type or T.LongType())
    asked = set(wanted)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, r in _readers(batch):
                for k, d in enumerate(r.ids):
                    if d in asked:
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d], pa.int64() if held == "long" else pa.string()), "ids": pa.array([np.frombuffer(r.document(k), "<i4").tolist()], pa.list_(pa.int32()))})

    return _files(spark, out_dir).mapInArrow(get, f"doc_id {held}, ids array<int>").select(doc_id.alias("doc_id"), "ids")
