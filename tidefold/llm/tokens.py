"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker's cache holds, some 60 bytes each, so 30 MB; the longest piece kept, in bytes.
CACHE_PIECES, CACHE_BYTES = 500_000, 64

#: Bytes of text that are encoded together, unless one text alone has more; pieces that are learnt in one run; characters
#: that the library gets at once.
BATCH_BYTES, LEARN_PIECES, RAW_CHARS = 4 << 20, 1 << 15, 1 << 19

#: An odd multiplier, for hashes of pieces.
BASE = 0x9E3779B97F4A7C15

_held: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `starts` and have `counts` elements, one after the other."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class Cache:
    """Ids of pieces in flat arrays, found by a 64-bit hash and then compared byte by byte, so no hash can mislead."""

    def __init__(self):
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.keys = pa.array([], pa.large_binary())
        self.starts, self.counts, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, "<u4")

    @staticmethod
    def hashed(pieces: pa.Array) -> np.ndarray:
        """Of each piece (large_binary, none empty), the sum of its bytes times powers of a base, by running sums; mixed with its length."""
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        at = offsets - offsets[0]
        place = np.arange(len(text)) - np.repeat(at[:-1], np.diff(at))
        powers = np.full(int(place.max()) + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.add.reduceat((text + np.uint64(1)) * powers[place], at[:-1])
        x = sums ^ (sums >> np.uint64(29)) ^ (np.diff(at).astype(np.uint64) << np.uint64(57))
        return x * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 if it isn't held."""
        if not len(self.hashes):
            return np.full(len(pieces), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.where(self.hashes[at] == hashes, self.rows[at], -1)
        hit = np.flatnonzero(rows >= 0)
        same = pc.equal(self.keys.take(pa.array(rows[hit])), pieces.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        rows[hit[~same]] = -1
        self.used[rows[hit[same]]] = True
        return rows

    def put(self, pieces: pa.Array, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Holds more pieces; where there are too many, those found since the last time stay, at most half."""
        if len(self.rows) + len(pieces) > CACHE_PIECES:
            self._keep(np.flatnonzero(self.used)[: CACHE_PIECES // 2])
        fits = np.flatnonzero(pc.binary_length(pieces).to_numpy() <= CACHE_BYTES)[: max(CACHE_PIECES - len(self.rows), 0)]
        fits = fits[np.argsort(hashes[fits], kind="stable")]
        fits = fits[np.diff(hashes[fits], prepend=~hashes[fits[:1]]) != 0]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[fits]), len(self.hashes) - 1)
            fits = fits[self.hashes[at] != hashes[fits]]
        n, starts = len(self.counts), np.cumsum(counts) - counts
        order = np.searchsorted(self.hashes, hashes[fits])
        self.hashes, self.rows = np.insert(self.hashes, order, hashes[fits]), np.insert(self.rows, order, n + np.arange(len(fits)))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts[fits]) - counts[fits]])
        self.ids = np.concatenate([self.ids, _gathered(ids, starts[fits], counts[fits])])
        self.counts, self.used = np.concatenate([self.counts, counts[fits]]), np.concatenate([self.used, np.zeros(len(fits), bool)])
        self.keys = pa.concat_arrays([self.keys, pieces.take(pa.array(fits))])

    def _keep(self, rows: np.ndarray) -> None:
        new = np.full(len(self.counts), -1)
        new[rows] = np.arange(len(rows))
        held = new[self.rows] >= 0
        self.hashes, self.rows = self.hashes[held], new[self.rows[held]]
        self.ids = _gathered(self.ids, self.starts[rows], self.counts[rows])
        self.counts = self.counts[rows]
        self.starts, self.used = np.cumsum(self.counts) - self.counts, np.zeros(len(rows), bool)
        self.keys = self.keys.take(pa.array(rows))


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to encode(text, add_special_tokens=False).

    A byte-level BPE never merges across the cuts of its pre-tokenizer, and a single space or line feed between
    two other characters always begins a new cut. So for such a tokenizer the ids of a text are those of its
    pieces, " word" by " word", and a piece seen before needn't be encoded again. Texts with other runs of white
    space or with special tokens, and all texts of other kinds of tokenizer, are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and spec.get("truncation") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and model.get("type") == "BPE"
            and not model.get("dropout")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_piece = self.by_piece and not any(re.search(r"\s", t) for t in self.special)
        # White space but for single spaces and line feeds between other characters, and special tokens.
        odd = "".join(c for c in map(chr, range(0x3001)) if re.match(r"[^\S \n]", c))
        self.odd = "|".join([f"[{odd}]", "[ \n][ \n]", "^[ \n]", "[ \n]$", *map(re.escape, self.special)])
        self.cache = Cache()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)  # a byte-level token has a character a byte

    def _raw(self, texts: list[str]) -> Iterator[bytes]:
        chars = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        at = 0
        while at < len(texts):  # what the library returns takes some hundred bytes a token, so few texts at once
            to = max(at + 1, int(np.searchsorted(chars, RAW_CHARS + (chars[at - 1] if at else 0), side="right")))
            for e in self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False):
                yield array("I", e.ids).tobytes()
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode_array(pa.array(texts, pa.large_string()))
        bounds = [0, *ends.tolist()]
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, no nulls) one after the other, and where each text's end."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        if not whole.any():
            return self._by_piece(texts)
        ids, ends = self._by_piece(texts.filter(pa.array(~whole)))
        parts = np.split(ids, ends[:-1]) if len(ends) else []
        alone, pieced = self._raw(texts.filter(pa.array(whole)).to_pylist()), iter(parts)
        both = [np.frombuffer(next(alone), "<u4") if w else next(pieced) for w in whole.tolist()]
        return np.concatenate(both), np.cumsum([len(x) for x in both])

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cuts the texts where they lie, in one buffer, and looks each distinct piece up once."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        if data is None or not len(texts):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        begin, end = int(offsets[0]), int(offsets[-1])
        text = np.frombuffer(data, np.uint8)[begin:end]
        feeds = text == 10
        cut = np.zeros(end - begin + 1, bool)
        cut[:-1] = feeds | (text == 32)
        cut[1:] |= feeds
        cut[offsets - begin] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts + begin), data).dictionary_encode()
        ids, counts = self._distinct(pieces.dictionary.cast(pa.large_binary()))
        starts, which = np.cumsum(counts) - counts, pieces.indices.to_numpy()
        ends = np.cumsum(counts[which])
        return _gathered(ids, starts[which], counts[which]), np.concatenate(([0], ends))[np.searchsorted(cuts, offsets[1:] - begin)]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some distinct pieces, one after the other, and how many each has."""
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        hashes = Cache.hashed(pieces)
        rows = self.cache.find(pieces, hashes)
        hit, missed = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        held = _gathered(self.cache.ids, self.cache.starts[rows[hit]], self.cache.counts[rows[hit]])
        counts = np.zeros(len(pieces), np.int64)
        counts[hit] = self.cache.counts[rows[hit]]
        parts = [held]
        for at in range(0, len(missed), LEARN_PIECES):
            some = missed[at : at + LEARN_PIECES]
            new = pieces.take(pa.array(some))
            ids, n = self._learnt(new.cast(pa.large_string()).to_pylist())
            self.cache.put(new, hashes[some], ids, n)
            parts.append(ids)
            counts[some] = n
        flat = np.concatenate(parts)
        starts, order = np.zeros(len(pieces), np.int64), np.concatenate([hit, missed])
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return _gathered(flat, starts, counts), counts

    def _learnt(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, encoded in one run: they are told apart by the bytes that each id stands for."""
        bare = np.fromiter((p[0] not in " \n" for p in pieces), bool, len(pieces))
        joined = "".join([f"\n{p}" if b else p for p, b in zip(pieces, bare.tolist(), strict=True)])
        ids = np.frombuffer(next(self._raw([joined])), "<u4")
        ends = np.cumsum(self.bytes_of[ids])
        text = np.frombuffer(joined.encode(), np.uint8)
        want = np.append(np.flatnonzero((text == 32) | (text == 10))[1:], len(text))  # no piece has a space or a line feed but its first
        cuts = np.searchsorted(ends, want)
        if len(want) != len(pieces) or not len(ends) or ends[-1] != want[-1] or (ends[cuts] != want).any():
            alone = [np.frombuffer(x, "<u4") for x in self._raw(pieces)]
            return np.concatenate(alone), np.array([len(x) for x in alone], np.int64)
        begins = np.concatenate(([0], cuts[:-1] + 1)) + bare  # a line feed put before a piece is an id of its own
        counts = cuts + 1 - begins
        return _gathered(ids, begins, counts), counts


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def batches(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, texts) in runs of about BATCH_BYTES; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        past = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, past + BATCH_BYTES, side="right")))
        yield first, pc.fill_null(texts.slice(first, last - first), "")
        first = last
    pa.default_memory_pool().release_unused()  # a worker waits for its next task beside others' work
