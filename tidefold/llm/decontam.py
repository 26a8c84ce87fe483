"""Benchmark decontamination by spaced-seed hashing, native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import written

#: The masks: 1 keeps a word's hash, 0 ignores it. Together they meet every window of WINDOW words, or every
#: shorter text of MASKED_WORDS words or more, that has no more substitutions than `tolerated` says. Items of fewer words are
#: met whole, by a mask of their own length.
MASKS = ("111011", "11111")
WINDOW, MASKED_WORDS = 13, 8

#: Seeds that are broadcast, 24 bytes each and some; those of a larger benchmark are joined by shuffling.
BROADCAST_SEEDS = 1_000_000

#: Words of a document that are searched at once, and those before and after them that a window may reach.
SEGMENT, BEFORE, AFTER = 4096, 16, 24


def tolerated(window: int) -> int:
    """Substitutions that a window may have."""
    return 2 if window >= 12 else 1 if window >= MASKED_WORDS else 0


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    core = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.split(core, " ")


def _seed(words: str, at: Column, mask: str, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(F.col(words), at + i) for i, c in enumerate(mask) if c == "1"])


def seeds(items: DataFrame, masks: tuple[str, ...] = MASKS, short: tuple[int, ...] = ()) -> DataFrame:
    """Of benchmark texts (item, words): seed, item, q (the seed's place in the item); whole items of the `short` lengths have one seed."""
    n = F.size("words")
    rows = items.where(n >= MASKED_WORDS).select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("q"))
    parts = [rows.where(F.col("q") + len(mask) <= F.col("n")).select(_seed("words", F.col("q"), mask, k).alias("seed"), "item", "q") for k, mask in enumerate(masks)]
    parts += [items.where(n == size).select(_seed("words", F.lit(0), "1" * size, len(masks) + k).alias("seed"), "item", F.lit(0).alias("q")) for k, size in enumerate(short)]
    return reduce(DataFrame.unionByName, parts)


def _segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text), s, seg: a document's words in overlapping segments."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), tokens(F.col(text_col)).alias("words"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / SEGMENT).cast("int")), lambda k: F.slice("words", F.greatest(F.lit(1), k * SEGMENT + 1 - BEFORE), SEGMENT + BEFORE + AFTER))
    # The outer form, for the other makes Spark compute what it explodes once more, in a filter.
    return rows.select("doc_id", "th", cut.alias("cut")).select("doc_id", "th", F.posexplode_outer("cut").alias("s", "seg"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc_id, item_id) of every document that holds a window of a benchmark text, and that text.

    A window is 13 consecutive words of the item, with 2 substitutions at most; an item of 8 to 12 words is
    one window itself (2 substitutions for 12, else 1), one of 1 to 7 words must be there whole and unchanged. Words are lower-case runs
    of letters and digits. All windows of all documents are hashed under the masks, in one pass, and joined with the benchmark's
    seeds; around each hit the aligned words are compared. Items of equal words are searched once and all reported.

    A benchmark of up to BROADCAST_SEEDS seeds (some 500,000 words) is broadcast, and documents aren't shuffled. The hashes of a larger one are
    joined by shuffling (document, place, hash), and the hits then find their segments again.

    Null and empty texts, of documents or items, match nothing; ids that repeat are reported once; a hit in a long text costs as much as
    one in a short text; an empty table on either side gives an empty table. Other columns, whatever their names, aren't read.
    """
    given = written(items.select(F.col(item_col).alias("id"), tokens(F.col(item_text_col)).alias("words")).where("words[0] <> ''").withColumn("item", F.xxhash64("words")), "items")
    texts = given.dropDuplicates(["item"]).select("item", "words")
    short = tuple(sorted(r["n"] for r in given.select(F.size("words").alias("n")).where(F.col("n") < MASKED_WORDS).distinct().collect()))
    table = written(seeds(texts, masks, short), "seeds")
    hashes = written(texts.select(F.col("item").alias("__item"), F.transform("words", lambda x: F.xxhash64(x)).alias("hs")), "hashes")
    few = table.count() <= BROADCAST_SEEDS
    whole = [*masks, *("1" * n for n in short)]

    # From here to the join, rows stay within one generated loop: nothing of a segment is copied for its places.
    rows = _segments(docs, id_col, text_col)
    rows = rows.select("doc_id", "th", "s", "seg", F.explode_outer(F.sequence(F.lit(0), len(whole) * F.size("seg") - 1)).alias("__i"))
    rows = rows.select("doc_id", "th", "s", "seg", F.expr(f"__i div {len(whole)}").cast("int").alias("p"), F.expr(f"__i % {len(whole)}").alias("__k"))
    span, seed = F.when(F.lit(False), 0), F.when(F.lit(False), F.lit(0).cast("long"))
    for k, mask in enumerate(whole):
        span = span.when(F.col("__k") == k, len(mask))
        seed = seed.when(F.col("__k") == k, _seed("seg", F.col("p"), mask, k))
    rows = rows.where(F.col("p") + span <= F.size("seg"))
    if few:
        hits = rows.select("doc_id", "seg", "p", seed.alias("seed")).join(F.broadcast(table), "seed").join(F.broadcast(hashes), F.col("item") == F.col("__item"))
    else:
        places = rows.select("doc_id", "th", "s", "p", seed.alias("seed")).join(table, "seed").distinct()
        again = _segments(docs, id_col, text_col).withColumnsRenamed({"doc_id": "__d", "th": "__th", "s": "__s"})
        hits = places.join(again, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__th")) & (F.col("s") == F.col("__s")))
        hits = hits.join(hashes, F.col("item") == F.col("__item"))
    # A hit takes along the words about it, in the document and the item, that a window around the seed may hold; the item's begin at `a`.
    n, q, p = F.size("hs"), F.col("q"), F.col("p")
    hits = hits.withColumn("w", F.least(n, F.lit(WINDOW)))
    a = F.greatest(F.lit(0), q - (F.col("w") - 1), q - p)
    hits = hits.withColumn("a", a).withColumn("b", F.least(n, q + F.col("w") + max(map(len, whole)), q - p + F.size("seg")))
    here = F.slice("seg", p - q + F.col("a") + 1, F.col("b") - F.col("a"))
    hits = hits.select("doc_id", "item", "w", here.alias("here"), F.slice("hs", F.col("a") + 1, F.col("b") - F.col("a")).alias("there"))
    same = F.transform("there", lambda x, j: F.when(F.xxhash64(F.get("here", j)) == x, 1).otherwise(0))
    w = F.col("w")
    need = w - F.when(w >= 12, 2).when(w >= MASKED_WORDS, 1).otherwise(0)
    good = F.when(F.size("there") >= w, F.exists(F.sequence(F.lit(1), F.size("there") - w + 1), lambda s: F.aggregate(F.slice(same, s, w), F.lit(0), lambda x, y: x + y) >= need))
    found = hits.groupBy("doc_id", "item").agg(F.bool_or(good).alias("good")).where("good")
    return found.join(given.select(F.col("item").alias("__item"), F.col("id").alias("item_id")).distinct(), F.col("item") == F.col("__item")).select("doc_id", "item_id").distinct()
