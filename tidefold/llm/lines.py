"""Line dedup within one edit by deletion neighbourhoods, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import SPACE, SPACE_RUN, bucketed, written

#: An edit may be a fifth of the longer line at most: of so many units or more. Units are words; characters too where a line has at most so many words.
MIN_UNITS = 5

#: Units, and the bits of a line's halves that are theirs.
WORDS, CHARS = 0, 4

#: Variants' kinds: the line as it is, less one unit, and less one unit at a known place.
WHOLE, SHORTER, MASKED = 0, 1, 2

#: Bits of a unit's hash at a place: sums of them stay within 64 bits for lines of up to 2^27 units.
LOW = (1 << 36) - 1


def _joined(lines: DataFrame, line: Column, name: str) -> DataFrame:
    """Adds `name`: the line's words, joined by one space. Most lines are so already, and cost no regular expression."""
    core, odd = F.col("__core"), F.contains(F.col("__core"), F.lit(2 * SPACE[0]))
    for s in SPACE[1:]:
        odd |= F.contains(core, F.lit(s))
    # Of its own projection, so that it is trimmed once.
    return lines.withColumn("__core", F.btrim(line, F.lit(SPACE))).withColumn(name, F.when(odd, F.regexp_replace(core, SPACE_RUN, " ")).otherwise(core)).drop("__core")


def _halves(part, n: Column, units: int) -> list[Column]:
    """Hashes that a line of `n` units shares with every line one edit away: in two lines, the shorter of L units, either
    the first L/2 units are equal or the last. `part(length, last)` gives so many of the first or the last units; the low three bits say which of the hashes it is."""
    out = []
    for k, length, least in ((0, n, MIN_UNITS - 1), (2, n - 1, MIN_UNITS - 1)):
        half = F.shiftright(length, 1)
        for side in (0, 1):
            key = F.xxhash64(F.lit(units), length, F.lit(side), part(half, side == 1)).bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(units + k + side).cast("long"))
            out.append(F.when(length >= least, key))
    return out


def _variants(lines: DataFrame, units: str, n: str, which: int) -> DataFrame:
    """key, line, kind: the hashed deletion neighbourhood of lines (line, halves, units, n), cut to the halves that matched.

    A sequence's hash is a pair of sums over its units' hashes at their places. Running sums of them, at the units' own places and
    one place earlier, give the hash less any unit at once; so a line costs a row for each unit, whatever its length.
    """
    rows = lines.select("line", F.col(n).alias("n"), "halves", F.posexplode_outer(units).alias("i", "__w")).select("line", "n", "halves", "i", F.xxhash64("__w").alias("__h"))
    at, all_ = Window.partitionBy("line").orderBy("i").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("line")
    i, n = F.col("i"), F.col("n")
    less, without, whole = [], [], []
    for seed in (1, 2):
        here = F.xxhash64(F.lit(seed), i, "__h").bitwiseAND(F.lit(LOW))
        moved = F.xxhash64(F.lit(seed), i - 1, "__h").bitwiseAND(F.lit(LOW))
        before = F.coalesce(F.sum(here).over(at), F.lit(0))
        after = F.sum(moved).over(all_) - F.coalesce(F.sum(moved).over(at), F.lit(0)) - moved
        whole.append(F.sum(here).over(all_).alias(f"__w{seed}"))
        less.append((before + after).alias(f"__l{seed}"))
        without.append(here.alias(f"__x{seed}"))
    rows = rows.select("line", "n", "halves", "i", *whole, *less, *without)
    matched = lambda k: F.col("halves").bitwiseAND(F.lit(1 << (which + k))) != 0
    # A match in the first half leaves the edit to the second, and the other way about.
    half, under = F.floor(n / 2), F.floor((n - 1) / 2)
    masked = (n >= MIN_UNITS) & ((matched(0) & (i >= half)) | (matched(1) & (i < n - half)))
    shorter = (n >= MIN_UNITS) & ((matched(2) & (i >= under)) | (matched(3) & (i < n - under)))
    variant = lambda when, kind, *key: F.when(when, F.struct(F.xxhash64(F.lit(which), *key).alias("key"), F.lit(kind).alias("kind")))
    made = F.array(
        variant((i == 0) & (matched(0) | matched(1)), WHOLE, F.lit(0), n, "__w1", "__w2"),
        variant(shorter, SHORTER, F.lit(0), n - 1, "__l1", "__l2"),
        variant(masked, MASKED, F.lit(1), n, i, F.col("__w1") - F.col("__x1"), F.col("__w2") - F.col("__x2")),
    )
    out = rows.select("line", F.explode_outer(made).alias("v")).where("v is not null")
    return out.select("v.key", "line", "v.kind")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays differ by one element put in, taken out or exchanged."""
    def first_gap(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        zipped = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q)
        return F.coalesce(F.nullif(F.array_position(zipped, True), F.lit(0)), (n + 1).cast("long")).cast("int")

    at = first_gap(a, b)
    tail = lambda x, skip: F.slice(x, at + skip, F.greatest(F.size(x) - at - skip + 1, F.lit(0)))
    same = (F.size(a) == F.size(b)) & (tail(a, 1) == tail(b, 1))
    more = (F.size(a) == F.size(b) + 1) & (tail(a, 1) == tail(b, 0))
    fewer = (F.size(a) + 1 == F.size(b)) & (tail(a, 0) == tail(b, 1))
    return (F.greatest(F.size(a), F.size(b)) >= MIN_UNITS) & (same | more | fewer)


def _characters(w: str) -> Column:
    """A line's characters, its words joined by one space; null where it has more than MIN_UNITS words."""
    return F.when(F.size(w) <= MIN_UNITS, F.split(F.array_join(w, " "), ""))


def _key(doc_id: str, th: str) -> list[Column]:
    """Two hashes, 128 bits, of a document's id and the hash of its text."""
    return [F.xxhash64(doc_id, th).alias("k1"), F.xxhash64(F.lit(7), th, doc_id).alias("k2")]


def _kept_lines(table: DataFrame, text: Column) -> DataFrame:
    """k1, k2, keep (line numbers) of the lines that stay, of those that have a word; `table` is bucketed by k1, k2."""
    rows = table.select("doc_id", "th", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = _joined(rows.where(F.btrim("line", F.lit(SPACE)) != ""), F.col("line"), "c")
    rows = rows.select(F.struct("doc_id", "th", "line_no").alias("at"), "c", (F.octet_length("c") - F.octet_length(F.replace("c", F.lit(" "), F.lit(""))) + 1).alias("n"))
    rows = rows.select("at", "c", "n", F.when(F.col("n") <= MIN_UNITS, F.col("c")).alias("short"))
    some_words = lambda length, last: F.call_function("substring_index", "c", F.lit(" "), -length if last else length)
    some_chars = lambda length, last: F.substring(F.col("short"), F.length("short") - length + 1 if last else F.lit(1), length)
    halves = _halves(some_words, F.col("n"), WORDS) + _halves(some_chars, F.length("short"), CHARS)
    rows = rows.select("at", F.xxhash64("c").alias("line"), F.xxhash64(F.lit(1), "c").alias("h2"), F.array_compact(F.array(*halves)).alias("halves"))
    # Equal lines become one, at their earliest place, before anything else is shuffled.
    one = written(rows.groupBy("line", "h2").agg(F.min("at").alias("at"), F.first("halves").alias("halves")), "lines")

    halves = one.select("line", F.explode("halves").alias("half"))
    half = F.col("half").bitwiseAND(F.lit(-8))
    several = halves.groupBy(half.alias("__half")).agg(F.count(F.lit(1)).alias("__of")).where("__of > 1").select("__half")
    bits = halves.join(several, half == F.col("__half")).groupBy("line").agg(F.bit_or(F.expr("shiftleft(1, cast(half & 7 as int))")).alias("halves"))
    near = one.select("line", "at").join(bits, "line")
    near = written(near.groupBy(*_key("at.doc_id", "at.th")).agg(F.collect_list(F.struct("at.line_no", "line", "halves")).alias("near")), "near")

    found = table.join(near, ["k1", "k2"]).select("doc_id", "th", F.split(text, "\n").alias("__lines"), F.explode("near").alias("x"))
    found = _joined(found, F.get("__lines", F.col("x.line_no")), "c")
    found = found.select("x.line", F.struct("doc_id", "th", "x.line_no").alias("at"), "x.halves", F.split("c", " ").alias("w"))
    near, plain = bucketed(found.dropDuplicates(["line"]), ["line"], "texts")

    as_words = _variants(near.withColumn("__n", F.size("w")), "w", "__n", WORDS)
    as_chars = _variants(near.where(F.size("w") <= MIN_UNITS).withColumn("c", _characters("w")).withColumn("__n", F.size("c")), "c", "__n", CHARS)
    made = written(as_words.unionByName(as_chars), "variants")
    several = made.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("key")
    met = written(made.join(several, "key").distinct().join(near.select("line", "at"), "line"), "met")
    # Star links: of each key the earliest line, by kind, stands for all.
    who = F.struct("at", "line")
    groups = met.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, who)).alias(f"w{k}") for k in (WHOLE, SHORTER, MASKED)])
    other = F.when(F.col("kind") == WHOLE, F.col(f"w{SHORTER}")).when(F.col("kind") == SHORTER, F.col(f"w{WHOLE}")).otherwise(F.col(f"w{MASKED}"))
    pairs = met.join(groups, "key").select("line", "at", other.alias("first")).where(F.col("first.at") < F.col("at"))
    pairs = pairs.select("line", F.col("first.line").alias("earlier")).distinct()
    # Thousands of lines may have the same earlier one.
    mine, theirs = near.select("line", "w"), plain.select(F.col("line").alias("earlier"), F.col("w").alias("v"))
    chars = F.when(F.least(F.size("w"), F.size("v")) < MIN_UNITS, one_edit(_characters("w"), _characters("v")))
    losers = pairs.join(mine, "line").join(theirs, "earlier").where(one_edit(F.col("w"), F.col("v")) | F.coalesce(chars, F.lit(False))).select("line").distinct()
    stay = one.join(losers, "line", "left_anti")
    return stay.groupBy(*_key("at.doc_id", "at.th")).agg(F.collect_list("at.line_no").alias("keep"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_lines, n_removed and kept_text to every row of `docs`.

    A line with a word goes if an earlier line, by (id, line number), has the same words in order or is one edit away, where an edit is a
    fifth of the longer line at most: one word put in, taken out or exchanged, the longer of MIN_UNITS words or more; or one character,
    the shorter of fewer words, the longer of MIN_UNITS characters or more. An earlier line counts whether it
    stays or not. Lines without a word stay. So of any group of copies the earliest stays, and the result doesn't depend on the
    order of work. White space within a line counts as one space, all else as it is.

    Null and empty texts have no lines to lose and give an empty kept_text. Null ids come before all others; rows equal in id and text are
    one document and fare alike; documents that share only the id go by a hash of the text. Very long texts and lines cost as much a word
    as short ones. An empty table gives an empty table. Columns of `docs` are kept, whatever their names, but for ones named as those added.
    """
    added = ("n_lines", "n_removed", "kept_text")
    row = F.struct(*[F.col(c) for c in docs.columns if c not in added or c in (id_col, text_col)])
    rows = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    # The texts are dealt out once, by document, for all that is joined to them.
    table, _ = bucketed(rows.select("*", *_key("doc_id", "th")), ["k1", "k2"], "documents")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    joined = table.join(_kept_lines(table, text), ["k1", "k2"], "left").select("row", text.alias("text"), F.coalesce("keep", F.array().cast("array<int>")).alias("keep"))
    lines = joined.withColumn("lines", F.split("text", "\n"))
    blank = lambda x: F.btrim(x, F.lit(SPACE)) == ""
    lines = lines.withColumn("n", F.size(F.filter("lines", lambda x: ~blank(x)))).withColumn("all", F.size("keep") == F.col("n"))
    # A set would be searched line by line; sorted together, a kept place precedes its line.
    lines = lines.withColumn("marks", F.when(~F.col("all"), F.sort_array(F.concat(F.transform("keep", lambda k: F.struct(k.alias("k"), F.lit(0).alias("z"), F.lit("").alias("l"))), F.transform("lines", lambda x, k: F.struct(k.alias("k"), F.lit(1).alias("z"), x.alias("l")))))))
    stays = lambda x, j: (x["z"] == 1) & (blank(x["l"]) | ((j > 0) & (F.get(F.col("marks"), j - 1)["z"] == 0)))
    rest = F.array_join(F.transform(F.filter("marks", stays), lambda x: x["l"]), "\n")
    out = F.struct(F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.size("keep")).cast("long").alias("n_removed"), F.when(F.col("all"), F.col("text")).otherwise(rest).alias("kept_text"))
    # Through an explode of one, which filters on the result aren't pushed below, into the lambdas above.
    done = lines.select("row", F.explode_outer(F.array(out)).alias("out"))
    held = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return done.select(*held, "out.*")
