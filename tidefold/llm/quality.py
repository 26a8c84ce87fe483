"""Quality rules as a short-circuit cascade, native."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import SPACE, where_late, words

#: Rows, about, of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000

SYMBOLS = "#*$%&|<>"


#: What the rules measure of a text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "letters", "capitals")


class Measures:
    """The measures of a text, which stand in columns `at`_..."""

    def __init__(self, at: str):
        for name in (*MEASURES, "n_repeat_words"):
            setattr(self, name, lambda c=f"{at}_{name}": F.col(c))


@dataclass(frozen=True)
class Rule:
    """A document that `rejects`, a function of its Measures, is true for goes."""

    name: str
    rejects: Callable[[Measures], Column]


#: The rules, in no order that matters: a document is kept if none rejects it.
RULES = (
    Rule("few_words", lambda m: m.n_words() < 50),
    Rule("symbols", lambda m: m.n_symbols() * 10 > m.n_words() * 2),
    Rule("capitals", lambda m: m.capitals() * 100 > m.letters() * 40),
    Rule("no_letters", lambda m: m.letters() * 100 < m.word_chars() * 50),
    Rule("word_length", lambda m: (m.word_chars() < m.n_words() * 2) | (m.word_chars() > m.n_words() * 25)),
    Rule("dup_lines", lambda m: m.n_dup_lines() * 100 > m.n_lines() * 60),
)

#: The base's second half as a rule: the dearest measure by far, which a cascade takes only of texts that are still alive.
REPEATS = Rule("repeats", lambda m: m.n_repeat_words() * 100 > m.n_words() * 50)


def measured(df: DataFrame, text: str, at: str) -> DataFrame:
    """Adds MEASURES as `at`_n_words ..., and the words as `at`_w."""
    w, t, lines, st = f"{at}_w", f"{at}_t", f"{at}_l", f"{at}_st"
    given = [F.col(c) for c in df.columns]
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(w, words(F.col(t))).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    stats = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "letters": F.length(t) - F.length(F.regexp_replace(t, "\\p{L}+", "")),
        "capitals": F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")),
    }
    # Through an explode of one, which filters aren't pushed below: they would compute all this once more for each use.
    out = out.select(*given, w, F.explode_outer(F.array(F.struct(*[x.cast("long").alias(c) for c, x in stats.items()]))).alias(st))
    return out.select(*given, w, *[F.col(f"{st}.{c}").alias(f"{at}_{c}") for c in MEASURES])


def with_repeats(df: DataFrame, at: str, alive: Column) -> DataFrame:
    """Adds `at`_n_repeat_words to measured rows, null where they aren't `alive`; the words go.

    A word counts as repeated if a 3-word window that covers it is found twice or more in the text. Windows are
    compared by 64-bit hashes within the row. Texts whose windows all differ, most of them, are done then; of others the hashes' high
    bits are sorted with the windows' places in the low ones, and neighbours are compared in full.
    """
    w, h, g, k, p, out_ = (f"{at}_{c}" for c in ("w", "h", "g", "k", "p", "rp"))
    given = [F.col(c) for c in df.columns if c != w]
    n = F.size(w)
    out = df.withColumn(h, F.when(alive & (n > 3), F.transform(w, lambda x: F.xxhash64(x))))
    out = out.withColumn(g, F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), n - 2))
    low = F.expr(f"shiftleft(1L, length(bin(cast(size({w}) as bigint)))) - 1L")
    out = out.withColumn(k, F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))))
    place = lambda x: x.bitwiseAND(low).cast("int")
    same = lambda x, j: F.coalesce(F.get(F.col(g), place(F.get(F.col(k), j))) == F.get(F.col(g), place(x)), F.lit(False))
    out = out.withColumn(p, F.sort_array(F.transform(F.filter(k, lambda x, i: same(x, i - 1) | same(x, i + 1)), place)))
    gap = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col(p), i + 1) - x, F.lit(3))))
    covered = F.when(alive, F.coalesce(F.aggregate(gap, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    out = out.select(*given, F.explode_outer(F.array(F.struct(covered.alias("n")))).alias(out_))
    return out.select(*given, F.col(f"{out_}.n").alias(f"{at}_n_repeat_words"))


def hits(rule: Rule, at: str) -> Column:
    return F.coalesce(rule.rejects(Measures(at)), F.lit(False))


def profiled(df: DataFrame, text: str, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, after_base: bool = False) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share of rows rejected) of each rule on a bounded sample of `df`.

    The sample is drawn at random, `sample_rows` rows about; it meets on one executor and settles only the order
    in which rules are tried, never what they decide. A rule costs what a plan pays for it: the measures are there, but for
    repeats, which are counted when the rule is tried. With `after_base` only rows that the base leaves are judged, as in `judged`.
    A job's own overhead is taken off the costs.
    """
    share = min(1.0, sample_rows / max(df.count(), 1))
    sample = measured(df.select(F.col(text).alias("__t")).sample(share, seed=1).repartition(1), "__t", "__q")
    if after_base:
        sample = base_failed(with_repeats(sample, "__q", F.lit(True)), "__q").where("not __q_failed")
    sample = sample.persist()

    def timed(rejects: Column, rows: DataFrame) -> tuple[float, int, int]:
        began = time.perf_counter()
        n, of = rows.agg(F.count_if(rejects), F.count(F.lit(1))).collect()[0]
        return time.perf_counter() - began, n, of

    timed(F.lit(False), sample)
    idle, _, rows = timed(F.lit(False), sample)
    out = []
    for rule in rules:
        took, n, _ = timed(hits(rule, "__q"), with_repeats(sample, "__q", F.lit(True)) if rule is REPEATS else sample)
        out.append((rule, max(took - idle, 1e-6) / max(rows, 1), n / max(rows, 1)))
    sample.unpersist()
    return out


def ordered(profile: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections for the cost first; ties by name."""
    return [r for r, cost, share in sorted(profile, key=lambda x: (-(x[2] / max(x[1], 1e-12)), x[0].name))]


def cascade(rules: list[Rule], at: str) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't computed then."""
    verdict = F.when(F.lit(False), "")
    for rule in rules:
        verdict = verdict.when(hits(rule, at), rule.name)
    return verdict.otherwise(F.lit(None).cast("string"))


def base_failed(df: DataFrame, at: str) -> DataFrame:
    n, repeated = F.col(f"{at}_n_words"), F.col(f"{at}_n_repeat_words")
    return df.withColumn(f"{at}_failed", (n < 50) | (100 * repeated > 50 * n))


def _prefix(df: DataFrame) -> str:
    """The start of names that no column of `df` has."""
    at = "__q"
    while any(c.lower().startswith(at) for c in df.columns):
        at += "q"
    return at


def filtered(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that neither a rule nor the base (few_words, repeats) rejects, in one cascade.

    Rules that come before `repeats` in the order save its cost for the rows they reject. Null and empty texts have no words, so
    `few_words` rejects them; repeated rows are judged one by one; very long texts are judged whole, in n log n; an empty table gives
    an empty table; all columns are kept, whatever their names.
    """
    at = _prefix(df)
    order = ordered(profiled(df, text_col, (*{r.name: r for r in (RULES[0], *rules)}.values(), REPEATS), sample_rows))
    cut = order.index(REPEATS)
    rows = measured(df, text_col, at).withColumn(f"{at}_first", cascade(order[:cut], at))
    rows = with_repeats(rows, at, F.col(f"{at}_first").isNull())
    left = F.col(f"{at}_first").isNull() & cascade(order[cut:], at).isNull()
    return where_late(rows, left).select(*[F.col(c) for c in df.columns])


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: its id, the base statistics, base_failed, kept, and `rejected_by`, the rule that rejected it first.

    The base's statistics are asked of every row, so only the other rules form the cascade, tried on rows that the base leaves.
    Null and empty texts count as texts without words: all counts 0, base_failed true, kept false. Repeated
    rows are judged one by one; very long texts are judged whole; an empty table gives an empty table; other columns of `df` aren't read.
    """
    order = ordered(profiled(df, text_col, rules, sample_rows, after_base=True))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    rows = base_failed(with_repeats(measured(rows, "__text", "__q"), "__q", F.lit(True)), "__q")
    rows = rows.withColumn("rejected_by", F.when(F.col("__q_failed"), F.lit("base")).otherwise(cascade(order, "__q")))
    return rows.select(
        "doc_id",
        *[F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__q_failed").alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
        "rejected_by",
    )
