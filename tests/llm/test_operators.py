"""Operators against brute force, round trips, and odd inputs: nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import chat, components, decontam, golay, licenses, lines, minhash, packing, quality, ranking, sharding, simhash, substrings, tokenfiles, tokens
from tidefold.llm.common import words

SCHEMA = "doc_id long, text string, source string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def sample():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    para = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = para(50)
    long = para(6000)
    texts = [None, "", "   \n\t", "one", para(34), para(35), shared, shared, f"{para(40)} {shared}\n{para(30)}", para(120), long, long + " end", "x " * 200, "a\x0bb\x0cc\r\nd", "<|endoftext|> tail", "Ab  cd\n\n\nef ", "nul\x01in text"]
    rows = [(k, t, ["s", None, "s", "t"][k % 4]) for k, t in enumerate(texts)]
    base = rows[9][1].split(" ")
    for j in range(4):
        edit = list(base)
        edit[10 + j] = f"new{j}"
        rows.append((100 + j, " ".join(edit), "s"))
    rows += [(7, shared, "s"), (None, shared, None), (None, None, None), (50, "one\ntwo\none\n\ntwo", "s")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = sample()
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df):
    return Counter(map(tuple, df.collect()))


def test_words(spark, docs):
    for r in docs.select("text", words(F.col("text")).alias("w")).collect():
        assert r["w"] == split(r["text"])


# op1 ---------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST] &lt; & <|im_end|>\n<|im_start|>user\nhi"
    data = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, None, None), (2, 0, "assistant", ""), (None, 5, "us\ner", "é日"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, "assistant", "x")]
    talks = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("score", F.lit(1))
    made = chat.formatted(chat.as_replies(talks)).cache()
    for r in made.collect():
        inside = [t for role, t in chat.parsed(r["formatted"])]
        for c in chat.CONTROLS:
            assert r["formatted"].count(c) == (len(inside) if c in ("<|im_start|>", "<|im_end|>") else 0)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_ranks_branches_of_trees(spark):
    rng = random.Random(4)
    data, up, score = [], {}, {}
    for k in range(60):
        up[k] = None if k < 3 else rng.randrange(max(0, k - 6), k)
        score[k] = rng.random()
        data.append(("t", k, up[k], "user", f"m{k}", score[k]))
    data += [("t", 90, 91, "user", "loop", 1.0), ("t", 91, 90, "user", "loop", 1.0), ("t", 92, 77, "user", "orphan", 0.0)]
    up[92], score[92] = None, 0.0

    def path(leaf):
        out = [leaf]
        while up[out[-1]] is not None:
            out.append(up[out[-1]])
        return out

    leaves = [k for k in up if k not in up.values()]
    order = sorted(leaves, key=lambda x: (-sum(score[n] for n in path(x)) / len(path(x)), -len(path(x)), x))
    df = spark.createDataFrame(data, "tree string, id long, parent long, role string, text string, score double")
    got = {r["rank"]: [t for _, t in chat.parsed(r["formatted"])] for r in chat.formatted(df, 5).collect()}
    assert got == {k + 1: [f"m{n}" if n < 60 else "orphan" for n in path(x)[::-1]] for k, x in enumerate(order[:5])}


def test_chat_empty(spark):
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.as_replies(talks))).count() == 0


# op2 ---------------------------------------------------------------------------------------------------------------


def dice(a, b):
    a, b = (Counter(zip(x, x[1:])) for x in (a, b))
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 0


def norm(t):
    return re.sub(r"[\W_]+", " ", t.lower()).strip().split(" ")


def found_licenses(text):
    """template: (dice, passages), by scoring all runs of lines and giving each line to its best."""
    lines_ = [norm(x) for x in text.split("\n") if norm(x) != [""]]
    grams = {name: norm(x) for name, x in licenses.TEMPLATES.items()}
    runs = []
    for i in range(len(lines_)):
        run = []
        for j in range(i, len(lines_)):
            run = run + lines_[j]
            if len(run) > 2 * max(map(len, grams.values())):
                break
            for name, x in grams.items():
                if 0.6 * len(x) < len(run) < 1.6 * len(x) and (d := dice(run, x)) >= licenses.THRESHOLD:
                    at = sum(map(len, lines_[:i]))
                    runs.append((-d, at - (at + len(run) - 1), name, i, j))
    owned = {min(r for r in runs if r[3] <= k <= r[4]) for k in range(len(lines_)) if any(r[3] <= k <= r[4] for r in runs)}
    out = {}
    for name in {r[2] for r in owned}:
        mine, passages, end = sorted((r[3], r[4]) for r in owned if r[2] == name), 0, -1
        for i, j in mine:
            passages += i > end
            end = max(end, j)
        out[name] = (round(max(-r[0] for r in owned if r[2] == name), 6), passages)
    return out


@pytest.mark.parametrize("most", [licenses.BROADCAST_GRAMS, 0])
def test_licenses_equal_brute_force(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", most)
    mit = licenses.TEMPLATES["MIT"]
    texts = {1: mit, 2: mit.replace("Software", "Program"), 3: "intro\nReleased under the MIT License\nend", 4: None, 5: "", 6: "MIT\n\n" + mit[:400] + "\n" + mit[400:], 7: "nothing to see here at all", 8: mit + " " + mit}
    texts |= {20 + k: x for k, x in enumerate(licenses.TEMPLATES.values())}
    texts |= {60 + k: f"first\n{x}\n\nlast" for k, x in enumerate(licenses.TEMPLATES.values())}
    df = spark.createDataFrame([*texts.items(), (1, mit)], "doc_id long, text string").withColumn("template", F.lit("clash"))
    got = {(r["doc_id"], r["template"]): (r["dice"], r["n_passages"]) for r in licenses.scanned(df).collect()}
    want = {(d, name): x for d, t in texts.items() for name, x in found_licenses(t or "").items()}
    assert got == want and (3, "MIT line") in got and (8, "MIT") not in got
    for k, name in enumerate(licenses.TEMPLATES):  # each licence is itself and no other
        assert [x for d, x in got if d == 20 + k] == [name] and [x for d, x in got if d == 60 + k] == [name]
    assert licenses.scanned(empty).count() == 0 and licenses.scanned(docs).count() == 0


def test_licenses_within_longer_texts(spark):
    rng = random.Random(5)
    prose = lambda n: "\n".join(" ".join(rng.choice(["of", "the", "software", "tide", "any", "is"]) for _ in range(9)) for _ in range(n))
    wrap = lambda t, n: "\n".join(" ".join(t.split(" ")[i : i + n]) for i in range(0, len(t.split(" ")), n))
    mit, gpl, isc = (licenses.TEMPLATES[k] for k in ("MIT", "GPL-3.0 notice", "ISC"))
    parts = mit.replace(": The above", ":\n\nThe above").replace("Software. THE", "Software.\n\nTHE")
    texts = {
        1: f"{prose(40)}\n\n{parts}\n\n{prose(30)}",
        2: f"{prose(30)}\n{wrap(gpl, 8)}\n{prose(30)}",
        3: f"{prose(5)}\n\n{wrap(isc, 3)}\n \n{prose(60)}\n{wrap(isc, 11)}",
        4: prose(90),
        5: f"{prose(40)}\n{wrap(mit[:500], 7)}\n{prose(40)}",
        6: f"{prose(3)}\n{wrap(mit, 10)}\n{wrap(gpl, 9)}\nThis work is licensed under the GNU General Public License, version 3.\n{prose(3)}",
        **{100 + k: f"{prose(8)}\n{wrap(x, 9)}\n{prose(8)}" for k, x in enumerate(licenses.TEMPLATES.values())},
    }
    rows = [*texts.items(), (1, texts[1]), (None, texts[2])]
    out = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {(d, name): x for d, t in texts.items() for name, x in found_licenses(t).items()}
    assert {k: n for k, (_, n) in want.items() if k[0] < 7} == {(1, "MIT"): 1, (2, "GPL-3.0 notice"): 1, (3, "ISC"): 2, (6, "MIT"): 1, (6, "GPL-3.0 notice"): 1, (6, "GPL-3.0 line"): 1}
    planted = list(licenses.TEMPLATES)
    assert all((100 + k, x) in want for k, x in enumerate(planted))  # all wrapped notices are found
    want[None, "GPL-3.0 notice"] = want[2, "GPL-3.0 notice"]
    assert {(r["doc_id"], r["template"]): (r["dice"], r["n_passages"]) for r in out} == want


# op3 ---------------------------------------------------------------------------------------------------------------


def edited(a, b):
    """Whether two sequences, the longer of 5 or more, differ by one element put in, taken out or exchanged."""
    if max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def removed_lines(rows):
    seen, gone = [], set()
    for place, w in rows:
        c = " ".join(w)
        if any(w == x or edited(w, x) or (min(len(w), len(x)) < 5 and edited(c, " ".join(x))) for x in seen):
            gone.add(place)
        seen.append(w)
    return gone


def near_lines():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(30)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(8, 14))] for _ in range(12)] + [["a"] * 12, ["a", "b"] * 6]
    base += [[rng.choice(["tide", "fold", "sea", "日本", "x"]) for _ in range(n)] for n in (1, 2, 3, 4, 4, 5, 5, 6, 7)]
    rows = []
    for d in range(90):
        made = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                kind, j = rng.randrange(6), rng.randrange(len(w))
                if kind == 0:
                    w[j] = rng.choice(vocab)
                elif kind == 1:
                    w.insert(j, rng.choice(vocab))
                elif kind == 2 and len(w) > 1:
                    del w[j]
                else:
                    c = list(" ".join(w))
                    p = rng.randrange(len(c))
                    c[p : p + (kind != 3)] = rng.choice([[], ["é"], [" "], [","]])
                    w = split("".join(c)) or ["z"]
            made.append("  ".join(w))
        rows.append((d, "\n".join(made), "s"))
    return [*rows, (200, "", "s"), (201, None, "s"), (202, " \n\t\n", "s"), (203, "only\n\nonly", None), (204, "Yes\nYet\nNo", "s"), (205, "12345\n12346", "s")]


@pytest.mark.parametrize("also", ["line", "k1", "row", "__n", "kept_text"])
def test_lines_equal_brute_force(spark, also):
    rows = near_lines()
    df = spark.createDataFrame(rows, SCHEMA).withColumn(also, F.lit("clash")).repartition(3)
    flat = [((d, k), tuple(split(x))) for d, t, _ in sorted(rows) for k, x in enumerate((t or "").split("\n")) if split(x)]
    gone = removed_lines(flat)
    assert {(204, 1), (205, 0)}.isdisjoint(gone) and (205, 1) in gone
    out = lines.deduplicated(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)
        assert (got[d]["kept_text"], got[d]["n_removed"]) == (kept, sum(p[0] == d for p in gone))
        assert also == "kept_text" or got[d][also] == "clash"


def test_lines_with_a_common_half(spark):
    """A third of the lines begin alike; near copies among them are found, the others stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    head, data = "this page was last edited on".split(), []
    for d in range(400):
        line = [*head, *(word() for _ in range(6))] if d % 3 == 0 else [word() for _ in range(12)]
        data.append((d, " ".join(line)))
        if d % 7 == 0:
            data.append((1000 + d, " ".join([*line[:8], word(), *line[9:]])))
    got = {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: int(d >= 1000) for d, _ in data}


def test_lines_of_odd_rows(docs, empty):
    assert lines.deduplicated(empty).count() == 0
    out = lines.deduplicated(docs)
    assert out.count() == docs.count()
    assert [r["kept_text"] for r in out.where("doc_id = 50").collect()] == ["two\n"]  # a null id came first with nothing; doc 3 has "one"


def test_lines_of_odd_white_space(spark):
    """Words part at six characters only; a line without runs of them is taken as it is, others by a regular expression."""
    tail = "c d e f"
    texts = [f"a b {tail}", f"\ta  b {tail} \r", f"a\x0bb\x0c{tail}", f"a \t b {tail}", f"x\u00a0y z {tail} g", f"x y z {tail} g h", f"x\x1cy z {tail} g k", " \t\x0b", "日  本", "日 本"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lines._joined(rows, F.col("text"), "c").collect():
        assert r["c"] == " ".join(split(r["text"]))
    data = [(k, t, "s") for k, t in enumerate(texts)]
    gone = removed_lines([((k, 0), tuple(split(t))) for k, t in enumerate(texts) if split(t)])
    assert {k for k, _ in gone} >= {1, 2, 3, 9}
    got = {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {k: int((k, 0) in gone) for k in range(len(texts))}


# op4 ---------------------------------------------------------------------------------------------------------------


def test_masks_meet_every_tolerated_pattern():
    for size in range(decontam.MASKED_WORDS, decontam.WINDOW + 1):
        for bad in itertools.combinations(range(size), decontam.tolerated(size)):
            assert any(all(o + i not in bad for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(size - len(m) + 1))


@pytest.mark.parametrize("most", [decontam.BROADCAST_SEEDS, 300])
def test_decontamination_equals_brute_force(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(decontam, "SEGMENT", 50)  # so that texts are cut
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", most)  # so that seeds are shuffled
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(400)]
    para = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [para(n) for n in (7, 8, 11, 12, 13, 30, 40, 1, 3)] + [None, [], para(200)]
    items += [items[5], items[0]]
    texts = []
    for k in range(80):
        it = items[k % 9]
        part = list(it[rng.randrange(max(1, len(it) - 13)) :][:13]) if k % 2 else list(it)
        for _ in range(k % 4):
            part[rng.randrange(len(part))] = "XX"
        texts.append((k, " ".join(para(rng.choice([0, 3, 60, 200])) + part + para(rng.choice([0, 20]))).upper()))
    texts += [(500, None), (501, ""), (502, " ".join(items[5]) + "."), (None, " ".join(items[5])), (None, "vv"), (503, " ".join(items[8]))]
    bench = spark.createDataFrame([(k, None if x is None else " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"item_id": F.lit(1), "words": F.lit("clash"), "seed": F.lit(0)}).repartition(3)
    want = set()
    for d, t in texts:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        for k, it in enumerate(items):
            n = min(13, len(it or ()))
            if n and any(sum(a == b for a, b in zip(w[p : p + n], it[q : q + n], strict=False)) >= n - decontam.tolerated(n) for q in range(len(it) - n + 1) for p in range(len(w) - n + 1)):
                want.add((d, k))
    assert set(map(tuple, decontam.matches(df, bench).collect())) == want and {(None, 5), (502, 12), (503, 8)} <= want
    assert {k for _, k in want} == set(range(9)) | {12, 13}
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.matches(docs, bench.limit(0)).count() == 0


# op5 ---------------------------------------------------------------------------------------------------------------


def test_sharding_keeps_the_mixture(spark, docs, empty):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit(1).alias("shard"))
    out = sharding.sharded(rows, 24)
    got = out.collect()
    assert multiset(sharding.sharded(rows.repartition(7), 24)) == multiset(out)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(125)) for v in by.values())
    total = Counter(r["source"] for r in got)
    each = Counter((r["shard"], r["source"]) for r in got)
    assert all(abs(each[s, x] - n / 24) <= 2 for x, n in total.items() for s in range(24))
    assert sharding.sharded(empty, 24).count() == 0
    odd = sharding.sharded(docs, 5).collect()
    sizes = Counter(r["shard"] for r in odd)
    assert len(odd) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1


def test_sharding_equals_brute_force(spark):
    rows = spark.range(700).select(F.when(F.col("id") % 5 < 3, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), (F.col("id") * 7).alias("h"), F.create_map(F.lit("a"), F.array(F.struct(F.col("id").alias("x")))).alias("__p"), F.col("id").alias("all"))
    hashed = rows.withColumn("key", F.xxhash64(F.lit(17), "doc_id", sharding._row_hash(rows, 18))).withColumn("s", F.xxhash64("source")).collect()
    by = defaultdict(list)
    for r in hashed:
        by[r["source"]].append((r["key"] % 2**64, r["all"], r["s"]))
    order = sorted(((2 * k + 1) / (2 * len(v)), s, source or "", k, i) for source, v in by.items() for k, (_, i, s) in enumerate(sorted(v)))
    for shards in (1, 7, 24):
        want = {}
        for p, x in enumerate(order):
            shard = p * shards // len(order)
            want[x[-1]] = (shard, p - -(-shard * len(order) // shards))
        out = sharding.sharded(rows, shards)
        assert out.columns == [*rows.columns, "shard", "slot"]
        assert {r["all"]: (r["shard"], r["slot"]) for r in out.collect()} == want


def test_ranks_in_groups(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("h"), "id").withColumn("b", ranking.top_bits(F.col("h"), 3))
    got = ranking.ranked(rows, ["g"], "b", [F.col("h")], "r", "n").collect()
    for g in (0, 1):
        part = sorted((r["h"] % 2**64, r["r"]) for r in got if r["g"] == g)
        assert [r for _, r in part] == list(range(250)) and all(r["n"] == 250 for r in got)


# op6, op10 ---------------------------------------------------------------------------------------------------------


def ids_of(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for _, x, _ in rows]


def test_encoder_equals_the_library():
    rows = [(0, t, "") for t in ["", " a", "a ", "a  b", "a\nb", "a\n\nb", "don't stop's", "x.\ny, z! ", "é\xa0b c", "日本 語", "w" * 300 + " " + "q" * 60 + ".", "a <|endoftext|> b", "tab\there now", "\x01 x", "Hi, you. Hi you, hi. you.", " ", "\n", "a.b c.d e;", "1,2 x1. 2nd."]]
    e = tokens.Encoder(tokens.default_path())
    want = [np.array(x, "<u4").tobytes() for x in ids_of(rows)]
    assert e.encode([t for _, t, _ in rows]) == want
    assert e.encode([]) == [] and e.encode(["", ""]) == [b"", b""]


@pytest.mark.parametrize("limit", ["CACHE_PIECES", "CACHE_BYTES", "BATCH_BYTES", "LEARN_PIECES", "RAW_CHARS"])
def test_encoder_within_any_bounds(monkeypatch, limit):
    import pyarrow as pa

    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdeéß日,.") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(0, (" " if k % 5 else "\n").join(rng.choice(vocab) for _ in range(rng.randint(0, 60))), "") for k in range(80)] + [(0, "a  b", ""), (0, None, "")]
    monkeypatch.setattr(tokens, limit, 7)
    e, got = tokens.Encoder(tokens.default_path()), []
    for first, texts in tokens.batches(pa.array([t for _, t, _ in rows])):
        ids, ends = e.encode_array(texts)
        assert first == len(got)
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == ids_of(rows)


def test_token_files_round_trip(spark, docs, empty, tmp_path, monkeypatch):
    rows = sorted(sample(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter((d, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for (d, _, _), x in zip(rows, ids_of(rows), strict=True))
    out = f"file://{tmp_path}/t"
    monkeypatch.setattr(tokenfiles, "CHUNK_BYTES", 2_000)
    tokenfiles.write(docs.withColumn("__id", F.lit("clash")), out, file_bytes=20_000)
    got = tokenfiles.read(spark, out).collect()
    files = sorted((tmp_path / "t").glob("part-*"))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want and len(files) > 1
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    some = {r["doc_id"]: zlib.crc32(np.array(r["ids"], "<i4").tobytes()) for r in tokenfiles.documents(spark, out, [9, 3]).collect()}
    assert some == {r["doc_id"]: r["ids_crc32"] for r in got if r["doc_id"] in (9, 3)}
    # The files are whole zstandard streams, and several chunks make one.
    import zstandard

    sizes = []
    for f in files:
        with f.open("rb") as file:
            r = tokenfiles.Reader(file)
            sizes.append(len(r.entries) - 1 - len(r.frames))
            data = b"".join(r.document(k) for k in range(len(r.ids)))
        plain = zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read()
        assert plain.startswith(data) and plain[len(data) :].startswith(b'{"ids"')
    assert max(sizes) > 0
    assert tokenfiles.round_trip(empty).count() == 0


@pytest.mark.parametrize("kind", ["string", "date", "decimal(5,2)", "binary", "int", "double"])
def test_token_files_of_any_id(spark, kind):
    rows = spark.createDataFrame([("10", "a b"), ("7", "c"), (None, None)], "k string, text string")
    ids = F.date_add(F.lit("2020-01-01").cast("date"), F.col("k").cast("int")) if kind == "date" else F.col("k").cast(kind)
    rows = rows.select(ids.alias("doc_id"), "text")
    got = tokenfiles.round_trip(rows)
    assert got.schema["doc_id"].dataType == rows.schema["doc_id"].dataType
    assert [r["doc_id"] for r in got.orderBy("start").collect()] == [r["doc_id"] for r in rows.orderBy("doc_id").collect()]


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "x.tokz"
    with path.open("wb") as out:
        w = tokenfiles.Writer(out)
        w.add(1, b"\x01\x00\x00\x00" * 50)
        w.cut()
        w.add(2, b"\x02\x00\x00\x00" * 3_000_000)
        w.close()
    with path.open("rb") as f:
        r = tokenfiles.Reader(f)
        assert r.first == [0, 1, 4] and len(r.document(1)) == 12_000_000 and r.starts == [0, 50]
    data = bytearray(path.read_bytes())
    data[12] ^= 1
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(Exception):  # noqa: B017
        tokenfiles.Reader(f).document(0)


def test_patterns_place_everything():
    rng = random.Random(2)
    hist = Counter(rng.randint(1, 100) for _ in range(5000))
    packs = packing.patterns(hist, 100)
    placed = Counter()
    for pack, n in packs:
        assert sum(pack) <= 100
        for x in pack:
            placed[x] += n
    assert placed == hist
    assert sum(n for _, n in packs) * 100 <= 1.03 * sum(k * n for k, n in hist.items())
    assert packing.patterns({}, 100) == []


def test_packing_places_every_id_once(spark, docs, empty):
    rows = sample()
    got = packing.packed(docs, size=64).collect()
    ids = {}
    for (d, t, _), x in zip(rows, ids_of(rows), strict=True):
        ids.setdefault(d, []).append([*x, 0])
    assert sum(r["length"] for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    for r in got:
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.packed(empty).count() == 0


def test_packed_sequences_equal_brute_force(spark, docs, empty):
    rows = sample()
    texts = Counter((d, tuple([*x, 0])) for (d, _, _), x in zip(rows, ids_of(rows), strict=True))
    got = packing.sequences(docs.withColumn("length", F.lit("clash")), pad_id=9).collect()
    made = defaultdict(list)
    for r in got:
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 1024) and set(r["ids"][n:]) <= {9}
        assert [p["offset"] for p in r["parts"]] == list(itertools.accumulate([0, *(p["length"] for p in r["parts"])]))[:-1] and sum(p["length"] for p in r["parts"]) == n
        for p in r["parts"]:
            made[p["doc_id"]].append((p["start"], r["ids"][p["offset"] : p["offset"] + p["length"]]))
    for d in {d for d, _ in texts}:
        # Pieces of documents that share an id are told apart by trying: every text must be there, and nothing else.
        left = made[d]
        for x in sorted((x for (k, x), n in texts.items() if k == d for _ in range(n)), key=len, reverse=True):
            for s in range(0, len(x), 1024):
                left.remove((s, list(x[s : s + 1024])))
        assert left == []
    rooms = []  # shortest pack first, one piece after the other, longest first
    for n in sorted((min(1024, len(x) - s) for (_, x), n in texts.items() for _ in range(n) for s in range(0, len(x), 1024)), reverse=True):
        if rooms and max(rooms) >= n:
            rooms[rooms.index(max(rooms))] -= n
        else:
            rooms.append(1024 - n)
    assert Counter(1024 - r["n_tokens"] for r in got) == Counter(rooms)
    assert packing.sequences(empty).count() == 0


# op7 ---------------------------------------------------------------------------------------------------------------


def test_substrings_equal_brute_force(spark, docs, empty, monkeypatch):
    rows = sample()
    for width in (1, 35):
        count = Counter(tuple(w[k : k + width]) for _, t, _ in rows for w in [split(t)] for k in range(len(w) - width + 1))
        want = Counter()
        for d, t, _ in rows:
            w = split(t)
            gone = [False] * len(w)
            for k in range(len(w) - width + 1):
                if count[tuple(w[k : k + width])] > 1:
                    gone[k : k + width] = [True] * width
            want[d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
        assert multiset(substrings.deduplicated(docs, width=width)) == want
        # Runs that begin anew within a document, and other columns, change nothing.
        monkeypatch.setattr(substrings, "CHUNK_WORDS", 64)
        docs = docs.withColumns({"k1": F.lit("clash"), "parts": F.lit(1)})
        assert multiset(substrings.deduplicated(docs, width=width)) == want
        monkeypatch.undo()
    assert substrings.deduplicated(empty).count() == 0


# op8 ---------------------------------------------------------------------------------------------------------------


def test_quality_statistics_equal_brute_force(docs, empty, monkeypatch):
    want = Counter()
    for d, t, _ in sample():
        w, t = split(t), t or ""
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        worded = [x for x in t.split("\n") if split(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(worded) - len(set(worded)), len(cover), failed] += 1
    got = quality.judged(docs)
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    assert got.where("kept and base_failed").count() == 0
    assert quality.judged(empty).count() == 0 and quality.filtered(empty).columns == empty.columns
    kept = Counter(r for r in sample() if r[0] in {x["doc_id"] for x in got.where("kept").collect()} and r[1])
    assert multiset(quality.filtered(docs)) == kept and len(kept) > 3
    clash = docs.withColumns({"__q_w": F.lit("clash"), "__keep": F.lit(None)})
    assert multiset(quality.filtered(clash).drop("__q_w", "__keep")) == kept and quality.filtered(clash).columns == clash.columns
    # Wherever the cascade takes the repeats.
    with monkeypatch.context() as m:
        for order in ((quality.REPEATS, *quality.RULES), (*quality.RULES[::-1], quality.REPEATS)):
            m.setattr(quality, "ordered", lambda _, order=order: list(order))
            assert multiset(quality.filtered(docs)) == kept


def test_order_of_rules_never_changes_a_verdict(docs):
    a = quality.judged(docs, rules=quality.RULES).select("doc_id", "kept")
    b = quality.judged(docs, rules=quality.RULES[::-1], sample_rows=1).select("doc_id", "kept")
    assert multiset(a) == multiset(b)
    cheap, dear = quality.Rule("cheap", None), quality.Rule("dear", None)
    assert quality.ordered([(dear, 1.0, 0.5), (cheap, 0.1, 0.2)]) == [cheap, dear]


# op9 ---------------------------------------------------------------------------------------------------------------


def test_golay_indices_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2000)
    row, _ = golay.nearby(x)
    assert set(np.bincount(row)) == {1, 6}
    for bits in range(3):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(23, bits, replace=False):
                y[k] ^= 1 << b
        a, b = ([set() for _ in x] for _ in range(2))
        for sets, w in ((a, x), (b, y)):
            for r, i in zip(*golay.nearby(w), strict=True):
                sets[r].add(i)
        assert all(p & q for p, q in zip(a, b, strict=True))


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    for bits in range(5):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        a, b = ([set() for _ in x] for _ in range(2))
        for sets, w in ((a, x), (b, y)):
            for r, i in zip(*simhash.keys(w), strict=True):
                sets[r].add(i)
        assert all(p & q for p, q in zip(a, b, strict=True))


def components_of(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_simhash_groups_equal_brute_force(docs, empty):
    import xxhash

    def slow(t):
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        parts = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    rows = sample()
    fps = [slow(t) for _, t, _ in rows]
    root = components_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(rows[k][0], least.get(r, 1 << 60))
    want = Counter((rows[k][0], f"{fps[k]:016x}", least.get(r)) for k, r in enumerate(root))
    assert multiset(simhash.clustered(docs)) == want
    assert simhash.clustered(empty).count() == 0


def test_forest_spans_what_all_links_span():
    rng = np.random.default_rng(3)
    centre = np.uint64(rng.integers(0, 1 << 63))
    fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(300)], np.uint64))
    left, right = simhash.forest(fps)
    at = {int(x): k for k, x in enumerate(fps)}
    made = [(at[int(a)], at[int(b)]) for a, b in zip(np.concatenate(left), np.concatenate(right), strict=True)]
    every = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 4]
    assert components_of(len(fps), made) == components_of(len(fps), every) and len(made) < len(fps)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_copies_of_one_text_leave_nothing_to_hold(spark):
    rng = random.Random(13)
    base = [f"w{k}" for k in range(200)]
    texts = [(k, " ".join([*base[: k % 190], f"x{k}", *base[k % 190 + 1 :]])) for k in range(120)]
    rows = [(d, minhash.shingles(t.encode())) for d, t in texts]
    sets = spark.createDataFrame([(minhash.node(x), bytearray(x.tobytes())) for _, x in rows], "node long, set binary")
    met = sets.select(F.lit(5).cast("long").alias("key"), "node")
    left, links = minhash._thinned(met, sets, 80)
    assert left.count() == 0 and links.count() == 119
    chain = [base]
    for _ in range(12):  # each near the one before, the last far from the first
        chain.append(list(chain[-1]))
        for _ in range(2):
            chain[-1][rng.randrange(200)] = f"y{rng.randrange(10**6)}"
    ends = minhash.clustered(spark.createDataFrame([*texts, *((1000 + k, " ".join(c)) for k, c in enumerate(chain))], "doc_id long, text string"))
    assert {r["component_id"] for r in ends.collect()} == {0}


def test_texts_of_one_template_part_by_rare_shingles(spark):
    rng = random.Random(17)
    form = [f"w{k}" for k in range(150)]
    texts = [form + [f"d{k}n{j}" for j in range(60)] for k in range(50)]
    texts += [[*t[:205], f"late{k}", *t[206:]] for k, t in enumerate(texts[:10])]  # a near copy of each of the first ten
    rng.shuffle(texts)
    found = [minhash.shingles(" ".join(t).encode()) for t in texts]
    known = spark.createDataFrame([(minhash.node(x), bytearray(x.tobytes())) for x in found], "node long, set binary")
    near = {frozenset(minhash.node(found[k]) for k in p) for p in itertools.combinations(range(60), 2) if (both := len(np.intersect1d(found[p[0]], found[p[1]]))) * 180 >= 80 * (len(found[p[0]]) + len(found[p[1]]))}
    assert len(near) == 10
    met = minhash._met(known.select(F.lit(5).cast("long").alias("key"), "node"))
    assert {r["n"] for r in met.collect()} == {60}
    groups = defaultdict(set)
    for r in minhash._met(minhash._parted(met, known, 80)).collect():
        groups[r["key"]].add(r["node"])
    assert set(map(frozenset, groups.values())) == near and len(groups) == 10


@pytest.mark.parametrize("hot", [minhash.HOT, 8, 1])
def test_minhash_groups_equal_brute_force(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)  # so that keys are thinned
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in sample() if r[0] is not None]
    for g in range(40):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(60, 200))]
        rows.append((1000 + 10 * g, " ".join(base)))
        for j in range(3):  # similarities about 0.8
            edit = list(base)
            for _ in range(max(1, len(base) // rng.choice([40, 48, 60]))):
                edit[rng.randrange(len(edit))] = f"new{rng.randrange(10**6)}"
            rows.append((1001 + 10 * g + j, " ".join(edit)))
    sets = []
    for _, t in rows:
        w = [x.decode("utf-8", "replace") for x in (t or "").encode().lower().split()]
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    low = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        both, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if total == 0 or 10 * both >= 8 * total:
            low += bool(total) and 10 * both < 8.5 * total
            parent[root(i)] = root(j)
    want = {}
    for i, (d, _) in enumerate(rows):
        want[root(i)] = min(want.get(root(i), d), d)
    assert low > 5
    out = minhash.clustered(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, out.select("doc_id", "component_id").collect())) == Counter((d, want[root(i)]) for i, (d, _) in enumerate(rows))
    assert minhash.clustered(empty).count() == 0


def similar(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


@pytest.mark.parametrize("hot", [minhash.HOT, 4])
def test_near_copies_go_by_fingerprints_and_an_exact_check(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)  # so that a component goes by bands
    rng = random.Random(23)
    sets = lambda t: minhash.shingles(t.encode())
    apart = lambda a, b: (simhash.print_of(sets(a)) ^ simhash.print_of(sets(b))).bit_count()

    def edited(words, n):
        out = list(words)
        for k in rng.sample(range(len(out)), n):
            out[k] = f"new{rng.randrange(10**6)}"
        return " ".join(out)

    def pair(n, fits):
        while True:
            words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            base = " ".join(words)
            for _ in range(40):
                if fits(base, other := edited(words, n)):
                    return base, other

    near = pair(1, lambda a, b: apart(a, b) <= 4 and similar(sets(a), sets(b)) >= 0.8)
    alike = pair(6, lambda a, b: apart(a, b) <= 4 and similar(sets(a), sets(b)) < 0.8)  # by its fingerprint only
    wide = pair(4, lambda a, b: apart(a, b) > 6 and similar(sets(a), sets(b)) >= 0.8)  # not by its fingerprint
    words = [f"v{k}" for k in range(300)]
    many = [edited(words, 1) for _ in range(8)]
    texts = [*near, *alike, *wide, *many, near[0].upper(), "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, **dict.fromkeys(range(6, 14), 6), 14: 0, 15: 15, 16: 15}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()} == want
    assert simhash.near_copies(empty).count() == 0
    monkeypatch.setattr(minhash, "bands", lambda found: np.zeros(0, np.int64))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()}
    assert got[1] == 0 and got[14] == 0 and got[3] == 3 and got[5] == 5
    assert hot < 8 or {got[k] for k in range(6, 14)} == {6}
