"""Chat formatting: root-to-leaf paths of reply trees, ranked and written as conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm import ranking
from tidefold.llm.common import written

#: The template's marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Control strings that no formatted text or role may contain but as marks.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Steps of a score, and turns, that leaves and rows are ranked in.
SCORE_STEPS, TURNS = 64, 4096

#: What stands for the first character of a control string, and for a line feed in a role.
ENTITIES = (("<", "&lt;"), ("[", "&lsqb;"), ("\n", "&nl;"), ("&", "&amp;"))


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """Every `&` becomes `&amp;`; then the first character of each control string becomes its entity."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for first, entity in ENTITIES[:2]:
        rests = [re.escape(c[1:]) for c in controls if c[0] == first]
        if rests:
            out = F.regexp_replace(out, f"{re.escape(first)}(?={'|'.join(rests)})", entity)
    return out


def unescaped(text: str) -> str:
    for plain, entity in ENTITIES:
        text = text.replace(entity, plain)
    return text


def _node(tree: str, key: str) -> Column:
    return F.struct(F.col(tree).alias("t"), F.col(key).alias("k"))


def leaf_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Of messages (tree, id, parent, score): tree, leaf, rank, node, up, for each node of each chosen path.

    Ancestors are found by doubling: the k-th self-join gives every node the one 2^k above it and the score in between,
    so a tree of depth d takes log d joins. Leaves are ranked in their tree by the mean score of their path, then
    the longer path, then the smaller id; the first `branches` are kept (all if None) before any path is laid out. Laying
    out again takes log d joins, from the longest step to the shortest. `up` counts steps from the leaf.

    A parent that is absent makes its child a root. Nodes below a cycle never reach a root and have no path.
    """
    nodes = messages.select(_node("tree", "id").alias("node"), F.when(F.col("parent").isNotNull(), _node("tree", "parent")).alias("to"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("n"))
    present = nodes.select(F.col("node").alias("to"), F.lit(True).alias("__there"))
    linked = nodes.where("to is not null").join(present, "to", "left").select("node", F.when(F.col("__there"), F.col("to")).alias("to"), "total", "n")
    step = linked.unionByName(nodes.where("to is null").select("node", "to", "total", "n"))
    steps = [written(step, "steps")]
    most = steps[0].count()
    while (1 << (len(steps) - 1)) <= most and not steps[-1].where("to is not null").isEmpty():
        up = steps[-1].select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("total").alias("__total"), F.col("n").alias("__n"))
        # Nodes that have reached their root are done; only the others are joined.
        done, going = steps[-1].where("to is null"), steps[-1].where("to is not null")
        longer = going.join(up, "to", "left").select("node", F.col("__to").alias("to"), (F.col("total") + F.coalesce("__total", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"))
        longer = longer.unionByName(done)
        steps.append(written(longer, "steps"))
    whole = steps[-1].where("to is null")
    parents = steps[0].where("to is not null").select(F.col("to").alias("node")).distinct()
    leaves = whole.join(parents, "node", "left_anti")
    mean = F.col("total") / F.col("n")
    leaves = leaves.withColumn("t", F.col("node.t")).withColumn("b", -F.floor(mean * SCORE_STEPS))
    # In steps of the score, so a tree of any number of leaves isn't one task's.
    leaves = ranking.ranked(leaves, ["t"], "b", [mean.desc(), F.col("n").desc(), F.col("node.k")], "rank", "of").withColumn("rank", (F.col("rank") + 1).cast("int"))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    paths = leaves.select(F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(steps) - 2, -1, -1):
        # After a written step the plan starts anew, so the union never doubles it.
        paths = written(paths, "paths")
        above = steps[k].where("to is not null").select("node", "to")
        paths = paths.unionByName(paths.join(above, "node").select("leaf", "rank", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up")))
    return paths.select(F.col("leaf.t").alias("tree"), F.col("leaf.k").alias("leaf"), "rank", F.col("node.k").alias("node"), "up")


def formatted(messages: DataFrame, branches: int | None = None, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """Of messages (tree, id, parent, role, text, score): tree, leaf, rank, formatted, loss_spans.

    `loss_spans` are the [begin, end) code points of `formatted` that assistants' texts take. Null roles and texts are
    empty. Messages that share an id count as one (the first by role and text). An empty table has no conversations.
    """
    spoken = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")).alias("__m")).select("tree", "id", "__m.*")
    spoken = written(spoken, "messages")
    paths = leaf_paths(spoken.select("tree", "id", "parent", "score"), branches)
    said = spoken.select(F.col("tree").alias("__tree"), F.col("id").alias("__id"), "role", "text")
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("node") == F.col("__id")))
    role = F.replace(escaped(F.col("role"), controls), F.lit("\n"), F.lit("&nl;"))
    body = escaped(F.col("text"), controls)
    turns = turns.select("tree", "leaf", "rank", "up", (F.col("role") == "assistant").alias("__loss"), F.concat(F.lit(OPEN), role, F.lit("\n")).alias("__head"), body.alias("__body"))
    turns = turns.withColumn("__len", (F.length("__head") + F.length("__body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("__len").over(before), F.lit(0)) + F.length("__head")
    turns = turns.select("tree", "leaf", "rank", (-F.col("up")).alias("at"), F.concat("__head", "__body", F.lit(CLOSE)).alias("seg"), "__loss", begin.alias("begin"), (begin + F.length("__body")).alias("end"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "seg", "begin", "end", "__loss"))).alias("t"))
    return whole.select(
        "tree",
        "leaf",
        "rank",
        F.concat_ws("", F.transform("t", lambda x: x["seg"])).alias("formatted"),
        F.transform(F.filter("t", lambda x: x["__loss"]), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"))).alias("loss_spans"),
    )


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    out = []
    for segment in formatted.split(OPEN)[1:]:
        role, text = segment.split("\n", 1)
        if not text.endswith(CLOSE):
            raise ValueError("a turn isn't closed")
        out.append((unescaped(role), unescaped(text[: -len(CLOSE)])))
    return out


def read_back(conversations: DataFrame) -> DataFrame:
    """Of (tree, formatted, loss_spans): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = conversations.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                text, spans = text.as_py(), spans.as_py()
                turns = parsed(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescaped(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("tree", "formatted", "loss_spans").where("formatted is not null").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages (tree, id, parent, role, text, score): each turn replies to the one before.

    Rows of a conversation go by turn, then role and text, nulls first; so repeated rows follow each other. A null
    conv_id is a conversation too.
    """
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text", F.floor(F.col("turn") / TURNS).alias("b"))
    # In runs of turns, so a conversation of any length isn't one task's.
    rows = ranking.ranked(rows, ["tree"], "b", [F.col("turn"), F.col("role"), F.col("text")], "id", "of").withColumn("id", F.col("id") + 1)
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
