"""Chat formatting of reply trees.

Messages of a conversation form a tree by ``parent_id``. Root-to-leaf paths come from iterative
self-joins: a table of jumps (each message to its ancestor 1, 2, 4, ... steps up) is joined with
itself, and the messages known on each leaf's path are joined with the jumps, so a path of n
messages takes about log2(n) joins. Branches of a conversation are ranked by the sum of their
messages' scores, and each chosen path is one formatted conversation.

Template: ``### <role>: <text> </turn>`` and a line end per turn. Inside texts a backslash is
doubled and the marks ``###`` and ``</turn>`` get a backslash before them; in roles colons do too.
``parse`` undoes all of it. The loss mask is a list of spans of the formatted text: the text of
every assistant turn, without marks.

Defined cases: null text or role is empty; a null conversation id is a conversation of its own;
null scores count 0; a parent that does not exist makes its message a root; repeated message ids
keep the row with the smallest (role, text); rows without a message id are left out, as are
branches that hang on a cycle; equal branch scores rank by leaf id; extra columns are ignored;
repeated rows in a table of turns are turns of their own, tied turns go by role, then text.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import drop, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, CLOSE = "### ", " </turn>\n"
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*?): ((?:[^\\#<]|\\.|#(?!##)|<(?!/turn>))*) </turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    return out.replace(":", "\\:") if role else out


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the spans under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}: ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; raises on text that ``render`` cannot have made."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of a linear table ``(conv_id, turn, role, text)``: each row answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id", F.row_number().over(order).cast("long").alias("node_id"), "role", "text",
    ).select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
             "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """``conv, leaf, node, above``: every message on every root-to-leaf path, with its distance to
    the leaf. ``messages`` has ``conv, node, parent``, unique by (conv, node)."""
    known = messages.select("conv", F.col("node").alias("parent"))
    up = save(messages.where("parent is not null").join(known, ["conv", "parent"], "left_semi")
              .select("conv", "node", F.col("parent").alias("to")), "jumps")
    leaf = messages.join(up.select("conv", F.col("to").alias("node")), ["conv", "node"], "left_anti")
    on = save(leaf.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "paths")
    longest = messages.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    for k in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        more = (on.join(up, ["conv", "node"])
                .select("conv", "leaf", F.col("to").alias("node"), (F.col("above") + 2 ** k).alias("above")))
        wider = save(on.unionByName(more), "paths")
        ahead = up.select("conv", F.col("node").alias("to"), F.col("to").alias("end"))
        further = save(up.join(ahead, ["conv", "to"]).select("conv", "node", F.col("end").alias("to")), "jumps")
        drop(on)
        drop(up)
        on, up = wider, further
    roots = (messages.join(messages.select("conv", F.col("node").alias("parent")), ["conv", "parent"], "left_anti")
             .select("conv", "node"))
    whole = on.join(roots, ["conv", "node"], "left_semi").select("conv", "leaf")
    return on.join(whole, ["conv", "leaf"], "left_semi")


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """``conv_id, rank, leaf_id, formatted, loss`` of the best ``branches`` paths of each
    conversation (all of them by default). ``loss`` holds (start, end) spans of ``formatted``.

    ``messages`` has ``conv_id, node_id, parent_id, role, text, score``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    once = Window.partitionBy("conv", "node").orderBy("role", "text", "score", "parent")
    own = save(messages.where("node_id is not null").select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none")).alias("conv"), "conv_id",
        F.col("node_id").cast("long").alias("node"), F.col("parent_id").cast("long").alias("parent"),
        role.alias("role"), text.alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n"), "messages")
    on = paths(own.select("conv", "node", "parent")).join(own, ["conv", "node"])
    turns = on.groupBy("conv", "leaf").agg(
        F.first("conv_id").alias("conv_id"), F.sum("score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "role", "text"))).alias("turns"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
    ranked = turns.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [render((t["role"], t["text"]) for t in turns) for turns in part.column("turns").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("rank"), part.column("leaf"),
                     pa.array([m for m, _ in made], pa.string()),
                     pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["conv_id", "rank", "leaf_id", "formatted", "loss"])

    return ranked.select(F.col("conv_id").cast("long").alias("conv_id"), "rank", "leaf", "turns").mapInArrow(
        run, "conv_id long, rank int, leaf_id long, formatted string, loss array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations read back to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                under = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under),
                             hashlib.sha256(under.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
