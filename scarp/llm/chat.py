"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins enumerate the root-to-leaf paths: each round joins the paths found so far
with jumps of twice the length, so a tree of depth d takes log2(d) rounds, and a message without a parent in its tree is a
root. Paths are ranked by the sum of their messages' scores (ties to the smaller leaf) and the best of each tree are formatted,
each as one conversation. A formatted conversation is the text of its turns in order:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|`` (in a role a line feed becomes ``\\n``), so that no
text can hold a control string, and reading undoes it. The loss mask covers the text of assistant turns.

Null role or text counts as empty. Rows of a conversation with one turn number follow in the order of role and text;
repeated rows are turns. A null conv_id is a conversation of its own. An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarp.llm.texts import stored

START, END, TAIL = "<|im_start|>", "<|im_end|>", "\n"
LOSS_ROLE = "assistant"
NO_ID = -(1 << 63)
TURNS_PER_RANGE = 256
_TURN = re.compile(re.escape(START) + r"((?:[^\n\\]|\\.)*)\n((?:(?!<\|)[\s\S])*)" + re.escape(END + TAIL))


def escape(s: str, role: bool = False) -> str:
    s = s.replace("\\", "\\\\").replace("<|", "<\\|")
    return s.replace("\n", "\\n") if role else s


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S) if "\\" in s else s


def as_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages (tree, node, parent, role, text, score): each row replies to the one before.

    Rows are numbered per range of turn numbers, with the ranges before added, so that a long conversation is dealt out.
    """
    t = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("tree"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("range", F.coalesce(F.floor(F.col("turn") / TURNS_PER_RANGE), F.lit(NO_ID)))
    sizes = t.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("tree", "range", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("tree", "range").orderBy("turn", "role", "text"))
    numbered = t.withColumn("place", place).join(first, ["tree", "range"])
    node = F.col("first") + F.col("place") - 1
    return numbered.select("tree", node.alias("node"), F.when(node > 0, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, back): for each leaf the messages from it (back 0) to its root."""
    nodes = messages.select("tree", "node")
    up = stored(messages.where("parent IS NOT NULL").select("tree", "node", "parent")
                .join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
                .select("tree", "node", F.col("parent").alias("to")), "reply-jumps")
    leaves = nodes.join(up.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    found = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "reply-paths")
    total, step = messages.count(), 1
    while not up.isEmpty():
        if step > total:
            raise ValueError("replies form a cycle")
        more = found.join(up, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("back") + step).alias("back"))
        found = stored(found.unionByName(more), "reply-paths")
        ahead = up.select("tree", F.col("node").alias("to"), F.col("to").alias("then"))
        up = stored(up.join(ahead, ["tree", "to"]).select("tree", "node", F.col("then").alias("to")), "reply-jumps")
        step *= 2
    return found


def best_paths(found: DataFrame, messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """The paths of the ``per_tree`` best branches of each tree."""
    scores = (found.join(messages.select("tree", "node", "score"), ["tree", "node"])
              .groupBy("tree", "leaf").agg(F.sum("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= per_tree).select("tree", "leaf", "rank")
    return found.join(best, ["tree", "leaf"])


_PARTS = "tree long, leaf long, turn long, part string, loss_start long, loss_end long"


def format_paths(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """The formatted conversations, a row per turn in order: tree, leaf, turn, part, loss_start, loss_end.

    A conversation is the concatenation of its parts. Loss positions count code points of the conversation; they are null
    where a turn has no loss. Parts stream, so the length of a conversation is not held in memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, turn = None, 0, 0
        for b in batches:
            out = []
            for tree, leaf, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if key != (tree, leaf):
                    key, at, turn = (tree, leaf), 0, 0
                head, body = f"{START}{escape(role, True)}\n", escape(text)
                a = at + len(head)
                loss = (a, a + len(body)) if role == LOSS_ROLE else (None, None)
                part = head + body + END + TAIL
                out.append((tree, leaf, turn, part, *loss))
                at, turn = at + len(part), turn + 1
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                                  ["tree", "leaf", "turn", "part", "loss_start", "loss_end"])

    rows = chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    return (rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", F.desc("back"))
            .select("tree", "leaf", "role", "text").mapInArrow(run, _PARTS))


def read_back(parts: DataFrame) -> DataFrame:
    """Per formatted conversation what reading it gives: turns, their digest, and what lies under the loss mask.

    ``parts`` are rows of ``format_paths`` in their order; a part that is not a well-formed turn raises.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def row():
            return key[0], n, turns.hexdigest(), lost, loss.hexdigest(), at

        for b in batches:
            out = []
            for tree, leaf, part, a, z in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if key != (tree, leaf):
                    if key:
                        out.append(row())
                    key, n, at, lost, turns, loss = (tree, leaf), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if not (m := _TURN.fullmatch(part)):
                    raise ValueError("a turn is damaged")
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if a is not None:
                    text = unescape(part[a - at:z - at])
                    lost += len(text)
                    loss.update(text.encode())
                n, at = n + 1, at + len(part)
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        if key:
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row(), kinds)], names)

    schema = "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.mapInArrow(run, schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted parts of conversations given as turns (see ``format_paths``)."""
    messages = stored(as_messages(turns), "messages")
    return format_paths(best_paths(paths(messages), messages), messages)
