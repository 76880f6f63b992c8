"""Chat formatting of reply trees.

Messages form trees by parent. Iterative self-joins with doubling reach list, for every leaf, its whole path from the root (a chain of
depth d takes log2(d) joins); branches are ranked by score; each chosen path becomes one conversation text. Turns are
marked with the template's control strings, which are escaped inside texts, reversibly: every `<|` becomes `<\\|` and
every `<\\` run gets one more backslash; a role keeps to one line. The loss mask is the list of code-point spans of assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlab.session import materialise, release

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_TO = re.compile(r"<(\\*)\|")
_FROM = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """text without `<|`: a backslash more between `<` and `|`."""
    return _TO.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _FROM.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: a backslash is doubled, a line end becomes a backslash and n; then as escape."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, spans): the conversation text and the code-point spans of its trained texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def root_paths(messages: DataFrame) -> DataFrame:
    """(leaf, message, up) for every leaf of a tree: the messages on its path, up steps above it.

    messages: id, parent (null at a root). A parent that is missing counts as a root's null; messages on or under a cycle reach
    no root and are left out; repeated ids count once (the smallest parent).
    """
    nodes = messages.filter("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    ids = nodes.select(F.col("id").alias("parent"))
    below = nodes.filter("parent is not null").join(ids.withColumn("there", F.lit(True)), "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"))
    nodes = materialise(nodes.filter("parent is null").select("id", "parent").union(below), "tree")  # roots share no key, so none of them meet
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("id")).distinct()
    paths = nodes.join(parents, "id", "left_anti").select(F.col("id").alias("leaf"), F.col("id").alias("message"), F.lit(0).cast("long").alias("up"))
    jump = nodes.filter("parent is not null").select(F.col("id").alias("message"), F.col("parent").alias("to"))
    step, total = 1, nodes.count()
    while step <= total and not jump.isEmpty():
        more = paths.join(jump, "message").select("leaf", F.col("to").alias("message"), F.col("up") + step)
        was = paths, jump
        paths = materialise(paths.union(more), "paths")
        jump = materialise(jump.join(jump.select(F.col("message").alias("to"), F.col("to").alias("next")), "to").select("message", F.col("next").alias("to")), "jumps")
        release(*was)
        step *= 2
    roots = nodes.filter("parent is null").select(F.col("id").alias("message"))
    whole = paths.join(roots, "message").select("leaf")
    return paths.join(whole, "leaf", "left_semi")


def best_paths(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, nth, score, position, role, text) of the chosen paths of every tree, positions from the root.

    messages: id, parent, tree, role, text, score. A path's score is the mean of its messages' scores (null: 0); paths of a tree
    are ranked by it, ties to the longer path, then to the smaller leaf; the first per_tree are kept (all, if None).
    """
    paths = root_paths(messages)
    # one row per id, the one with the smallest parent, as in root_paths
    order = Window.partitionBy("id").orderBy(F.col("parent").asc_nulls_last(), "role", "text")
    once = messages.filter("id is not null").withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    score = F.coalesce("score", F.lit(0.0))
    scored = paths.join(once.select(F.col("id").alias("message"), score.alias("score")), "message")
    scored = scored.groupBy("leaf").agg((F.sum("score") / F.count("*")).alias("score"), F.max("up").alias("depth"))
    ranked = scored.join(once.select(F.col("id").alias("leaf"), "tree"), "leaf")
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")
    chosen = ranked.withColumn("nth", F.row_number().over(rank))
    chosen = chosen if per_tree is None else chosen.filter(F.col("nth") <= per_tree)
    full = paths.join(chosen, "leaf").join(once.select(F.col("id").alias("message"), "role", "text"), "message")
    return full.select("tree", "leaf", "nth", "score", (F.col("depth") - F.col("up")).alias("position"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, spans) of each path of best_paths: the text and the spans under the loss mask."""
    turns = paths.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
            yield pd.DataFrame({"tree": pdf["tree"], "leaf": pdf["leaf"], "formatted": [m[0] for m in made], "spans": [[list(s) for s in m[1]] for m in made]})

    return turns.mapInPandas(run, "tree long, leaf string, formatted string, spans array<array<long>>")


def threads(conversations: DataFrame) -> DataFrame:
    """messages (for best_paths) of a table conv_id, turn, role, text: each row answers the one before it by turn.
    Equal turns go by role, then text; null turns come first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", F.row_number().over(order))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    at = lambda n: F.concat_ws(":", conv, n.cast("string"))
    return rows.select(at(F.col("nth")).alias("id"), F.when(F.col("nth") > 1, at(F.col("nth") - 1)).alias("parent"), F.col("conv_id").alias("tree"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of formatted conversations, from their text and spans alone."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, spans in zip(pdf["formatted"], pdf["spans"], strict=True):
                turns, loss = parse(text), "".join(unescape(text[a:b]) for a, b in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            got = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([pdf["tree"].rename("conv_id").reset_index(drop=True), got], axis=1)

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
