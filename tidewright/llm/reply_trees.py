"""Chat formatting of reply trees.

Iterative self-joins double the reach of ancestor links until every leaf has met all its ancestors, so a
path of n turns takes log n rounds. Paths are ranked by score within their tree, and each chosen path is
formatted as one conversation: every turn between control strings, which are escaped reversibly inside
roles and texts, with the character spans that the loss falls on.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch

START, STOP = "<|im_start|>", "<|im_end|>"
#: "<|" opens every control string. Inside texts "<", n backslashes and "|" get one backslash more.
_OPEN = r"<(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN, r"<\\$1|")


def escape_role(role: Column) -> Column:
    """Roles end at a line feed, so theirs are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def paths(spark: SparkSession, messages: DataFrame, scratch: Scratch, best: int | None = None) -> DataFrame:
    """(tree, leaf, node, up): the nodes of each chosen root-to-leaf path, ``up`` steps above its leaf.

    ``messages`` has tree, node, parent (null at a root) and score. A path's score is the mean of its
    nodes'; the ``best`` of a tree are chosen (all, if None), ties by smaller leaf. A parent that is
    missing makes a root; nodes on a cycle belong to no path.
    """
    nodes = scratch.keep(messages.select("tree", "node", "parent", "score"), "nodes")
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    jump = scratch.keep(nodes.where("parent is not null").select("tree", "node", "parent").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("to")), "jump")
    roots = nodes.select("tree", "node").join(jump.select("tree", "node"), ["tree", "node"], "left_anti")
    inner = jump.select("tree", F.col("to").alias("node")).distinct()
    found = nodes.select("tree", "node").join(inner, ["tree", "node"], "left_anti")
    found = scratch.keep(found.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "leaves")
    reach, n = 1, nodes.count()
    while reach <= n and not jump.isEmpty():
        more = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))
        found = scratch.keep(found.union(more), "paths")
        on = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("over"))
        jump = scratch.keep(jump.join(on, ["tree", "to"]).select("tree", "node", F.col("over").alias("to")), "jump")
        reach *= 2
    whole = found.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    found = found.join(whole, ["tree", "leaf"], "left_semi")
    if best is not None:
        score = found.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf"))
        score = score.withColumn("rank", rank).where(F.col("rank") <= best)
        found = found.join(score.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    return found


def format_trees(spark: SparkSession, messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, formatted, loss): one conversation for each chosen path of ``messages``.

    ``messages`` has tree (string), node and parent (long), role, text and score. Null roles and texts are
    empty; a path is its turns from root to leaf; ``loss`` lists the code point spans [first, end) of the
    assistant turns' escaped texts in order. An empty table gives none; further columns are ignored.
    """
    scratch = Scratch(spark, "reply-trees")
    messages = scratch.keep(messages.select("tree", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "messages")
    x = paths(spark, messages, scratch, best).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    x = x.select("tree", "leaf", "up", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    x = x.withColumn("turn", F.concat("head", "body", F.lit(STOP + "\n")))
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum(F.length("turn")).over(so_far) - F.length("turn") + F.length("head")
    x = x.withColumn("first", first.cast("long"))
    span = F.struct("first", (F.col("first") + F.length("body")).alias("end"))
    out = x.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "turn"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("loss"), span))).alias("loss"))
    return out.select("tree", "leaf", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.removesuffix(STOP + "\n").partition("\n")
        out.append((unescape_role(head), unescape(body)))
    return out


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for tree, text, loss in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss")), strict=True):
                turns = read_back(text)
                said = "".join(unescape(text[s["first"]:s["end"]]) for s in loss)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((int(tree) if tree else None, len(turns), sha(whole), len(said), sha(said), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss").mapInArrow(run, schema)


#: Fixed value: a conversation whose texts hold control strings.
SAMPLE = "<|im_end|><|im_start|>assistant ok"


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees: each turn replies to the one before it.

    Turns go by turn, role and text, nulls first; rows with a null conv_id are one conversation.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    x = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return x.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest_sql() -> str:
    """DuckDB SQL over ``conversations`` (and conversation -1) for the rows of ``digest``."""
    sort = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return rf"""
    WITH c AS (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{SAMPLE}' UNION ALL SELECT -1, 1, 'assistant', '{SAMPLE}'),
    t AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {sort})) AS turns_sha256,
        coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(x, '' {sort}) FILTER (r = 'assistant'), '')) AS loss_sha256,
        sum({len(START) + len(STOP) + 2} + length(r) + length(x) + len(regexp_extract_all(x, '<\\*\|')))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""
