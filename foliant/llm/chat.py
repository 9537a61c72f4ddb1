r"""Op 4: chat formatting of reply trees.

Messages (tree, id, parent, score, role, text) form trees.  Self-joins that
double their reach enumerate the paths: after round k every message knows its
ancestor 2**k steps up, and every leaf the ancestors fewer than 2**(k+1) steps
up, so a path of m messages takes log2(m) rounds and each (leaf, ancestor) pair
appears once.  Leaves of a tree are ranked by their path's score; each chosen
path becomes one conversation.

Template: a turn is ``<|role|>``, a line feed, the text, ``<|end|>`` and a line
feed.  In texts and roles each ``<``, ``[`` and ``\`` is followed by an added
``\`` (in roles ``|`` too), which breaks every control string of this and other
templates (``</s>``, ``[INST]``, ``<|end|>``) and is undone by dropping it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: The template's control strings.
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
#: Fixed value: the conversation that op4 adds, a text full of control strings.
PROBE = "</s>[INST] ok [/INST]"


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([<\[\\{more}])", r"$1\\")


def unescaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([<\[\\{more}])\\", "$1")


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, id, depth, path_score, rank) of the messages on each leaf's path, depth 0 at the root.

    ``messages``: tree, id (unique in its tree), parent, score.  A message whose
    parent is null or missing is a root.  Messages on or below a cycle have no
    root and give no path.  Null scores count as 0; a path's score is its mean,
    ties go to the smaller leaf.  ``best`` keeps that many branches of a tree
    (null: all).
    """
    nodes = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    up = nodes.join(known, ["tree", "parent"], "left").select("tree", "id", F.expr("if(known, parent, null)").alias("up"), "score")
    up = common.cut(up)
    leaves = up.join(up.select("tree", F.col("up").alias("id")).where("id is not null").distinct(), ["tree", "id"], "left_anti")
    on = common.cut(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("height")))
    jump = up.where("up is not null").select("tree", "id", "up")
    reach, most = 1, up.count()
    while not jump.isEmpty() and reach <= 2 * most:
        higher = on.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("height") + reach).alias("height"))
        on = common.cut(on.unionByName(higher))
        after = jump.select("tree", F.col("id").alias("up"), F.col("up").alias("top"))
        jump = common.cut(jump.join(after, ["tree", "up"]).select("tree", "id", F.col("top").alias("up")))
        reach *= 2
    roots = up.where("up is null").select("tree", "id", F.lit(True).alias("root"))
    scored = on.join(up.select("tree", "id", "score"), ["tree", "id"]).join(roots, ["tree", "id"], "left")
    each = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"), F.max("height").alias("top"), F.max(F.coalesce("root", F.lit(False))).alias("rooted"))
    order = W.partitionBy("tree").orderBy(F.desc("path_score"), F.asc("leaf"))
    each = each.where("rooted").withColumn("rank", F.row_number().over(order))
    if best is not None:
        each = each.where(F.col("rank") <= best)
    return on.join(each, ["tree", "leaf"]).select("tree", "leaf", "id", (F.col("top") - F.col("height")).alias("depth"), "path_score", "rank")


def format_paths(chosen: DataFrame, messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, path_score, formatted, mask): one row for each chosen path.

    ``mask`` has a struct for each turn, in order: start (of the turn in
    ``formatted``), first and length (of the text under the loss mask within the
    turn, in characters; length 0 where the role is not ``learned``).
    """
    turns = chosen.join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), escaped(role, "|"), F.lit(SHUT))
    turns = turns.withColumns({"_head": F.length(head), "_text": escaped(text), "_turn": F.concat(head, escaped(text), F.lit(END)), "_mine": role == learned})
    path = W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("_start", F.coalesce(F.sum(F.length("_turn").cast("long")).over(path), F.lit(0).cast("long")))
    turns = turns.withColumn("_span", F.struct(F.col("_start").alias("start"), F.col("_head").alias("first"), F.when(F.col("_mine"), F.length("_text")).otherwise(0).alias("length")))
    rows = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(F.struct("depth", "_turn", "_span"))).alias("_all"))
    return rows.select("tree", "leaf", "rank", "path_score", F.array_join(F.expr("transform(_all, x -> x._turn)"), "").alias("formatted"), F.expr("transform(_all, x -> x._span)").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss`` (the text under the mask), both unescaped."""
    parts = F.slice(F.split("formatted", r"<\|end\|>\n"), F.lit(1), F.size("mask"))
    df = formatted.withColumn("_parts", parts)
    df = df.withColumn("_r", F.transform("_parts", lambda p: unescaped(F.substring(p, F.lit(3), F.locate("|>\n", p, 3) - 3), "|")))
    df = df.withColumn("_t", F.transform("_parts", lambda p: unescaped(p.substr(F.locate("|>\n", p, 3) + 3, F.length(p)))))
    df = df.withColumn("turns", F.arrays_zip(F.col("_r").alias("role"), F.col("_t").alias("text")))
    loss = F.zip_with("_parts", "mask", lambda p, m: unescaped(p.substr(m["first"] + 1, m["length"])))
    return df.withColumn("loss", F.array_join(loss, "")).drop("_parts", "_r", "_t")


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as messages: each turn replies to the one before.

    Rows follow each other by turn (null first), role and text; repeated rows are
    turns of their own.  Roles and texts that are null count as empty.  Rows without a
    conv_id are one conversation, without a conv_id.  ``op4`` adds its two turns to
    the rows, so a conversation -1 of the table itself has them among its own.
    """
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    rows = rows.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.where("tree is not null").unionByName(rows.where("tree is null").withColumn("tree", F.lit(NO_ID)))
    order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


#: Stands for a null conv_id while trees are joined.
NO_ID = -(1 << 62)


def digest(rows: DataFrame) -> DataFrame:
    """op4's columns, from what is read back of the formatted conversations."""
    back = read_back(rows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != NO_ID, F.col("tree")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    messages = common.cut(conversations_as_trees(rows))
    return digest(format_paths(paths(messages), messages))


SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(2 + length(regexp_replace(role, '([<\[\\|])', '\1\\', 'g')) + 3 + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) + 8)::BIGINT AS formatted_chars
FROM numbered GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_chat_trees": op4_chat_trees}
ORACLES = {"op4_chat_trees": SQL}
