"""The message cleaner: message -> lines -> runs -> paragraphs -> message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text

#: Fixed value: the second line of a Markdown table.
SEPARATOR = r"\|?\s*:?-{3,}:?\s*\|"
#: Fixed value: a numbered line of a reference list.
CITATION = r"(?U)^\s*(?:\[\d+\]|\d+[\.\)])\s+"


def collapse_tables(lines: DataFrame, key: list[str], pos: str = "line_pos", line: str = "line") -> DataFrame:
    """One placeholder row for each Markdown table, with ``table_lines``, its length.

    A table starts at the first line of a run of lines with ``|`` whose next line
    is a separator, and goes to the run's end.  Rows keep their order in ``pos``.
    """
    by = W.partitionBy(*key).orderBy(pos)
    bar = F.col(line).contains("|")
    df = lines.withColumn("_bar", bar).withColumn("_run", F.sum(F.when(bar, 0).otherwise(1)).over(by))
    df = df.withColumn("_starts", F.col("_bar") & F.coalesce(F.lead(F.col(line)).over(by).rlike(f"(?U){SEPARATOR}"), F.lit(False)))
    run = W.partitionBy(*key, "_run", "_bar")
    df = df.withColumn("_from", F.when(F.col("_bar"), F.min(F.when(F.col("_starts"), F.col(pos))).over(run)))
    df = df.withColumn("_end", F.max(pos).over(run))
    table = F.col("_from").isNotNull() & (F.col(pos) >= F.col("_from"))
    size = F.col("_end") - F.col("_from") + 1
    head = F.substring(text.normalize_space(line), 1, 240)
    mark = F.concat(F.lit("[Markdown table omitted locally: "), (size - 2).cast("string"), F.lit(" data rows; header: "), head, F.lit("]"))
    df = df.where(~table | (F.col(pos) == F.col("_from")))
    df = df.withColumn("table_lines", F.when(table, size).otherwise(0).cast("long")).withColumn(line, F.when(table, mark).otherwise(F.col(line)))
    return df.drop("_bar", "_run", "_starts", "_from", "_end")


def first_occurrence(df: DataFrame, scope: list[str], key: str, order: list[str]) -> DataFrame:
    """``repeat``: false for a key's first row of its scope."""
    w = W.partitionBy(*scope, key).orderBy(*order)
    return df.withColumn("repeat", F.row_number().over(w) > 1)


def clean_messages(messages: DataFrame) -> DataFrame:
    """(paper, msg, text) -> cleaned text and counters, one row for each message.

    Quoted lines go, tables collapse, reference lists become placeholders;
    paragraphs seen before in the paper (messages in the order of ``msg``) and
    courtesies go; long results keep head and tail.  Placeholders of reference
    lists are neither repeats nor seen; courtesies count as seen.
    """
    key = ["paper", "msg"]
    df = messages.select(*key, text.split_lines(text.or_empty("text")).alias("_lines")).withColumn("_left", F.filter("_lines", lambda x: ~text.is_quoted(x)))
    quoted = df.select(*key, (F.size("_lines") - F.size("_left")).alias("quoted_lines"))
    lines = collapse_tables(df.select(*key, F.posexplode("_left").alias("line_pos", "line")), key)  # places without the quoted lines
    whole = lines.groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"]), "\n").alias("_text"),
        F.sum("table_lines").alias("table_lines"),
    )
    parts = whole.select(*key, F.posexplode(text.split_paragraphs("_text")).alias("par", "p"))
    parts = parts.withColumn("compact", text.normalize_space("p")).withColumn("cites", F.size(F.filter(text.split_lines("p"), lambda x: x.rlike(CITATION))))
    listed = (F.length("compact") > 400) & (rules.matches("compact", rules.REFERENCE_HEAD) | (F.col("cites") >= 3))
    parts = parts.withColumn("listed", listed).withColumn("print", F.when(F.col("listed"), F.concat_ws("/", F.lit("ref"), "msg", "par")).otherwise(F.concat(F.lit("p:"), F.lower("compact"))))
    parts = first_occurrence(parts, ["paper"], "print", ["msg", "par"])
    parts = parts.withColumn("courtesy", ~F.col("listed") & ~F.col("repeat") & rules.is_courtesy("compact"))
    mark = F.concat(F.lit("[Reference list omitted locally: "), F.greatest("cites", F.lit(1)).cast("string"), F.lit(" entries]"))
    kept = F.when(~F.col("repeat") & ~F.col("courtesy"), F.struct("par", F.when(F.col("listed"), mark).otherwise(F.col("p")).alias("p")))
    out = parts.groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["p"]), "\n\n").alias("joined"),
        F.count_if("listed").alias("reference_blocks"), F.count_if("repeat").alias("duplicate_paragraphs"), F.count_if("courtesy").alias("courtesy_paragraphs"),
    )
    counts = ("quoted_lines", "table_lines", "reference_blocks", "duplicate_paragraphs", "courtesy_paragraphs")
    df = quoted.join(whole.select(*key, "table_lines"), key, "left").join(out, key, "left")
    df = df.withColumn("joined", text.or_empty("joined")).withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    return df.select(*key, text.head_tail("joined").alias("cleaned"), *counts, (F.length("joined") > text.MOST).cast("long").alias("truncated"))


def route_messages(cleaned: DataFrame) -> DataFrame:
    """``route`` of (kind, cleaned) rows: empty, reminder, nudge, local_event or discussion."""
    review, c = F.col("kind") == "reviewer_comments", F.col("cleaned")
    df = cleaned.withColumns({"score_action": rules.score_action(c), "concern_resolution": rules.resolution(c)})
    decided = (F.col("score_action") != "unknown") | (F.col("concern_resolution") != "unknown")
    return df.withColumn("route", rules.first_label([
        (c == "", "empty"),
        (review & rules.matches(c, rules.REMINDER_TERMS) & ~rules.matches(c, rules.SCORE_TERMS), "reminder"),
        ((F.col("kind") == "rebuttals") & rules.matches(c, rules.AUTHOR_NUDGE, "isU") & ~rules.matches(c, rules.CONTENT_TERMS), "nudge"),
        (review & decided, "local_event"),
    ], "discussion"))
