"""Joins, ID reconciliation, the event merge and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text


def reconcile_ids(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """(key, status) of the distinct ids on either side: both, missing or extra."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(True))
    b = returned.select(key).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_e") & F.col("_r"), "both").when(F.col("_e"), "missing").otherwise("extra")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def left_default(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    joined = left.join(right, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def routed(papers: DataFrame, patterns: list[tuple[str, str, str, str]], fallback: dict[str, str], search: str = "search", domains: str = "domains") -> DataFrame:
    """A row for each archetype of a paper: those of its domains whose pattern occurs,
    or the domain's fallback where none does.  The patterns are unrolled: no join."""
    per = []
    for domain, other in fallback.items():
        found = F.filter(F.array(*[F.when(rules.matches(search, p), F.lit(i)) for i, d, _, p in patterns if d == domain]), lambda x: x.isNotNull())
        hit = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))
        per.append(F.when(F.array_contains(domains, domain), hit).otherwise(F.array().cast("array<string>")))
    return papers.withColumn("archetype", F.explode(F.array_distinct(F.flatten(F.array(*per)))))


def regex_join(rows: DataFrame, search: str, patterns: dict[str, str], rule: str = "rule") -> DataFrame:
    """A row for each literal pattern that occurs in a text, as RE2 reads it: unrolled, each is compiled once."""
    hits = F.filter(F.array(*[F.when(F.col(search).rlike(rules.as_re2(p)), F.lit(i)) for i, p in patterns.items()]), lambda x: x.isNotNull())
    return rows.withColumn(rule, F.explode(hits))


def attributed(base: DataFrame, later: DataFrame, key: str, value: str, when: str) -> DataFrame:
    """(key, value) of every key of either source: the last of ``later`` by ``when``, else that of ``base``."""
    rows = base.select(key, value, F.lit(None).cast(later.schema[when].dataType).alias(when)).unionByName(later.select(key, value, when))
    return rows.groupBy(key).agg(F.max(F.struct(F.col(when).alias("w"), F.col(value).alias("v"))).alias("last")).select(key, F.col("last.v").alias(value))


def provenance_counts(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """How many outcomes were merged from events, and how many were reconciled."""
    return outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("merged_from").isNotNull()).alias("merged"), F.count_if("reconciled").alias("reconciled"))


def membership(groups: DataFrame, group: str, members: str) -> DataFrame:
    """member -> group from (group, ARRAY members)."""
    return groups.select(F.explode(members).alias("member"), F.col(group).alias("group"))


def merge_events(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """Local events merged into a paper's outcomes.

    ``outcomes``: paper, pos, reviewer_id, effectiveness, score_action, confidence.
    ``events``: paper, ord, reviewer_id, source_message_id, evidence.
    Keys are (paper, reviewer without prefix, action).  An event whose key has
    outcomes changes the last of them; the first event of an unmatched key adds
    one, later ones change that.  Action and resolution come from the evidence.
    """
    key = ["paper", "rid", "score_action"]
    e = events.withColumns({"rid": text.without_reviewer("reviewer_id"), "evidence": text.or_empty("evidence")})
    e = e.withColumns({"score_action": rules.score_action("evidence"), "effect": rules.effect_of(rules.resolution("evidence"))})
    per = e.groupBy(*key).agg(
        F.min("ord").alias("first_ord"), F.count("*").alias("n_events"), F.min_by("reviewer_id", "ord").alias("raw_id"),
        F.max_by(F.struct("effect", "source_message_id", "evidence"), "ord").alias("last"),
    )
    o = outcomes.withColumn("rid", text.without_reviewer("reviewer_id"))
    o = o.withColumn("_last", F.col("pos") == F.max("pos").over(W.partitionBy(*key)))
    joined = o.join(per, key, "full_outer")
    old, hit = F.col("pos").isNotNull(), F.coalesce(F.col("_last"), F.lit(False)) & F.col("n_events").isNotNull()
    new = ~old
    changed = hit | new
    return joined.select(
        "paper", F.when(old, F.col("pos")).alias("pos"), F.when(new, F.col("first_ord")).alias("event_ord"),
        F.when(old, F.col("reviewer_id")).otherwise(F.col("raw_id")).alias("reviewer_id"), "score_action",
        F.when(changed, F.col("last.effect")).otherwise(F.col("effectiveness")).alias("effectiveness"),
        F.when(old, F.col("confidence")).otherwise(F.lit(0.95)).alias("confidence"),
        F.when(new, F.lit("python_filter")).alias("source"),
        F.when(changed, F.col("last.source_message_id")).alias("source_message_id"),
        F.when(changed, F.col("last.evidence")).alias("evidence_excerpt"),
        (hit | (new & (F.col("n_events") > 1))).alias("local_reconciled"),
    )


def enum_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of every value of a fixed domain, zeros included."""
    domain = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return domain.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def qa_report(expected: DataFrame, returned: DataFrame, key: str = "openreview_id") -> DataFrame:
    """One row: counts, duplicates, and the lists of errors and warnings."""
    ids = reconcile_ids(expected, returned, key).agg(
        F.count_if(F.col("status") != "extra").alias("expected_papers"), F.count_if(F.col("status") != "missing").alias("unique_papers"),
        F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "extra").alias("extra"),
    )
    rows = returned.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("returned_papers"), F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    both = ids.crossJoin(rows)  # one row each
    only = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return both.withColumn("errors", only(F.col("missing") + F.col("extra") > 0, f"{key}_mismatch")).withColumn("warnings", only(F.col("duplicate_ids") > 0, f"duplicate_{key}_deduplicated"))


def with_raw(column: str, fields: dict[str, Column], element: str = "x") -> Column:
    """Array of structs whose ``fields`` are normalised, their old values kept as ``<field>_raw``."""

    def one(x: Column) -> Column:
        for name in fields:
            x = x.withField(f"{name}_raw", x[name])
        for name, make in fields.items():
            x = x.withField(name, make(x[f"{name}_raw"]))
        return x

    return F.transform(column, one)
