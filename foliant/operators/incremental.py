"""Daily increments, snapshots, progress and activity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking, sampling


def remaining(inventory: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return inventory.join(processed.select(key), key, "left_anti")


def daily_selection(inventory: DataFrame, processed: DataFrame, run: int, rate: float, key: str, year: str) -> DataFrame:
    """The rows of run ``run``: the next step of the cumulative target, split over years
    by largest remainder (ties: the earlier year), each year's first rows in hash order."""
    total = inventory.count()
    left = remaining(inventory, processed, key)
    step = sampling.daily_targets(total, rate, inventory.sparkSession.createDataFrame([(run,)], "run int")).first()["papers"]
    strata = left.groupBy(year).agg(F.count("*").alias("n"))
    have = left.count()
    if not have:
        return left
    strata = sampling.quotas(strata, min(have, step), [F.col(year).asc()])
    return sampling.take_quota(left, strata, year, ranking.hash_order(year, key))


def snapshot(baseline: DataFrame, runs: DataFrame, key: str, date: str) -> DataFrame:
    """Baseline rows replaced by the latest run's (``date`` is null in the baseline)."""
    both = baseline.withColumn(date, F.lit(None).cast("date")).unionByName(runs, allowMissingColumns=True)
    return ranking.best_per_key(both, [key], [F.col(date).desc_nulls_last()])


def trailing_days(as_of: Column, days: int = 3) -> Column:
    """``as_of`` and the days before it, newest first."""
    return F.sequence(as_of, F.date_sub(as_of, days - 1), F.expr("interval -1 day"))


def previous_week(as_of: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week before that of ``as_of``."""
    monday = F.date_trunc("week", as_of).cast("date")
    return F.date_sub(monday, 7), F.date_sub(monday, 1)


def recent(added_on: str, as_of: Column, days: int = 30) -> Column:
    return F.col(added_on) >= F.date_sub(as_of, days)


def in_report(day: str, as_of: Column) -> Column:
    """Days of the trailing three or of the previous week."""
    start, end = previous_week(as_of)
    return F.col(day).between(F.date_sub(as_of, 2), as_of) | F.col(day).between(start, end)


def replace_block(text: str | Column, name: str, content: str | Column) -> Column:
    """``text`` with what stands between the START and END markers replaced; an error without them."""
    text = F.col(text) if isinstance(text, str) else text
    content = F.lit(content) if isinstance(content, str) else content
    start, end = f"<!-- {name}:START -->", f"<!-- {name}:END -->"
    at = F.locate(start, text)
    rest = text.substr(at + len(start), F.length(text))
    stop = F.locate(end, rest)
    body = F.regexp_replace(content, r"(?U)[\s\x1c-\x1f]+$", "")
    made = F.concat(text.substr(F.lit(1), at - 1), F.lit(start + "\n"), body, F.lit("\n" + end), rest.substr(stop + len(end), F.length(rest)))
    return F.when((at > 0) & (stop > 0), made).otherwise(F.raise_error(F.lit(f"markers missing: {name}")))


def progress(items: DataFrame, corpus: int, tags: str = "research_tags", outcomes: str = "response_outcomes", top: int = 20) -> DataFrame:
    """(metric, key, value): analysed papers and their coverage in per cent, papers of the
    ``top`` tags, and outcomes by effectiveness and by score action (null or empty: unknown)."""
    number = lambda c: c.cast("double").alias("value")
    none = F.lit(None).cast("string").alias("key")
    known = lambda c: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.lit("unknown")).alias("key")
    totals = items.agg(F.count("*").alias("n"))
    rows = totals.select(F.lit("analyzed_papers").alias("metric"), none, number(F.col("n")))
    rows = rows.unionByName(totals.select(F.lit("coverage_percent").alias("metric"), none, number(F.bround(F.col("n") / F.lit(corpus) * 100, 4))))
    each = items.select(F.explode(outcomes).alias("o"))
    for metric, field in (("response_effectiveness", "effectiveness"), ("score_actions", "score_action")):
        rows = rows.unionByName(each.groupBy(known(field)).agg(number(F.count("*"))).withColumn("metric", F.lit(metric)))
    common = items.select(F.explode(tags).alias("key")).where("key <> ''").groupBy("key").agg(number(F.count("*"))).orderBy(F.desc("value"), "key").limit(top)
    return rows.unionByName(common.withColumn("metric", F.lit("top_research_tags")))
