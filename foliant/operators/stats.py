"""Histograms, nearest-rank quantiles, phase splits and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts by keys and value; a null value is ``None``."""
    return df.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, value: str, fractions: list[float], keys: list[str] | None = None) -> DataFrame:
    """Values at the half-even index round((n - 1) * f) of the sorted values.

    Equal values are counted first, so a rank is found among distinct values and
    their running counts, and no group's values are gathered in one row.
    """
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    counts = counts.withColumns({"upto": F.sum("c").over(by.orderBy("v")), "total": F.sum("c").over(by)})
    at = [half_even((F.col("total") - 1) * F.lit(f)).cast("long") for f in fractions]
    held = [F.max(F.when((F.col("upto") > a) & (F.col("upto") - F.col("c") <= a), F.col("v"))).alias(f"p{round(f * 100)}") for f, a in zip(fractions, at, strict=True)]
    return counts.groupBy(*keys).agg(F.sum("c").alias("n"), *held)


def count_of_counts(df: DataFrame, key: str, member: str) -> DataFrame:
    """How many keys have each number of distinct members."""
    per = df.groupBy(key).agg(F.count_distinct(member).alias("members"))
    return per.groupBy("members").agg(F.count("*").alias("n_keys"))


def mean_or_zero(x: str | Column, digits: int) -> Column:
    return F.coalesce(half_even(F.avg(x), digits), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole != 0, half_even(part / whole * 100, digits))


def top_tags_by_phase(tags: DataFrame, phase: str, tag: str, ordinal: str, k: int, keys: list[str]) -> DataFrame:
    """The ``k`` most frequent tags of each phase as an array, ties by first appearance."""
    counts = tags.groupBy(*keys, phase, tag).agg(F.count("*").alias("n"), F.min(ordinal).alias("o"))
    w = W.partitionBy(*keys, phase).orderBy(F.desc("n"), "o")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy(*keys, phase).agg(F.collect_set(tag).alias("tags"))


def coverage(test: Column, *known: Column) -> Column:
    """Share of the test tags that are known; null without test tags."""
    empty = F.array().cast("array<string>")
    test = F.coalesce(test, empty)
    base = empty
    for k in known:
        base = F.array_union(base, F.coalesce(k, empty))
    return F.when(F.size(test) > 0, half_even(F.size(F.array_intersect(test, base)) / F.size(test), 3))


def tag_frequency(df: DataFrame, tags: str, keys: list[str] | None = None) -> DataFrame:
    """Rows that carry each tag of an array column."""
    return df.select(*(keys or []), F.explode(tags).alias("tag")).groupBy(*(keys or []), "tag").agg(F.count("*").alias("n"))


def sum_by_dynamic_key(df: DataFrame, usage: str) -> DataFrame:
    """Sums of the numeric values of a MAP<STRING, STRING> column by key."""
    each = df.select(F.explode(usage).alias("key", "value")).withColumn("value", F.expr("try_cast(value as double)"))
    return each.where("value is not null").groupBy("key").agg(F.sum("value").alias("total"))
