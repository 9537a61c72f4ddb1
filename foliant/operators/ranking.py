"""Deduplication, upsert, top-k and ordering with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, key: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; ``rank`` keeps their place."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_most_complete(items: DataFrame, key: str, lists: list[str], ordinal: str) -> DataFrame:
    """One row for each key: most filled lists, then longest JSON, then earliest.

    Rows come with ``first_seen``, the key's first ordinal, which orders them.
    """
    filled = sum((F.coalesce(F.size(c) > 0, F.lit(False)).cast("int") for c in lists), F.lit(0))
    size = F.length(F.to_json(F.struct(*sorted(c for c in items.columns if c != ordinal)), {"ignoreNullFields": "false"}))
    df = items.withColumn("first_seen", F.min(ordinal).over(W.partitionBy(key)))
    return best_per_key(df, [key], [filled.desc(), size.desc(), F.col(ordinal).asc()])


def upsert_latest(df: DataFrame, key: list[str], when: list) -> DataFrame:
    """The last written row of each key."""
    return best_per_key(df, key, [F.desc(c) for c in when])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, which fails at run time on a null, empty or repeated key."""
    counted = df.withColumn("_n", F.count("*").over(W.partitionBy(key)))
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "") | (F.col("_n") > 1)
    said = F.concat(F.lit(f"missing or duplicate {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return counted.where(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def most_common(df: DataFrame, value: str | Column, ordinal: str, k: int) -> DataFrame:
    """(value, n, first_seen) of the ``k`` most frequent values; ties by first appearance."""
    value = F.col(value) if isinstance(value, str) else value
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def hash_order(year: str, key: str) -> list[Column]:
    """A reproducible pseudo-random order within years."""
    return [F.col(year).asc(), F.sha2(F.col(key).cast("string"), 256).asc()]


def places(df: DataFrame, coarse: dict[str, Column], order: list, place: str = "place") -> DataFrame:
    """Every row's place in the whole order, from 1, without one task for all rows.

    ``coarse`` names leading parts of the order, ascending, nulls first, as columns
    of few values: they are counted and summed up, and rows are numbered by
    ``order`` among those that agree in them.
    """
    names = list(coarse)
    rows = df.withColumns(coarse)
    counts = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    before = W.orderBy(*[F.col(c).asc_nulls_first() for c in names]).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").withColumnsRenamed({c: f"{c}_" for c in names})
    numbered = rows.withColumn(place, F.row_number().over(W.partitionBy(*names).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names]
    return numbered.join(counts, same).withColumn(place, F.col(place) + F.col("_before")).drop("_before", *names, *[f"{c}_" for c in names])


def newest_first(date: str, key: str) -> list[Column]:
    """The latest date first, then the greatest id."""
    return [F.desc(date), F.desc(key)]


def preview(both: DataFrame, one: DataFrame, two: DataFrame, order: list, n: int = 30) -> DataFrame:
    """All of the intersection, then the first ``n`` of either list."""
    return both.unionByName(one.orderBy(*order).limit(n)).unionByName(two.orderBy(*order).limit(n))


def first_batches(batches: DataFrame, name: str, n: int) -> DataFrame:
    """The first ``n`` batches by file name."""
    return batches.orderBy(name).limit(n)


def tier_rank(tier: str) -> Column:
    t = F.col(tier)
    return F.when(t == "core", 0).when(t == "adjacent", 1).when(t.isNull(), 2).when(t == "generic", 3)


def topic_order() -> list[Column]:
    """Both topics first, then the tiers, the newest year, the title and the id."""
    both = F.col("agent_tier").isNotNull() & F.col("education_tier").isNotNull()
    return [F.when(both, 0).otherwise(1), tier_rank("agent_tier"), tier_rank("education_tier"), F.desc("year"), F.lower("title"), F.asc("openreview_id")]


def truncated(column: str, most: int) -> Column:
    """The first ``most`` elements; null counts as empty."""
    return F.coalesce(F.slice(column, 1, most), F.expr(f"filter(`{column}`, x -> false)"))


def too_long(column: str, most: int) -> Column:
    return F.coalesce(F.size(column) > most, F.lit(False))
