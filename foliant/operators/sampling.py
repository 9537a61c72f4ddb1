"""Largest-remainder quotas, quantile sampling and temporal splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quotas(counts: DataFrame, target: int | Column, ties: list[Column]) -> DataFrame:
    """``counts`` (a row for each stratum, with ``n``) with ``quota``.

    floor(target * n / total) each; what is left goes to the largest fractions,
    ties in the order of ``ties``.  Strata are few: one task orders them.
    """
    target = F.lit(target) if isinstance(target, int) else target
    total = W.partitionBy(F.lit(0))
    df = counts.withColumn("_exact", target * F.col("n") / F.sum("n").over(total)).withColumn("_floor", F.floor("_exact"))
    df = df.withColumn("_left", target - F.sum("_floor").over(total))
    df = df.withColumn("_rank", F.row_number().over(total.orderBy((F.col("_exact") - F.col("_floor")).desc(), *ties)))
    return df.withColumn("quota", (F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_exact", "_floor", "_left", "_rank")


def take_quota(rows: DataFrame, strata: DataFrame, key: str, order: list) -> DataFrame:
    """The first ``quota`` rows of each stratum."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.join(F.broadcast(strata.select(key, "quota")), key).where("_rank <= quota").drop("_rank", "quota")


def quantile_sample(rows: DataFrame, key: str, size: str, ident: str, seed: str) -> DataFrame:
    """One row for each of ``quota`` equal slices of a stratum's rows sorted by ``size``.

    The pick within a slice is the least seeded hash.  ``rows`` carry ``quota``;
    a stratum with no more rows than its quota is kept whole.
    """
    w = W.partitionBy(key).orderBy(size, ident)
    df = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy(key))})
    # Slice s holds the indexes from floor(s n / q) on: the last s whose start is not above i.
    df = df.withColumn("slice", F.when(F.col("quota") >= F.col("_n"), F.col("_i")).otherwise(F.expr("((_i + 1) * quota - 1) div _n"))).where("quota > 0")
    pick = W.partitionBy(key, "slice").orderBy(F.sha2(F.concat(F.lit(seed), F.col(ident).cast("string")), 256), ident)
    return df.withColumn("_p", F.row_number().over(pick)).where("_p = 1").drop("_i", "_n", "_p")


def phase(year: str, training: int = 2024, calibration: int = 2025, test: int = 2026) -> Column:
    y = F.col(year)
    return F.when(y == training, "training").when(y == calibration, "calibration").when(y == test, "heldout_test")


def daily_targets(total: int, rate: float, runs: DataFrame, run: str = "run") -> DataFrame:
    """Papers that run k adds: round(total * rate * (k + 1)) - round(total * rate * k), half-even, 1 at least."""
    at = lambda k: F.bround(F.lit(float(total)) * F.lit(rate) * k, 0).cast("long")
    return runs.withColumn("papers", F.greatest(F.lit(1), at(F.col(run) + 1) - at(F.col(run))))
