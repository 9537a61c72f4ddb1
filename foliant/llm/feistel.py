"""Op 3: a reproducible shuffle into shards by a Feistel permutation.

Rows get global row numbers in the order of a 64-bit hash of their content; a
Feistel network over a x b cells (a * b just above the row count n) permutes
them, walking the cycle from the few cells at or above n until it comes below.
Number p then lies in shard p mod k at slot p div k, so shards' row counts are
at most one apart (law ``rows``), and shard and slot follow from the row number.

Row numbers need no single sorted task: the hash's top bits choose one of 4,096
buckets, rows are numbered within their bucket, and a bucket starts where the
counts of those before it end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKET_BITS, ROUNDS, BLOCK = 12, 8, 4096


class Feistel:
    """A permutation of 0 .. n-1 fixed by ``seed``; ``of`` for numbers, ``columns`` for Spark."""

    def __init__(self, n: int, seed: str = "shuffle"):
        self.n = n
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        words = [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "big") for k in range(ROUNDS)]
        self.keys = [((w >> 33) | 1, w & 0x7FFFFFFF) for w in words]  # factor and addend below 2**31
        self.steps = self._longest_walk()

    def once(self, x: int) -> int:
        left, right = x % self.a, x // self.a
        for k, (m, c) in enumerate(self.keys):
            if k % 2:
                right = (right + self._mix(left, m, c)) % self.b
            else:
                left = (left + self._mix(right, m, c)) % self.a
        return right * self.a + left

    @staticmethod
    def _mix(v: int, m: int, c: int) -> int:
        y = v * m + c
        return y ^ (y >> 15)

    def of(self, x: int) -> int:
        x = self.once(x)
        while x >= self.n:
            x = self.once(x)
        return x

    def _longest_walk(self) -> int:
        """Applications that suffice for every row: one, and one for each cell at or
        above n that some walk passes.  There are fewer than sqrt(n) + 1 such cells."""
        beyond = range(self.n, self.a * self.b)
        after = {x: self.once(x) for x in beyond}
        entered, steps = set(beyond) - set(after.values()), 1
        while entered:
            steps += 1
            entered = {after[x] for x in entered if after[x] >= self.n}
        return steps

    def columns(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """``df`` with the permuted ``x`` (0 <= x < n) as ``out``."""
        if not self.n:
            return df.withColumn(out, F.col(x))
        df = df.withColumn(out, F.lit(self.n))
        for step in range(self.steps):
            start = F.col(x) if not step else F.col(out)
            df = df.withColumns({"_l": start % self.a, "_r": F.expr(f"`{x if not step else out}` div {self.a}")})
            for k, (m, c) in enumerate(self.keys):
                one, other, size = ("_r", "_l", self.b) if k % 2 else ("_l", "_r", self.a)
                y = F.col(other) * m + c
                df = df.withColumn(one, (F.col(one) + y.bitwiseXOR(F.shiftright(y, 15))) % size)
            df = df.withColumn(out, F.when(F.col(out) < self.n, F.col(out)).otherwise(F.col("_r") * self.a + F.col("_l")))
        return df.drop("_l", "_r")


def row_numbers(rows: DataFrame, by: list[str], out: str) -> tuple[DataFrame, int]:
    """``rows`` with a number from 0 for each, in the order of a hash of ``by``, and their count.

    Equal rows are counted before they are dealt and copied afterwards, so a row
    that repeats millions of times is one row of its bucket.
    """
    spark = rows.sparkSession
    hashed = rows.groupBy(*by).agg(F.count("*").alias("_copies"))
    hashed = common.cut(hashed.withColumn("_hash", F.xxhash64(*by)))
    bucket: Column = F.shiftrightunsigned("_hash", 64 - BUCKET_BITS).cast("int")
    # At most 4,096 rows, whatever the input.
    sizes = [(r[0], r[1]) for r in hashed.groupBy(bucket.alias("b")).agg(F.sum("_copies").alias("n")).sort("b").collect()]
    starts, n = [], 0
    for b, count in sizes:
        starts.append((b, n))
        n += count
    starts_df = spark.createDataFrame(starts, "_bucket int, _start long")
    order = W.partitionBy("_bucket").orderBy("_hash", *[F.col(c).asc_nulls_first() for c in by])
    placed = hashed.withColumn("_bucket", bucket).withColumn("_upto", F.sum("_copies").over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(F.broadcast(starts_df), "_bucket").withColumn("_first", F.expr("_start + _upto - _copies"))
    blocks = placed.withColumn("_k", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {BLOCK})")))
    inner = F.expr(f"sequence(_k * {BLOCK}, least(_copies, (_k + 1) * {BLOCK}) - 1)")
    return blocks.withColumn("_i", F.explode(inner)).select(*by, (F.col("_first") + F.col("_i")).alias(out)), n


def shard(docs: DataFrame, shards: int = 8, seed: str = "shuffle") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, place of every row.

    A null text has size 1 and the checksum of the empty text; rows that repeat
    each have their place; null doc_ids are ordinary keys.  An empty table gives
    no rows, other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.utf8_bytes("text") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = row_numbers(base, ["doc_id", "size", "text_crc32"], "row_number")
    placed = Feistel(n, seed).columns(numbered, "row_number", "place")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_feistel_shards": op3_feistel_shards}
