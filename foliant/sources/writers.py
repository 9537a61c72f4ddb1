"""Sinks: JSONL, CSV, routed and batched files, deterministic gzip, Markdown, ledgers."""

from __future__ import annotations

import gzip
import hashlib
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escape, markdown_cell


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_ready(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays joined by ``;``, booleans as True or False, nulls empty."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.coalesce(F.concat_ws(";", c), F.lit("")).alias(c)
        if kinds[c] == "boolean":
            return F.coalesce(F.initcap(F.col(c).cast("string")), F.lit("")).alias(c)
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    return df.select(*[cell(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    csv_ready(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_routed(df: DataFrame, path: str, routes: dict[str, Column]) -> None:
    """Each row goes to every route whose test it passes, in one pass over ``df``."""
    hits = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in routes.items()]), lambda x: x.isNotNull())
    df.withColumn("route", F.explode(hits)).write.mode("overwrite").partitionBy("route").option("ignoreNullFields", False).json(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """Numbered batches; those of an earlier write go first."""
    df.repartition(batch).write.mode("overwrite").partitionBy(batch).json(path)


def prompts(df: DataFrame, batch: str, ordinal: str, item: Column, instructions: str) -> DataFrame:
    """(batch, prompt): instructions and the batch's items, in order, as one JSON object."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(ordinal), item.alias("item")))), lambda x: x["item"])
    rows = df.groupBy(batch).agg(items.alias("papers"))
    return rows.select(batch, F.to_json(F.struct(F.lit(instructions).alias("instructions"), "papers"), {"ignoreNullFields": "false"}).alias("prompt"))


def deterministic_gzip(df: DataFrame, order: list) -> tuple[bytes, str, int]:
    """Gzip bytes without a time stamp, their SHA-256, and the row count.

    For published indexes of bounded size: rows are streamed through the driver.
    """
    out, n = io.BytesIO(), 0
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0) as packed:
        for row in df.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator():
            packed.write((row["line"] + "\n").encode("utf-8"))
            n += 1
    return out.getvalue(), hashlib.sha256(out.getvalue()).hexdigest(), n


def topic_pages(papers: DataFrame) -> DataFrame:
    """(topic_slug, page, papers): Markdown of each topic, titles in case-folded order."""
    entry = F.concat(F.lit("## "), html_escape("title"), F.lit("\n\n"), F.lit("Link: "), F.col("openreview_url"), F.lit("\n\n"), html_escape("abstract"), F.lit("\n"))
    sort = F.struct(F.lower("title").alias("k"), F.col("openreview_id").alias("i"), entry.alias("entry"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(sort)), lambda x: x["entry"]), "\n")
    rows = papers.groupBy("topic_slug").agg(F.min_by("topic", F.struct(F.lower("title"), "openreview_id")).alias("topic"), F.count("*").alias("papers"), body.alias("body"))
    return rows.select("topic_slug", "topic", "papers", F.concat(F.lit("# "), html_escape("topic"), F.lit("\n\n"), F.col("body")).alias("page"))


def markdown_table(df: DataFrame, columns: list[str], order: list, most: int = 100) -> str:
    """A report table of at most ``most`` rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(markdown_cell(F.col(c).cast("string")), F.lit("-")) for c in columns]), F.lit(" |"))
    rows = [r["line"] for r in df.orderBy(*order).limit(most).select(line.alias("line")).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *rows])


def pretty_report(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def commit_run(spark: SparkSession, outputs: dict[str, DataFrame], root: str, run: str, ids: DataFrame) -> bool:
    """Write a run's outputs, then its success marker, then the ledger; once for each run.

    Each write ends with Spark's own commit, so a run that failed half-way has no
    marker and is written anew.
    """
    marker = f"{root}/runs/run={run}"
    if done(spark, root, run):
        return False
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{root}/outputs/{name}/run={run}")
    spark.createDataFrame([("success",)], "status string").coalesce(1).write.mode("overwrite").json(marker)
    ids.write.mode("overwrite").parquet(f"{root}/ledger/run={run}")
    return True


def done(spark: SparkSession, root: str, run: str) -> bool:
    """Whether the run has its success marker."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/runs/run={run}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
