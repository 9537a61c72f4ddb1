"""Typed readers: nested JSON documents, JSONL, batch results, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, B = T.StringType(), T.LongType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


def strings(names: str) -> dict:
    return dict.fromkeys(names.split(), S)


# The fields of papers, reviews and messages, in their order.
PAPER = "openreview_id forum year track title abstract tldr keywords primary_area decision accepted_any accepted_main".split()
REVIEW = "reviewer_id rating confidence soundness contribution presentation summary_text strengths_text weaknesses_text questions_text summary strengths weaknesses questions".split()
MESSAGE = "id role signature comment replyto tcdate tmdate".split()

MESSAGE_TYPE = struct(**strings("id role signature comment replyto"), tcdate=L, tmdate=L)
REVIEW_TYPE = struct(**strings(" ".join(REVIEW) + " soundness_text presentation_text contribution_text"))
AUTHOR_TYPE = struct(name=S, affiliations=T.ArrayType(S))
PAPER_TYPE = struct(
    openreview_id=S, forum=S, year=L, track=S, title=S, abstract=S, tldr=S, keywords=S, primary_area=S, area_dir=S, decision=S,
    accepted_any=B, accepted_main=B, openreview_url=S, pdf_url=S, authors=T.ArrayType(AUTHOR_TYPE), review_statistics=S,
    reviews=T.ArrayType(REVIEW_TYPE), rebuttals=T.ArrayType(MESSAGE_TYPE), reviewer_comments=T.ArrayType(MESSAGE_TYPE), _corrupt_record=S,
)
OUTCOME_TYPE = struct(**strings("reviewer_id effectiveness score_action"), confidence=T.DoubleType())
COUNTERFACTUAL_TYPE = struct(**strings("treatment outcome assumptions evidence_grade"), confidence=T.DoubleType())
RESULT_TYPE = struct(
    openreview_id=S, research_tags=T.ArrayType(S), positive_factors=T.ArrayType(S), negative_factors=T.ArrayType(S),
    response_outcomes=T.ArrayType(OUTCOME_TYPE), counterfactuals=T.ArrayType(COUNTERFACTUAL_TYPE),
)


def papers(spark: SparkSession, root: str, skip_index: bool = True) -> DataFrame:
    """One row for each JSON document below ``root``; keywords are an array whether
    the document has a list or one string; ``path`` is where it was read."""
    df = spark.read.schema(PAPER_TYPE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(root)
    df = df.withColumn("path", F.col("_metadata.file_path"))
    if skip_index:
        df = df.where(~F.col("path").endswith("/index.json"))
    listed = F.from_json("keywords", T.ArrayType(S))
    single = F.when(F.coalesce("keywords", F.lit("")) != "", F.array("keywords")).otherwise(F.array().cast("array<string>"))
    return df.withColumn("keywords", F.when(F.ltrim("keywords").startswith("["), listed).otherwise(single))


def main_track(df: DataFrame) -> DataFrame:
    return df.where(F.col("track") == "main")


def paper_id(ident: str = "openreview_id", forum: str = "forum"):
    """The id, or the forum where it is null or empty."""
    return F.coalesce(F.nullif(F.col(ident), F.lit("")), F.col(forum))


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def batch_results(spark: SparkSession, root: str, item: T.StructType = RESULT_TYPE) -> DataFrame:
    """Elements of ``papers`` of every batch file, ``ordinal`` = (file name, place)."""
    df = spark.read.schema(struct(papers=T.ArrayType(item))).option("multiLine", True).option("pathGlobFilter", "batch_*_result.json").json(root)
    df = df.select(F.col("_metadata.file_name").alias("file"), F.posexplode("papers").alias("pos", "item"))
    return df.select("item.*", F.struct("file", "pos").alias("ordinal"))


def ledger(spark: SparkSession, path: str, key: str = "openreview_id") -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias(key)).distinct()


def last_messages(lines: DataFrame, text: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """Text of the last well-formed agent message of an event stream, malformed lines ignored."""
    event = F.from_json(text, "type string, item struct<type: string, text: string>")
    said = lines.where(F.try_parse_json(text).isNotNull()).withColumn("e", event).where("e.type = 'item.completed' and e.item.type = 'agent_message'")
    return said.agg(F.max_by("e.item.text", ordinal).alias("text"))


def inventory(papers_df: DataFrame) -> DataFrame:
    """(openreview_id, year, path) of main-track papers, which must have unique ids."""
    from ..operators.ranking import assert_unique

    ids = main_track(papers_df).select(paper_id().alias("openreview_id"), "year", "path")
    return assert_unique(ids, "openreview_id").orderBy("year", F.sha2("openreview_id", 256))


def discussion(papers_df: DataFrame) -> DataFrame:
    """Rebuttals, then comments, of each paper: (paper, msg, kind, message fields)."""
    empty = F.array().cast(T.ArrayType(MESSAGE_TYPE))

    def tagged(kind: str):
        return F.transform(F.coalesce(F.col(kind), empty), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m")))

    both = [tagged(k) for k in ("rebuttals", "reviewer_comments")]
    rows = papers_df.select(paper_id().alias("paper"), F.posexplode(F.concat(*both)).alias("msg", "x"))
    return rows.select("paper", "msg", "x.kind", "x.m.*").withColumnRenamed("comment", "text")


def compact(names: list[str], source):
    """A struct's fields as JSON-ready values: empty strings are null and so left out."""
    return F.struct(*[F.nullif(source[n].cast("string"), F.lit("")).alias(n) for n in names])


def payload(papers_df: DataFrame) -> DataFrame:
    """(openreview_id, paper, reviews, discussion) as compact JSON, whitelisted fields only."""
    paper = F.to_json(F.struct(*PAPER), {"ignoreNullFields": "false"})
    reviews = F.to_json(F.transform(F.coalesce("reviews", F.array().cast(T.ArrayType(REVIEW_TYPE))), lambda r: compact(REVIEW, r)))
    return papers_df.select(paper_id().alias("openreview_id"), paper.alias("paper"), reviews.alias("reviews"))
