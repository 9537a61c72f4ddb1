"""A training-corpus pipeline: each stage calls one operator of ``foliant.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of their ``docs``, whatever their names and however many.

A null text counts as empty: it fails the base test of the first stage, is no copy
of anything, covers nothing and has no tokens.  Null and repeated doc_ids are rows
like others: of rows that are equal in doc_id and text one is left by the join of
near copies, rows that differ in either are judged on their own.  An empty table
gives an empty one; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe_tree, common, jaccard, quality, tiling, toxicity

#: Near copies: word shingles and similarity in per cent.
WORDS, PER_CENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every learned rule."""
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.non_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; see ``jaccard.one_of_each``."""
    return jaccard.one_of_each(docs, WORDS, PER_CENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no benchmark item is covered."""
    return tiling.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining documents."""
    import public_tokenizers

    return bpe_tree.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", non_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", encoded),
]

#: Learned rules and classifiers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}")
            common.tidy(spark)
    return docs
