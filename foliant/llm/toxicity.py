"""Op 2: a toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words, fitted in numpy on a bounded sample
of labelled rows.  For each sampled sentence that names an identity, a twin with
the names swapped is made; the loss adds ``fairness`` times the mean squared
difference of the two sentences' logits, so that what a neutral mention of a
group adds to a score is driven towards what any other group's adds.

Labels come only from the training folds; a score uses the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are fitted, of each label: those with the smallest hashes.
SAMPLE = 8_000
#: Distinct sentence pairs that are fitted, those with the smallest hashes, and words
#: that may carry a weight.
PAIRS, WORDS = 20_000, 2_048
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7

#: Identity terms by kind; a swap replaces each by the next of its kind.
IDENTITIES = {
    "faith": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "faiths": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    "gender": ["man", "woman"],
    "genders": ["men", "women"],
    "orientation": ["straight", "gay", "lesbian", "bisexual"],
    "colour": ["white", "black", "asian", "latino"],
    "origin": ["american", "african", "mexican", "chinese", "arab", "european"],
    "age": ["young", "old"],
    "ability": ["disabled", "deaf", "blind"],
}
SWAP = {w: group[(k + 1) % len(group)] for group in IDENTITIES.values() for k, w in enumerate(group)}

#: Everything of ASCII that is neither letter, digit nor white space separates words.
GAPS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
SENTENCE = re.compile(r"[.!?\n]+")


#: Letters of a word's stem; stems are features beside whole words.
STEM = 4


def words_of(text: str) -> set[str]:
    """Distinct lower-case words, and stems of the longer ones, marked by a star."""
    words = set(text.lower().translate(GAPS).split())
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Model:
    """Weights of words and stems; a score adds those that a text has."""

    weights: dict[str, float]
    bias: float

    def scores(self, texts: Iterable[str]) -> list[float]:
        known, get = self.weights.keys(), self.weights.__getitem__
        z = np.array([self.bias + sum(map(get, sorted(known & words_of(t)))) for t in texts])
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def slopes(w: np.ndarray, b: float, data: tuple, fairness: float, ridge: float) -> tuple[np.ndarray, float]:
    """Gradient of the loss that ``fit`` names; ``data`` as ``laid_out`` gives it."""
    row, col, y, share, pair, pair_col, sign, weight = data
    z = np.bincount(row, w[col], len(y)) + b
    g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    gw, gb = np.bincount(col, g[row], len(w)) + ridge * w, float(g.sum())
    if len(weight):
        change = weight * np.bincount(pair, sign * w[pair_col], len(weight))
        gw = gw + 2 * fairness / weight.sum() * np.bincount(pair_col, sign * change[pair], len(w))
    return gw, gb


def laid_out(rows: list[list[int]], labels: list[int], pairs: list[tuple[list[int], list[int]]], weights: list[float] | None) -> tuple:
    """Rows and pairs as lists of places, so memory follows the words that occur."""
    flat = lambda lists: (np.repeat(np.arange(len(lists)), [len(r) for r in lists]), np.array([c for r in lists for c in r], np.int64))
    row, col = flat(rows)
    one, one_col = flat([a for a, _ in pairs])
    two, two_col = flat([b for _, b in pairs])
    y = np.array(labels, np.float64)
    n1 = max(1.0, float(y.sum()))
    share = np.where(y > 0, 0.5 / n1, 0.5 / max(1.0, len(y) - n1))
    weight = np.ones(len(pairs)) if weights is None else np.array(weights, np.float64)
    return row, col, y, share, np.concatenate([one, two]), np.concatenate([one_col, two_col]), np.repeat([1.0, -1.0], [len(one), len(two)]), weight


def fit(
    rows: list[list[int]], labels: list[int], pairs: list[tuple[list[int], list[int]]], size: int, fairness: float = 1.0, ridge: float = 2e-4, steps: int = 400, weights: list[float] | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias: balanced logistic loss + ridge / 2 * squares + fairness * weighted mean squared logit change."""
    data = laid_out(rows, labels, pairs, weights)
    w, b = np.zeros(size), 0.0
    # Adam on the whole sample; the loss is convex.
    m, v, mb, vb, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.1
    for step in range(1, steps + 1):
        gw, gb = slopes(w, b, data, fairness, ridge)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b = b - rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, float(b)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold whose labels are never learned (null doc_ids too)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = 1.0) -> Model:
    """Fit on at most ``sample`` rows of each label (0 and 1) outside the held-out fold.

    A doc_id labelled more than once counts as toxic if any label is 1; of documents
    that repeat a doc_id the one with the greatest text hash is fitted.  Null labels
    and null doc_ids are left out.  All sentences of the sampled rows that name an
    identity give pairs; equal pairs are one with a weight, and of more than ``PAIRS``
    distinct ones those with the smallest hashes count.  Without rows of both labels
    the model scores every text alike, below the threshold.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (0, 1):  # a bounded number of ids, never texts, by hash order
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = common.cut(chosen)
    if ids.groupBy("toxic").count().count() < 2:
        return Model({}, -2.0)
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = F.max(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    texts = texts.groupBy("doc_id", "toxic").agg(one).select("doc_id", "one.text", "toxic")  # at most 2 * sample rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.string())), ("pairs", pa.list_(pa.list_(pa.list_(pa.string()))))])
        for b in batches:
            for doc, text, toxic in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                pairs = []
                for s in SENTENCE.split(text):
                    own = words_of(s)
                    if not SWAP.keys().isdisjoint(own):
                        twin = " ".join(SWAP.get(w, w) for w in s.lower().translate(GAPS).split())
                        pairs.append([sorted(own), sorted(words_of(twin))])
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "toxic": toxic, "words": sorted(words_of(text)), "pairs": pairs}], kinds)

    rows = common.cut(texts.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int")).mapInArrow(bags, "doc_id long, toxic int, words array<string>, pairs array<array<array<string>>>"))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model({}, -2.0)
    # Words by the likelihood ratio of their presence in either label's rows.
    n1, n0 = totals[1], totals[0]
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("p"), F.count("*").cast("double").alias("n")).where("n >= 3")
    counts = counts.withColumns({"q": F.expr("n - p"), "e1": F.expr(f"n * {n1} / {n1 + n0}"), "e0": F.expr(f"n * {n0} / {n1 + n0}")})
    part = lambda a, b: f"if({a} > 0, {a} * ln({a} / {b}), 0)"
    gain = F.expr(f"2 * ({part('p', 'e1')} + {part('q', 'e0')} + {part(f'({n1} - p)', f'({n1} - e1)')} + {part(f'({n0} - q)', f'({n0} - e0)')})")
    picked = counts.withColumn("gain", gain).where("gain > 12").orderBy(F.desc("gain"), "word").limit(WORDS).select("word").collect()
    names = sorted({r["word"] for r in picked} | set(SWAP))
    place = {w: k for k, w in enumerate(names)}
    wanted = F.array(*map(F.lit, names))
    data = rows.select("doc_id", "toxic", F.array_intersect("words", wanted).alias("words")).orderBy("doc_id").collect()
    short = rows.select(F.explode("pairs").alias("pair")).select(F.transform("pair", lambda x: F.array_intersect(x, wanted)).alias("pair"))
    alike = short.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.xxhash64("pair"), "pair").limit(PAIRS).collect()
    numbers = lambda found: [place[w] for w in found]
    pairs = [(numbers(r["pair"][0]), numbers(r["pair"][1])) for r in alike]
    w, bias = fit([numbers(r["words"]) for r in data], [r["toxic"] for r in data], pairs, len(names), fairness, weights=[r["n"] for r in alike])
    return Model({n: float(w[k]) for n, k in place.items() if abs(w[k]) > 1e-4}, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; null texts are scored as empty ones.

    Repeated rows score alike and a text is taken whole, however long.  Columns of
    ``docs`` stay, but those named as the new ones are replaced; ``non_toxic`` filters
    and leaves every column as it is.  An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(t or "" for (t,) in common.rows(b, names.index("text")))
            found = pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*names, "score", "predicted"])

    base = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return base.mapInArrow(run, schema)


def non_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(t or "" for (t,) in common.rows(b, at))
            yield b.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_toxicity": op2_toxicity}
