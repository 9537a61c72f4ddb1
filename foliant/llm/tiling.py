"""Op 7: benchmark decontamination by greedy string tiling.

Documents and test items become words.  Seeds, hashes of ``SEED`` neighbouring
words, are joined: a document meets an item when they share one.  Of such a pair
only the document's stretches of shared seeds are compared with the item: the
longest matches of unmarked words are found by running Karp-Rabin hashing and
marked, longest first, until no match of ``SEED`` words is left.  The share of
the item's words that is marked is its coverage, which does not depend on the
order in which the passages of an item stand in the document.

Items are sent to every task while their texts have at most ``SENT`` bytes; beyond
that seeds of both sides are joined by a shuffle: of each item as many of its
rarest seeds as leave out fewer than a document must share to cover it, so phrases
that many documents have join nothing.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .shingles import mixed, windows, word_hashes

SEED, COVERAGE, SENT = 5, 0.6, 4_000_000
#: ASCII bytes that are neither letters nor digits part words.
TABLE = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").translate(TABLE).split()


def running_hashes(words: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each window of ``size`` words."""
    if len(words) < size:
        return
    lead, value = pow(BASE, size - 1, MODULUS), 0
    for w in words[:size]:
        value = (value * BASE + w) % MODULUS
    yield 0, value
    for k in range(size, len(words)):
        value = ((value - words[k - size] * lead) * BASE + words[k]) % MODULUS
        yield k - size + 1, value


def free_runs(words: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of the windows of ``size`` words of which none is marked."""
    at = 0
    while at < len(words):
        if marked[at]:
            at += 1
            continue
        end = at
        while end < len(words) and not marked[end]:
            end += 1
        for k, value in running_hashes(words[at:end], size):
            yield at + k, value
        at = end


def tiles(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in item, start in doc, length), non-overlapping on both sides."""
    item_marked, doc_marked, out = [False] * len(item), [False] * len(doc), []
    size = max(least, len(item))
    while True:
        places = defaultdict(list)
        for k, value in free_runs(item, item_marked, size):
            places[value].append(k)
        found, longest = [], 0
        for d, value in free_runs(doc, doc_marked, size) if places else ():
            for k in places.get(value, ()):
                n = 0  # a hash is only a hint: compare, and go on past the window
                while k + n < len(item) and d + n < len(doc) and item[k + n] == doc[d + n] and not item_marked[k + n] and not doc_marked[d + n]:
                    n += 1
                if n >= size:
                    found.append((-n, k, d))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(found)
        while found:  # longest first, then first in the item, then first in the document
            n, k, d = heapq.heappop(found)
            free = [not (item_marked[k + j] or doc_marked[d + j]) for j in range(-n)]
            if all(free):
                item_marked[k : k - n] = doc_marked[d : d - n] = [True] * -n
                out.append((k, d, -n))
                continue
            start = None  # what other tiles leave of this match waits for its turn
            for j, is_free in enumerate([*free, False]):
                if is_free and start is None:
                    start = j
                elif not is_free and start is not None:
                    if j - start >= size:
                        heapq.heappush(found, (start - j, k + start, d + start))
                    start = None
        if size == least or all(item_marked):
            return out
        size = max(least, size // 2)


class Items:
    """Benchmark items with an index of their seeds (items shorter than a seed are one)."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = SEED):
        self.seed, self.words, self.of = seed, {}, defaultdict(set)
        for item, text in rows:
            h = word_hashes(words_of(text or ""))
            if len(h):
                self.words[item] = h
        sizes = {min(seed, len(h)) for h in self.words.values()}
        self.sizes = sorted(sizes)
        for item, h in self.words.items():
            k = min(seed, len(h))
            for s in seeds(h, k).tolist():
                self.of[s].add(item)
        known = np.fromiter(self.of, np.uint64, len(self.of))
        self.mask = np.uint64((1 << (16 * len(known)).bit_length()) - 1)
        self.filter = np.zeros(int(self.mask) + 1, bool)
        self.filter[(known & self.mask).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item -> [(start, length) of the document's stretches of its seeds]."""
        spots: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k in self.sizes:
            if len(h) < k:
                continue
            s = seeds(h, k)
            for at in np.flatnonzero(self.filter[(s & self.mask).astype(np.int64)]).tolist():
                for item in self.of.get(int(s[at]), ()):
                    if min(self.seed, len(self.words[item])) == k:
                        runs = spots[item]
                        if runs and at <= sum(runs[-1]):
                            runs[-1] = (runs[-1][0], at + k - runs[-1][0])
                        else:
                            runs.append((at, k))
        return spots

    def coverage(self, item: int, h: np.ndarray, runs: list[tuple[int, int]]) -> tuple[float, int, int]:
        """Share of the item's words in tiles, number of tiles, longest tile."""
        words, doc = self.words[item].tolist(), []
        for k, (at, n) in enumerate(runs):  # a negative number ends each stretch
            doc += [*h[at : at + n].tolist(), -1 - k]
        found = tiles(words, doc, min(self.seed, len(words)))
        return sum(n for _, _, n in found) / len(words), len(found), max((n for _, _, n in found), default=0)


def seeds(h: np.ndarray, k: int) -> np.ndarray:
    return mixed(windows(h, k), 17)


OUT = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max("text").alias("text"))


def _given(items: DataFrame, sent: int) -> list[tuple[int, str]] | None:
    """The items, if their texts have ``sent`` bytes at most."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return [(r["item_id"], r["text"]) for r in items.sort("item_id").collect()] if size <= sent else None


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, seed: int = SEED, sent: int = SENT) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of the pairs with coverage >= ``least``.

    Case and ASCII punctuation do not count.  Null and wordless texts, items
    included, match nothing; items of fewer than ``seed`` words must occur whole.
    Rows that repeat a doc_id give an item once, with the greatest coverage; a null
    doc_id is a doc_id.  Equal item_ids: the row with the greatest text counts.
    Texts are taken whole, however long; of tiles of equal length the first in the
    item, then in the document, is marked first.  Other columns are ignored.
    """
    items = _items(benchmark)
    given = _given(items, sent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = _by_seeds(rows, items, least, seed) if given is None else _by_items(rows, given, least, seed)
    best = F.max(F.struct("coverage", F.col("n_tiles").alias("tiles"), "longest")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.coverage", F.col("best.tiles").alias("n_tiles"), "best.longest")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, seed: int = SEED, sent: int = SENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any columns) that cover no item, as they are.

    Nulls, repeats and ties as in ``contaminated``, but each row is judged by its
    own text alone.
    """
    items = _items(benchmark)
    given = _given(items, sent)
    if given is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        found = _by_seeds(rows, items, least, seed).select(F.col("doc_id").alias("own_id"), F.col("body").alias("own_body")).distinct()
        return common.among(docs, common.stored(found, "contaminated"), "left_anti")
    shared, at = docs.sparkSession.sparkContext.broadcast(given), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value, seed)
        for b in batches:
            yield b.filter(pa.array([not any(_covered(index, t or "", least)) for (t,) in common.rows(b, at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _by_items(docs: DataFrame, given: list[tuple[int, str]], least: float, seed: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(given)  # at most ``sent`` bytes of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value, seed)
        for b in batches:
            yield _batch(OUT, [(d, *x) for d, t in common.rows(b) for x in _covered(index, t, least)])

    return docs.mapInArrow(run, OUT)


def _by_seeds(docs: DataFrame, items: DataFrame, least: float, seed: int) -> DataFrame:
    """``OUT`` and ``body`` by a shuffle of seeds.

    Tiles that cover an item hold at least one seed for every ``seed`` words, so of
    its S places a document shares ``need``; counted as different seeds, at least
    need / (places of the most frequent seed).  Some of the S - need + 1 rarest are
    among them.
    """
    docs = docs.withColumn("body", F.xxhash64("text"))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, body, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = word_hashes(words_of(text))
                found = [np.unique(seeds(h, k)) for k in range(1, seed + 1) if k <= len(h)]  # an item may be shorter than a seed
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                n = len(flat)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key] * n, pa.int64()), "body": pa.array([body] * n, pa.int64()), "hash": pa.array(flat.view(np.int64))})

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes(words_of(text))
                if not len(h):
                    continue
                flat, places = np.unique(seeds(h, k := min(seed, len(h))), return_counts=True)
                need = max(1, math.ceil(math.ceil(least * len(h) - 1e-9) / k / places.max()))
                n = len(flat)
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * n, pa.int64()), "hash": pa.array(flat.view(np.int64)), "kept": pa.array([n - min(n, need) + 1] * n, pa.int32())})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, body, text, item, item_text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                found = _covered(Items([(item, item_text)], seed), text, least)
                yield _batch(f"{OUT}, body long", [(doc, *x, body) for x in found])

    item_seeds = common.stored(items.mapInArrow(of_items, "item_id long, hash long, kept int"), "item_seeds")
    met = common.stored(docs.select("doc_id", "body", "text").mapInArrow(of_docs, "doc_id long, body long, hash long").join(item_seeds.select("hash").distinct(), "hash"), "doc_seeds")
    counts = met.groupBy("hash").agg(F.count("*").alias("c"))
    rarest = W.partitionBy("item_id").orderBy(F.coalesce("c", F.lit(0)), "hash")  # an item's own seeds
    keys = item_seeds.join(counts, "hash", "left").withColumn("place", F.row_number().over(rarest)).where("place <= kept").select("item_id", "hash")
    both = met.join(keys, "hash").select("doc_id", "body", "item_id").distinct()
    same = both["doc_id"].eqNullSafe(docs["doc_id"]) & (both["body"] == docs["body"])
    both = both.join(docs, same).select(both["doc_id"], both["body"], "text", "item_id")
    both = both.join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "body", "text", "item_id", "item_text")
    return both.mapInArrow(pairs, f"{OUT}, body long")


def _covered(index: Items, text: str, least: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, coverage, number of tiles, longest tile) of the items that a text covers."""
    h = word_hashes(words_of(text))
    for item, runs in sorted(index.hits(h).items()):
        share, count, longest = index.coverage(item, h, runs)
        if share >= least:
            yield item, share, count, longest


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split(" ") for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_string_tiling": op7_string_tiling}
