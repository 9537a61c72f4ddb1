"""Op 10: document scores by masked pseudo-likelihood.

A network sees the words on both sides of a masked word (position-specific
embeddings, summed and squashed) and predicts it by a three-level softmax: a
group of words, a smaller group in it, then the word.  A document's score is the
sum over its words of their conditional log-probabilities.

The corpus gives two things, in one pass over every document: counts of all its
words, from which the vocabulary comes, and its texts as streams of word hashes.
Every position of every document is masked once while the network is trained.
Streams are dealt to replicas by their hashes, a number that follows from the
corpus alone; each replica is trained in numpy on its streams in the order of
their hashes.  A round trains on its share of the replicas and their mean, added
up as a tree, starts the next round, so that the scores do not depend on how the
input is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words on each side, width of the network, words that have an id of their own.
SIDE, WIDTH, KNOWN = 2, 16, 16_128
#: Outcomes of the three levels, and ids.
LEVELS = (32, 32, 16)
SIZE, LAST, ROUNDS = 32 * 32 * 16, 32 * 32, 2
#: Positions of a step: an eighth of what was seen before, between these.
LEAST_STEP, MOST_STEP = 512, 32_768
#: Positions that a replica gets on average, and that are shuffled among themselves.
REPLICA, SHUFFLED = 4_000_000, 1 << 18
TABLE = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
#: First value of the sums of squared gradients.
INIT = 1e-6
#: Words of one piece of a long text, which is one row.
AT_ONCE = 65_536
#: Positions that are scored at once.
SCORED = 32_768
#: Values of a replica's parameters in one row, and rows that are added in one go.
PIECE, ADDED = 65_536, 256
#: Cells that count the words without an id of their own (a power of two, as is the
#: number of shared ids), the cells of one piece, and the count of what was never seen.
CELLS, CELL_PIECE, UNSEEN = 1 << 20, 1 << 12, 0.01
#: Words that a task counts before it passes them on.
COUNTED = 1_000_000
#: Hash that stands for the place beyond an end of a text.
EDGE = np.uint32(0)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").translate(TABLE).split()


def word_hashes(text: str) -> np.ndarray:
    words = words_of(text)
    return np.maximum(np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)), EDGE + 1)


def framed(ids: np.ndarray, edge: int) -> np.ndarray:
    """Rows of 2 * SIDE + 1 neighbours; ``edge`` stands beyond the text's ends."""
    wide = np.concatenate([np.full(SIDE, edge, ids.dtype), ids, np.full(SIDE, edge, ids.dtype)])
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * SIDE + 1)


class Counts:
    """Counts of words, merged as they come; ``full`` when it holds many."""

    def __init__(self):
        self.parts, self.waiting = [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(np.unique(hashes, return_counts=True))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > 4 * COUNTED:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([np.zeros(0, np.uint32), *(w for w, _ in self.parts)]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([np.zeros(0), *(c for _, c in self.parts)]), len(words)).astype(np.int64)
        self.parts, self.waiting = [(words, counts)], len(words)
        return words, counts

    def full(self) -> bool:
        return self.waiting > COUNTED and len(self.merge()[0]) > COUNTED


def gather(docs: DataFrame) -> DataFrame:
    """(kind 0: hash, count of a word in a task; kind 1: body, k, stream of word hashes).

    ``SIDE`` edges stand before and after a text; a long one is cut into pieces,
    numbered by ``k``, that overlap by ``SIDE`` places on both sides.
    """
    gap = np.full(SIDE, EDGE)
    names = ["kind", "hash", "count", "body", "k", "stream"]

    def counted(counts: Counts) -> pa.RecordBatch:
        words, n = counts.merge()
        none = pa.nulls(len(words), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words), np.int32)), pa.array(words.astype(np.int64)), pa.array(n), none, none.cast(pa.int32()), none.cast(pa.string()).cast(pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for b in batches:
            bodies, places, parts, met = [], [], [], []
            for body, text in common.rows(b):
                h = word_hashes(text)
                if len(h):
                    met.append(h)
                    wide = np.concatenate([gap, h, gap])
                    pieces = [wide[k : k + AT_ONCE + 2 * SIDE].tobytes() for k in range(0, len(h), AT_ONCE)]
                    bodies += [body] * len(pieces)
                    places += range(len(pieces))
                    parts += pieces
            m = len(parts)
            if m:
                counts.add(np.concatenate(met))
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), none, none, pa.array(bodies, pa.int64()), pa.array(places, pa.int32()), pa.array(parts, pa.binary())], names)
            if counts.full():
                yield counted(counts)
                counts = Counts()
        yield counted(counts)

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(text).alias("body"), text.alias("text")).mapInArrow(run, "kind int, hash long, count long, body long, k int, stream binary")


def frames_of(stream: np.ndarray, edge: int) -> np.ndarray:
    """Windows of a stream's words, the masked one in the middle."""
    frames = np.lib.stride_tricks.sliding_window_view(stream, 2 * SIDE + 1)
    return frames[frames[:, SIDE] != edge]


@dataclass
class Network:
    """``known``: hash -> id of the frequent words; other words share the ids above
    theirs by hash, and each of them takes the part of its id's probability that its
    count has of the id's; words that also share a cell are counted together."""

    known: dict[int, int]
    parts: np.ndarray  # CELLS, logarithms
    context: np.ndarray  # 2 * SIDE * (SIZE + 1), WIDTH
    bias: np.ndarray  # WIDTH
    top: np.ndarray  # 1, WIDTH + 1, 32
    middle: np.ndarray  # 32, WIDTH + 1, 32
    low: np.ndarray  # LAST, WIDTH + 1, 16

    @staticmethod
    def fresh(known: dict[int, int], parts: np.ndarray, counts: np.ndarray) -> Network:
        """Small random embeddings; output biases at the words' shares."""
        rng = np.random.default_rng(7)
        share = (counts + 0.5) / (counts + 0.5).sum()
        groups = [share.reshape(-1, size).sum(1) for size in (SIZE // LEVELS[0], LEVELS[2], 1)]
        levels = []
        for size, own, above in zip(LEVELS, groups, (np.ones(1), *groups[:-1]), strict=True):
            w = np.empty((len(own) // size, WIDTH + 1, size), np.float32)
            w[:, :-1] = rng.normal(0, 0.1, (len(w), WIDTH, size))
            w[:, -1] = np.log(own.reshape(-1, size) / above.reshape(-1)[:, None])
            levels.append(w)
        context = rng.normal(0, 0.1, (2 * SIDE * (SIZE + 1), WIDTH)).astype(np.float32)
        return Network(known, parts, context, np.zeros(WIDTH, np.float32), *levels)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashes: the word's own, or a shared one; ``SIZE`` for ``EDGE``."""
        if not hasattr(self, "_sorted"):
            keys = np.array(sorted(self.known), np.uint32)
            self._sorted = keys, np.array([self.known[int(k)] for k in keys], np.int32)
        keys, own = self._sorted
        out = (KNOWN + hashes % np.uint32(SIZE - KNOWN)).astype(np.int32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out = np.where(keys[at] == hashes, own[at], out)
        return np.where(hashes == EDGE, np.int32(SIZE), out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """``around``: rows of the context table, a column for each side position."""
        z = self.bias + self.context.take(around[:, 0], axis=0)
        for j in range(1, 2 * SIDE):
            z += self.context.take(around[:, j], axis=0)
        h = np.ones((len(around), WIDTH + 1), np.float32)
        np.tanh(z, out=h[:, :-1])
        return h

    def levels(self, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(weights, group, outcome) of each level for words in ascending order."""
        low, last = np.divmod(target, LEVELS[2])
        first, second = np.divmod(low, LEVELS[1])
        return [(self.top, np.zeros_like(first), first), (self.middle, first, second), (self.low, low, last)]

    def log_probabilities(self, frames: np.ndarray) -> np.ndarray:
        """Of the middle word of each row, given the others."""
        out = np.empty(len(frames), np.float32)
        for k in range(0, len(frames), SCORED):
            part = frames[k : k + SCORED]
            order = in_order(part[:, SIDE])
            part = part[order]
            h, total = self.hidden(part[:, SIDES] + OFFSETS), np.zeros(len(part), np.float32)
            for weights, group, outcome in self.levels(part[:, SIDE]):
                z = scored(h, weights, runs_of(group))
                top = z.max(1, keepdims=True) if far(z) else np.float32(0)
                total += z[np.arange(len(z)), outcome] - top.ravel() - np.log(row_sums(np.exp(z - top)))
            out[k : k + SCORED][order] = total
        return out

    def of_stream(self, stream: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each word of a stream (of hashes, with edges)."""
        ids = self.ids(stream)
        words = stream[SIDE:-SIDE][stream[SIDE:-SIDE] != EDGE]
        logs = self.log_probabilities(frames_of(ids, SIZE)).astype(np.float64)
        own = ids[SIDE:-SIDE][ids[SIDE:-SIDE] != SIZE]
        rare = own >= KNOWN  # these have a part of the id that they share
        logs[rare] += self.parts[words[rare] & np.uint32(CELLS - 1)]
        return logs

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.bias, self.top, self.middle, self.low]

    def step(self, part: np.ndarray, rate: float, sums: list[np.ndarray]) -> None:
        """One step of AdaGrad on rows of ids, the masked word in the middle."""
        part = part[in_order(part[:, SIDE])]  # words of a group stand together
        n, m = len(part), np.float32(1 / len(part))
        around, every = part[:, SIDES] + OFFSETS, np.arange(n)
        h = self.hidden(around)
        gh = np.zeros_like(h)
        for (weights, group, outcome), s in zip(self.levels(part[:, SIDE]), sums[2:], strict=True):
            runs = runs_of(group)
            p = scored(h, weights, runs)
            if far(p):
                p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p *= m / row_sums(p)[:, None]
            p[every, outcome] -= m
            met, g, back = [q for q, _, _ in runs], np.empty((len(runs), *weights.shape[1:]), np.float32), np.empty_like(h)
            for x, (q, i, j) in enumerate(runs):
                np.matmul(h[i:j].T, p[i:j], out=g[x])
                np.matmul(p[i:j], weights[q].T, out=back[i:j])
            gh += back
            now = s[met] + g * g
            s[met] = now
            weights[met] -= rate * g / np.sqrt(now)
        gz = gh[:, :-1] * (1 - h[:, :-1] ** 2)
        g = gz.sum(0)
        sums[1] += g * g
        self.bias -= rate * g / np.sqrt(sums[1])
        for j in range(2 * SIDE):
            order = in_order(part[:, SIDES[j]])
            keys = around[order, j]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            rows, g = keys[starts], np.add.reduceat(gz.take(order, axis=0), starts)
            now = sums[0][rows] + g * g
            sums[0][rows] = now
            self.context[rows] -= rate * g / np.sqrt(now)

    def fresh_sums(self) -> list[np.ndarray]:
        return [np.full_like(p, INIT) for p in self.parameters()]

    def copy(self) -> Network:
        return Network(self.known, self.parts, *(p.copy() for p in self.parameters()))

    def score(self, text: str) -> tuple[int, float]:
        """Number of words and the sum of their conditional log-probabilities."""
        counts, sums = self.scores([text])
        return counts[0], sums[0]

    def scores(self, texts: list[str]) -> tuple[list[int], list[float]]:
        """``score`` of many texts, short ones scored together and long ones in parts."""
        gap = np.full(SIDE, EDGE)
        counts, sums, held, waiting = [0] * len(texts), [0.0] * len(texts), [], 0

        def flush() -> None:
            nonlocal held, waiting
            if held:
                logs = self.of_stream(np.concatenate([gap, *(x for _, part, _ in held for x in (part, gap))]))
                starts = np.cumsum([0] + [n for _, _, n in held[:-1]])
                for (k, _, _), s in zip(held, np.add.reduceat(logs, starts).tolist(), strict=True):
                    sums[k] += s
            held, waiting = [], 0

        for k, text in enumerate(texts):
            hashes = word_hashes(text)
            counts[k] = n = len(hashes)
            if n > AT_ONCE:
                wide = np.concatenate([gap, hashes, gap])
                sums[k] = sum(float(self.of_stream(wide[at : at + AT_ONCE + 2 * SIDE]).sum()) for at in range(0, n, AT_ONCE))
            elif n:
                held.append((k, hashes, n))
                waiting += n
                if waiting >= AT_ONCE:
                    flush()
        flush()
        return counts, sums


SIDES = [j for j in range(2 * SIDE + 1) if j != SIDE]
#: First row of each side position in the context table.
OFFSETS = (np.arange(2 * SIDE) * (SIZE + 1)).astype(np.int32)


def in_order(ids: np.ndarray) -> np.ndarray:
    """Places of ids in ascending order; two-byte keys are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16), kind="stable")


def runs_of(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, begin, end) of a sorted array."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return list(zip(group[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True))


def scored(h: np.ndarray, weights: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits of each row under its group's weights."""
    z = np.empty((len(h), weights.shape[2]), np.float32)
    for q, i, j in runs:
        np.matmul(h[i:j], weights[q], out=z[i:j])
    return z


def far(z: np.ndarray) -> bool:
    """Whether exponents might overflow or vanish."""
    return bool(z.size) and max(z.max(), -z.min()) > 60


def row_sums(e: np.ndarray) -> np.ndarray:
    return (e @ np.ones((e.shape[1], 1), e.dtype)).ravel()


class Replica:
    """A network that is trained on the streams that it is given, in steps that do not
    depend on how they come."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.sums = network.copy(), rate, network.fresh_sums()
        self.rng, self.held, self.waiting, self.seen = np.random.default_rng(11), [], 0, 0

    def add(self, frames: np.ndarray) -> None:
        while len(frames):
            taken, frames = frames[: SHUFFLED - self.waiting], frames[SHUFFLED - self.waiting :]
            self.held.append(taken)
            self.waiting += len(taken)
            if self.waiting == SHUFFLED:
                self.flush()

    def flush(self) -> None:
        if self.held:
            frames = self.rng.permutation(np.concatenate(self.held))
            at = 0
            while at < len(frames):
                size = min(MOST_STEP, max(LEAST_STEP, self.seen // 8))
                part = frames[at : at + size]
                self.network.step(part, self.rate, self.sums)
                at, self.seen = at + len(part), self.seen + len(part)
        self.held, self.waiting = [], 0


def summed(parts: DataFrame, group: str | None) -> DataFrame:
    """Sums of (piece, replica, weight, values) rows by piece and ``group``, in the order of
    the replicas, added as they stream by."""
    names = ["piece", "replica", "weight", "values"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, weight = None, None, 0.0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names)
        for b in batches:
            for piece, part, w, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if (piece, part) != now:
                    if now is not None:
                        yield out()
                    now, total, weight = (piece, part), 0.0, 0.0
                total, weight = total + np.frombuffer(values.as_buffer(), np.float64), weight + w
        if now is not None:
            yield out()

    part = F.floor(F.col("replica") / ADDED).cast("long") if group else F.lit(0).cast("long")
    rows = parts.withColumn("part", part).repartition("piece", "part").sortWithinPartitions("piece", "part", "replica")
    return rows.select("piece", "part", "weight", "values").mapInArrow(add, "piece int, replica long, weight double, values binary")


def averaged(parts: DataFrame, pieces: int, replicas: int) -> list[np.ndarray]:
    """Weighted means of the replicas' (piece, replica, weight, values) rows, added as a tree."""
    while replicas > ADDED:
        parts, replicas = summed(parts, "part"), -(-replicas // ADDED)
    found = {r["piece"]: np.frombuffer(r["values"]) / r["weight"] for r in summed(parts, None).collect()}  # of the size of one network
    return [found[k].astype(np.float32) for k in range(pieces)] if found else []


def frequent(counts: DataFrame) -> list:
    """The ``KNOWN`` most frequent words; only those of the counts that decide are ordered."""
    level = F.floor(F.log("n") * 64)
    found, low = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["level"]):
        found, low = found + r["c"], r["level"]
        if found >= KNOWN:
            break
    return counts.where(level >= low).orderBy(F.desc("n"), "hash").limit(KNOWN).collect()


def cells(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and words of each cell, added as they stream by, piece by piece."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.RecordBatch.from_pydict({"piece": pa.array([now], pa.int32()), "values": pa.array([total.tobytes()], pa.binary())})
        for b in batches:
            pieces, place, n = (b.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.r_[True, pieces[1:] != pieces[:-1]]) if len(pieces) else []
            for i, j in zip(starts, [*starts[1:], len(pieces)], strict=True):
                if pieces[i] != now:
                    if now is not None:
                        yield out()
                    now, total = int(pieces[i]), np.zeros((2, CELL_PIECE))
                total[0] += np.bincount(place[i:j], n[i:j], CELL_PIECE)
                total[1] += np.bincount(place[i:j], minlength=CELL_PIECE)
        if now is not None:
            yield out()

    cell = F.col("hash").bitwiseAND(CELLS - 1)
    rows = counts.select(F.floor(cell / CELL_PIECE).cast("int").alias("piece"), (cell % CELL_PIECE).cast("int").alias("place"), "n")
    n, words = np.zeros(CELLS), np.zeros(CELLS)
    for r in rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, values binary").collect():
        at = slice(r["piece"] * CELL_PIECE, (r["piece"] + 1) * CELL_PIECE)
        n[at], words[at] = np.frombuffer(r["values"]).reshape(2, CELL_PIECE)
    return n, words


def parts_of(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Logarithm of the part that a word of each cell has of its shared id."""
    own = (n + UNSEEN).reshape(-1, SIZE - KNOWN)
    return (np.log(own / own.sum(0)).ravel() - np.log(np.maximum(words, 1))).astype(np.float32)


def train(docs: DataFrame, rounds: int = ROUNDS) -> Network:
    """Learn from every position of every document, each once; an empty or wordless
    corpus gives an untrained network.

    Rows that are equal are trained as often as they occur.  They are counted before
    they are dealt, so that a text's copies are spread over the replicas.
    """
    spark = docs.sparkSession
    seen = common.stored(gather(docs), "gathered")
    counts = common.stored(seen.where("kind = 0").groupBy("hash").agg(F.sum("count").alias("n")), "counts")
    top = frequent(counts)
    n, words = cells(counts)
    positions = int(counts.agg(F.sum("n")).first()[0] or 0)
    common.discard(counts)
    for r in top:
        n[r["hash"] & (CELLS - 1)] -= r["n"]
        words[r["hash"] & (CELLS - 1)] -= 1
    shares = np.zeros(SIZE)
    shares[: len(top)] = [r["n"] for r in top]
    shares[KNOWN:] = n.reshape(-1, SIZE - KNOWN).sum(0)
    network = Network.fresh({int(r["hash"]): k for k, r in enumerate(top)}, parts_of(n, words), shares)
    if positions and rounds:
        replicas = -(-positions // (REPLICA * rounds))  # of each round
        streams = common.stored(dealt(seen.where("kind = 1"), network, replicas, rounds), "streams")
        common.discard(seen)
        for round_ in range(rounds):
            network = trained(streams.where(F.col("round") == round_), network, replicas, 0.1 / (1 + round_))
        common.discard(streams)
    else:
        common.discard(seen)
    return network


def dealt(streams: DataFrame, network: Network, replicas: int, rounds: int) -> DataFrame:
    """(round, replica, body, k, times, ids): each stream's ids, with the replicas that
    train on it and how many times.

    Copies of a stream go to neighbouring replicas, one each while there are enough.
    """
    given = streams.sparkSession.sparkContext.broadcast(network)  # about 12 MB, whatever the corpus

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [given.value.ids(np.frombuffer(x.as_buffer(), np.uint32)).astype(np.uint16).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["body", "k", "ids"])

    coded = streams.select("body", "k", "stream").mapInArrow(encode, "body long, k int, ids binary")
    each = coded.groupBy("body", "k").agg(F.first("ids").alias("ids"), F.count("*").alias("copies"))
    all_ = replicas * rounds
    start = F.pmod(F.xxhash64("body", "k"), F.lit(all_))
    put = each.withColumns({"start": start, "i": F.explode(F.expr(f"sequence(0L, least(copies, {all_}L) - 1)"))})
    place = F.pmod(F.col("start") + F.col("i"), F.lit(all_))
    times = F.expr(f"copies div {all_} + if(i < copies % {all_}, 1, 0)")
    return put.select((place % rounds).cast("int").alias("round"), F.floor(place / rounds).cast("long").alias("replica"), "body", "k", times.alias("times"), "ids")


def trained(streams: DataFrame, network: Network, replicas: int, rate: float) -> Network:
    """The mean of replicas of ``network``, each trained on its streams."""
    given = streams.sparkSession.sparkContext.broadcast(network)
    pieces = -(-sum(p.size for p in network.parameters()) // PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None

        def out() -> Iterator[pa.RecordBatch]:
            own.flush()
            flat = np.concatenate([p.ravel() for p in own.network.parameters()]).astype(np.float64) * own.seen
            for k in range(pieces):
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "replica": pa.array([now], pa.int64()), "weight": pa.array([float(own.seen)]), "values": pa.array([flat[k * PIECE : (k + 1) * PIECE].tobytes()], pa.binary())})

        for b in batches:
            for replica, times, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if replica != now:
                    if own is not None:
                        yield from out()
                    own, now = Replica(given.value, rate), replica
                frames = frames_of(np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int32), SIZE)
                for _ in range(times):
                    own.add(frames)
        if own is not None:
            yield from out()

    ordered = streams.repartition(replicas, "replica").sortWithinPartitions("replica", F.xxhash64("k", "body"), "body", "k")
    mean = averaged(ordered.select("replica", "times", "ids").mapInArrow(run, "piece int, replica long, weight double, values binary"), pieces, replicas)
    given.unpersist()
    if not mean:
        return network
    ends = np.cumsum([p.size for p in network.parameters()])[:-1]
    shaped = [v.reshape(p.shape) for v, p in zip(np.split(np.concatenate(mean), ends), network.parameters(), strict=True)]
    return Network(network.known, network.parts, *shaped)


def pseudo_likelihood(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_tokens, pll and mean_log_p of every row.

    Null and wordless texts have no tokens, pll 0 and a null mean; repeated rows
    have equal scores.  Other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sums = given.value.scores([x for (x,) in common.rows(b, 1)])
            means = [s / n if n else None for n, s in zip(counts, sums, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], ["doc_id", "n_tokens", "pll", "mean_log_p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, pll double, mean_log_p double")


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pseudo_likelihood(docs, train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_pseudo_likelihood": op10_pseudo_likelihood}
