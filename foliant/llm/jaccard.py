"""Op 5: n-gram Jaccard join by prefix filters under several global orders.

Documents with the same shingle set are one node.  A node's prefix under a
global order of all shingles is its first n - ceil(t n) + 1 shingles; nodes that
reach similarity t share a prefix shingle under *every* order, so candidates are
verified only if they meet under each of three:

1. rarest shingle first (its count over all documents, from a fixed-size count
   sketch), then by hash;
2. the same counts in coarser steps, then by another hash;
3. by a third hash alone.

Order 1 makes the blocks.  Prefixes that are longer by l - 1 shingles meet in l of
them, so nodes with fewer shared ones leave at once: their rows are all that this
costs, no pair is made for them.  What is left are near copies and texts that
are mostly shared passages.  Each such node goes to a chunk, at most ``CHUNK``
nodes of the largest block that it is in, and only chunks meet: a pair of chunks
that share a block, with lengths and positions that allow a link, is one row.
Within it the three filters are intersected and what passes is verified, many
nodes with many at a time; out come, for each node, the number of its links and
the smallest node that they reach there.  No pair of nodes is ever a row.

Where only components are asked for, each block's chunks meet its largest chunk
first, and after that only chunks whose nodes are in different components.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import contract_words, mixed, shingle_set, word_hashes

#: Counters of the shingle sketch (a power of two) and of one piece of it.
SKETCH, PIECE = 1 << 22, 1 << 14
#: A prefix is longer by this part of a set than two linked sets need to meet.
LONGER = 20
#: Nodes and shingles of a chunk, at most on average.
CHUNK, CHUNK_SHINGLES = 256, 1 << 17
#: Rows of a token that meet in a task; tokens that the sketch counts more often are spread.
HOT = 4096
#: Nodes that a task remembers as already written.
REMEMBERED = 50_000
#: Columns of an incidence matrix at once.
WIDE = 4096


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


class Orders:
    """A document's shingles and their three orders."""

    def __init__(self, words: int, per_cent: int, sketch: np.ndarray | None = None):
        self.words, self.per_cent, self.sketch = words, per_cent, sketch

    def node(self, text: str) -> tuple[int, np.ndarray]:
        """Node id (a 64-bit hash of the set) and the set."""
        found, _ = shingle_set(word_hashes(contract_words(text)), self.words)
        return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0, found

    @staticmethod
    def cells(found: np.ndarray) -> np.ndarray:
        return (mixed(found, 5) & np.uint64(SKETCH - 1)).astype(np.int64)

    def prefix_size(self, n: int) -> int:
        return n - -(-self.per_cent * n // 100) + 1

    def counts(self, found: np.ndarray) -> np.ndarray:
        return self.sketch[self.cells(found)]

    def first(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.lexsort((mixed(found, 1), counts))

    def second(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.lexsort((mixed(found, 2), np.frexp(counts.astype(np.float64))[1] // 2))

    def third(self, found: np.ndarray) -> np.ndarray:
        return np.argsort(mixed(found, 3))


class Seen:
    """Remembers a bounded number of nodes; what it forgets is only written twice."""

    def __init__(self):
        self.nodes: set[int] = set()

    def __contains__(self, node: int) -> bool:
        return node in self.nodes

    def add(self, node: int) -> None:
        if len(self.nodes) >= REMEMBERED:
            self.nodes.clear()
        self.nodes.add(node)


def _nodes_and_counts(docs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """Rows of kind 0: a document's node; of kind 1: a piece of the task's shingle counts."""
    make = Orders(words, per_cent)
    names = ["kind", "doc_id", "body", "node", "n", "piece", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for b in batches:
            nodes, sizes = [], []
            for (text,) in common.rows(b, 2):
                node, found = make.node(text)
                nodes.append(node)
                sizes.append(len(found))
                np.add.at(total, make.cells(found), np.uint32(1))
            m = len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        pieces = [k for k in range(SKETCH // PIECE) if total[k * PIECE : (k + 1) * PIECE].any()]
        packed = [zlib.compress(total[k * PIECE : (k + 1) * PIECE].tobytes(), 1) for k in pieces]
        m = len(pieces)
        none = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), none, none, none, pa.nulls(m, pa.int32()), pa.array(pieces, pa.int32()), pa.array(packed, pa.binary())], names)

    return docs.mapInArrow(run, "kind int, doc_id long, body long, node long, n int, piece int, counts binary")


def _summed(parts: DataFrame) -> np.ndarray:
    """The shingle counts of all tasks: pieces are added as they stream by, one at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            top = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
            return pa.RecordBatch.from_pydict({"piece": pa.array([now], pa.int32()), "counts": pa.array([zlib.compress(top.tobytes(), 1)], pa.binary())})

        for b in batches:
            for piece, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if piece != now:
                    if now is not None:
                        yield out()
                    now, total = piece, np.zeros(PIECE, np.uint64)
                total += np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
        if now is not None:
            yield out()

    rows = parts.select("piece", "counts").repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, counts binary").collect()
    sketch = np.zeros(SKETCH, np.uint32)  # 16 MB, whatever the input
    for r in rows:
        sketch[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return sketch


def _keys(docs: DataFrame, words: int, per_cent: int, sketch, hot: int) -> DataFrame:
    """(token, salt, node, pos, n): each node's longer prefix under order 1.

    ``salt`` spreads the rows of a token whose count is above ``hot``, by node.
    """
    names = ["token", "salt", "node", "pos", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Orders(words, per_cent, sketch.value), Seen()
        for b in batches:
            held, waiting = [], 0
            for (text,) in common.rows(b, 0):
                node, found = make.node(text)
                n = len(found)
                if not n or node in seen:
                    continue
                seen.add(node)
                counts = make.counts(found)
                own = make.first(found, counts)[: min(n, make.prefix_size(n) + n // LONGER)]
                spread = counts[own].astype(np.int64) // hot
                salt = np.where(spread > 0, 1 + node % np.maximum(spread, 1), 0).astype(np.int32)
                held.append((found[own], salt, np.full(len(own), node, np.int64), np.arange(len(own), dtype=np.int32), np.full(len(own), n, np.int32)))
                waiting += len(own)
                if waiting >= 200_000:
                    yield _flat(held, names)
                    held, waiting = [], 0
            if held:
                yield _flat(held, names)

    return docs.select("text").mapInArrow(run, "token long, salt int, node long, pos int, n int")


def _flat(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    token, *others = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([_signed(token), *map(pa.array, others)], names)


def _shared(keys: DataFrame) -> DataFrame:
    """(token, node, pos, n) of tokens that two nodes have, and of all that are spread.

    One exchange; sorted rows stream by and are compared with their neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, False  # the last row, and whether it has its predecessor's token
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            token, salt, node = now[:3]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # copies of a row go
            now = [x[fresh] for x in now]
            token, salt = now[:2]
            same = token[1:] == token[:-1]
            kept = np.r_[before, same] | np.r_[same, False] | (salt > 0)
            before = bool(same[-1]) if len(same) else before
            held = [x[-1:].copy() for x in now]
            yield out(now, kept[:-1], slice(0, -1))
            common.release()
        if held is not None:
            yield out(held, np.array([before]) | (held[1] > 0), slice(None))

    def out(now: list[np.ndarray], kept: np.ndarray, part: slice) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(now[i][part][kept]) for i in (0, 2, 3, 4)], ["token", "node", "pos", "n"])

    dealt = keys.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return dealt.mapInArrow(run, "token long, node long, pos int, n int")


def _sets(texts: DataFrame, words: int, per_cent: int, sketch) -> DataFrame:
    """(chunk, node, c, shingles, second, third) of (chunk, node, c, text) rows: the shingles
    under order 1, and the prefixes under the others as 32-bit hashes."""
    names = ["chunk", "node", "c", "shingles", "second", "third"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Orders(words, per_cent, sketch.value), Seen()
        for b in batches:
            rows = []
            for chunk, node, c, text in common.rows(b):
                if node in seen:
                    continue
                own, found = make.node(text)
                if own != node:  # another text with the same hash
                    continue
                seen.add(node)
                counts, size = make.counts(found), make.prefix_size(len(found))
                short = [(found[o[:size]] >> np.uint64(32)).astype(np.uint32) for o in (make.second(found, counts), make.third(found))]
                rows.append((chunk, node, c, found[make.first(found, counts)].tobytes(), *(np.unique(x).tobytes() for x in short)))
                if len(rows) == 200:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    return texts.mapInArrow(run, "chunk long, node long, c long, shingles binary, second binary, third binary")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the intersections of two lists of sets."""
    out, n = np.zeros((len(a), len(b)), np.float32), len(a)
    values, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(n + len(b)), [len(x) for x in (*a, *b)])
    common_ones = np.zeros(len(values), bool)
    common_ones[place[row >= n]] = True
    on_left = np.zeros(len(values), bool)
    on_left[place[row < n]] = True
    common_ones &= on_left
    kept = common_ones[place]
    row, column, size = row[kept], (np.cumsum(common_ones) - 1)[place[kept]], int(common_ones.sum())
    for k in range(0, size, WIDE):
        mine = (column >= k) & (column < k + WIDE)
        x = np.zeros((n + len(b), min(WIDE, size - k)), np.float32)
        x[row[mine], column[mine] - k] = 1
        out += x[:n] @ x[n:].T
    return out


class Chunk:
    """Nodes with their copies, sets and prefixes, from an Arrow list of structs."""

    def __init__(self, members: pa.StructArray, per_cent: int):
        col = lambda name: members.field(name)
        sets = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in col(name)]
        self.nodes, self.copies = (col(c).to_numpy(zero_copy_only=False) for c in ("node", "c"))
        self.sets = sets("shingles", np.uint64)
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.prefixes = [[x[: n - -(-per_cent * n // 100) + 1] for x, n in zip(self.sets, self.sizes.tolist(), strict=True)], sets("second", np.uint32), sets("third", np.uint32)]


def links(a: Chunk, b: Chunk, per_cent: int) -> np.ndarray:
    """Which nodes of ``a`` link with which of ``b``: prefixes meet under every order, then the exact test."""
    total = a.sizes[:, None] + b.sizes[None]
    may = (100 * np.minimum(a.sizes[:, None], b.sizes[None]) >= per_cent * np.maximum(a.sizes[:, None], b.sizes[None])) & (a.nodes[:, None] != b.nodes[None])
    for left, right in zip(a.prefixes, b.prefixes, strict=True):
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(rows):
            return may
        met = overlaps([left[i] for i in rows], [right[j] for j in cols]) > 0
        may[np.ix_(rows, cols)] &= met
    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if len(rows):
        both = np.zeros(may.shape)
        both[np.ix_(rows, cols)] = overlaps([a.sets[i] for i in rows], [b.sets[j] for j in cols])
        may &= 100 * both >= per_cent * (total - both)
    return may


def _reached(a: Chunk, b: Chunk, linked: np.ndarray) -> pa.RecordBatch:
    """(node, root, links) of the nodes with links: the smallest node that they reach here,
    and how many documents they link with."""
    far = np.iinfo(np.int64).max
    left, right = a.nodes.copy(), b.nodes.copy()
    while True:
        on_right = np.minimum(right, np.where(linked, left[:, None], far).min(0))
        on_left = np.minimum(left, np.where(linked, on_right[None], far).min(1))
        if (on_left == left).all() and (on_right == right).all():
            break
        left, right = on_left, on_right
    n_left, n_right = linked @ b.copies, linked.T @ a.copies
    nodes, roots, counts = (a.nodes, left, n_left) if a is b else (np.r_[a.nodes, b.nodes], np.r_[left, right], np.r_[n_left, n_right])
    some = counts > 0
    return pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (nodes, roots, counts)], ["node", "root", "links"])


def _within(chunks: DataFrame, per_cent: int) -> DataFrame:
    """(node, root, links) by the links within each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members in b.column(0):
                own = Chunk(members.values, per_cent)
                yield _reached(own, own, links(own, own, per_cent))
            common.release()

    return chunks.where(F.size("members") > 1).select("members").mapInArrow(run, "node long, root long, links long")


def _between(pairs: DataFrame, chunks: DataFrame, per_cent: int) -> DataFrame:
    """(node, root, links) by the links between the chunks of each pair (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (Chunk(m.values, per_cent) for m in (x, y))
                yield _reached(a, b, links(a, b, per_cent))
            common.release()

    side = lambda c: chunks.select(F.col("chunk").alias(c), F.col("members").alias(f"in_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("in_a", "in_b")
    return met.mapInArrow(run, "node long, root long, links long")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, comp): the smallest node that edges reach, for nodes with edges.

    ``labels`` (node, comp) are components already known; ``edges`` (a, b) join
    nodes of any of them.  Each round hooks every component onto its smallest
    neighbour, follows those hooks, and contracts the edges.  Every round's tables
    go when the next one's are written.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node"))
    if labels is not None:
        ends = labels.unionByName(ends.join(labels, "node", "left_anti"))
    labels = common.stored(ends, "labels")
    to = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    old: list[DataFrame] = []
    while True:
        edges = common.stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        for t in old:
            common.discard(t)
        if edges.isEmpty():
            common.discard(edges)
            return labels
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).where("to < a")
        onward = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hook = common.stored(hook.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "hook")
        root = lambda c, hook=hook: hook.select(F.col("a").alias(c), F.col("to").alias(f"_{c}"))
        old = [edges, hook, labels]
        labels = common.stored(labels.join(root("comp"), "comp", "left").select("node", F.coalesce("_comp", "comp").alias("comp")), "labels")
        edges = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))


def _blocks(rows: DataFrame, words: int, per_cent: int, sketch, hot: int) -> DataFrame:
    """(token, node, pos, n, c) of the tokens that ``c`` nodes share, two or more, of the
    nodes whose longer prefixes hold as many shared tokens as a link needs."""
    shared = common.stored(_shared(_keys(rows, words, per_cent, sketch, hot)), "shared")
    least = f"((n * {per_cent} + 99) div 100)"  # of a partner's size, and of the overlap
    size = f"(n - {least} + 1)"
    alive = shared.groupBy("node").agg(F.count("*").alias("got"), F.first("n").alias("n")).where(f"got >= {least} div {LONGER} + 1").select("node")
    blocks = common.stored(shared.where(f"pos < {size}").join(alive, "node"), "alive")
    counts = blocks.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    out = common.stored(blocks.join(counts, "token"), "blocks")
    common.discard(shared)
    common.discard(blocks)
    common.tidy(rows.sparkSession)
    return out


def _homes(blocks: DataFrame) -> DataFrame:
    """(node, chunk): chunks of bounded size of the nodes whose largest block is the same."""
    homes = blocks.groupBy("node").agg(F.max(F.struct("c", "token")).alias("most"), F.first("n").alias("n")).select("node", "n", F.col("most.token").alias("home"))
    sizes = homes.groupBy("home").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    parts = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("s") / CHUNK_SHINGLES)).cast("long")
    put = homes.join(sizes.select("home", parts.alias("k")), "home")
    return put.select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), "k")).alias("chunk"))


def _meeting(blocks: DataFrame, homes: DataFrame) -> DataFrame:
    """(token, chunk, m, cap, low, high): chunks in blocks of several: how many nodes, the most
    shingles from a node's place on, the least and the greatest set."""
    now = blocks.join(homes, "node").groupBy("token", "chunk").agg(F.count("*").alias("m"), F.max(F.expr("n - pos")).alias("cap"), F.min("n").alias("low"), F.max("n").alias("high"))
    several = now.groupBy("token").agg(F.min("chunk").alias("x"), F.max("chunk").alias("y")).where("x <> y").select("token")
    return now.join(several, "token")


def _fit(per_cent: int) -> str:
    """Whether lengths and places allow a link between x and y."""
    need = f"(x.low + y.low) * {per_cent} / ({per_cent} + 100) - 1e-9"
    return f"least(x.cap, y.cap) >= {need} and 100L * x.high >= {per_cent}L * y.low and 100L * y.high >= {per_cent}L * x.low"


def _pairs(meeting: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): all pairs of chunks that share a block in which a link is possible."""
    x, y = meeting.alias("x"), meeting.alias("y")
    met = x.join(y, F.expr("x.token = y.token and x.chunk < y.chunk")).where(_fit(per_cent))
    return met.select(F.col("x.chunk").alias("a"), F.col("y.chunk").alias("b")).distinct()


def _star_pairs(meeting: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): of each block, its largest chunk with each other one."""
    heads = meeting.groupBy("token").agg(F.max(F.struct("m", "chunk", "cap", "low", "high")).alias("h")).select("token", "h.*")
    met = meeting.alias("x").join(heads.alias("y"), "token").where("x.chunk <> y.chunk").where(_fit(per_cent))
    return met.select(F.least("x.chunk", "y.chunk").alias("a"), F.greatest("x.chunk", "y.chunk").alias("b")).distinct()


def _open_pairs(blocks: DataFrame, homes: DataFrame, labels: DataFrame, done: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): pairs of chunks, not done, that share a block in which nodes of different
    components might link."""
    now = blocks.join(homes, "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    now = now.groupBy("token", "chunk", "comp").agg(F.max(F.expr("n - pos")).alias("cap"), F.min("n").alias("low"), F.max("n").alias("high"))
    mixed_ones = now.groupBy("token").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.min("chunk").alias("r"), F.max("chunk").alias("s")).where("p <> q and r <> s").select("token")
    now = now.join(mixed_ones, "token")
    met = now.alias("x").join(now.alias("y"), F.expr("x.token = y.token and x.chunk < y.chunk and x.comp <> y.comp")).where(_fit(per_cent))
    return met.select(F.col("x.chunk").alias("a"), F.col("y.chunk").alias("b")).distinct().join(done, ["a", "b"], "left_anti")


def _chunks(rows: DataFrame, members: DataFrame, homes: DataFrame, words: int, per_cent: int, sketch) -> DataFrame:
    """(chunk, members): the sets of each chunk's nodes, each from one of its texts."""
    chosen = members.where("n > 0").groupBy("node").agg(F.min("body").alias("body"), F.count("*").alias("c")).join(homes, "node")
    chosen = common.stored(chosen, "chosen")
    few = chosen.count() <= common.SENT
    texts = rows.join(F.broadcast(chosen) if few else chosen, "body").select("chunk", "node", "c", "text")
    sets = _sets(texts, words, per_cent, sketch).dropDuplicates(["node"])
    made = common.stored(sets.groupBy("chunk").agg(F.collect_list(F.struct("node", "c", "shingles", "second", "third")).alias("members")), "chunks")
    common.discard(chosen)
    return made


def _found(blocks: DataFrame, homes: DataFrame, chunks: DataFrame, per_cent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(node, root, links) rows and (node, comp): by all links, or by those that it takes
    to know the components."""
    edges = lambda found: found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    meeting = common.stored(_meeting(blocks, homes), "meeting")
    pairs = common.stored(_pairs(meeting, per_cent) if every else _star_pairs(meeting, per_cent), "pairs")
    found = common.stored(_within(chunks, per_cent).unionByName(_between(pairs, chunks, per_cent)), "found")
    labels = components(edges(found))
    if not every:
        rest = common.stored(_open_pairs(blocks, homes, labels, pairs, per_cent), "open")
        if not rest.isEmpty():
            more = common.stored(_between(rest, chunks, per_cent), "more")
            before, labels = labels, components(edges(more), labels)
            for t in (before, more):
                common.discard(t)
        common.discard(rest)
    for t in (meeting, pairs):
        common.discard(t)
    return found, labels


def with_body(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and ``body``, a 64-bit hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("body", F.xxhash64("text"))


def _classes(docs: DataFrame, words: int, per_cent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, node, n) of every row, and (node, comp, c, n_links) of the nodes that link
    (n_links where ``every`` link is verified)."""
    spark, rows = docs.sparkSession, with_body(docs)
    both = common.stored(_nodes_and_counts(rows.select("doc_id", "body", "text"), words, per_cent), "nodes")
    counted = _summed(both.where("kind = 1"))
    hot = max(HOT, 16 * int(counted.mean()))
    sketch = spark.sparkContext.broadcast(counted)  # 16 MB, whatever the input
    members = both.where("kind = 0").select("doc_id", "body", "node", "n")
    common.tidy(spark)
    blocks = _blocks(rows, words, per_cent, sketch, hot)
    homes = common.stored(_homes(blocks), "homes")
    chunks = _chunks(rows, members, homes, words, per_cent, sketch)
    found, labels = _found(blocks, homes, chunks, per_cent, every)
    linked = labels.join(found.groupBy("node").agg(F.sum("links").alias("near")), "node") if every else labels
    linked = common.stored(linked, "linked")
    for t in (blocks, homes, chunks, found, labels):
        common.discard(t)
    sketch.unpersist()
    common.tidy(spark)
    return members, linked


def classes(docs: DataFrame, words: int = 4, per_cent: int = 85, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    With ``links`` also n_links, the number of other rows that the row links with;
    then every pair that passes the filters is verified.

    Two documents link when 100 * |A and B| >= ``per_cent`` * |A or B|, A and B
    their sets of ``words``-word shingles; component_id is the smallest doc_id
    that links reach.  Null and wordless texts have no shingles and link with
    nothing; rows that repeat a doc_id belong to their texts' components.  Null
    doc_ids take part but are never a component's smallest unless alone.  Other
    columns are ignored; an empty table gives no rows.
    """
    members, labels = _classes(docs, words, per_cent, links)
    # Copies are one row of their node until the end.
    own = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = common.cut(own)
    ids = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = own.join(ids, "comp")
    if links:
        of_node = of_node.withColumn("n_links", F.coalesce("near", F.lit(0)) + F.col("c") - 1)
    extra = ["n_links"] if links else []
    size = F.col("n").cast("long").alias("n_shingles")
    result = members.where("n > 0").join(of_node.select("node", "component_id", *extra), "node", "left").select("doc_id", size, "component_id", *extra)
    alone = members.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in extra])
    return result.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any columns), one for each group of near copies.

    Of a component the row with the smallest doc_id stays (null last; of equal ones
    the one whose text has the smaller hash; of rows equal in both, one).  Null and
    wordless texts are no copies of anything and all stay.
    """
    members, labels = _classes(docs, words, per_cent, False)
    names = id_, body = common.unused(docs, "own_id", "own_body")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body")
    own = members.where("n > 0").groupBy("node").agg(F.min(row).alias("row")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = own.groupBy("comp").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias(id_), F.col("row.body").alias(body))
    rows = members.where("n > 0").groupBy(F.col("doc_id").alias(id_), F.col("body").alias(body)).agg(F.count("*").alias("copies"))
    first = common.stored(first, "first")
    chosen = rows[id_].eqNullSafe(first[id_]) & (rows[body] == first[body])
    gone = common.stored(rows.join(first, chosen, "left_anti").select(*names), "gone")
    twice = common.stored(rows.where("copies > 1").join(first, chosen, "left_semi").select(*names), "twice")
    kept = common.among(docs, gone.unionByName(twice), "left_anti")
    if twice.isEmpty():
        return kept
    again = common.among(docs, twice, "inner").dropDuplicates(names)
    return kept.unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"), links=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_jaccard_join": op5_jaccard_join}
