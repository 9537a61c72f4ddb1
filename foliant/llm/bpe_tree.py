"""Op 8: BPE encoding of long texts by tree concatenation, and decoding.

A text becomes a stream of unmerged tokens.  Streams longer than a leaf are
halved, anywhere, until leaves remain; leaves are encoded on their own and
joined in pairs up the tree.  At a join, windows of 4, 8, 16 ... ids on either
side are encoded anew until the window's first id is the left side's and its
last id the right side's.  The result is then the whole's encoding: with a merge
list in which every merge comes after those that make its parts, ids are the
encoding of their letters exactly when each two neighbours are the encoding of
theirs, and each pair of neighbours lies in the left side, the window or the
right side.  ``TreeBpe`` checks the merge list for that property.

Halves run in parallel: a stream longer than ``segment`` is cut into rows of its
own that go to different tasks, and their ids are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import Bounded, packed, word_bpe

LEAF, SEGMENT, WINDOW = 4096, 65_536, 4


class TreeBpe:
    def __init__(self, path: str):
        self.bpe = bpe = word_bpe(path)
        merges = [m if isinstance(m, list) else m.split(" ") for m in bpe.spec["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if a + b in made:
                raise ValueError(f"two merges make {a + b!r}")
            made[a + b] = rank
        if any(made.get(part, -1) > rank for rank, pair in enumerate(merges) for part in pair):
            raise ValueError("a merge comes before one that makes its part")
        end = bpe.end
        marked = {i: m for m, i in bpe.marks.items()}
        #: What an id adds to a stream: its letters, and a space if it ends its word.
        self.letters = [marked[i] + " " if i in marked else s[: -len(end)] + " " if end and s.endswith(end) else s for i, s in enumerate(bpe.strings)]
        self.open_ids = Bounded(self._open, 16_000_000)

    def _open(self, word: str) -> bytes:
        return packed([t.id for t in self.bpe.open_model.tokenize(word)] if word else [])

    def leaf(self, stream: str) -> bytes:
        """Ids of a piece of a stream; its last word ends only if a space follows."""
        words = stream.split(" ")
        last = words.pop()
        return b"".join(map(self.bpe.ids.__getitem__, words)) + (b"" if not last else self.bpe.ids[last] if last in self.bpe.marks else self.open_ids[last])

    def text_of(self, ids: bytes) -> str:
        return "".join(map(self.letters.__getitem__, memoryview(ids).cast("I")))

    def join(self, left: bytes, right: bytes, opens: bool) -> bytes:
        """``opens``: the right side begins with the space that ends the left's last word."""
        if not left or not right and not opens:
            return left + right
        if not opens and left and self.letters[int.from_bytes(left[-4:], "little")].endswith(" "):
            return left + right
        n = WINDOW
        while True:
            a, b = left[-4 * n :], right[: 4 * n]
            text = self.text_of(a) + (" " if opens else "") + self.text_of(b)
            window = self.leaf(text)
            if (len(b) == len(right) or window[-4:] == b[-4:]) and (len(a) == len(left) or window[:4] == a[:4]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            n *= 2

    def tree(self, parts: list[tuple[bytes, bool]]) -> tuple[bytes, bool]:
        """Join neighbours, level by level: (ids, whether the piece began with a space)."""
        while len(parts) > 1:
            pairs = [(self.join(a, b, opens), begins or not a and opens) for (a, begins), (b, opens) in zip(parts[::2], parts[1::2], strict=False)]
            parts = pairs + parts[len(parts) & ~1 :]
        return parts[0]

    def piece(self, stream: str, leaf: int = LEAF) -> tuple[bytes, bool]:
        """Ids of any part of a stream, and whether it began with a word's end."""
        if len(stream) <= leaf:
            opens = stream.startswith(" ")
            return self.leaf(stream[1:] if opens else stream), opens
        count = 1 << (-(-len(stream) // leaf) - 1).bit_length()
        cuts = [len(stream) * k // count for k in range(count + 1)]
        return self.tree([self.piece(stream[a:b], leaf) for a, b in zip(cuts, cuts[1:], strict=False)])

    def encode(self, text: str, leaf: int = LEAF) -> bytes:
        return self.piece(self.bpe.stream(text), leaf)[0]

    def decode(self, ids: bytes) -> str:
        """The library's decoding for a file without a decoder: its strings, spaced."""
        return " ".join(map(self.bpe.strings.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def tree_bpe(path: str) -> TreeBpe:
    return TreeBpe(path)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(tree: TreeBpe, ids: bytes) -> tuple[int, str, str]:
    numbers = memoryview(ids).cast("I")
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return len(numbers), sha(" ".join(map(str, numbers))), sha(tree.decode(ids))


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.strip().split(" ") for x in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def encode_documents(docs: DataFrame, tokenizer: str, segment: int = SEGMENT, leaf: int = LEAF, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, with ``keep_ids``) of every row.

    A null text counts as empty: no ids, digests of the empty string.  Repeated
    rows, repeated or null doc_ids each give their row; other columns are
    ignored.  Texts of more than ``segment`` characters take the second way,
    in which their parts are encoded by different tasks.
    """
    schema = OUT + (", ids binary" if keep_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def result(tree: TreeBpe, doc: int, ids: bytes) -> tuple:
        return (doc, *digests(tree, ids), *([ids] if keep_ids else []))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_bpe(tokenizer)
        for b in batches:
            for k in range(0, b.num_rows, 500):  # what goes back stays small
                yield _batch(schema, [result(tree, d, tree.encode(t, leaf)) for d, t in common.rows(b.slice(k, 500))])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_bpe(tokenizer)
        for b in batches:
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                stream = tree.bpe.stream(text)
                for k, at in enumerate(range(0, max(1, len(stream)), segment)):
                    yield _batch("row long, doc_id long, k int, stream string", [(row, doc, k, stream[at : at + segment])])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_bpe(tokenizer)
        for b in batches:
            for row, doc, k, stream in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                yield _batch("row long, doc_id long, k int, ids binary, opens boolean", [(row, doc, k, *tree.piece(stream, leaf))])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (row, k): the parts of one text follow each other."""
        tree, now, doc, parts = tree_bpe(tokenizer), None, None, []
        for b in batches:
            for row, d, _, ids, opens in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if row != now:
                    if parts:
                        yield _batch(schema, [result(tree, doc, tree.tree(parts)[0])])
                    now, doc, parts = row, d, []
                parts.append((ids, opens))
        if parts:
            yield _batch(schema, [result(tree, doc, tree.tree(parts)[0])])

    short = rows.where(F.length("text") <= segment).mapInArrow(whole, schema)
    long = rows.where(F.length("text") > segment).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = long.mapInArrow(segments, "row long, doc_id long, k int, stream string").repartition("row", "k")
    parts = parts.mapInArrow(encoded, "row long, doc_id long, k int, ids binary, opens boolean")
    return short.unionByName(parts.repartition("row").sortWithinPartitions("row", "k").mapInArrow(joined, schema))


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_bpe_tree": op8_bpe_tree}
