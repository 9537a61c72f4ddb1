"""Op 1: token ids as Arrow stream files of fixed-size-list batches.

Each part file is an Arrow IPC stream whose batches hold equal-length sequences:
``ids`` (fixed_size_list of the smallest unsigned type that holds the
vocabulary) and ``mask`` (fixed_size_list<bool>, false on the padding that fills
the part's last sequence).  All batches but the last have the same number of
rows and so the same number of bytes, which makes the place of every sequence
computable; a memory map gives it without copying.  A part's documents are in
``part-N.index.arrow``: doc_id, first (position in the part) and n_tokens.

Rows are dealt to parts by ranges of (doc_id, crc32 of the text, place in the
input), so that even a repeated row is spread; the parts follow each other in that
order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files
from .words import word_bpe

LENGTH, ROWS, END = 1024, 256, 1
#: Bytes of rows that are encoded together, and so share their distinct words.
TOGETHER = 24 << 20


def gathered(batches: Iterator[pa.RecordBatch], least: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches of ``least`` bytes or more, but for the last; none without rows."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def id_type(size: int) -> np.dtype:
    """The smallest unsigned type for ids below ``size``."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class SequenceWriter:
    """Packs ids end to end into sequences of ``length`` and writes full batches."""

    def __init__(self, sink, kind: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.kind, self.length, self.rows, self.held, self.waiting, self.total = kind, length, rows, [], 0, 0
        unit = pa.from_numpy_dtype(kind)
        self.types = pa.list_(unit, length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", self.types[0]), ("mask", self.types[1])], {"length": str(length), "rows": str(rows)})
        self.stream = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.rows * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat, step = np.concatenate(self.held) if self.held else np.zeros(0, self.kind), self.rows * self.length
        while len(flat) >= step or last and len(flat):
            taken, flat = flat[:step], flat[step:]
            full = -(-len(taken) // self.length) * self.length
            mask = np.arange(full) < len(taken)
            taken = np.concatenate([taken, np.zeros(full - len(taken), self.kind)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((taken, mask), self.types, strict=True)]
            self.stream.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held, self.waiting = [flat], len(flat)

    def close(self) -> None:
        self._flush(True)
        self.stream.close()


class SequenceFile:
    """Random access to a part file; ``sequence`` and ``span`` of a map copy nothing
    but what crosses batches.

    Batch ``k`` starts ``k`` times the first one's bytes after it, in any store: one
    seek and one read, or none of either where the file is mapped.
    """

    def __init__(self, source):
        self.source = source
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(source))
        self.rows, self.length = (int(self.schema.metadata[c]) for c in (b"rows", b"length"))
        self.start, self.step, self.at, self.now = source.tell(), 0, -1, None

    def _read(self, at: int) -> pa.RecordBatch:
        self.source.seek(at)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def _batch(self, k: int) -> pa.RecordBatch:
        if not self.step:
            self.now, self.at = self._read(self.start), 0
            self.step = self.source.tell() - self.start
        if k != self.at:
            self.now, self.at = self._read(self.start + k * self.step), k
        return self.now

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence ``k``."""
        batch, row = self._batch(k // self.rows), k % self.rows
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)
        return ids[row * self.length : (row + 1) * self.length], batch.column(1)[row].values

    def span(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from position ``first``; one view where they share a batch."""
        step, out = self.rows * self.length, []
        while count:
            k, at = divmod(first, step)
            taken = self._batch(k).column(0).values.to_numpy(zero_copy_only=True)[at : at + count]
            if not len(taken):
                raise ValueError("the file ends before the span")
            out.append(taken)
            first, count = first + len(taken), count - len(taken)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "<u4")


def write_parts(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the part files below ``folder``.

    Returns one row for each part that has documents, in order: part, uri,
    n_docs, n_tokens.  A null text counts as empty (its ids are the end id
    alone), a null doc_id comes first, rows with equal doc_id and text are each
    written.  A text is taken whole, over as many sequences and batches as it fills.
    An empty table writes nothing.  Other columns of ``docs`` are ignored.
    """
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.withColumns({"tie": F.crc32("text"), "place": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    dealt = dealt.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = gathered(batches)
        first = next(batches, None)
        if first is None:
            return
        part, bpe = first.column(0)[0].as_py(), word_bpe(tokenizer)
        kind = id_type(max(len(bpe.strings), end_id + 1))
        uri = f"{folder}/part-{part:06d}"
        index = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with files.written_whole(f"{uri}.arrow") as sink, files.written_whole(f"{uri}.index.arrow") as side:
            out, notes, batch = SequenceWriter(sink, kind, length, rows), pa.ipc.new_stream(side, index), first
            while batch is not None:
                at, (ids, sizes) = out.total, bpe.encode_all(batch.column(2))
                out.add(np.insert(ids, np.cumsum(sizes), end_id))
                sizes += 1
                places = at + np.cumsum(sizes) - sizes
                notes.write_batch(pa.record_batch([batch.column(1).cast(pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], schema=index))
                n_docs += len(sizes)
                ids = first = batch = None
                common.release()
                batch = next(batches, None)
            out.close()
            notes.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([out.total], pa.int64())})

    done = dealt.mapInArrow(write, "part int, uri string, n_docs long, n_tokens long").collect()  # a row for each part
    schema = "part int, uri string, n_docs long, n_tokens long, base long"
    base, rows_out = 0, []
    for r in sorted(done):
        rows_out.append((*r, base))
        base += r["n_tokens"]
    return docs.sparkSession.createDataFrame(rows_out, schema)


def read_documents(parts: DataFrame) -> DataFrame:
    """Read part files back: doc_id, start, n_tokens, ids_crc32, part, first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with files.opened(f"{uri}.arrow") as source, files.opened(f"{uri}.index.arrow") as side:
                    ids = SequenceFile(source)
                    for notes in pa.ipc.open_stream(side):
                        first, count = notes.column(1), notes.column(2)
                        sums = [zlib.crc32(ids.span(a, n).astype("<u4", copy=False)) for a, n in zip(first.to_pylist(), count.to_pylist(), strict=True)]
                        starts = pa.compute.add(first, base)
                        yield pa.RecordBatch.from_arrays([notes.column(0), starts, count, pa.array(sums, pa.int64()), pa.array([part] * len(sums), pa.int32()), first], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "first"])

    import pyarrow.compute  # noqa: F401  for pa.compute on executors

    listed = parts.select("part", "uri", "base")
    n = max(1, parts.count())
    return listed.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, first long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    folder = common.new_folder(spark, "op1")
    return read_documents(write_parts(docs, folder, public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_token_files": op1_token_files}
