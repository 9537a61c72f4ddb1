"""Op 9: WARC archives, written and read sequentially.

Writer: one gzip member for each record, a file for each task, in the shared
folder.  Reader: raw bytes are inflated member by member with an incremental
zlib object; within a member the header block ends at an empty line and
Content-Length frames the block, which is hashed as it passes and never held
whole.  Block and payload digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

#: Fixed values of the WARC format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, LEAST = 1 << 16, 1000


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", base32(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if refers_to is not None else []),
        ("Content-Length", str(len(block))),
    ]
    plain = VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block + CRLF + CRLF
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(plain) + pack.flush()


class Damaged(ValueError):
    """The bytes are not the archive that they should be."""


class Members:
    """Plain bytes of a gzip file, member by member, read forwards in chunks."""

    def __init__(self, source):
        self.source, self.raw, self.plain, self.pack = source, b"", b"", None

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if self.pack is not None and (self.plain or not self.pack.eof):
            raise Damaged("a record ends before its member")
        self.raw = self.raw or self.source.read(CHUNK)
        self.pack = zlib.decompressobj(31) if self.raw else None
        return bool(self.raw)

    def _more(self) -> bool:
        """Inflate a little more of this member; False at its end."""
        if self.pack.eof:
            return False
        if not self.raw and not self.pack.unconsumed_tail:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                raise Damaged("the file ends within a member")
        try:
            self.plain += self.pack.decompress(self.pack.unconsumed_tail + self.raw, CHUNK)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        self.raw = self.pack.unused_data
        return True

    def line(self) -> bytes:
        while CRLF not in self.plain:
            if not self._more():
                raise Damaged("a line does not end")
        line, _, self.plain = self.plain.partition(CRLF)
        return line

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.plain and not self._more():
                raise Damaged("a block ends before its length")
            part, self.plain = self.plain[:count], self.plain[count:]
            count -= len(part)
            yield part

    def finish(self) -> None:
        while self._more():
            pass


def read_records(source) -> Iterator[dict]:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of each record, verified."""
    members = Members(source)
    page = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    while members.next_member():
        if members.line() != VERSION:
            raise Damaged("not a WARC record")
        head = {}
        while line := members.line():
            name, colon, value = line.decode("utf-8").partition(":")
            if not colon:
                raise Damaged("a header line without a colon")
            head[name.strip().lower()] = value.strip()
        block, payload, http, body, length = hashlib.sha1(), hashlib.sha1(), b"", False, 0
        for part in members.take(int(head["content-length"])):
            block.update(part)
            if not body:
                http += part
                before, gap, part = http.partition(CRLF + CRLF)
                body = bool(gap)
                http = before if body else http
            if body:
                payload.update(part)
                length += len(part)
        if b"".join(members.take(4)) != CRLF + CRLF:
            raise Damaged("a record does not end in two line ends")
        members.finish()
        if base32(block.digest()) != head["warc-block-digest"]:
            raise Damaged("the block digest differs")
        fields = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
        whole = int(fields["Content-Length"])
        if head["warc-type"] == "response" and (length != whole or base32(payload.digest()) != head["warc-payload-digest"]):
            raise Damaged("the payload digest differs")
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        refers = head.get("warc-refers-to")
        yield {"page_id": page(head["warc-record-id"]), "payload_bytes": whole, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": page(refers) if refers else None}


def with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload and refers_to: null for responses, else the response's page_id.

    Of equal payloads of ``least`` bytes or more, that of the largest page_id is
    the response (rows that repeat it, page_id and all, too); the others and
    those without a page_id refer to it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.when(F.length("payload") >= least, F.unhex(F.sha1("payload"))))
    # Counting first makes a payload's copies one row for each task; only digests
    # that do repeat, a few bytes each, meet the pages again.
    again = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("key", "last")
    again = common.stored(again, "repeated")
    # Payloads stay in place while the digests that repeat are few enough to be sent;
    # else they move by digest, where Spark splits what one digest has too much of.
    met = rows.join(F.broadcast(again) if again.count() <= common.SENT else again, "key", "left")
    return met.select("page_id", "url", "payload", F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write each partition's records to a file of ``folder``; returns uri and records."""
    parted = with_roles(pages).select(F.spark_partition_id().alias("part"), "page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri, count, batch = f"{folder}/part-{first.column(0)[0].as_py():06d}.warc.gz", 0, first
        with files.written_whole(uri) as sink:
            while batch is not None:
                for k in range(batch.num_rows):
                    sink.write(record(*(batch.column(i)[k].as_py() for i in range(1, 5))))
                count += batch.num_rows
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([count], pa.int64())})

    return parted.mapInArrow(write, "uri string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the files listed in ``uri``, a task for each file."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = files.store_of(uri)
                held = []
                with store.open_input_stream(path, compression=None) as source:
                    for r in read_records(source):
                        held.append(r)
                        if len(held) == 1000:
                            yield pa.RecordBatch.from_pylist(held, types)
                            held = []
                yield pa.RecordBatch.from_pylist(held, types)

    return archives.mapInArrow(read, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "op9")
    done = write_archives(common.table(spark, sf_dir, "pages"), folder).collect()  # a row for each file
    listed = spark.createDataFrame([(r["uri"],) for r in done], "uri string")
    return read_archives(listed.repartitionByRange(max(1, len(done)), "uri"))


SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": SQL}
