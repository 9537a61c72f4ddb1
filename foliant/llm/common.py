"""Shared storage and small column helpers of this subpackage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words (U+0020 and U+0009 to U+000D).
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Bytes of the batches in which Spark passes rows to Python, where the session says nothing.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what Python workers hold of long texts; a value that the user set stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def release() -> None:
    """Give back to the system what Arrow holds of batches that are gone."""
    pa.default_memory_pool().release_unused()


def rows(batch, *columns: int) -> Iterator[tuple]:
    """A batch's rows (of some columns), made one at a time."""
    yield from zip(*((x.as_py() for x in batch.column(i)) for i in columns or range(batch.num_columns)), strict=True)
    release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent on one machine (tests) a folder is made and set; on a
    cluster it has to be given.
    """
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that loops do not grow its plan."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let the driver forget finished work: shuffle files, checkpoints and broadcasts
    that nothing refers to any more are removed when its JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        with suppress(Exception):
            drop_folder(spark, path)

    atexit.register(remove)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_in = path
    return made


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that no later plan reads."""
    drop_folder(df.sparkSession, df.stored_in)


#: Keys that are broadcast at most (a number and a hash each); more are joined by a shuffle.
SENT = 1_000_000


def body_of(docs: DataFrame) -> Column:
    """A 64-bit hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``keys`` (two columns: doc_id, and the text's ``body_of``) as ``how`` says.

    Texts stay in place while the keys are few enough to be sent.
    """
    id_, body = keys.columns
    same = docs["doc_id"].cast("long").eqNullSafe(keys[id_]) & (body_of(docs) == keys[body])
    return docs.join(F.broadcast(keys) if keys.count() <= SENT else keys, same, how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def utf8_bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8"))
