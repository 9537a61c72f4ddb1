"""The daily increment as a stream of files: availableNow and foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import ranking
from ..sources import writers


def run_increments(spark: SparkSession, incoming: str, schema, root: str, key: str, transform=lambda df: df) -> int:
    """Process the files of ``incoming`` that no run has seen; returns the number of new runs.

    The stream's checkpoint is the ledger of files; a batch that was committed
    before a crash is not written again.
    """
    made = []

    def batch(df: DataFrame, number: int) -> None:
        rows = ranking.best_per_key(transform(df), [key], [key])
        if writers.commit_run(df.sparkSession, {"items": rows}, root, f"{number:06d}", rows.select(key)):
            made.append(number)

    stream = spark.readStream.schema(schema).json(incoming)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(made)
