"""Row streams over landing folders with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_landing(spark: SparkSession, path: str, schema: str, header: bool = True, files_each: int = 100) -> DataFrame:
    """New CSV files of a folder as rows; ``files_each`` bounds what one trigger takes."""
    return spark.readStream.schema(schema).option("header", header).option("maxFilesPerTrigger", files_each).csv(path)


def each_page(rows: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls a listener with each batch of rows, until what has landed is done; a restart goes on where it stopped."""
    return rows.writeStream.foreachBatch(listener).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
