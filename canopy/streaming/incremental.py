"""Counts of predictions as tile files arrive (S11 as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from canopy.operators.aggregates import counts


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1_000) -> DataFrame:
    """Rows of Parquet files as they appear in a folder; the checkpoint remembers finished files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_counts(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop: each batch's partial counts are a folder named by the batch.

    A batch that is run again replaces its own folder, so counts aren't doubled after a
    failure; readers add the partial counts up (A2).
    """

    def save(batch: DataFrame, number: int) -> None:
        counts(batch, *keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
