"""Resumable extraction: a file stream whose micro-batches go through an extractor and are appended once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def extract(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, extractor: Callable[[DataFrame], DataFrame], key: str, files_per_batch: int = 50) -> None:
    """Process all new files under source, then stop. Files done before are known from the checkpoint, and keys done before from
    the stream's state, partitioned by key; earlier output is not read. A batch that is run again replaces its own folder."""

    def batch(d: DataFrame, n: int) -> None:
        extractor(d).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).dropDuplicates([key])
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
