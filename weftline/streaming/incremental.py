"""Structured Streaming: resumable, deduplicated appends and bounded scans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_arriving(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int | None = None, name: str | None = None) -> DataFrame:
    """Files of a folder (of one name or glob) as they arrive; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema).format(fmt)
    for option, value in (("maxFilesPerTrigger", files_per_trigger), ("pathGlobFilter", name)):
        if value:
            reader = reader.option(option, value)
    return reader.load(path)


def first_arrivals(stream: DataFrame, keys: Sequence[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first row of each key. With a watermark (column, delay) keys older than it are forgotten, so state stays bounded."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def append_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Appends what is there now and stops; run again, it goes on where it ended."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls handle with each micro-batch: periodic results, previews, upserts."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
