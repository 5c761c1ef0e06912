"""Incremental reading of sensor logs that land as finished files in a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.stores import BucketStore
from ..sources.zeek import attach_headers, decode_lines, number_lines, text_lines

# Fixed value: the live reader refuses longer lines; readers of finished files take any.
MAX_LINE_CHARS = 1_048_576


def landing_lines(spark: SparkSession, directory: str, files_per_trigger: int = 100, glob: str = "*.log") -> DataFrame:
    """Streaming lines of new files. File sources do not follow appends: rotate, then move files in."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob)
    return text_lines(reader.text(directory)).withColumn("zeek_available_at", F.current_timestamp())


def decode_batch(lines: DataFrame) -> DataFrame:
    """Raw records of one micro-batch; a file is never split over micro-batches."""
    return decode_lines(attach_headers(number_lines(lines)), MAX_LINE_CHARS)


def stream_zeek(
    spark: SparkSession, directory: str, handle: Callable[[DataFrame, int], None], checkpoint: str,
    files_per_trigger: int = 100, available_now: bool = False,
) -> StreamingQuery:
    """Decode every new file and pass each micro-batch of raw records, rejects included, to ``handle``."""
    writer = (
        landing_lines(spark, directory, files_per_trigger)
        .writeStream.foreachBatch(lambda lines, batch: handle(decode_batch(lines), batch))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_alerts(path: str, key: str = "alert_id", order: str = "observed_at") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that keeps one row per alert id, the newest by ``order``, in a ``BucketStore``."""
    return lambda alerts, batch: BucketStore(alerts.sparkSession, path, key, order).merge(alerts, batch)


def current_alerts(spark: SparkSession, path: str, key: str = "alert_id", order: str = "observed_at") -> DataFrame:
    return BucketStore(spark, path, key, order).read()
