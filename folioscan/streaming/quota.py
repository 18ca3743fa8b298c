"""Streaming forms of the quota, the sweep and extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.requests import QUOTA, QUOTA_WINDOW

LATE = "30 minutes"
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_counts(requests: DataFrame, key: str, time: str, window: str = QUOTA_WINDOW, late: str = LATE, limit: int = QUOTA) -> DataFrame:
    """(key, window_start, requests, over): counts of each tumbling window; state goes when a window is `late` old."""
    counted = requests.withWatermark(time, late).groupBy(key, F.window(time, window).alias("_w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("_w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over"))


def stream_first_uploads(uploads: DataFrame, name: str, time: str, keep: str = LATE) -> DataFrame:
    """Uploads less those whose name was seen within the time kept."""
    return uploads.withWatermark(time, keep).dropDuplicatesWithinWatermark([name])


def stream_files(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they land, each once."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_trigger)).load(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands what there is to `each` in micro-batches and ends; batch numbers make it repeatable."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
