"""Request quota and retention, as batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTA, QUOTA_WINDOW = 100, "15 minutes"


def quota_counts(requests: DataFrame, key: str, time: str, window: str = QUOTA_WINDOW) -> DataFrame:
    """(key, window_start, requests): requests of a key in each tumbling window."""
    return requests.groupBy(key, F.window(time, window).alias("_w")).agg(F.count("*").alias("requests")).select(key, F.col("_w.start").alias("window_start"), "requests")


def admit(requests: DataFrame, key: str, time: str, tie: list[str], limit: int = QUOTA, window: str = QUOTA_WINDOW) -> DataFrame:
    """requests with window_start, place (their turn in the window) and admitted."""
    rows = requests.withColumn("window_start", F.window(time, window)["start"])
    turn = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(time, *tie))
    return rows.withColumn("place", turn).withColumn("admitted", F.col("place") <= limit)


def expired(modified: Column, now: Column, seconds: int) -> Column:
    """Whether something was last changed more than so many seconds ago."""
    return F.unix_timestamp(now) - F.unix_timestamp(modified) > seconds


def sweep_candidates(listing: DataFrame, root: str, now: Column, seconds: int) -> DataFrame:
    """First-level entries under root that have expired; hidden ones stay."""
    name = F.replace(F.col("path"), F.lit(root.rstrip("/") + "/"), F.lit(""))
    visible = F.startswith("path", F.lit(root.rstrip("/") + "/")) & ~F.contains(name, F.lit("/")) & ~F.startswith(name, F.lit("."))
    return listing.where(visible & expired(F.col("modificationTime"), now, seconds))
