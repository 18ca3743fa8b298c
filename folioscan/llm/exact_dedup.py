"""Exact deduplication by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, empty_if_null, group_in_two_levels, null_safe_key, one_row_each, salt_count


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.regexp_replace(empty_if_null(text_col), SPACE, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"))
    return rows.withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space. Rows are combined in each map
    task, then per (digest, salt), then over the salts' winners; digest and full content are the key every
    time, so a digest collision never joins two texts. Only winners and counts go to the last combining. Null text counts as empty; of repeated (doc_id, text)
    rows one is kept; null ids lose to others; an empty table gives no rows; other columns are not read.
    `salts` defaults to the square root of the row count.
    """
    rows = _keyed(docs, id_col, text_col)
    out = group_in_two_levels(rows, ["text_sha256", "_norm"], "doc_id", salts or salt_count(docs), route=["text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns."""
    kept = exact_dedup(docs, id_col, text_col, salts).where("kept").select(null_safe_key("doc_id").alias("_key"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.regexp_replace(empty_if_null(text_col), SPACE, " ").cast("binary"), 256)
    return one_row_each(docs, [null_safe_key(id_col), sha], kept)
