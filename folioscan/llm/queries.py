"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path
from .audio import render_vector, same_recordings
from .common import table
from .dart_minhash import near_duplicates
from .exact_dedup import exact_dedup
from .html_extract import extract
from .licenses import license_report
from .line_dedup import SHARE, line_report
from .mixing import mix
from .packing import pack
from .toxicity import score, train
from .warc import round_trip


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), share=SHARE)


def op5_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each embedding is rendered as a recording of one note per number."""
    return same_recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", render_vector).withColumnRenamed("rec_id", "vec_id")


QUERIES = {
    "op1_noisy_or_toxicity": op1_noisy_or_toxicity,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_segment_line_dedup": op4_segment_line_dedup,
    "op5_chunked_warc": op5_chunked_warc,
    "op6_license_scan": op6_license_scan,
    "op7_source_mixing": op7_source_mixing,
    "op8_wrapper_extraction": op8_wrapper_extraction,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_chroma_fingerprints": op10_chroma_fingerprints,
}

ORACLE = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
    "op5_chunked_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, payload FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS best FROM d),
        digits AS (SELECT *, ('0x' || substr(hex, 1, 10))::UBIGINT AS a, ('0x' || substr(hex, 11, 10))::UBIGINT AS b,
                          ('0x' || substr(hex, 21, 10))::UBIGINT AS c, ('0x' || substr(hex, 31, 10))::UBIGINT AS e FROM g)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((CASE i // 8 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE e END) >> (35 - 5 * (i % 8))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM digits
    """,
}
