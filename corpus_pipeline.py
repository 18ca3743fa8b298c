"""A training-data pipeline over documents: toxicity, exact dedup, near dedup, source mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm.dart_minhash import keep_representatives
from folioscan.llm.exact_dedup import keep_first
from folioscan.llm.mixing import take_mix
from folioscan.llm.packing import pack
from folioscan.llm.queries import vocabulary
from folioscan.llm.toxicity import drop_toxic, train
from folioscan.session import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled rows of docs, doesn't reject.

    Null and empty texts have no sentence and stay; repeated rows are judged alike; rows with a null id are judged but
    never trained on; a score of 0.5 or more is rejected; an empty table stays empty; the columns stay as they are.
    """
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for runs of white space: the one with the smallest id.

    Null and empty texts are one group; a null id loses to any other; of repeated rows one stays; an empty table stays empty.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id (null last; of repeated ids one).

    Texts without words are equal only to themselves, null and empty ones to each other; an empty table stays empty.
    """
    return keep_representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, none more than twice.

    Null and empty texts have no words and are taken as often as their source's whole rounds ask; a null source is one source, the last; repeated
    rows each count; of documents of one length those with the smallest seeded hashes are taken; an empty table stays empty.
    """
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that the mix takes twice is packed twice.

    Null and empty texts are their end id alone; null ids stay null; very long texts fill windows of their own; an empty table gives no pieces.
    """
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("source_mixing", mixture),
    ("packing", packing),
]

#: Model training, signatures and packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again; the one before is then deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
