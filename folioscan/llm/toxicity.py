"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import Memo, whole_row

#: Labelled documents used for fitting, at most (those with the smallest hashed ids), and the most characters that one may have.
#: So the driver gets at most MAX_TRAIN * MAX_TRAIN_CHARS / 2 words' feature indexes, of 4 bytes each.
MAX_TRAIN, MAX_TRAIN_CHARS = 20_000, 200_000
#: Sentences from this score on are reported as offending.
OFFENDING = 0.5
#: Features of the model, and the fewest training documents that one needs.
MAX_FEATURES, MIN_DOCS = 1_000, 6
AFFIX_LENGTHS = (3, 4, 5, 6, 7)
L2, STEPS, RATE = 5e-5, 400, 0.05

# Marks that end a sentence.
_SENTENCE = re.compile("[.!?\n…؟।。！？｡]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """A word itself, its beginnings and its ends."""
    found = [word]
    for k in AFFIX_LENGTHS:
        if len(word) > k:
            found += [word[:k] + "-", "-" + word[-k:]]
    return found


class WordFeatures(Memo):
    """word -> indexes of its features that the model has."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__(lambda word: tuple(vocabulary[f] for f in word_features(word) if f in vocabulary))


@dataclass
class Instances:
    """Sentences of documents: how many each has, and (sentence, feature) pairs of those with features."""

    n_sentences: np.ndarray
    doc_of: np.ndarray
    pair_sentence: np.ndarray
    pair_feature: np.ndarray
    spans: list[tuple[int, int]]

    @classmethod
    def read(cls, texts: list[str | None], memo: WordFeatures) -> Instances:
        counts, docs, sentences, features, spans = np.zeros(len(texts), np.int64), [], [], [], []
        for d, text in enumerate(texts):
            at, text = 0, text or ""
            # Cut before lower-casing, which can change lengths: spans are places in the text as it is.
            for m in [*_SENTENCE.finditer(text), None]:
                end = m.start() if m else len(text)
                words = _WORD.findall(text[at:end].lower())
                if words:
                    counts[d] += 1
                    if found := set().union(*map(memo.__getitem__, words)):
                        features += found
                        sentences += [len(docs)] * len(found)
                        docs.append(d)
                        spans.append((at, end))
                at = m.end() if m else end
        return cls(counts, np.asarray(docs, np.int64), np.asarray(sentences, np.int64), np.asarray(features, np.int64), spans)


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def sentence_logits(self, x: Instances) -> np.ndarray:
        return self.bias + np.bincount(x.pair_sentence, self.weights[x.pair_feature], len(x.doc_of))

    def log_clean(self, x: Instances, z: np.ndarray) -> np.ndarray:
        """Minus the log of the chance that no sentence of the document is toxic."""
        n = len(x.n_sentences)
        rest = x.n_sentences - np.bincount(x.doc_of, minlength=n)
        return np.bincount(x.doc_of, np.logaddexp(0, z), n) + rest * np.logaddexp(0, self.bias)


def gradient(model: Model, x: Instances, y: np.ndarray) -> np.ndarray:
    """Slope of the mean cross-entropy of the noisy-or over document labels, plus the weights' penalty; the bias last."""
    n = max(1, len(y))
    z = model.sentence_logits(x)
    clean = np.exp(-model.log_clean(x, z))
    slope = (1 - y) - y * clean / np.maximum(1 - clean, 1e-9)
    by_sentence = slope[x.doc_of] / (1 + np.exp(-z))
    weights = np.bincount(x.pair_feature, by_sentence[x.pair_sentence], len(model.weights)) / n + L2 * model.weights
    rest = x.n_sentences - np.bincount(x.doc_of, minlength=len(y))
    return np.append(weights, (by_sentence.sum() + (slope * rest).sum() / (1 + np.exp(-model.bias))) / n)


def loss(model: Model, x: Instances, y: np.ndarray) -> float:
    """What gradient() is the slope of."""
    dirty = model.log_clean(x, model.sentence_logits(x))
    return float(np.where(y > 0, -np.log(-np.expm1(-dirty)), dirty).mean() + L2 / 2 * (model.weights**2).sum())


def fit(x: Instances, y: np.ndarray, vocabulary: dict[str, int]) -> Model:
    """Minimise the cross-entropy of the noisy-or over document labels."""
    size = len(vocabulary)
    model = Model(vocabulary, np.zeros(size), -5.0)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1 if len(y) else 1):
        grad = gradient(model, x, y)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.weights -= move[:-1]
        model.bias -= float(move[-1])
    return model


def held_out(id_col: str) -> Column:
    return (F.crc32(F.col(id_col).cast("string")) % 5) == 0


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, hits = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            found = {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}
            docs.update(found)
            if label:
                hits.update(found)
        names = list(docs)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs[f] for f in names], pa.int64()), pa.array([hits[f] for f in names], pa.int64())], ["feature", "n", "hits"])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of the labelled documents that are not held out, at most max_rows of them and none beyond MAX_TRAIN_CHARS."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    # Repeated documents train once each; of several labels of a document the highest holds.
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # At most max_rows rows of two numbers: small enough to broadcast at any input size.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.char_length("text"), F.lit(0)) <= MAX_TRAIN_CHARS)
    return texts.join(F.broadcast(known), F.col("id") == F.col("_id")).select("id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, **columns) -> Model:
    """Fit on the training rows: features by how far their labels depart from chance, then the noisy-or.

    Texts stay on the executors; the driver gets the chosen features, at most MAX_FEATURES, and of the training
    rows, at most max_rows, the indexes of the features in their sentences. Without labels the model is constant.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(training_rows(docs, labels, max_rows, **columns), "train")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or not positive or positive == n:
        # One class only: a constant score on that side.
        scratch.drop_all()
        return Model({}, np.zeros(0), -9.0 if not positive else 9.0)
    rate = positive / n
    counted = rows.select("text", "label").mapInArrow(_count_features, "feature string, n long, hits long")
    totals = counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where(F.col("n") >= MIN_DOCS)
    spread = F.sqrt(F.col("n") * rate * (1 - rate) * (1 - F.col("n") / (n + 1)))
    score = F.round(F.abs(F.col("hits") - F.col("n") * rate) / spread, 9)
    best = totals.orderBy(score.desc(), "feature").limit(MAX_FEATURES).select("feature").collect()
    vocabulary = {r[0]: k for k, r in enumerate(best)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordFeatures(vocabulary)
        for batch in batches:
            x = Instances.read(batch.column("text").to_pylist(), memo)
            sentences = [[] for _ in range(len(batch))]
            cuts = np.searchsorted(x.pair_sentence, np.arange(len(x.doc_of) + 1))
            for s, d in enumerate(x.doc_of):
                sentences[d].append(x.pair_feature[cuts[s] : cuts[s + 1]].astype(np.int32).tolist())
            arrays = [batch.column("id"), batch.column("label"), pa.array(x.n_sentences, pa.int64()), pa.array(sentences, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "n", "sentences"])

    encoded = rows.mapInArrow(encode, "id long, label int, n long, sentences array<array<int>>").toArrow().sort_by("id")
    scratch.drop_all()
    held = encoded.column("sentences").combine_chunks()
    by_doc, by_sentence = np.diff(held.offsets.to_numpy()), np.diff(held.flatten().offsets.to_numpy())
    doc_of = np.repeat(np.arange(len(by_doc)), by_doc)
    pair_sentence, pair_feature = np.repeat(np.arange(len(by_sentence)), by_sentence), held.flatten().flatten().to_numpy()
    x = Instances(encoded.column("n").to_numpy(), doc_of, pair_sentence, pair_feature.astype(np.int64), [])
    return fit(x, encoded.column("label").to_numpy().astype(float), vocabulary)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its score: doc_id, held_out, score, predicted, n_sentences, offending.

    offending has the start, end and score of every sentence whose own score is at least OFFENDING, in text order; start and end
    are places in the text as it is. Whole texts are read; null and empty texts have no sentence and score 0. Rows stay
    in their partitions, repeated rows are scored alike, null ids are never held out, an empty table gives no rows, other columns are not read.
    """
    spans = "array<struct<start: long, end: long, score: double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordFeatures(model.vocabulary)
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                x = Instances.read(batch.column("text").to_pylist(), memo)
                z = model.sentence_logits(x)
                total = -np.expm1(-model.log_clean(x, z))
                own = 1 / (1 + np.exp(-z))
                found: list[list[dict]] = [[] for _ in range(len(batch))]
                for s in np.flatnonzero(own >= OFFENDING):
                    found[x.doc_of[s]].append({"start": x.spans[s][0], "end": x.spans[s][1], "score": float(own[s])})
                arrays = [batch.column("doc_id"), pa.array(total), pa.array(x.n_sentences, pa.int64()), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "n_sentences", "offending"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, score double, n_sentences long, offending {spans}")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with their own columns; nothing is shuffled."""

    @F.pandas_udf("double")
    def score_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = WordFeatures(model.vocabulary)
        for texts in parts:
            found = []
            for at in range(0, len(texts), 500):
                x = Instances.read([t if isinstance(t, str) else None for t in texts.iloc[at : at + 500]], memo)
                found += (-np.expm1(-model.log_clean(x, model.sentence_logits(x)))).tolist()
            yield pd.Series(found, index=texts.index, dtype="float64")

    return docs.select(whole_row(docs), score_of(F.col(text_col)).alias("_score")).where(F.col("_score") < threshold).select("_row.*")
