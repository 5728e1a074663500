"""Toxicity by logistic regression with FTRL-proximal updates over hashed words, word pairs and skip pairs.

A text's features are the distinct hashes, in `BITS` bits, of its lower-cased words without ASCII punctuation,
of neighbouring words and of words with one word between. Training goes once or more over a bounded sample of
labelled documents. Each coordinate has its own learning rate from the gradients it has seen, and L1 keeps the
weight of a coordinate at exactly zero until its gradients add up to more than `l1`, so the model is a short
list of coordinates and weights, at most 12 bytes for each of the `2 ** BITS` coordinates, that every task gets.

Bound of the sample: the `SAMPLE` labelled documents of the training part with the smallest hash of their id.
Of rows that share a doc_id the sample has the one with the smallest text. The features of whole texts are taken;
only those of the sample's documents meet in one task.

Defined results: a null or empty text has no feature and gets the score of the intercept; labels other than 0
and 1 are not learned from, and of conflicting labels of a document 1 counts; a null doc_id counts as held out; without any label to learn from every score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.llm import common
from claimlab.llm.words import mixed, word_hashes

BITS = 20
SAMPLE = 12_000
EPOCHS = 6
_LEFT, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """Per-coordinate rate `alpha / (beta + sqrt(sum of squared gradients))`, and the two penalties."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.0


def features(texts: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """Feature coordinates of each text, with repetitions."""
    shift = np.uint64(64 - bits)
    for _, words, begin in word_hashes(texts, lower=True, plain=True):
        single = (words >> shift).astype(np.uint32)
        pair = (mixed(words[:-1] * _LEFT + words[1:]) >> shift).astype(np.uint32)
        skip = (mixed(words[:-2] * _SKIP + words[2:]) >> shift).astype(np.uint32)
        begin = begin.tolist()
        for a, b in zip(begin, begin[1:]):
            yield np.concatenate([single[a:b], pair[a : max(a, b - 1)], skip[a : max(a, b - 2)]])


class FtrlLogistic:
    """Weights follow from two running sums for each coordinate; the last one is the intercept."""

    def __init__(self, bits: int = BITS, settings: Settings = Settings()):
        self.settings, self.intercept = settings, 1 << bits
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.settings, self.z[at]
        # The intercept is not drawn to zero.
        l1 = np.where(at == self.intercept, 0.0, s.l1)
        return np.where(
            np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        )

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.intercept)
        weights = self.weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(weights.sum(), -35, 35))) - label
        grown = np.sqrt(self.n[at] + gradient * gradient)
        self.z[at] += gradient - (grown - np.sqrt(self.n[at])) / self.settings.alpha * weights
        self.n[at] += gradient * gradient

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        weights = self.weights(at)
        return at[weights != 0], weights[weights != 0]


def fitted(
    documents: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, settings: Settings = Settings()
) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and their weights; documents and labels hold the training part only."""
    order = F.xxhash64("doc_id")
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most `sample` rows of two numbers, so the broadcast is bounded.
    known = F.broadcast(known.orderBy(order, "doc_id").limit(sample))
    texts = documents.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(f).astype("<u4").tobytes() for f in features(batch.column(2), bits)]
            columns = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(held, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "toxic", "features"])

    def train(group: pa.Table) -> pa.Table:
        model = FtrlLogistic(bits, settings)
        group = group.sort_by("doc_id")
        rows = [np.frombuffer(f, dtype="<u4").astype(np.int64) for f in group.column("features").to_pylist()]
        marks = group.column("toxic").to_pylist()
        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                model.learn(rows[i], marks[i])
        at, weights = model.sparse()
        return pa.table({"at": pa.array(at, pa.int64()), "weight": pa.array(weights, pa.float64())})

    extracted = texts.mapInArrow(extract, "doc_id long, toxic int, features binary")
    rows = extracted.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "at long, weight double").toArrow()
    return rows.column("at").to_numpy(), rows.column("weight").to_numpy()


def scored(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id and the probability of toxicity of every whole text."""
    coordinates, values = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << bits) + 1)
        weights[coordinates] = values
        for batch in batches:
            sums = np.full(batch.num_rows, weights[-1])
            for i, found in enumerate(features(batch.column(1), bits)):
                found = found[weights[found] != 0]
                if len(found):
                    sums[i] += weights[np.unique(found)].sum()
            scores = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn from four fifths of the labels, score all documents."""
    documents, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    known = ~common.held_out("doc_id")
    model = fitted(documents.where(known), labels.where(known))
    scores = scored(documents, model)
    return scores.select(
        "doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
