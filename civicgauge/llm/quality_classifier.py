"""Operator 5: quality classifier, a logistic regression over hashed word n-grams trained by follow-the-regularised-leader.

Features are the buckets of words and word pairs (a word that follows itself is one and the same pair), each with its count
over the root of the number of n-grams, so that the length of a text does not decide. Training texts are those of labelled
ids outside the held-out fold, one for each of at most ``train_rows`` ids (those with the smallest hashes). They are one
group, so one task runs per-coordinate updates with L1 and L2 terms over them for some epochs, in an order that follows from
the ids: the model is the same however many partitions there are. Scoring is a sparse dot product: the n-grams of each text
meet the weight table (at most ``buckets`` + 1 rows, broadcast) and are summed in the task that reads the text.

Inputs of a score are the words alone: no labels, language, source or id.

Defined results: a null or empty text has the score of the bias; without training rows every score is 0.5; a label that is
null is none, and of several labels of one id the smallest counts, of several texts of one labelled id the one with the
smallest hash; repeated rows are scored each on their own; an empty
table gives an empty table; only id and text are read, so other columns do not clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.grams import BUCKETS, bounded_labels, gram_buckets, labelled_once, with_word_hashes
from civicgauge.llm.tasks import workers_find_package
from civicgauge.session import durable

TRAIN_ROWS = 10_000
EPOCHS = 5
HELD_OUT = 2
BIAS = -1


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == HELD_OUT, F.lit(False))


class Leader:
    """Follow the regularised leader: weights are a closed form of summed gradients, zero where L1 outweighs them."""

    def __init__(self, size: int, rate: float = 2.0, smooth: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> None:
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.sums, self.squares = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        sums = self.sums[at]
        size = np.maximum(np.abs(sums) - self.l1, 0)
        return -np.sign(sums) * size / ((self.smooth + np.sqrt(self.squares[at])) / self.rate + self.l2)

    def update(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        """One row: distinct positions, their values, 0 or 1."""
        weights = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(weights @ values, -35, 35))) - label) * values
        squares = self.squares[at] + gradient ** 2
        self.sums[at] += gradient - (np.sqrt(squares) - np.sqrt(self.squares[at])) / self.rate * weights
        self.squares[at] = squares


def sparse(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions and values of a text's n-grams; the last position is the bias."""
    at, counts = np.unique(grams, return_counts=True)
    return np.append(at, buckets).astype(np.int32), np.append(counts / max(1.0, np.sqrt(len(grams))), 1.0).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS,
          text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Weight table: ``bucket`` (BIAS for the bias) and ``weight``, without zeros; at most ``buckets`` + 1 rows."""
    known = labelled_once(labels.filter(~held_out(id_column)), {"label": F.col("quality")}, id_column).filter(F.col("label").isin(0, 1))
    chosen = bounded_labels(known, train_rows, id_column).select(F.col(id_column).alias("label_id"), "label")
    rows = docs.select(F.col(id_column).alias("row_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("row_id") == F.col("label_id"))
    # Of several texts of one id one is learnt from, so that there are `train_rows` of them at most.
    rows = rows.groupBy("row_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_word_hashes(rows).select("row_id", "label", gram_buckets(F.col("word_hashes"), buckets, doubled=True).alias("grams"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        found = [(i, y, np.asarray(g, dtype=np.int32)) for i, y, g in zip(frame["row_id"], frame["label"], frame["grams"])]
        # By id: the order rows arrive in does not count.
        found = [(sparse(g, buckets), y) for _, y, g in sorted(found, key=lambda x: x[0])]
        model, order = Leader(buckets + 1), np.random.default_rng(0)
        for _ in range(epochs):
            for k in order.permutation(len(found)):
                model.update(*found[k][0], int(found[k][1]))
        weights = model.weights()
        at = np.flatnonzero(weights)
        return pd.DataFrame({"bucket": np.where(at == buckets, BIAS, at).astype("int32"), "weight": weights[at]})

    workers_find_package(docs.sparkSession)
    # Written so that the model is fitted once.
    return durable(rows.groupBy(F.lit(0).alias("model")).applyInPandas(fit, "bucket int, weight double"), "weights")


def score(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Id and ``score`` (probability of label 1) of each row."""
    rows = with_word_hashes(docs.select(F.monotonically_increasing_id().alias("row_number"), F.col(id_column), F.col(text).alias("text")))
    grams = rows.select("row_number", id_column, gram_buckets(F.col("word_hashes"), buckets, doubled=True).alias("grams"))
    grams = grams.select("row_number", id_column, F.greatest(F.size("grams"), F.lit(1)).alias("n_grams"),
                         F.explode(F.concat(F.array(F.lit(BIAS)), F.col("grams"))).alias("bucket"))
    met = grams.join(F.broadcast(weights), "bucket", "left")
    weight = F.coalesce(F.col("weight"), F.lit(0.0))
    dots = met.groupBy("row_number", id_column, "n_grams").agg(
        F.sum(F.when(F.col("bucket") == BIAS, weight).otherwise(0.0)).alias("bias"),
        F.sum(F.when(F.col("bucket") == BIAS, 0.0).otherwise(weight)).alias("dot"))
    margin = F.col("bias") + F.col("dot") / F.sqrt("n_grams")
    return dots.select(id_column, (1 / (1 + F.exp(-margin))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, buckets: int = BUCKETS, text: str = "text", id_column: str = "doc_id",
             **settings) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) of each row."""
    scored = score(docs, train(docs, labels, buckets, text=text, id_column=id_column, **settings), buckets, text, id_column)
    return scored.select(id_column, held_out(id_column).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
