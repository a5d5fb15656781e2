"""Toxicity: a linear classifier of character n-grams with naive Bayes scaling.

A feature is the presence of a hashed n-gram of 3 to 6 characters of the lower-cased text.  Each is
scaled by its naive Bayes log-count ratio between the classes, a logistic regression is trained on
the scaled features, and the product of ratio and weight is the feature's share of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cadaspark.llm.classify import fitted, scored, sigmoid, training_rows
from cadaspark.llm.common import documents, freed, groups, labels

SIZES = (3, 4, 5, 6)
BITS = 20
DIM = 1 << BITS
#: Labelled rows of each class that the model is fitted on at most.
MOST = 4000
MODULUS, HELD = 5, 0
LEAST_DOCS, SMOOTH, EPOCHS, RATE, DECAY = 3, 0.5, 6, 0.5, 1e-5
_BASE = np.uint32(0x01000193)


class NGrams:
    """Hashed n-grams of texts; ``of(text)`` lists each present feature once."""

    def __init__(self):
        self.last = np.zeros(DIM, np.int32)

    def of(self, text: str) -> np.ndarray:
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
        parts, h = [], np.zeros(len(c), np.uint32)
        for n in range(1, SIZES[-1] + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * _BASE + c[n - 1 :] + np.uint32(1)
            if n in SIZES:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                parts.append(x >> np.uint32(32 - BITS))
        if not parts:
            return np.zeros(0, np.uint32)
        found = np.concatenate(parts)
        place = np.arange(len(found), dtype=np.int32)
        self.last[found] = place
        return found[self.last[found] == place]


def fit(texts: list[str], label: np.ndarray) -> np.ndarray:
    """Weights (ratio times weight) and, last, the intercept."""
    grams = NGrams()
    counts = np.zeros((2, DIM), np.float32)
    for t, y in zip(texts, label, strict=True):
        counts[y, grams.of(t)] += 1
    n = np.bincount(label, minlength=2).astype(np.float32)
    if not n.all():
        return np.append(np.zeros(DIM, np.float32), 4.0 if n[1] else -4.0)
    share = [(counts[k] + SMOOTH) / (n[k] + 2 * SMOOTH) for k in (0, 1)]
    ratio = np.log(share[1] / share[0])
    ratio[counts.sum(axis=0) < LEAST_DOCS] = 0
    rows = [r[ratio[r] != 0] for r in map(grams.of, texts)]  # only features that count are held
    weight, square = np.zeros(DIM, np.float32), np.full(DIM, 1.0, np.float32)
    bias, bias_square = 0.0, 1.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = ratio[r]
            g = float(sigmoid(bias + weight[r] @ x)) - label[i]
            step = g * x + DECAY * weight[r]
            square[r] += step * step
            weight[r] -= RATE * step / np.sqrt(square[r]) / np.sqrt(max(1, len(r)))
            bias_square += g * g
            bias -= RATE * g / bias_square**0.5
    return np.append(weight * ratio, np.float32(bias))


def score(texts: list[str], weights: np.ndarray) -> np.ndarray:
    grams = NGrams()
    return sigmoid(np.array([weights[grams.of(t)].sum(dtype=np.float64) for t in texts]) + weights[-1]) if texts else np.zeros(0)


def toxicity(docs: DataFrame, labelled: DataFrame, label: str = "toxic", modulus: int = MODULUS, held: int = HELD, most: int = MOST) -> DataFrame:
    """A row a document: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows with ``crc32(doc_id as text) mod modulus`` other than ``held``, at most
    ``most`` of each class; without usable labels of one class every text gets the same score on the
    other side of 0.5.  Only the text is an input of a score; null counts as empty, and empty texts
    get the intercept's score.  Repeated rows get equal scores; an empty table gives an empty result;
    other columns are not read.
    """
    weights = fitted(training_rows(docs, labelled, label, modulus, held, most), fit)
    return scored(docs, weights, score, modulus, held)


def drop_toxic(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, with all their columns, whatever their names.

    Null texts count as empty; empty texts get the intercept's score.  Repeated rows stay or go
    together; an empty table gives an empty result; without usable labels of one class all rows get
    the same score, so all stay or all go.  Rows pass through in groups of bounded size.
    """
    weights = fitted(training_rows(docs, labelled, "toxic", MODULUS, HELD, MOST), fit)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                clean = score([t or "" for t in part.column("text").to_pylist()], shared.value) < 0.5
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
