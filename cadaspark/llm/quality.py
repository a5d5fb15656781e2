"""Quality: logistic regression of hashed word n-grams, trained by follow-the-regularised-leader.

Features are hashed word unigrams and bigrams, and the same over word shapes (runs of capitals,
small letters, digits and signs), where a bigram also says whether its words are equal: texts are
full of words that no labelled row has.  A feature's value is its share of the text's words, times a
constant; a score is the sparse dot product with the weights.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cadaspark.llm.classify import fitted, scored, sigmoid, training_rows
from cadaspark.llm.common import documents, labels
from cadaspark.llm.words import coded_words, mix

BITS = 18
DIM = 1 << BITS
SCALE = 8.0
#: Labelled rows of each class that the model is fitted on at most.
MOST = 8000
MODULUS, HELD = 3, 1
EPOCHS, ALPHA, BETA, LASSO, RIDGE = 3, 0.3, 1.0, 0.05, 0.01

_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^aA0])\1+"), rb"\1\1")]


def shape(word: bytes) -> bytes:
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word[:8]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each place, (4, places), and each text's first place."""
    distinct, places, first = coded_words(texts)
    made = [np.fromiter((xxhash.xxh64_intdigest(x, seed=s) for x in xs), np.uint64, len(distinct)) for s, xs in ((1, distinct), (2, map(shape, distinct)))]
    out = []
    starts = np.zeros(len(places), bool)
    starts[first[:-1][first[:-1] < len(places)]] = True
    for each in made:
        now = each[places] if len(places) else np.zeros(0, np.uint64)
        before = np.append(now[:1] * 0, now[:-1])
        before[starts] = 0
        pair = now + before * np.uint64(0x9E3779B97F4A7C15)
        if each is made[1]:
            same = np.append(False, places[1:] == places[:-1]) & ~starts if len(places) else starts
            pair = pair + same.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out += [mix(now), mix(pair + np.uint64(11))]
    return (np.stack(out) >> np.uint64(64 - BITS)).astype(np.int32), first


def fit(texts: list[str], label: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights and, last, the intercept."""
    n = np.bincount(label, minlength=2)
    if not n.all():
        return np.append(np.zeros(DIM, np.float32), 4.0 if n[1] else -4.0)
    rows = []
    for at in range(0, len(texts), 500):
        f, first = features(texts[at : at + 500])
        for a, b in zip(first[:-1], first[1:], strict=True):
            idx, c = np.unique(f[:, a:b], return_counts=True)
            rows.append((idx, (SCALE / max(1, b - a) * c).astype(np.float32)))
    z, square, bias, bias_square = np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), 0.0, 1.0
    pull = n.sum() / (2 * n)  # both classes weigh the same
    order = np.random.default_rng(7)

    def weight(r: np.ndarray) -> np.ndarray:
        out = -(z[r] - np.sign(z[r]) * LASSO) / ((BETA + np.sqrt(square[r])) / ALPHA + RIDGE)
        out[np.abs(z[r]) <= LASSO] = 0
        return out

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            r, x = rows[i]
            w = weight(r)
            g = float(sigmoid(bias + w @ x) - label[i]) * pull[label[i]]
            step = g * x
            z[r] += step - (np.sqrt(square[r] + step * step) - np.sqrt(square[r])) / ALPHA * w
            square[r] += step * step
            bias_square += g * g
            bias -= ALPHA * g / bias_square**0.5
    return np.append(weight(np.arange(DIM)), np.float32(bias))


def score(texts: list[str], weights: np.ndarray) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    f, first = features(texts)
    per_place = np.append(weights[f].sum(axis=0, dtype=np.float64), 0.0)
    sums = np.add.reduceat(per_place, first[:-1])
    n = np.diff(first)
    return sigmoid(np.where(n > 0, SCALE * sums / np.maximum(n, 1), 0) + weights[-1])


def quality(docs: DataFrame, labelled: DataFrame, label: str = "quality", modulus: int = MODULUS, held: int = HELD, most: int = MOST) -> DataFrame:
    """A row a document: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows with ``crc32(doc_id as text) mod modulus`` other than ``held``, at most
    ``most`` of each class; without usable labels of one class every text gets the same score on the
    other side of 0.5.  Only the text is an input of a score; null counts as empty, and texts without
    words get the intercept's score.  Repeated rows get equal scores; an empty table gives an empty
    result; other columns are not read.
    """
    weights = fitted(training_rows(docs, labelled, label, modulus, held, most), fit)
    return scored(docs, weights, score, modulus, held)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))
