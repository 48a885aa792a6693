"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader.

Features are the distinct words and word pairs of a text, and runs of up to three word shapes (letter case,
digits, punctuation, whether a word repeats the one before), hashed into one table. A text's score is a
sparse dot product with the table. Training goes once over a bounded sample per epoch, one document at
a time, with per-coordinate rates and the L1 and L2 terms of the follow-the-regularised-leader update.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import REMEMBERED_WORDS, byte_texts, ngram_hashes, raw, scramble
from keytide.llm.labelled import in_fold, labelled_sample

BITS = 20
#: Documents of each label from which the model is fitted, and passes over them.
SAMPLE_ROWS, EPOCHS = 2500, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4

_RUNS = [(re.compile(rb"[A-Z]{2,}"), b"AA"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]


def shape(word: bytes) -> bytes:
    for pattern, short in _RUNS:
        word = pattern.sub(short, word)
    return word[:12]


class WordFeatures(dict):
    """Row of each remembered word in two tables: its hash and its shape's."""

    def __init__(self):
        self.words, self.shapes = np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.words):
            self.words, self.shapes = (np.concatenate([t, np.empty_like(t)]) for t in (self.words, self.shapes))
        self.words[at] = xxhash.xxh64_intdigest(word)
        self.shapes[at] = xxhash.xxh64_intdigest(shape(word), 1)
        self[word] = at
        return at

    def of(self, text: bytes) -> np.ndarray:
        """Distinct table places of a text's features, in order."""
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        words = text.split()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        ids, shapes = self.words[rows], self.shapes[rows]
        if len(rows) > 1:
            shapes[1:] ^= (ids[1:] == ids[:-1]).astype(np.uint64)
        grams = [scramble(ids), ngram_hashes(ids, 2), scramble(~shapes), ngram_hashes(~shapes, 2), ngram_hashes(~shapes, 3)]
        return np.unique((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass
class Model:
    """Weights of a logistic regression; a text without features gets the bias alone."""

    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray) -> float:
        total = self.bias
        if len(places):
            total += float(self.weights[places].sum()) / np.sqrt(len(places))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit(rows: list[tuple[np.ndarray, int, float]], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Follow-the-regularised-leader over ``(places, label, weight)``; place 0 of the state is the bias.

    Without rows, or with rows of one label only, every text scores that label's share.
    """
    labels = [label for _, label, _ in rows]
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full(len(z), L1)
    l1[0] = 0

    def leader(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            places, label, weight = rows[i]
            at = np.concatenate([[0], places + 1])
            x = np.full(len(at), 1 / np.sqrt(max(1, len(places))))
            x[0] = 1
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
            g = (p - label) * weight * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    final = leader(np.arange(len(z)))
    return Model(final[1:].astype(np.float32), float(final[0]))


def _training_rows(sample: DataFrame) -> list[tuple[np.ndarray, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = WordFeatures()
        for batch in batches:
            places = [features.of(t).tobytes() for t in byte_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places, pa.binary())], ["doc_id", "label", "places"]
            )

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, places binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(bytes(r["places"]), np.int32), r["label"]) for r in rows]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, held_out) -> Model:
    sample, weights = labelled_sample(docs, labels, label, held_out, {0: SAMPLE_ROWS, 1: SAMPLE_ROWS})
    least = min((w for w in weights.values() if w), default=1.0)
    # Square roots keep a rare label from being drowned while its share still counts.
    return fit([(p, v, float(np.sqrt(max(1.0, weights[v] / least)))) for p, v in _training_rows(sample)])


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per input row.

    Labels are read only from rows whose crc32 of the id as text, modulo ``folds``, is not ``fold``; those that are
    are ``held_out``. Null and empty texts have no features and score the bias. A null id is not held out and
    learns nothing. Repeated rows score alike; an empty table gives an empty result; without labels of both
    kinds all scores are equal. Other columns are not looked at.
    """
    model = fit_quality(docs, labels, label, in_fold("doc_id", folds, fold))
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = WordFeatures()
        for batch in batches:
            scores = np.array([model.score(features.of(t)) for t in byte_texts(batch, "text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))],
                [f.split()[0] for f in schema.split(", ")],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        in_fold("doc_id", folds, fold).alias("held_out"),
        raw("text").alias("text"),
    )
    return rows.mapInArrow(run, schema)
