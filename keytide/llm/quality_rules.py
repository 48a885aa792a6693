"""Quality rules: exact rule statistics, and isolation forests over their ratios.

The base rules reject short and repetitive texts. Two forests look at the statistics of the rest, one at how a text is
written and one at the lines and words it repeats (some repetition is common in clean texts, and in one forest
with the other features its rows would set the threshold for all), in steps of a tenth
(finer ones single out ordinary texts): random splits of small samples isolate unusual documents after few steps, so a short mean path marks
an anomaly. The score above which a document is rejected is calibrated on all labelled rows: at most
``clean_loss`` of the clean ones may score higher.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import WordHashes, bounded_sample, byte_texts, ngram_hashes, raw, slices, stage, task_memory

#: Rows from which the trees are grown.
SAMPLE_ROWS = 8192
TREES, LEAF_SAMPLE = 128, 256
MIN_WORDS, MAX_REPEATED = 20, 30

_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "upper", "marks", "word_length", "neighbours", "dup_lines", "repeat_words"]
#: Features of each forest: how a text is written, and what it repeats.
GROUPS = (slice(0, 5), slice(5, 7))
#: Words of an ordinary text that every feature is averaged with, so that short texts are no outliers.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_UPPER = 20, 5.7, 0.03
#: Lines of an ordinary text that the share of repeated lines is averaged with.
PRIOR_LINES = 4


def _without(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words inside windows that occur twice or more."""
    grams = ngram_hashes(ids, window)
    values, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    if len(values) == len(grams):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(text: bytes, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The rule statistics in the order of their columns, and the forest's features."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols, dup_lines = _without(text, _SYMBOLS), len(lines) - len(set(lines))
    ids = hashes.of(words)
    repeats = repeated_words(ids) if len(words) > 8 else 0
    n, letters = len(words) + PRIOR_WORDS, PRIOR_WORDS * 6
    features = [
        min(2.0, symbols / n),
        (_without(text, _UPPER) + PRIOR_UPPER * letters) / (_without(text, _LETTERS) + letters),
        min(2.0, _without(text, b"!?") / n),
        min(20.0, (chars + PRIOR_LENGTH * PRIOR_WORDS) / n) / 10,
        int(np.count_nonzero(ids[1:] == ids[:-1])) / n,
        dup_lines / (len(lines) + PRIOR_LINES),
        repeats / n,
    ]
    features = [round(f, 1) for f in features]
    return [len(words), chars, symbols, dup_lines, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


@dataclass
class Forest:
    """Trees as arrays of one length: split feature (-1 in a leaf), threshold, children, path length."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    limit: float = np.inf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over its expectation: near 1 for anomalies."""
        total = np.zeros(len(rows))
        for feature, threshold, left, path in zip(self.feature, self.threshold, self.left, self.path):
            node = np.zeros(len(rows), np.int64)
            while True:
                split = feature[node]
                go = np.flatnonzero(split >= 0)
                if not len(go):
                    break
                at = node[go]
                node[go] = left[at] + (rows[go, split[go]] >= threshold[at])
            total += path[node]
        return np.exp2(-total / (len(self.path) * self.norm))

    def rejects(self, rows: np.ndarray) -> np.ndarray:
        return self.scores(rows) > self.limit if len(rows) else np.zeros(0, bool)


@dataclass
class Forests:
    """One forest per group of features, each with its own limit."""

    parts: list[Forest]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([part.scores(rows[:, group]) for part, group in zip(self.parts, GROUPS)])

    def rejected(self, scores: np.ndarray) -> np.ndarray:
        return (scores > np.array([part.limit for part in self.parts])).any(1)


def _expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, seed: int = 7) -> Forest:
    """Isolation trees over samples of ``rows``; without rows, a forest that rejects nothing."""
    rng = np.random.default_rng(seed)
    size = min(LEAF_SAMPLE, len(rows))
    deepest = int(np.ceil(np.log2(max(2, size))))
    trees = []
    for _ in range(TREES):
        feature, threshold, left, path = [-1], [0.0], [0], [0.0]
        work = [(0, rows[rng.choice(len(rows), size, replace=False)] if size else rows, 0)]
        while work:
            node, part, depth = work.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            able = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(able):
                path[node] = depth + _expected_path(len(part))
                continue
            f = int(rng.choice(able))
            cut = rng.uniform(low[f], high[f])
            feature[node], threshold[node], left[node] = f, cut, len(feature)
            for side in (part[part[:, f] < cut], part[part[:, f] >= cut]):
                work.append((len(feature), side, depth + 1))
                for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (path, 0.0)):
                    column.append(empty)
        trees.append((feature, threshold, left, path))
    longest = max(len(t[0]) for t in trees)
    packed = [
        np.array([np.pad(np.array(t[i], kind), (0, longest - len(t[i]))) for t in trees])
        for i, kind in enumerate((np.int64, np.float64, np.int64, np.float64))
    ]
    return Forest(*packed, norm=max(1.0, _expected_path(size)))


def calibrate(
    forest: Forest, rows: np.ndarray, clean: np.ndarray, clean_loss: float, counts: np.ndarray | None = None
) -> Forest:
    """Set the limit so that at most ``clean_loss`` of the clean rows score above it.

    A row stands for ``counts`` rows, one by default. Without labelled rows of both kinds nothing is rejected.
    """
    forest.limit = np.inf
    if clean.any() and not clean.all():
        scores = forest.scores(rows[clean])
        order = np.argsort(scores)
        upto = np.cumsum(np.ones(len(scores), np.int64) if counts is None else counts[clean][order])
        rank = int(upto[-1]) - 1 - int(clean_loss * int(upto[-1]))
        forest.limit = float(scores[order[np.searchsorted(upto, rank, "right")]])
    return forest


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the five statistics, ``base_failed`` and the forest's features, one row per input row."""
    schema = f"doc_id long, {', '.join(n + ' long' for n in _NAMES)}, base_failed boolean, features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        with task_memory(hashes):
            for batch in (p for b in batches for p in slices(b, "text")):
                found = [statistics(t, hashes) for t in byte_texts(batch, "text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *(pa.array([s[i] for s, _ in found], pa.int64()) for i in range(len(_NAMES))),
                        pa.array([base_failed(s[0], s[4]) for s, _ in found], pa.bool_()),
                        pa.array([f for _, f in found], pa.list_(pa.float64())),
                    ],
                    ["doc_id", *_NAMES, "base_failed", "features"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    return rows.mapInArrow(run, schema)


def fit_forest(stats: DataFrame, labels: DataFrame, clean_loss: float = 0.005) -> Forests:
    """Grow the forests on a bounded sample and calibrate each on all labelled rows, for its part of the loss.

    ``labels`` has ``doc_id`` and ``quality`` (1 is clean). Rows that the base rules reject take no part. Labelled
    rows are counted per combination of features, of which there are few, as features are in tenths.
    """
    able = stats.filter("not base_failed").select("doc_id", "features")
    grown = [r["features"] for r in bounded_sample(able, SAMPLE_ROWS, "doc_id").collect()]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("clean")).dropna()
    known = able.join(known, "doc_id").groupBy("features", "clean").agg(F.count("*").alias("n")).collect()
    width = len(FEATURES)
    rows = np.array([r["features"] for r in known], float).reshape(-1, width)
    clean = np.array([r["clean"] for r in known], bool)
    counts = np.array([r["n"] for r in known], np.int64)
    grown_rows, loss = np.array(grown, float).reshape(-1, width), clean_loss / len(GROUPS)
    return Forests([calibrate(grow(grown_rows[:, g]), rows[:, g], clean, loss, counts) for g in GROUPS])


def quality_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", clean_loss: float = 0.005
) -> DataFrame:
    """Statistics and verdict per input row.

    Columns: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept`` and the anomaly ``score``, the higher one of the forests. Null and empty texts have no words and fail the
    base rules. Rows repeat as they come in; an empty table gives an empty result; without labels of both
    kinds only the base rules reject. Other columns are not looked at.
    """
    stats = stage(rule_statistics(docs, key, text), "rules")
    forest = fit_forest(stats, labels, clean_loss)
    schema = f"doc_id long, {', '.join(n + ' long' for n in _NAMES)}, base_failed boolean, kept boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = np.array(batch.column("features").flatten()).reshape(-1, len(FEATURES))
            scores = forest.scores(features)
            failed = np.array(batch.column("base_failed").to_pylist(), bool)
            kept = ~failed & ~forest.rejected(scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(kept), pa.array(scores.max(1))],
                [f.split()[0] for f in schema.split(", ")],
            )

    return stats.mapInArrow(run, schema)


def drop_low_quality(docs: DataFrame, labels: DataFrame, text: str = "text", clean_loss: float = 0.005) -> DataFrame:
    """``docs`` without the rows that the rules or the forest reject; all columns stay as they are."""
    stats = stage(rule_statistics(docs, "doc_id", text), "rules")
    forest = fit_forest(stats, labels, clean_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        with task_memory(hashes):
            for batch in (p for b in batches for p in slices(b, text)):
                found = [statistics(t, hashes) for t in byte_texts(batch, text)]
                failed = np.array([base_failed(s[0], s[4]) for s, _ in found], bool)
                odd = forest.rejected(forest.scores(np.array([f for _, f in found], float).reshape(-1, len(FEATURES))))
                yield batch.filter(pa.array(~(failed | odd)))

    return docs.mapInArrow(run, docs.schema)
