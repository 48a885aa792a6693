"""Toxicity by a linear-chain conditional random field over the words of a text.

Labels say only which documents are toxic, so words are labelled first: a word, or what it begins with,
that is frequent in toxic documents and next to absent from clean ones is a toxic word there; all
others are not. The field has two states; a word's score comes from hashed features of the word, its
beginnings and its end, and neighbouring states are tied by four transition scores. It is fitted by
gradient steps on the likelihood of labelled word runs, whose gradient are the marginals of the
forward-backward recursion.

A document is one chain. Its marginals give the offending words; their maximum and sum, put through a
logistic curve fitted on the sampled documents, give its score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import REMEMBERED_WORDS, WordHashes, byte_texts, ngram_hashes, portions, raw
from keytide.llm.labelled import in_fold, labelled_sample

BITS, RUN = 18, 24
#: Documents of each label from which the field is fitted.
CLEAN_ROWS, TOXIC_ROWS = 4000, 2500
#: A sign of toxicity is in this many sampled toxic documents, and this many times as frequent there.
SEEN, RATIO = 4, 25

_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def signs(word: bytes) -> list[bytes]:
    """Features of a word: itself, its beginnings, its end."""
    core = word.lower().strip(_EDGES)
    return [b"w" + core, *(b"p" + core[:n] for n in (3, 4, 5, 6) if len(core) > n), b"s" + core[-3:]]


def places(word: bytes) -> list[int]:
    return [xxhash.xxh64_intdigest(s) >> (64 - BITS) for s in signs(word)]


class Scores(dict):
    """Score of each remembered word."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = float(self.weights[places(word)].sum() + self.bias)
        return value


@dataclass
class Field:
    """State scores, transitions ``step[from, to]`` and the curve from marginals to a document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = -6.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of the toxic state at each place of each chain of word scores.

        All chains are worked on together, longest first, one place at a time; the recursions carry the
        ratio of the two states, which is all that the marginals need.
        """
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        lengths = np.array([len(chains[i]) for i in order], np.int64)
        result = [np.empty(0)] * len(chains)
        longest = int(lengths[0]) if len(lengths) else 0
        if not longest:
            return result
        flat = np.concatenate([chains[i] for i in order])
        starts = np.cumsum(lengths) - lengths
        alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # chains longer than t
        (a, b), (c, d) = np.exp(self.step)
        odds = np.exp(np.clip(flat, -30, 30))
        ahead, back = np.empty(len(flat)), np.empty(len(flat))
        ratio = np.empty(0)
        for t in range(longest):
            at = starts[: alive[t]] + t
            ratio = odds[at] * ((b + d * ratio[: alive[t]]) / (a + c * ratio[: alive[t]]) if t else 1.0)
            ahead[at] = ratio
        ratio = np.empty(0)
        for t in range(longest - 1, -1, -1):
            # Chains that end here start with equal messages; the others take one step back.
            at, more = starts[: alive[t]] + t, len(ratio)
            seen = odds[at[:more] + 1] * ratio
            ratio = np.concatenate([(c + d * seen) / (a + b * seen), np.ones(alive[t] - more)])
            back[at] = ratio
        both = ahead * back
        probabilities = both / (1 + both)
        for i, start, length in zip(order, starts, lengths):
            result[i] = probabilities[start : start + length]
        return result

    def document_inputs(self, marginals: np.ndarray) -> np.ndarray:
        most = float(marginals.max()) if len(marginals) else 0.0
        total = float(marginals.sum())
        return np.array([np.log((most + 1e-4) / (1 - most + 1e-4)), np.log1p(total), 1.0])

    def document_score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.document_inputs(marginals) @ self.curve, -40, 40))))


def _distinct(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Leave out near copies: texts that share their smallest or largest five-word hash with an earlier one."""
    hashes, seen, kept = WordHashes(), set(), []
    for text, label in rows:
        grams = ngram_hashes(hashes.of(text.lower().split()), 5)
        marks = {int(grams.min()), int(grams.max())} if len(grams) else {hash(text)}
        if not marks & seen:
            kept.append((text, label))
        seen |= marks
    return kept


def toxic_signs(rows: list[tuple[list[bytes], int]]) -> set[bytes]:
    """Words and beginnings that mark toxic documents."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    sizes = [1, 1]
    for words, label in rows:
        sizes[label] += 1
        found = {s for w in words for s in signs(w)[:-1] if len(s) > 3}
        counts[label].update(found)
    few, many = counts
    return {
        s for s, n in many.items() if n >= SEEN and n / sizes[1] > RATIO * (few[s] + 0.05) / sizes[0]
    }


def fit_field(rows: list[tuple[bytes, int]], weights: dict[int, float], epochs: int = 6, seed: int = 5) -> Field:
    """Label words, fit the field on runs of them, then the curve on whole documents."""
    model = Field()
    texts = [(t.split(), label) for t, label in _distinct(rows)]
    if len({label for _, label in texts}) < 2:
        share = (sum(v for _, v in rows) + 1) / (len(rows) + 2)
        model.curve = np.array([0.0, 0.0, np.log(share / (1 - share))])
        return model
    toxic = toxic_signs(texts)
    rng = np.random.default_rng(seed)
    runs: list[tuple[list[bytes], list[int]]] = []
    for words, label in texts:
        marks = [int(label == 1 and any(s in toxic for s in signs(w)[:-1])) for w in words]
        at = {i // RUN for i, m in enumerate(marks) if m} or {0}
        at |= {int(i) for i in rng.integers(0, len(words) // RUN + 1, 2)}
        runs += [(words[i * RUN : (i + 1) * RUN], marks[i * RUN : (i + 1) * RUN]) for i in sorted(at)]
    _fit_runs(model, [r for r in runs if r[0]], epochs, rng)
    scores = Scores(model.weights, model.bias)
    chains = [np.fromiter(map(scores.__getitem__, t.split()), float) for t, _ in rows]
    x = np.array([model.document_inputs(m) for m in model.marginals(chains)])
    y = np.array([v for _, v in rows], float)
    model.curve = _logistic(x, y, np.array([weights[v] for _, v in rows]))
    return model


def _fit_runs(model: Field, runs: list, epochs: int, rng: np.random.Generator) -> None:
    """Adaptive gradient steps on batches of runs; the padding of short runs is held in state 0."""
    width = len(signs(b"abcdefgh"))
    at = np.full((len(runs), RUN, width), 1 << BITS, np.int64)
    marks, there = np.zeros((len(runs), RUN), np.int64), np.zeros((len(runs), RUN), bool)
    known: dict[bytes, list[int]] = {}
    for i, (words, labels) in enumerate(runs):
        marks[i, : len(words)], there[i, : len(words)] = labels, True
        for j, word in enumerate(words):
            found = known.get(word) or known.setdefault(word, places(word))
            at[i, j, : len(found)] = found
    weights, squares = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    bias, step = np.array([-3.0]), np.zeros((2, 2))
    bias_squares, step_squares = np.full(1, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for part in (order[i : i + 128] for i in range(0, len(order), 128)):
            score = np.where(there[part], weights[at[part]].sum(2) + bias, -30.0)
            node, edge = _expectations(score, step)
            gold_edges = np.zeros_like(edge)
            pairs = there[part][:, 1:]
            gold = marks[part]
            np.add.at(gold_edges, (np.nonzero(pairs)[0], gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
            wrong = (node - gold) * there[part] / len(part)
            grad = np.zeros_like(weights)
            np.add.at(grad, at[part].reshape(-1), np.repeat(wrong.reshape(-1), width))
            grad[-1] = 0
            grad += 1e-6 * weights
            squares += grad * grad
            weights -= 0.3 * grad / np.sqrt(squares)
            bias_squares += wrong.sum() ** 2
            bias -= 0.1 * wrong.sum() / np.sqrt(bias_squares)
            inner = (edge - gold_edges).sum(0) / len(part) + 1e-4 * step
            step_squares += inner * inner
            step -= 0.1 * inner / np.sqrt(step_squares)
    model.weights, model.bias, model.step = weights[:-1], float(bias[0]), step


def _expectations(score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1, and expected transitions of each run, by the forward-backward recursion.

    ``score[run, place]`` is the score of state 1 over state 0.
    """
    runs, length = score.shape
    emit = np.exp(np.stack([np.zeros_like(score), np.clip(score, -30, 30)], 2))
    move = np.exp(step)
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    scale = np.empty((runs, length))
    for t in range(length):
        now = emit[:, t] * (ahead[:, t - 1] @ move if t else 1.0)
        scale[:, t] = now.sum(1)
        ahead[:, t] = now / scale[:, t, None]
    for t in range(length - 2, -1, -1):
        back[:, t] = (emit[:, t + 1] * back[:, t + 1]) @ move.T / scale[:, t + 1, None]
    node = ahead * back
    node /= node.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * move * (emit * back)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    pair *= (score[:, 1:] > -30)[:, :, None, None]
    return node[:, :, 1], pair.sum(1)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):  # damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        move = np.linalg.solve(hessian, x.T @ (weights * (p - y)) + 0.1 * w)
        w = w - move * min(1.0, 0.5 / max(1e-12, np.abs(move).max()))
    return w


def toxicity_model(docs: DataFrame, labels: DataFrame, label: str, held_out) -> Field:
    sample, weights = labelled_sample(docs, labels, label, held_out, {0: CLEAN_ROWS, 1: TOXIC_ROWS})
    rows = sorted(sample.select("doc_id", "label", "text").collect(), key=lambda r: r["doc_id"])
    return fit_field([(bytes(r["text"]), r["label"]) for r in rows], weights)


def offending(text: bytes, marginals: np.ndarray) -> str:
    """``start:end`` of the words more likely toxic than not, in code points, joined by commas."""
    at = set(np.flatnonzero(marginals >= 0.5).tolist())
    if not at:
        return ""
    found, done, chars = [], 0, 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i in at:
            chars += len(text[done : m.start()].decode("utf-8", "replace"))
            length = len(m[0].decode("utf-8", "replace"))
            found.append(f"{chars}:{chars + length}")
            chars, done = chars + length, m.end()
    return ",".join(found)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` per input row.

    ``spans`` are the offending words' ``start:end`` in code points. Labels are read only from rows whose
    crc32 of the id as text, modulo ``folds``, is not ``fold``; those that are are ``held_out``. Null and
    empty texts have no words, no spans and the score of a text without toxic words. A null id is not
    held out and teaches nothing. Repeated rows score alike; an empty table gives an empty result; without
    labels of both kinds all scores are equal. Other columns are not looked at.
    """
    model = toxicity_model(docs, labels, label, in_fold("doc_id", folds, fold))
    schema = "doc_id long, held_out boolean, score double, predicted int, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.weights, model.bias)
        for batch in batches:
            texts = byte_texts(batch, "text")
            values, spans = [], []
            for low, high in portions(texts, 16 << 20):
                words = [t.split() for t in texts[low:high]]
                chains = [np.fromiter(map(scores.__getitem__, w), float, len(w)) for w in words]
                marginals = model.marginals(chains)
                values += [model.document_score(m) for m in marginals]
                spans += [offending(t, m) for t, m in zip(texts[low:high], marginals)]
            score = np.array(values, float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32)),
                    pa.array(spans, pa.string()),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        in_fold("doc_id", folds, fold).alias("held_out"),
        raw("text").alias("text"),
    )
    return rows.mapInArrow(run, schema)
