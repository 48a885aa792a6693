"""Secret scanning: exact patterns, and a character convolutional network over all other runs.

Every run of token characters is a candidate, whatever its length and characters. Runs that a pattern covers are the
labelled findings; each is also shown bare, without its key name or prefix and in other spellings, so that the
network learns the secret and not only what names it. Of the others, those that look like a secret themselves are no
counter-examples. Each distinct run of the table counts once, with the text around one of its places; a fifth of the
runs is held out. All the others train a small network: character embeddings (other ones inside the run than around
it), a convolution, the maximum over all places, a logistic output per kind of finding. Shards of the runs are trained
on side by side from common weights, whose mean is the next start; every run is taken ``PASSES`` times or more. The
threshold of an output is the highest that keeps ``MIN_RECALL`` of all held-out findings of its kind. A kind adds
nothing if fewer than ``MIN_HELD`` of its findings are held out, or if its threshold lets more than ``MAX_ALARMS`` of
all held-out counter-examples pass. The network scores every run no pattern covers that looks like a secret, long ones
over their whole length; one output above its threshold is enough. It adds spans, it removes none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import byte_texts, portions, raw, remove, scramble, slices, stage, task_memory, tidy

KINDS = ["assign", "access", "hex", "model"]
_KINDS = 3  # those of the patterns
#: Runs about which a shard has; times the weights of the shards are averaged; times a run is learnt from at least.
SHARD_ROWS, TURNS, PASSES = 1 << 16, 12, 2
#: Counter-examples of a shard that a turn takes at least, if there are so many.
_TURN_ROWS = 8000
#: Findings and counter-examples that a step of training looks at.
_FOUND, _OTHERS = 32, 96
#: Logits are counted in steps of ``1 / _FINE`` up to ``_BINS / 2`` steps from 0.
_FINE, _BINS = 64, 1 << 13
#: Distinct runs a task gathers before it hands them on.
_GATHERED = 200_000
CANDIDATE, MIN_RECALL = 12, 0.98  # characters of a run that can look like a secret; recall on held-out findings
#: Held-out findings that a kind needs, and share of held-out counter-examples that it may accept.
MIN_HELD, MAX_ALARMS = 20, 2e-4
LEFT, CORE, RIGHT = 16, 48, 8
_SIZE = LEFT + CORE + RIGHT
_EMBED, _WIDTH, _FILTERS = 8, 5, 16
_CODES = 129  # ASCII, and one code for all other characters
#: Places scored at a time, and bytes of text laid out at a time.
_BLOCK, _PORTION = 1 << 15, 1 << 20

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")


def _mask(members: bytes) -> bytes:
    return bytes(0x78 if b in members else 0x20 for b in range(256))


_HEX_MASK = _mask(b"0123456789abcdef")
_MEMBER = np.array([chr(c) in "+/_.=-" or c < 128 and chr(c).isalnum() for c in range(_CODES)])
#: Kinds of characters: digit, capital, small letter, none of them.
_SORT = np.array([0 if c in range(0x30, 0x3A) else 1 if c in range(0x41, 0x5B) else 2 if c in range(0x61, 0x7B) else 3 for c in range(_CODES)])
_PRIME = 0x9E3779B97F4A7C15
_MARKS = scramble(np.arange(1, _CODES + 1, dtype=np.uint64))
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: bytes) -> list[Span]:
    """What the patterns find, by start and kind, in code points."""
    found: list[Span] = []
    decoded = None
    if b":" in text or b"=" in text:
        decoded = text.decode("utf-8", "replace")
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(decoded) if len(m[2]) >= 12]
    if b"AKIA" in text:
        decoded = decoded or text.decode("utf-8", "replace")
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(decoded) if m.end() - m.start() >= 18]
    if b"x" * 16 in text.translate(_HEX_MASK):
        decoded = decoded or text.decode("utf-8", "replace")
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(decoded)]
    return sorted(found)


def looks_secret(run: str) -> bool:
    """Whether a part of a run changes between small and capital letters and digits as random characters do."""
    for part in re.split(r"[./=_+-]", run) if run else ():
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in part]
        if len(part) >= CANDIDATE and 4 * sum(a != b for a, b in zip(kinds, kinds[1:])) >= len(part):
            return True
    return False


@dataclass
class Runs:
    """Texts as character codes, one after the other with zeros between, and all their runs."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    offsets: np.ndarray
    kinds: np.ndarray  # of the first base span that overlaps, or -1

    @staticmethod
    def of(texts: list[str], base: list[list[Span]]) -> Runs:
        gap = np.zeros(LEFT + RIGHT, np.uint32)
        parts, offsets, at = [gap], [], len(gap)
        for text in texts:
            parts += [np.frombuffer(text.encode("utf-32-le"), np.uint32), gap]
            offsets.append(at)
            at += len(text) + len(gap)
        codes = np.minimum(np.concatenate(parts), _CODES - 1).astype(np.int64)
        edges = np.flatnonzero(np.diff(_MEMBER[codes].view(np.int8))) + 1
        starts, ends, places = edges[::2], edges[1::2], np.array(offsets, np.int64)
        kinds = np.full(len(starts), -1)
        for offset, spans in zip(offsets, base):
            for start, kind, end in spans:
                part = slice(np.searchsorted(ends, start + offset, "right"), np.searchsorted(starts, end + offset))
                kinds[part] = np.where(kinds[part] < 0, kind, kinds[part])
        return Runs(codes, starts, ends, np.searchsorted(places, starts, "right") - 1, places, kinds)

    def secret(self) -> np.ndarray:
        """What ``looks_secret`` says of each run."""
        sorts = _SORT[self.codes]
        edges = np.flatnonzero(np.diff((sorts < 3).view(np.int8))) + 1
        first, last = edges[::2], edges[1::2]
        changes = np.concatenate([[0], np.cumsum(sorts[1:] != sorts[:-1])])
        like = (last - first >= CANDIDATE) & (4 * (changes[last - 1] - changes[first]) >= last - first)
        found = np.zeros(len(self.starts), bool)
        found[np.searchsorted(self.starts, first[like], "right") - 1] = True
        return found

    def hashes(self) -> np.ndarray:
        """A hash of the characters of each run."""
        powers = np.cumprod(np.full(len(self.codes), _PRIME, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_MARKS[self.codes] * powers)])
        back = np.cumprod(np.full(len(self.codes), pow(_PRIME, -1, 1 << 64), np.uint64))
        return scramble((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, some: np.ndarray) -> np.ndarray:
        """Codes of the windows of some runs."""
        starts, ends = self.starts[some][:, None], self.ends[some][:, None]
        core = starts + np.arange(CORE)
        core = np.where(core < ends, self.codes[np.minimum(core, len(self.codes) - 1)], 0)
        parts = [self.codes[starts + np.arange(-LEFT, 0)], core, self.codes[ends + np.arange(RIGHT)]]
        return np.concatenate(parts, 1).astype(np.uint8)

    def alone(self, some: np.ndarray) -> Runs:
        """Some runs with no more text than what is around them."""
        sizes = self.ends[some] - self.starts[some] + LEFT + RIGHT
        at = np.cumsum(sizes) - sizes
        place = np.repeat(self.starts[some] - LEFT - at, sizes) + np.arange(sizes.sum())
        starts = at + LEFT
        ends = starts + sizes - LEFT - RIGHT
        return Runs(self.codes[place], starts, ends, self.owner[some], self.offsets, self.kinds[some])


def window(left: str, core: str, right: str) -> str:
    return left[-LEFT:].rjust(LEFT, "\0") + core[:CORE].ljust(CORE, "\0") + right[:RIGHT].ljust(RIGHT, "\0")


def windows(text: str, start: int, end: int) -> list[str]:
    """The run with what surrounds it; of a long one its head."""
    return [window(text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT])]


def bare_windows(text: str, span: Span) -> list[str]:
    """A finding without the key name or prefix by which its pattern knows it, hexadecimal ones in other spellings too.

    The same bytes in capital hexadecimal digits or base64 are as secret, but no pattern would have labelled them.
    """
    start, kind, end = span
    value = _ASSIGN.match(text, start)[2] if kind == 0 else text[start + 4 : end] if kind == 1 else text[start:end]
    values = [value] if kind < 2 else []
    if _HEX.fullmatch(value) and looks_secret(value):
        values += [value.upper(), base64.b64encode(bytes.fromhex(value[: len(value) // 2 * 2])).decode()]
    return [window(text[max(0, start - LEFT) : start], v, text[end : end + RIGHT]) for v in values]


def coded(rows: list[str]) -> np.ndarray:
    """Character codes of windows."""
    codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).reshape(-1, _SIZE)
    return np.minimum(codes, _CODES - 1).astype(np.uint8)


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of windows, what is right of a short run moved up to it, and the places that windows have."""
    codes = rows.astype(np.int64)
    core = np.count_nonzero(codes[:, LEFT : LEFT + CORE], axis=1)[:, None]
    codes[:, LEFT : LEFT + CORE] += _CODES
    place = np.arange(_SIZE)
    moved = np.minimum(np.where(place < LEFT + core, place, place + CORE - core), _SIZE - 1)
    return np.take_along_axis(codes, moved, 1), place[: _SIZE - _WIDTH + 1] <= LEFT + core + RIGHT - _WIDTH


_SHAPES = {
    "embed": (2 * _CODES, _EMBED),
    "conv": (_WIDTH * _EMBED, _FILTERS),
    "bias": (_FILTERS,),
    "out": (_FILTERS, _KINDS),
    "out_bias": (_KINDS,),
}


@dataclass
class CharNetwork:
    """Weights, and threshold of the logit per kind; untrained it accepts nothing."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(_KINDS, np.inf))

    def _forward(self, codes: np.ndarray, there: np.ndarray) -> tuple:
        w = self.weights
        places = np.lib.stride_tricks.sliding_window_view(w["embed"][codes], _WIDTH, axis=1)
        flat = np.ascontiguousarray(places.transpose(0, 1, 3, 2)).reshape(len(codes), -1, _WIDTH * _EMBED)
        out = np.where(there[:, :, None], flat @ w["conv"] + w["bias"], np.float32(-1))
        top = out.argmax(1)
        peak = np.maximum(np.take_along_axis(out, top[:, None, :], 1)[:, 0, :], 0)
        return flat, top, peak, peak @ w["out"] + w["out_bias"]

    def logits(self, rows: list[str] | np.ndarray) -> np.ndarray:
        codes = rows if isinstance(rows, np.ndarray) else coded(rows)
        parts = [self._forward(*encode(codes[i : i + 512]))[-1] for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros((0, _KINDS))

    def counts(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """How often each step of each kind's logit is there, among findings of the kind and among counter-examples."""
        out = np.zeros((_KINDS, 2, _BINS), np.int64)
        steps = np.floor(self.logits(codes) * _FINE).astype(np.int64) + _BINS // 2
        steps = np.clip(steps, 0, _BINS - 1)
        for kind in range(_KINDS):
            for side, some in enumerate((kinds == kind, kinds < 0)):
                out[kind, side] += np.bincount(steps[some, kind], minlength=_BINS)
        return out

    def settle(self, counts: np.ndarray) -> None:
        """Set each kind's highest threshold with enough recall, if that is safe."""
        for kind, sides in enumerate(counts):
            found, alarms = (np.cumsum(side[::-1])[::-1] for side in sides)
            if found[0] < MIN_HELD:
                continue
            step = int(np.flatnonzero(found >= MIN_RECALL * found[0])[-1])
            if step and alarms[step] <= MAX_ALARMS * alarms[0]:
                self.thresholds[kind] = (step - _BINS // 2) / _FINE

    def accepts(self, runs: Runs) -> np.ndarray:
        """Which runs are secrets; the same numbers as from their windows, without making these."""
        if not self.weights or not len(runs.starts):
            return np.zeros(len(runs.starts), bool)
        peak = self._peaks(runs.codes, runs.starts, runs.ends)
        return (peak @ self.weights["out"] + self.weights["out_bias"] >= self.thresholds).any(1)

    def _peaks(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        w = self.weights
        table = np.stack([w["embed"] @ w["conv"][j * _EMBED : (j + 1) * _EMBED] for j in range(_WIDTH)])
        table[0] += w["bias"]
        peak = np.zeros((len(starts), _FILTERS), np.float32)

        def convolved(near: np.ndarray) -> np.ndarray:
            total = table[0].take(near[: len(near) - _WIDTH + 1], 0, mode="clip")
            for j in range(1, _WIDTH):
                total += table[j].take(near[j : len(near) - _WIDTH + 1 + j], 0, mode="clip")
            return total

        def raise_to(part: slice | np.ndarray, values: np.ndarray) -> None:
            peak[part] = np.maximum(peak[part], values)

        for low in range(0, len(codes), _BLOCK):  # places around runs and places inside them
            high = min(len(codes), low + _BLOCK)
            near = np.pad(codes[low : high + LEFT], (0, low + _BLOCK + LEFT - min(len(codes), high + LEFT)))
            around = convolved(near)
            two = np.maximum(around[:-1], around[1:])
            four = np.maximum(two[:-2], two[2:])
            twelve = np.maximum(np.maximum(four[:-8], four[4:-4]), four[8:])
            part = slice(*np.searchsorted(starts - LEFT, [low, high]))
            raise_to(part, twelve[starts[part] - LEFT - low])
            part = slice(*np.searchsorted(ends, [low, high]))
            raise_to(part, four[ends[part] - low])
            inside = convolved(near + _CODES)
            part = np.arange(np.searchsorted(ends, low + _WIDTH), np.searchsorted(starts, high))
            first, last = np.maximum(starts[part], low) - low, np.minimum(ends[part] - _WIDTH + 1, high) - low
            part, first, last = (x[last > first] for x in (part, first, last))
            if len(part):
                raise_to(part, np.maximum.reduceat(inside, np.column_stack([first, last]).ravel())[::2])
        for low in range(0, len(starts), _BLOCK // 8):  # places across an end of a run
            part = slice(low, low + _BLOCK // 8)
            start, end = starts[part], ends[part]
            for first in (start, end):
                near = np.stack([first + i for i in range(1 - _WIDTH, _WIDTH - 1)])
                near = codes[near] + _CODES * ((near >= start) & (near < end))
                for k in range(_WIDTH - 1):
                    total = table[0].take(near[k], 0, mode="clip")
                    for j in range(1, _WIDTH):
                        total += table[j].take(near[k + j], 0, mode="clip")
                    raise_to(part, total)
        return peak


@dataclass
class Training:
    """Weights, their running means (Adam) and the steps made."""

    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    @staticmethod
    def start(seed: int = 11) -> Training:
        rng = np.random.default_rng(seed)
        weights = {k: (0.3 * rng.standard_normal(s)).astype(np.float32) for k, s in _SHAPES.items()}
        return Training(weights, *({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2)))

    def flat(self) -> np.ndarray:
        parts = [v.ravel() for d in (self.weights, self.first, self.second) for v in d.values()]
        return np.concatenate([*parts, [self.step]]).astype(np.float64)

    @staticmethod
    def of(flat: np.ndarray) -> Training:
        out, at = [], 0
        for _ in range(3):
            out.append({})
            for k, shape in _SHAPES.items():
                size = int(np.prod(shape))
                out[-1][k] = flat[at : at + size].reshape(shape).astype(np.float32)
                at += size
        return Training(*out, step=int(round(flat[at])))

    def turn(self, codes: np.ndarray, kinds: np.ndarray, turn: int, seed: int = 0) -> int:
        """Learn from all findings of a shard and the turn's part of its counter-examples; how many rows that were."""
        found, others = np.flatnonzero(kinds >= 0), np.flatnonzero(kinds < 0)
        size = min(len(others), max(_TURN_ROWS, len(others) * PASSES // TURNS + 1))
        others = np.random.default_rng([seed, 1]).permutation(others)
        others = others.take(np.arange(turn * size, (turn + 1) * size), mode="wrap") if size else others
        rng = np.random.default_rng([seed, 2, turn])
        steps = max(-(-len(found) // _FOUND), -(-size // _OTHERS))
        sides = []
        for side, share in ((found, _FOUND), (others, _OTHERS)):
            rounds = -(-steps * share // len(side)) if len(side) else 0
            sides.append(np.concatenate([side[:0], *(rng.permutation(side) for _ in range(rounds))]))
        for i in range(steps):
            part = np.concatenate([s[i * n : (i + 1) * n] for s, n in zip(sides, (_FOUND, _OTHERS))])
            self._learn(codes[part], kinds[part], rng)
        return len(found) + size

    def _learn(self, codes: np.ndarray, kinds: np.ndarray, rng: np.random.Generator) -> None:
        """A step. Half of the windows get the text around another one, as the run itself is to be known."""
        mixed, other = np.flatnonzero(rng.random(len(codes)) < 0.5), rng.permutation(len(codes))
        around = np.r_[:LEFT, LEFT + CORE : _SIZE]
        lent = codes[other[mixed]][:, around]
        codes = codes.copy()
        codes[mixed[:, None], around] = lent
        codes, there = encode(codes)
        w = self.weights
        labels = (kinds[:, None] == np.arange(_KINDS)).astype(np.float32)
        asked = (labels > 0) | (kinds[:, None] < 0)  # a finding says nothing about the other kinds
        flat, top, peak, logit = CharNetwork(w)._forward(codes, there)
        wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * asked / len(codes)
        back = (wrong @ w["out"].T) * (peak > 0)
        chosen = np.take_along_axis(flat, top[:, :, None], 1)
        grads = {
            "out": peak.T @ wrong,
            "out_bias": wrong.sum(0),
            "bias": back.sum(0),
            "conv": np.einsum("nfd,nf->df", chosen, back),
            "embed": np.zeros_like(w["embed"]),
        }
        inward = np.einsum("nf,df->nfd", back, w["conv"]).reshape(len(codes), _FILTERS, _WIDTH, _EMBED)
        at = codes[np.arange(len(codes))[:, None, None], top[:, :, None] + np.arange(_WIDTH)]
        np.add.at(grads["embed"], at, inward)
        self.step += 1
        rate = 0.01 * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            w[k] -= (rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(np.float32)


def _enough(kinds: np.ndarray, held: np.ndarray) -> bool:
    return min(np.count_nonzero(((kinds >= 0) == a) & (held == b)) for a in (True, False) for b in (True, False)) >= 5


def train(found: list[tuple[str, int]], further: list[str] = ()) -> CharNetwork:
    """Fit on labelled windows ``(window, kind)``, kind -1 for counter-examples, as one shard; a fifth is held out.

    ``further`` are counter-examples that are held out as well.
    """
    rows = [*found, *((w, -1) for w in further)]
    codes, kinds = coded([w for w, _ in rows]), np.maximum(-1, np.array([k for _, k in rows], int))
    held = np.array([hashlib.md5(w.encode("utf-8", "replace")).digest()[0] % 5 == 0 for w, _ in rows], bool)
    held[len(found) :] = True
    if not _enough(kinds, held):
        return CharNetwork()
    training = Training.start()
    for turn in range(TURNS):
        training.turn(codes[~held], kinds[~held], turn)
    network = CharNetwork(training.weights)
    network.settle(network.counts(codes[held], kinds[held]))
    return network


def labelled_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``key, run, kind, rank, window`` of findings, once for each of their windows, and of distinct counter-examples.

    ``run`` is a hash of a run and ``key`` one of what counts once: of the run, or of a finding's window. Of a
    counter-example's places that with the smallest rank, a hash of its text and place, gives the window.
    """
    base = [base_spans(t) for t in texts]
    decoded = [t.decode("utf-8", "replace") for t in texts]
    runs = Runs.of(decoded, base)
    names = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    places = runs.starts - runs.offsets[runs.owner] if len(runs.starts) else runs.starts
    ranks, hashes = scramble(names[runs.owner] + places.astype(np.uint64)), runs.hashes()
    others = np.flatnonzero((runs.kinds < 0) & ~runs.secret())
    others = others[_firsts(hashes[others], ranks[others])]
    made: list[tuple[str, int, int]] = []
    for i in np.flatnonzero(runs.kinds >= 0).tolist():
        text, start, kind = decoded[runs.owner[i]], int(places[i]), int(runs.kinds[i])
        end = start + int(runs.ends[i] - runs.starts[i])
        span = next(s for s in base[runs.owner[i]] if s[0] < end and start < s[2])
        if kind == 0 and end <= _ASSIGN.match(text, span[0]).start(2):
            continue  # the key name by itself
        made += [(w, kind, i) for w in (windows(text, start, end)[0], *bare_windows(text, span))]
    at = np.array([i for *_, i in made], np.int64)
    shown = coded([w for w, *_ in made])
    keys = np.array([xxhash.xxh64_intdigest(w.tobytes()) for w in shown], np.uint64)
    return (
        np.concatenate([keys, hashes[others]]),
        np.concatenate([hashes[at], hashes[others]]),
        np.concatenate([[k for _, k, _ in made], np.full(len(others), -1)]).astype(np.int32),
        np.concatenate([ranks[at], ranks[others]]),
        np.concatenate([shown, runs.windows(others)]),
    )


def _firsts(keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of the smallest rank of every key."""
    order = np.lexsort((ranks, keys))
    ordered = keys[order]
    return order[np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(order)])]


def distinct_runs(docs: DataFrame, text: str) -> DataFrame:
    """``key, run, kind, window``: every distinct window of a finding and every distinct counter-example of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = labelled_runs([])
        with task_memory():
            for part in (p for batch in batches for p in slices(batch, "text", _PORTION)):
                kept = tuple(np.concatenate(x) for x in zip(kept, labelled_runs(byte_texts(part, "text"))))
                some = _firsts(kept[0] ^ kept[2].astype(np.uint64), kept[3])
                kept = tuple(x[some] for x in kept)
                if len(kept[0]) > _GATHERED:
                    yield packed(*kept)
                    kept = labelled_runs([])
            yield packed(*kept)
            kept = labelled_runs([])

    def packed(keys, hashes, kinds, ranks, shown) -> pa.RecordBatch:
        blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_SIZE), len(shown), [None, pa.py_buffer(shown.tobytes())])
        numbers = [pa.array(x.view(np.int64)) for x in (keys, hashes)]
        columns = [*numbers, pa.array(kinds), pa.array(ranks.view(np.int64)), blob.cast(pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "run", "kind", "rank", "window"])

    rows = docs.select(raw(text).alias("text"))
    rows = rows.mapInArrow(run, "key long, run long, kind int, rank long, window binary")
    first = F.min(F.struct("rank", "window", "run")).alias("first")
    rows = rows.groupBy("key", "kind").agg(first)
    return rows.select("key", "kind", F.col("first.run").alias("run"), F.col("first.window").alias("window"))


def _shards(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, windows, kinds``: the rows dealt out by hash, each shard as one row."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("kind", "ascending")])
        shard, kinds = table.column("shard")[0].as_py(), table.column("kind").to_numpy().astype(np.int8)
        row = {"shard": shard, "windows": b"".join(table.column("window").to_pylist()), "kinds": kinds.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("windows", pa.binary()), ("kinds", pa.binary())]))

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    rows = rows.select("key", "kind", "window", shard)
    return rows.groupBy("shard").applyInArrow(pack, "shard int, windows binary, kinds binary")


def _turn(shards: DataFrame, training: Training, turn: int) -> Training:
    """What the shards learn from the same weights, averaged by the rows they saw."""
    start = training.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(start)), 0
        for batch in batches:
            for row in batch.to_pylist():
                learner = Training.of(start)
                codes = np.frombuffer(row["windows"], np.uint8).reshape(-1, _SIZE)
                seen = learner.turn(codes, np.frombuffer(row["kinds"], np.int8).astype(int), turn, row["shard"])
                total += seen * learner.flat()
                rows += seen
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["rows", "total"])

    rows, total = 0, np.zeros(len(start))
    for part in shards.mapInArrow(run, "rows long, total binary").collect():  # a short row per task
        rows, total = rows + part["rows"], total + np.frombuffer(part["total"])
    return Training.of(total / rows)


def _held_counts(held: DataFrame, network: CharNetwork) -> np.ndarray:
    """The counts of the logits of all held-out rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((_KINDS, 2, _BINS), np.int64)
        for batch in batches:
            kinds, rows = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            counts += network.counts(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, _SIZE), kinds)
        flat = counts.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["place", "n"])

    counts = np.zeros(_KINDS * 2 * _BINS, np.int64)
    found = held.select("kind", "window").mapInArrow(run, "place long, n long")
    for place, n in found.groupBy("place").agg(F.sum("n")).collect():
        counts[place] = n
    return counts.reshape(_KINDS, 2, _BINS)


def fit_network(docs: DataFrame, text: str = "text") -> CharNetwork:
    """Train on every distinct finding and counter-example but a fifth, which sets the thresholds."""
    rows = stage(distinct_runs(docs, text), "runs")
    held = F.pmod(F.xxhash64("run"), F.lit(5)) == 0
    sizes = {(r["found"], r["held"]): r["count"] for r in rows.groupBy((F.col("kind") >= 0).alias("found"), held.alias("held")).count().collect()}
    network = CharNetwork()
    if min(sizes.get((a, b), 0) for a in (True, False) for b in (True, False)) >= 5:
        learnt = sizes[True, False] + sizes[False, False]
        shards = stage(_shards(rows.filter(~held), -(-learnt // SHARD_ROWS)), "shards")
        training = Training.start()
        for turn in range(TURNS):
            training = _turn(shards, training, turn)
        network = CharNetwork(training.weights)
        network.settle(_held_counts(rows.filter(held), network))
        remove(shards)
    remove(rows)
    return network


def all_spans(texts: list[bytes], network: CharNetwork) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans with those the network adds, of each text."""
    found = []
    for low, high in portions(texts, _PORTION):
        base = [base_spans(t) for t in texts[low:high]]
        added: list[list[Span]] = [[] for _ in base]
        if network.weights:
            decoded = [t.decode("utf-8", "replace") for t in texts[low:high]]
            runs = Runs.of(decoded, base)
            able = np.flatnonzero((runs.kinds < 0) & runs.secret())
            for i in able[network.accepts(runs.alone(able))].tolist():
                owner = int(runs.owner[i])
                start, end = (int(x[i] - runs.offsets[owner]) for x in (runs.starts, runs.ends))
                added[owner].append((start, 3, end))
        found += [(b, sorted(b + a)) for b, a in zip(base, added)]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets in every whole text, one row per input row.

    Columns: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_model``, ``base_sha256`` and ``spans``
    (``kind:start:end`` by start and kind, in code points, end exclusive). Null and empty texts have no
    spans. Repeated rows come back as they go in; an empty table gives an empty result; with too few
    labelled findings the network adds nothing. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    network = fit_network(docs, text)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, "text")):
            found = all_spans(byte_texts(batch, "text"), network)
            counts = [[sum(s[1] == k for s in spans) for _, spans in found] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([joined(s) for _, s in found], pa.string()),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    return rows.mapInArrow(run, schema)


def redacted(text: bytes, spans: list[Span], mark: str) -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    decoded, parts, reach = text.decode("utf-8", "replace"), [], 0
    for start, _, end in spans:
        if start >= reach:
            parts += [decoded[reach:start], mark]
        reach = max(reach, end)
    return "".join([*parts, decoded[reach:]])


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; ``n_chars``, if there, follows. No row goes."""
    network = fit_network(docs, text)
    sized = [f for f in docs.schema if f.name == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, text)):
            texts = byte_texts(batch, text)
            found = [spans for _, spans in all_spans(texts, network)]
            place = batch.schema.get_field_index(text)
            column = batch.column(place).to_pylist()
            new = [redacted(t, s, mark) if s else c for t, s, c in zip(texts, found, column)]
            batch = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
            if sized:
                place = batch.schema.get_field_index("n_chars")
                old = batch.column(place).to_pylist()
                new = [len(n) if s else o for n, s, o in zip(new, found, old)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
            yield batch

    return docs.mapInArrow(tidy(run), docs.schema)
