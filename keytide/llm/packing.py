"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only the number of pieces of each length matters for a packing, and lengths are at most the
capacity, so the plan is made from that small table whatever the number of documents:

* full pieces are sequences by themselves;
* dominance reduction: if a small set that contains the largest piece can take the place of any other set
  with it, as many such sequences as the counts allow are fixed: a piece nothing fits with; a pair
  that fills the sequence, or whose partner outweighs every pair that fits; a triple whose parts are
  each the largest possible where no fourth piece fits;
* what remains goes, longest first, to the sequence with the least room that holds it.

Sequences with equal contents are kept as one entry with a count. Each piece then finds its place from its
rank among the pieces of its length, which is counted in parts, so no length is gathered in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.common import byte_texts, raw, scramble, slices, stage, task_memory

CAPACITY = 2048
#: Pieces of one length that are ranked by one task, on average at most.
RANKED_TOGETHER = 500_000
#: Parts whose ids one Python worker remembers, some 40 bytes each; beyond it the memory starts anew.
REMEMBERED_CHUNKS = 1_000_000
#: Bytes of text encoded together; the arrays for that take some 50 bytes for each.
_PORTION = 1 << 20


class Powers:
    """Powers of an odd number modulo 2 to the 64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.values = np.uint64(base), np.empty(0, np.uint64)

    def up_to(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(n + n // 4, self.base)
            steps[:1] = 1
            self.values = np.cumprod(steps)
        return self.values[:n]


_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = Powers(_BASE), Powers(pow(_BASE, -1, 1 << 64))
_BYTES = scramble(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


class ChunkTokens:
    """Token ids of texts, from the ids of their parts between white space.

    The tokenizer drops white space and its words never reach across it, so the ids of a text are
    those of its parts one after the other; a full stop or comma after a letter at a part's end is a part
    of its own. Parts are told apart by 64-bit hashes, taken of all parts of many texts at once, and
    each distinct one is encoded once while remembered. Parts of plain letters go straight to the
    tokenizer's model, all others through the whole tokenizer, as do texts that may hold special tokens.
    """

    _SIMPLE = re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        shape = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xE0, 0x100) if c != 0xF7]
        self.table = {ord(c): shape.pre_tokenize_str(c)[0][0] for c in letters}
        self._forget()
        self.direct = self._agrees()

    def _agrees(self) -> bool:
        """Whether the short ways give what the tokenizer gives, tried on words with all their letters."""
        letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xE0, 0x100)] if c != 0xF7]
        words = ["".join(letters[i:] + letters[:i]) for i in range(len(letters))] + letters
        plain = self._whole([f" {w}.\n{w}, " for w in words])
        stop, comma = self._whole([".", ","])
        return plain == [self._word(w) + stop + self._word(w) + comma for w in words]

    def _forget(self) -> None:
        """Start with the full stop and the comma as parts 0 and 1."""
        self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self._keep(self._whole([".", ","]))

    def _keep(self, new: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def _word(self, word: str) -> list[int]:
        mapped = word if word.isascii() else word.translate(self.table)
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def _whole(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        words = b"\n".join(parts).decode("utf-8", "replace").lower().split("\n")
        simple = [self.direct and bool(self._SIMPLE.fullmatch(w)) for w in words]
        other = iter(self._whole([p.decode("utf-8", "replace") for p, s in zip(parts, simple) if not s]))
        at = len(self.lengths) + np.arange(len(parts))
        self._keep([self._word(w) if s else next(other) for w, s in zip(words, simple)])
        known, place = np.concatenate([self.known, hashes]), np.concatenate([self.place, at])
        order = np.argsort(known)
        self.known, self.place = known[order], place[order]

    def _parts(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the parts of ``data``; where chunks between white space start, and with which part."""
        buf = np.frombuffer(data, np.uint8)
        space = _SPACE[buf]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, ends = edges[0::2], edges[1::2]
        last, before = buf[ends - 1], buf[np.maximum(ends - 2, starts)]
        tail = ((last == 0x2E) | (last == 0x2C)) & (ends - starts > 1) & (before >= 0x61) & (before <= 0x7A)
        tail &= self.direct
        ends = ends - tail
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[buf] * _POWERS.up_to(len(buf)))])
        hashes = (sums[ends] - sums[starts]) * _INVERSE.up_to(len(buf))[starts]
        hashes = scramble(hashes + (ends - starts).astype(np.uint64))
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rank = np.minimum(np.searchsorted(self.known, values), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[rank] != values) if len(self.known) else np.arange(len(values))
        if len(new):
            self._learn(values[new], [data[starts[f] : ends[f]] for f in first[new].tolist()])
            rank = np.searchsorted(self.known, values)
        numbers = self.place[rank][inverse] if len(values) else np.empty(0, np.int64)
        # A tail follows its part.
        at = np.arange(len(numbers)) + np.cumsum(tail) - tail
        parts = np.empty(len(numbers) + int(tail.sum()), np.int64)
        parts[at] = numbers
        parts[at[tail] + 1] = (last[tail] == 0x2C).astype(np.int64)
        return parts, starts, np.concatenate([at, [len(parts)]])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.lengths) > REMEMBERED_CHUNKS:
            self._forget()
        special = [b"<|" in t for t in texts]
        plain = [b"" if s else t.lower() for t, s in zip(texts, special)]
        data = b"\n".join([*plain, b""])
        parts, starts, at = self._parts(data)
        lengths = self.lengths[parts]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(self.starts[parts] - ends[:-1], lengths) + np.arange(ends[-1])]
        borders = np.cumsum([0, *(len(t) + 1 for t in plain)])
        borders = ends[at[np.searchsorted(starts, borders)]]
        found = [flat[a:b] for a, b in zip(borders, borders[1:])]
        for i in np.flatnonzero(special):
            found[i] = np.array(self._whole([texts[i].decode("utf-8", "replace")])[0], np.uint32)
        return found


@cache
def chunk_tokens(path: str) -> ChunkTokens:
    """One for each Python worker, which keeps what it knows from task to task."""
    return ChunkTokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece: the ids of the text, then id 0."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_tokens(tokenizer)
        with task_memory():
            for batch in batches:
                for some in slices(batch, "text", _PORTION):
                    rows = []
                    for doc, tokens in zip(some.column(0).to_pylist(), chunks.encode(byte_texts(some, "text"))):
                        data = np.append(tokens, np.uint32(0)).astype("<u4")
                        for i, start in enumerate(range(0, len(data), capacity)):
                            part = data[start : start + capacity]
                            rows.append((doc, i, start, len(part), zlib.crc32(part.tobytes())))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                        [f.split()[0] for f in schema.split(", ")],
                    )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    return rows.mapInArrow(run, schema)


@dataclass
class Entry:
    """``count`` sequences with the same lengths in them, longest first."""

    lengths: tuple[int, ...]
    count: int


def _largest(counts: np.ndarray, limit: int) -> int:
    some = np.flatnonzero(counts[1 : limit + 1])
    return int(some[-1]) + 1 if len(some) else 0


def _smallest_sum(counts: np.ndarray, k: int) -> float:
    """Sum of the ``k`` smallest pieces; infinite if there are fewer."""
    total = 0
    for s in np.flatnonzero(counts):
        take = min(k, int(counts[s]))
        total, k = total + take * int(s), k - take
        if not k:
            return total
    return np.inf


def _best_pair(counts: np.ndarray, room: int) -> int:
    """Largest sum of two pieces within ``room``, 0 if no two fit."""
    sizes = np.flatnonzero(counts[: room + 1])
    best = 0
    for s in sizes[sizes <= room // 2].tolist():
        left = counts.copy()
        left[s] -= 1
        other = _largest(left, room - s)
        best = max(best, s + other if other else 0)
        if best == room:
            break
    return best


def _dominating(counts: np.ndarray, s: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the piece ``s`` that dominates all others with it, or None."""
    rest = counts.copy()
    rest[s] -= 1
    room = capacity - s
    k = _largest(rest, room)
    if not k:
        return (s,)
    if k == room or _smallest_sum(rest, 2) > room:
        return (s, k)
    if _smallest_sum(rest, 3) > room:
        if _best_pair(rest, room) <= k:
            return (s, k)
        rest[k] -= 1
        second = _largest(rest, room - k)
        if second and _largest(rest, room // 2) <= second:
            return (s, k, second)
    return None


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Entry]:
    """Fix dominating sets as long as there are any; ``counts`` keeps what is left.

    A dominating set stays one until a length in it runs out: what was the largest piece that fits still is, the
    sums of the smallest pieces only grow, and those of the best pairs only shrink. So it is fixed as often as it
    can be, at most a few pieces of some length are left each time, and the entries are no more than a small
    multiple of the capacity, whatever the counts.
    """
    fixed, again = [], True
    while again:
        again = False
        for s in range(capacity, 0, -1):
            while counts[s] and (found := _dominating(counts, s, capacity)):
                times = min(int(counts[x]) // found.count(x) for x in set(found))
                for x in found:
                    counts[x] -= times
                fixed.append(Entry(found, times))
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Entry]:
    """Longest first, each piece to the open sequence with the least room that holds it."""
    open_: list[list[Entry]] = [[] for _ in range(capacity + 1)]
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            room = next((r for r in range(s, capacity) if open_[r]), capacity)
            entry = open_[room].pop() if room < capacity else Entry((), left)
            each = min(room // s, left)
            full = min(entry.count, left // each)
            if entry.lengths and full < entry.count:
                open_[room].append(Entry(entry.lengths, entry.count - full))
            open_[room - each * s].append(Entry(entry.lengths + (s,) * each, full))
            left -= full * each
    return [e for entries in open_ for e in entries]


def plan(counts: np.ndarray, capacity: int) -> list[Entry]:
    """Sequences for ``counts[length]`` pieces of each length."""
    counts = counts.copy()
    whole = [Entry((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    return whole + reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


class Places:
    """Place of the piece with a given rank among those of its length."""

    def __init__(self, entries: list[Entry]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for e in entries:
            offset = 0
            for length in dict.fromkeys(e.lengths):
                many = e.lengths.count(length)
                rank = used.get(length, 0)
                rows.append((length, rank, sequence, many, offset))
                used[length] = rank + many * e.count
                offset += many * length
            sequence += e.count
        rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = (rows[:, 0] << 48) + rows[:, 1]
        self.rank, self.base, self.many, self.offset = rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 48) + rank, "right") - 1
        inside = rank - self.rank[at]
        many = self.many[at]
        return self.base[at] + inside // many, self.offset[at] + inside % many * length


def ranked(pieces_: DataFrame, parts: int) -> DataFrame:
    """Add ``rank`` (from 0) among the pieces of a length, counted in ``parts`` parts of each length."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    split = pieces_.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = split.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order))
    numbered = split.withColumn("inside", inside - 1).join(sizes, ["length", "part"])
    return numbered.withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its token ids and then id 0; only documents longer than ``capacity`` are cut. Columns:
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and empty texts are the single
    id 0. Repeated rows are packed as often as they come; a null ``doc_id`` stays null. An empty table
    gives an empty result; other columns are not looked at.
    """
    made = stage(pieces(docs, tokenizer, capacity, key, text), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # one row per length
        counts[row["length"]] = row["count"]
    places = Places(plan(counts, capacity))
    parts = max(16, -(-int(counts.max()) // RANKED_TOGETHER))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
                sequence, offset = places.of(length.astype(np.int64), rank.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                    [f.split()[0] for f in schema.split(", ")],
                )

    rows = ranked(made, parts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(run, schema)
