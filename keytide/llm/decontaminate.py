"""Benchmark decontamination by a prefix-filtered containment join.

Each benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window). A window is the set of its word shingles with their positions, and occurs in a document only
if all of them do, so one prefix token, its rarest shingle in the corpus, decides where to look:

1. count the windows' shingles over all documents;
2. order each window's shingles by that count and keep the rarest with its place in the window;
3. join the documents' shingles with these prefix tokens; a match fixes the place of the whole window,
   which must lie inside the document (position and length bound);
4. compare the words of the item-sized window one by one.

A benchmark whose windows fit one block of bounded size is sent to all tasks. A larger one stays on Spark:
windows, counts and prefix tokens are tables, a bit table sized by their number leaves of the documents' shingles those
that may be in the benchmark, and these are joined, with the words around them, with the prefix tokens.
Documents are never shuffled, and the driver holds at most one block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.bits import BitTable
from keytide.llm.common import WordHashes, byte_texts, ngram_hashes, raw, slices, stage, tidy, unused

#: Bytes of window text up to which a benchmark is sent to all tasks.
BLOCK_BYTES = 24 << 20
SHINGLE = 3
#: Occurrences of a prefix token in the documents from which its rows are dealt over several tasks.
HOT_ROWS = 20_000
#: Hot tokens up to which their table goes to all tasks.
SENT_ROWS = 500_000
_TABLE_BITS = 22

#: Letters a-z after lower-casing A-Z, digits and everything beyond ASCII make words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Membership:
    """Positions of the members of a fixed set of 64-bit values in an array."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.values)] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` that hold members, and the members' ranks."""
        if not len(self.values):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.table[self._slot(values)])
        rank = np.minimum(np.searchsorted(self.values, values[at]), len(self.values) - 1)
        ok = self.values[rank] == values[at]
        return at[ok], rank[ok]


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item, window``: the distinct windows of the items, words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            rows = {
                (item, b" ".join(words[i : i + window]))
                for item, text in zip(items, byte_texts(batch, "text"))
                if (words := words_of(text))
                for i in range(max(1, len(words) - window + 1))
            }
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows], pa.string()),
                    pa.array([w for _, w in rows], pa.binary()),
                ],
                ["item", "window"],
            )

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    found = benchmark.select(item, raw("text").alias("text")).mapInArrow(run, "item string, window binary")
    return found.distinct()


class Windows:
    """One block of the benchmark: windows, their items, and where to look for them."""

    def __init__(self, rows: list):
        items = defaultdict(set)
        for row in rows:
            items[bytes(row["window"])].add(row["item"])
        self.words = [w.split() for w in items]
        self.items = [sorted(i) for i in items.values()]
        hashes = WordHashes()
        self.shingles = [ngram_hashes(hashes.of(w), min(SHINGLE, len(w))) for w in self.words]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.words})
        self.places: dict[int, list[tuple[int, int]]] = {}

    def all_shingles(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *self.shingles])

    def order_by_rarity(self, counts: dict[int, int]) -> None:
        places = defaultdict(list)
        for w, shingles in enumerate(self.shingles):
            at = min(range(len(shingles)), key=lambda i: (counts.get(int(shingles[i]), 0), int(shingles[i])))
            places[int(shingles[at])].append((w, at))
        self.places = dict(places)

    def occurrences(self, words: list[bytes], hashes: WordHashes, members: Membership) -> list[tuple[int, int]]:
        """``(start, window)`` of every occurrence in a document."""
        ids, found = hashes.of(words), []
        for size in self.sizes:
            at, rank = members.find(ngram_hashes(ids, size))
            for position, r in zip(at.tolist(), rank.tolist()):
                for w, offset in self.places.get(int(members.values[r]), ()):
                    start, expected = position - offset, self.words[w]
                    if start < 0 or start + len(expected) > len(words):
                        continue
                    if min(SHINGLE, len(expected)) == size and words[start : start + len(expected)] == expected:
                        found.append((start, w))
        return found


def _count_shingles(docs: DataFrame, block: Windows) -> dict[int, int]:
    members_of = block.all_shingles()
    sizes = block.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, members = WordHashes(), Membership(members_of)
        counts = np.zeros(len(members.values), np.int64)
        for batch in (p for b in batches for p in slices(b, "text")):
            for text in byte_texts(batch, "text"):
                ids = hashes.of(words_of(text))
                for size in sizes:
                    counts += np.bincount(members.find(ngram_hashes(ids, size))[1], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(members.values[some].view(np.int64)), pa.array(counts[some])], ["shingle", "n"]
        )

    found = docs.select(raw("text").alias("text")).mapInArrow(tidy(run), "shingle long, n long")
    rows = found.groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["shingle"]).view(np.uint64)): r["n"] for r in rows}


def _fits(windows: DataFrame) -> bool:
    return (windows.agg(F.sum(F.length("window") + F.length("item") + 100)).first()[0] or 0) <= BLOCK_BYTES


def _block(docs: DataFrame, windows: DataFrame) -> Windows:
    """All windows, with their prefix tokens, in one block."""
    block = Windows(windows.collect())
    block.order_by_rarity(_count_shingles(docs, block))
    return block


def _shingled(windows: DataFrame) -> DataFrame:
    """``window, size, at, shingle``: the shingles of the distinct windows with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for window in batch.column(0).to_pylist():
                words = window.split()
                size = min(SHINGLE, len(words))
                found = ngram_hashes(hashes.of(words), size).view(np.int64).tolist()
                rows += [(window, size, at, shingle) for at, shingle in enumerate(found)]
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["window", "size", "at", "shingle"]
            )

    return windows.select("window").distinct().mapInArrow(run, "window binary, size int, at int, shingle long")


def _document_shingles(
    docs: DataFrame, sizes: list[int], table: BitTable, window: int, counted: bool
) -> DataFrame:
    """Shingles of ``docs`` (``text_key, text``) that the bit table knows: counts, or places with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts: dict[tuple[int, int], int] = defaultdict(int)
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), byte_texts(batch, "text")):
                words = words_of(text)
                ids = hashes.of(words)
                for size in sizes:
                    values = ngram_hashes(ids, size)
                    at = np.flatnonzero(table.taken(values))
                    for place, value in zip(at.tolist(), values[at].view(np.int64).tolist()):
                        if counted:
                            counts[size, value] += 1
                        else:
                            first = max(0, place - window + 1)
                            around = b" ".join(words[first : place + window])
                            rows.append((key, size, value, place, place - first, around))
            if counted:
                rows = [(size, value, n) for (size, value), n in counts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names
            )

    if counted:
        schema, kinds = "size int, shingle long, n long", (pa.int32(), pa.int64(), pa.int64())
    else:
        schema = "text_key long, size int, shingle long, place long, lead int, around binary"
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select("text_key", raw("text").alias("text")).mapInArrow(run, schema)


def _joined_occurrences(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """``text_key, start, end, window`` of every occurrence of a window in a text of ``docs``, each once."""
    shingles = stage(_shingled(windows), "shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    counts = _document_shingles(docs, sizes, BitTable.of(shingles.select("shingle").distinct(), "shingle"), window, counted=True)
    counts = counts.groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    ranked = shingles.join(counts, ["size", "shingle"], "left")
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at", "size")
    prefixes = ranked.groupBy("window").agg(F.min(rarity).alias("p")).select("window", "p.*").filter("n > 0")
    prefixes = stage(prefixes, "prefixes")
    # Of a token in very many places every place is dealt to one salt, and the windows are there for each.
    salts = F.least(F.lit(256), F.ceil(F.col("n") / HOT_ROWS)).cast("int").alias("salts")
    hot = stage(prefixes.filter(F.col("n") > HOT_ROWS).select("size", "shingle", salts).distinct(), "hot")
    hot = F.broadcast(hot) if hot.count() <= SENT_ROWS else hot
    some = lambda df: df.join(hot, ["size", "shingle"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    places = _document_shingles(docs, sizes, BitTable.of(prefixes.select("shingle").distinct(), "shingle"), window, counted=False)
    places = some(places).withColumn("salt", F.pmod(F.xxhash64("text_key", "place"), F.col("salts")).cast("int"))
    looked = some(prefixes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = places.drop("salts").join(looked.drop("salts", "n"), ["size", "shingle", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, place, lead, around, expected, at in zip(*(c.to_pylist() for c in batch.columns)):
                words, first = expected.split(), lead - at
                if first >= 0 and around.split()[first : first + len(words)] == words:
                    rows.append((key, place - at, place - at + len(words), expected))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                ["text_key", "start", "end", "window"],
            )

    pairs = pairs.select("text_key", "place", "lead", "around", "window", "at")
    return pairs.mapInArrow(run, "text_key long, start long, end long, window binary").distinct()


def _searcher(block: Windows) -> Callable[[bytes], tuple[int, list[tuple[int, int]]]]:
    hashes = WordHashes()
    members = Membership(np.array(list(block.places), np.uint64))

    def search(text: bytes) -> tuple[int, list[tuple[int, int]]]:
        words = words_of(text)
        return len(words), block.occurrences(words, hashes, members)

    return search


def _occurrences(docs: DataFrame, key: str, text: str, block: Windows) -> DataFrame:
    schema = "doc_id long, text_key long, n_words long, starts array<long>, ends array<long>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(block)
        for batch in (p for b in batches for p in slices(b, "text")):
            results = [search(t) for t in byte_texts(batch, "text")]
            found = [r[1] for r in results]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0] for r in results], pa.int64()),
                    pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[s + len(block.words[w]) for s, w in f] for f in found], pa.list_(pa.int64())),
                    pa.array(
                        [sorted({i for _, w in f for i in block.items[w]}) for f in found],
                        pa.list_(pa.string()),
                    ),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), raw(text).alias("text")
    )
    return rows.mapInArrow(run, schema)


def _finish(found: DataFrame) -> DataFrame:
    schema = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "items array<string>"
    )

    def hit(starts: list[int], ends: list[int]) -> int:
        total = reach = 0
        for s, e in sorted(zip(starts, ends)):
            total += max(0, e - max(s, reach))
            reach = max(reach, e)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, starts, ends, items = (c.to_pylist() for c in batch.columns)
            hits = [hit(s, e) for s, e in zip(starts, ends)]
            names = [sorted(set(i)) for i in items]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array([len(i) for i in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in names], pa.string()),
                    pa.array([h > 0 for h in hits], pa.bool_()),
                    pa.array(names, pa.list_(pa.string())),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    return found.select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(run, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = 10
) -> DataFrame:
    """Per input row: words, words inside any benchmark window, and the items that occur.

    Columns: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of the item ids, sorted
    as strings and joined by commas), ``contaminated``, ``items``. ``benchmark`` has ``item_id`` and
    ``text``. Null or wordless documents have no words and no hits; null or wordless items occur
    nowhere; a null ``item_id`` is named by the empty string; rows with one ``item_id`` are one item.
    Repeated documents come back as often as they go in, empty tables give empty or clean results,
    other columns are not looked at.
    """
    docs = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    windows = stage(_windows(benchmark, window), "windows")
    if _fits(windows):
        return _finish(_occurrences(docs, key, "text", _block(docs, windows)))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    found = stage(_joined_occurrences(keyed, windows, window), "occurrences")
    places = found.groupBy("text_key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    items = found.select("text_key", "window").distinct().join(windows, "window")
    items = items.groupBy("text_key").agg(F.collect_set("item").alias("items"))
    rows = _occurrences(docs, key, "text", Windows([])).select("doc_id", "text_key", "n_words")
    rows = rows.join(places, "text_key", "left").join(items, "text_key", "left")
    empty = F.array().cast("array<long>")
    return _finish(
        rows.withColumns(
            {
                "starts": F.coalesce("starts", empty),
                "ends": F.coalesce("ends", empty),
                "items": F.coalesce("items", F.array().cast("array<string>")),
            }
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; all columns stay as they are."""
    texts = docs.select(F.col(text).alias("text"))
    windows = stage(_windows(benchmark, window), "windows")
    if not _fits(windows):
        keyed = texts.withColumn("text_key", F.xxhash64("text"))
        name = unused(docs, "text_key")
        found = _joined_occurrences(keyed, windows, window).select(F.col("text_key").alias(name)).distinct()
        found = stage(found, "found")
        return docs.join(found, F.xxhash64(docs[text]) == found[name], "left_anti")
    block = _block(texts, windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(block)
        for batch in (p for b in batches for p in slices(b, text)):
            yield batch.filter(pa.array([not search(t)[1] for t in byte_texts(batch, text)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
