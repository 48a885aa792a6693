"""N-gram Jaccard join by prefix filters under several token orders.

A document is the set of its distinct word shingles. Two documents link when the sizes of their
intersection and union are in a ratio of at least ``percent``. All of it is exact up to equal 64-bit
hashes of different shingles or sets:

* Documents with equal sets form a class; only classes are compared.
* Shingles of all classes are counted in a table of ``1 << SLOT_BITS`` slots, by hash. Rarity is the slot's
  count in steps of the root of two. Any order of tokens that is the same for all sets is as good for a
  prefix filter, so slots that many rare shingles share cost time, never links.
* Three global orders of tokens. Of a set of ``n`` the first ``n - ceil(percent * n / 100) + 1`` tokens of an order
  are its prefix, and linked sets share a token of their prefixes under every order.
* First order: by rarity, then by hash. With ``l(n) = 1 + n // 20``, linked sets share at least ``l`` of the tokens
  up to the ``l - 1``-th behind the prefix (the ``l`` first common ones are there). Classes with fewer that any
  other class has there are out, most of them.
* Second order: what only one of the remaining classes has comes first, the rest by rarity and by another
  hash. Prefix tokens that classes share become rows and make buckets; a token of one class only joins nothing.
  At the first token two sets share, the tokens from there on must suffice for the overlap that their sizes ask for.
* Third order: by rarity and by a third hash. A candidate pair must share prefix tokens under this and the first
  order as well. Only prefixes are moved for that; whole sets follow for the pairs that are left.

Sharing a prefix token puts classes into a bucket. Pairs of a bucket are never listed at once: each class is
compared with one pivot first, classes that link become one component, and later rounds compare
pivots only with classes of other components until every bucket has one component or no class that
was not compared. No bucket is capped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.bits import BitTable
from keytide.llm.common import WordHashes, byte_texts, ngram_hashes, raw, remove, scramble, short_batches
from keytide.llm.common import slices, stage, task_memory, tidy
from keytide.llm.graph import components

_SPARE = 20
#: Bits of a shingle's hash that name its slot in the table of counts (a byte for each slot is sent to all tasks).
SLOT_BITS, _PART_BITS = 22, 6
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
_PART_SLOTS = 1 << (SLOT_BITS - _PART_BITS)
#: Differences between the hashes that order equally rare tokens.
_SECOND, _THIRD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Sets remembered by a task so that copies are worked on once; beyond it the memory starts anew.
_REMEMBERED_SETS = 500_000
#: Classes up to which their table goes to all tasks; beyond, documents are shuffled by id.
SENT_ROWS = 300_000
#: Pivots of a bucket in the first round of all pivots; later rounds take 8 times as many.
_PIVOTS = 8


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, a text without words none."""
    words = hashes.of(text.lower().split())
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(size, len(words))))


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _SLOT_SHIFT).astype(np.int64)


def prefix(
    tokens: np.ndarray,
    rarity: np.ndarray,
    percent: int,
    other: np.uint64 | None = None,
    more: int = 0,
    shared: BitTable | None = None,
) -> np.ndarray:
    """The first tokens of a sorted set under one of the orders, and ``more`` behind them.

    Orders differ by the hash they use among equally rare tokens (``other``); with ``shared`` the tokens
    that the table does not know come first.
    """
    level = rarity[slots(tokens)].astype(np.int16)
    if shared is not None:
        level += shared.taken(tokens) * np.int16(256)
    order = np.argsort(level, kind="stable") if other is None else np.lexsort((scramble(tokens ^ other), level))
    return tokens[order[: prefix_length(len(tokens), percent) + more]]


def least_shared(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any linked one, of the prefix and the ``n // 20`` tokens behind it."""
    return 1 + -(percent * n // -100) // _SPARE


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Some rows at a time with their sets and classes."""
    hashes = WordHashes()
    with task_memory(hashes):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, size, hashes) for t in byte_texts(part, "text")]
                yield part, sets, [_class(s) for s in sets]


class _Met:
    """Classes a task has worked on."""

    def __init__(self):
        self.classes: set[int] = set()

    def fresh(self, sets: list[np.ndarray], classes: list[int]) -> dict[int, np.ndarray]:
        """The sets, not empty, of classes not met before."""
        new = {c: s for c, s in zip(classes, sets) if len(s) and c not in self.classes}
        if len(self.classes) > _REMEMBERED_SETS:
            self.classes.clear()
        self.classes.update(new)
        return new


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: ``doc_id, n_shingles, cls`` of documents, and ``part, counts`` of each task's slots."""
    schema = "doc_id long, n_shingles long, cls long, part int, counts binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, counts = _Met(), np.zeros(1 << SLOT_BITS, np.uint32)
        for part, sets, classes in _texts(batches, size):
            new = met.fresh(sets, classes)
            if new:
                counts += np.bincount(slots(np.concatenate(list(new.values()))), minlength=len(counts)).astype(np.uint32)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(classes, pa.int64()),
                    none.cast(pa.int32()),
                    none.cast(pa.binary()),
                ],
                names,
            )
        parts = [p for p in counts.reshape(1 << _PART_BITS, _PART_SLOTS)]
        none = pa.nulls(len(parts)).cast(pa.int64())
        packed = pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(len(parts)), pa.int32()), packed], names)

    return docs.mapInArrow(run, schema)


def _rarity(described: DataFrame) -> np.ndarray:
    """Level of every slot, from counts added up on the executors; a byte for each slot is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                total = sums.setdefault(part, np.zeros(_PART_SLOTS, np.int64))
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        levels = [np.floor(2 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    parts = described.filter("part is not null").select("part", "counts").repartition(1 << _PART_BITS, "part")
    out = np.zeros((1 << _PART_BITS, _PART_SLOTS), np.uint8)
    for r in parts.mapInArrow(tidy(run), "part int, levels binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def _heads(docs: DataFrame, rarity: np.ndarray, size: int, percent: int) -> DataFrame:
    """``cls, n, head``: the prefix under the first order and what counts behind it; once for each task with the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for _, sets, classes in _texts(batches, size):
            new = met.fresh(sets, classes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(new), pa.int64()),
                    pa.array([len(s) for s in new.values()], pa.int32()),
                    _lists([prefix(s, rarity, percent, more=len(s) // _SPARE) for s in new.values()]),
                ],
                ["cls", "n", "head"],
            )

    return docs.mapInArrow(run, "cls long, n int, head array<long>")


def _shared(sets: DataFrame, column: str) -> DataFrame:
    """The ``token`` of a column of tokens that more than one class has."""
    rows = sets.select(F.explode(column).alias("token"), "cls")
    return rows.groupBy("token").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("token")


def _repeated(sets: DataFrame, column: str) -> DataFrame:
    """The ``token`` of a column of tokens that comes twice or more: all that ``_shared`` gives, and those of repeated rows.

    Whether a token is another class's, too, only says where it stands in an order, so more may count as such.
    """
    rows = sets.select(F.explode(column).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")


def _survivors(heads: DataFrame, shared: BitTable, percent: int) -> DataFrame:
    """``cls`` of the classes that share as many tokens of their heads as a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = _arrays(batch.column(2))
            owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
            known = np.bincount(owner[shared.taken(np.concatenate(arrays))], minlength=len(arrays))
            enough = known >= [least_shared(n, percent) for n in batch.column(1).to_pylist()]
            yield batch.select(["cls"]).filter(pa.array(enough))

    return heads.mapInArrow(tidy(run), "cls long").distinct()


def _prefixes(sets: DataFrame, rarity: np.ndarray, shared: BitTable, percent: int) -> DataFrame:
    """``token, cls, n, reach`` of the shared prefix tokens under the second order.

    ``reach`` is the number of tokens from this one on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows = []
                for cls, tokens in zip(part.column(0).to_pylist(), _arrays(part.column(1))):
                    head = prefix(tokens, rarity, percent, _SECOND, shared=shared)
                    at = np.flatnonzero(shared.taken(head))
                    rows.append((head[at], np.full(len(at), cls), np.full(len(at), len(tokens)), len(tokens) - at))
                columns = [np.concatenate(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0].view(np.int64)),
                        pa.array(columns[1].astype(np.int64)),
                        pa.array(columns[2].astype(np.int32)),
                        pa.array(columns[3].astype(np.int32)),
                    ],
                    ["token", "cls", "n", "reach"],
                )

    return sets.select("cls", "tokens").mapInArrow(tidy(run), "token long, cls long, n int, reach int")


def _class(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)], dtype=np.int32), pa.array(flat))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(offsets, offsets[1:])]


def _sets(docs: DataFrame, wanted: DataFrame, rarity: np.ndarray, size: int, percent: int) -> DataFrame:
    """``cls, first, third, tokens`` of the wanted classes, from the text of one document of each.

    A class comes once for each task that has its document; more than one has it only if ids repeat or are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for part, sets, classes in _texts(batches, size):
            asked = part.column(part.schema.get_field_index("cls")).to_pylist()
            found = met.fresh(*([x for x, c, a in zip(xs, classes, asked) if c == a] for xs in (sets, classes)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.int64()),
                    *(_lists([prefix(s, rarity, percent, o) for s in found.values()]) for o in (None, _THIRD)),
                    _lists(list(found.values())),
                ],
                ["cls", "first", "third", "tokens"],
            )

    if wanted.count() <= SENT_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "text", "cls")
    schema = "cls long, first array<long>, third array<long>, tokens array<long>"
    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` between the components ``ca, cb`` of the classes ``a, b`` that link.

    Pairs must share prefix tokens under the first and the third order, too, before their sets are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_arrays(batch.column(i)) for i in (2, 3))
            keep = pa.array([linked(p, q, percent) for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["ca", "cb"]).filter(keep).rename_columns(["a", "b"])

    def joined(some: DataFrame, *columns: str) -> DataFrame:
        """Pairs with columns of both their sets; only sets of classes that are in a pair are moved."""
        classes = stage(some.select(F.col("a").alias("cls")).union(some.select("b")).distinct(), "asked")
        asked = sets.join(_sent(classes), "cls", "left_semi")
        for end in ("b", "a"):
            some = some.join(asked.select(F.col("cls").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return some

    pairs = stage(pairs, "pairs")
    left = joined(pairs, "first", "third")
    for order in ("first", "third"):
        left = left.filter(F.arrays_overlap(f"{order}_a", f"{order}_b"))
    left = stage(left.select("a", "b", "ca", "cb").distinct(), "candidates")
    both = joined(left, "tokens")
    found = stage(both.select("ca", "cb", "tokens_a", "tokens_b").mapInArrow(tidy(run), "a long, b long"), "links")
    remove(pairs, left)
    return found


def _buckets(prefixes: DataFrame) -> DataFrame:
    """``token, cls, n, reach`` of the prefix tokens that classes share, each once."""
    ends = prefixes.groupBy("token").agg(F.min("cls").alias("x"), F.max("cls").alias("y"))
    shared = stage(ends.filter("x <> y").select("token"), "shared")
    shared = F.broadcast(shared) if shared.count() <= SENT_ROWS else shared
    return prefixes.join(shared, "token").dropDuplicates(["token", "cls"])


def _able(percent: int):
    """Whether a class (``n, reach``) and a pivot ``p`` can link if this is the first token they share."""
    overlap = F.ceil((F.col("n") + F.col("p.n")) * percent / F.lit(100 + percent))
    return F.least("reach", "p.reach") >= overlap


def _sent(table: DataFrame) -> DataFrame:
    """A written table as the side of a join: sent to all tasks if it is counted to be small."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def _rounds(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``cls, comp`` of every class that shares a bucket."""
    comp = stage(buckets.select("cls").distinct().withColumn("comp", F.col("cls")), "components")
    pivot = stage(buckets.groupBy("token").agg(F.min(F.struct("cls", "n", "reach")).alias("p")), "pivots")
    nearest = (
        buckets.join(_sent(pivot), "token")
        .filter((F.col("p.cls") != F.col("cls")) & _able(percent))
        .groupBy(F.col("cls").alias("b"))
        .agg(F.min("p.cls").alias("a"))
    )
    # At first every class is a component by itself.
    pairs = nearest.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    named, done, pivots = buckets.withColumn("comp", F.col("cls")), [pivot], _PIVOTS
    while True:
        links = _verified(pairs, sets, percent)
        merged = components(links)
        merged = stage(merged.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "merged")
        renamed = F.coalesce("new", "comp").alias("comp")
        newer = stage(comp.join(_sent(merged), "comp", "left").select("cls", renamed), "components")
        moved = stage(named.join(_sent(merged), "comp", "left").select("token", "cls", "n", "reach", renamed), "moved")
        ends = moved.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
        open_ = stage(ends.filter("x <> y").select("token"), "open")
        remove(comp, links, merged, *done)
        comp = newer
        if open_.isEmpty():
            remove(moved, open_)
            return comp
        named = stage(moved.join(_sent(open_), "token", "left_semi"), "named")
        remove(moved, open_)
        part = F.pmod(F.xxhash64("cls", F.lit(pivots)), F.lit(pivots))
        chosen = named.groupBy("token", part.alias("part")).agg(
            F.min(F.struct("cls", "n", "reach", "comp")).alias("p")
        )
        chosen = stage(chosen.select("token", "p"), "pivots")
        pairs = (
            named.join(_sent(chosen), "token")
            .filter((F.col("p.comp") != F.col("comp")) & _able(percent))
            .groupBy(F.least("p.cls", "cls").alias("a"), F.greatest("p.cls", "cls").alias("b"))
            .agg(F.least(F.min("p.comp"), F.min("comp")).alias("ca"), F.greatest(F.max("p.comp"), F.max("comp")).alias("cb"))
        )
        done = [named, chosen]
        compared = chosen.select("token", F.col("p.cls").alias("cls"))
        named = named.join(compared, ["token", "cls"], "left_anti")
        pivots *= 8


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """Link documents whose shingle sets are alike; one row per input row.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Columns: ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest ``doc_id`` reachable by links, itself included) and
    ``component_key`` (a hash that names the component).

    Null or wordless texts have no shingles and link with nothing; their ``component_id`` is their
    own id. Shorter texts are one shingle. A null ``doc_id`` links as any other; it is the component's
    id only if no member has one. Repeated rows come back as often as they go in. An empty table
    gives an empty result; other columns are not looked at.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    described = stage(_describe(rows, size), "described")
    found = described.filter("part is null")
    full = found.filter("n_shingles > 0")
    rarity = _rarity(described)
    heads = stage(_heads(rows, rarity, size, percent), "heads")
    shared = stage(_shared(heads, "head"), "shared")
    survivors = stage(_survivors(heads, BitTable.of(shared, "token"), percent), "survivors")
    remove(heads, shared)
    classes = stage(full.groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes")
    wanted = stage(classes.join(survivors, "cls"), "wanted")
    sets = stage(_sets(rows, wanted, rarity, size, percent), "sets")
    shared = stage(_repeated(sets, "tokens"), "shared")
    prefixes = stage(_prefixes(sets, rarity, BitTable.of(shared, "token"), percent), "prefixes")
    remove(shared, survivors)
    buckets = stage(_buckets(prefixes), "buckets")
    remove(prefixes)
    comp = _rounds(buckets, sets, percent)
    remove(buckets, sets, wanted)
    named = classes.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = stage(named, "named")
    remove(comp, classes)
    first = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(first, "comp").select("cls", "comp", "component_id")
    empty = F.col("n_shingles") == 0
    return found.join(named, "cls", "left").select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.xxhash64("doc_id")).otherwise(F.col("comp")).alias("component_key"),
    )
