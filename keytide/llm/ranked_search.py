"""Ranked lexical search: hashed max-sketches bound every score, exact rescoring goes down the bounds.

A document's impact of a term is ``10**9 * tf div (1000 * tf + 12 * m)``, where ``m`` grows with the document's
length; a score is the sum of impacts times term weights. Steps, per block of queries:

1. One pass over the documents folds every term into one of ``width`` coordinates by its hash and keeps the
   largest ``tf`` at each coordinate that the queries look up. A document's impact grows with ``tf``, so the
   largest impact at a coordinate follows from it as soon as the lengths of all documents are known. The
   pass also counts in how many documents each query term is.
2. Looked up in a sketch, a query's terms give an upper bound of its score; queries are looked up in batches.
3. The texts with the largest bounds of each query are scored exactly; the ``top``-th best of these scores is
   the query's first threshold.
4. All texts with a bound at or above a threshold are scored, in every task by descending bounds; the
   thresholds rise on the way, and the first text whose bounds are all below them ends the task's work.

Equal texts have equal scores, so texts are worked on once, by hash, and only the ``top`` smallest ids of each
are ranked. A text's hash and id stand for it when it is read again.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.common import byte_texts, raw, remove, slices, stage

#: Coordinates of a sketch, unless a caller gives another number.
WIDTH = 1 << 14
#: Bytes of query texts that go to all tasks together; a single longer query is a block of its own.
BLOCK_BYTES = 4 << 20
#: Texts scored for the first threshold, times ``top``.
SEEDS = 4
#: Pairs of texts and queries up to which their table goes to all tasks; beyond, documents are shuffled by id and hash.
SENT_PAIRS = 300_000
#: Sketches looked up at a time, and words remembered by a task.
_BATCH, _REMEMBERED = 512, 200_000
# What separates terms: all ASCII but digits and letters; capital letters become small ones.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


@dataclass
class Queries:
    """A block of queries: their terms as numbers, with repeats, and the coordinates they look up."""

    ids: list
    width: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    terms: list[dict[int, int]] = field(default_factory=list)  # per query: term number to repeats

    @staticmethod
    def of(rows: list[tuple], width: int = WIDTH) -> Queries:
        out = Queries([i for i, _ in rows], width)
        for _, text in rows:
            counts = Counter(terms_of(text))
            out.terms.append({out.vocabulary.setdefault(t, len(out.vocabulary)): n for t, n in counts.items()})
        return out

    def coordinate(self, term: bytes) -> int:
        return xxhash.xxh64_intdigest(term) % self.width

    def slots(self) -> np.ndarray:
        """Place of each coordinate among those looked up, or -1."""
        used = sorted({self.coordinate(t) for t in self.vocabulary})
        out = np.full(self.width, -1, np.int32)
        out[used] = np.arange(len(used))
        return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass
class Weights:
    """What the corpus says of the queries: number and length of documents, weights of terms."""

    documents: int
    length: int
    weights: np.ndarray

    @staticmethod
    def of(documents: int, length: int, frequencies: list[int]) -> Weights:
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequencies]
        return Weights(documents, length, np.array(w, np.int64))

    def m(self, sizes: list[int]) -> np.ndarray:
        return np.array([75 + 25 * n * self.documents // max(1, self.length) for n in sizes], np.int64)


def _sketches(docs: DataFrame, queries: Queries) -> DataFrame:
    """Rows of two kinds: sketches ``doc_id, hash, n, slots, tfs``, and counts ``term, df`` of each task."""
    schema = "doc_id long, hash long, n long, slots binary, tfs binary, term int, df long"
    vocabulary, slot_of = queries.vocabulary, queries.slots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, int] = {}
        frequencies = [0] * len(vocabulary)

        def sketch(text: bytes) -> tuple[int, bytes, bytes]:
            words = terms_of(text)
            best: dict[int, int] = {}
            for word, tf in Counter(words).items():
                slot = places.get(word)
                if slot is None:
                    if len(places) >= _REMEMBERED:
                        places.clear()
                    slot = places[word] = int(slot_of[queries.coordinate(word)])
                if slot >= 0:
                    if tf > best.get(slot, 0):
                        best[slot] = tf
                    number = vocabulary.get(word)
                    if number is not None:
                        frequencies[number] += 1
            return (
                len(words),
                np.fromiter(best, np.uint16, len(best)).tobytes(),
                np.fromiter(best.values(), np.uint32, len(best)).tobytes(),
            )

        for batch in batches:
            for part in slices(batch, "text"):
                made = [sketch(t) for t in byte_texts(part, "text")]
                none = pa.nulls(len(made))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([n for n, _, _ in made], pa.int64()),
                        pa.array([s for _, s, _ in made], pa.binary()),
                        pa.array([t for _, _, t in made], pa.binary()),
                        none.cast(pa.int32()),
                        none.cast(pa.int64()),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )
        numbers = [i for i, df in enumerate(frequencies) if df]
        none = pa.nulls(len(numbers))
        yield pa.RecordBatch.from_arrays(
            [
                *(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())),
                pa.array(numbers, pa.int32()),
                pa.array([frequencies[i] for i in numbers], pa.int64()),
            ],
            [f.split()[0] for f in schema.split(", ")],
        )

    return docs.select("doc_id", "hash", "text").mapInArrow(run, schema)


def _bounds(slots: list[bytes], tfs: list[bytes], sizes: list[int], lookups: list, weights: Weights) -> np.ndarray:
    """Upper bounds, one row per query and one column per sketch."""
    counts = [len(s) // 2 for s in slots]
    owner = np.repeat(np.arange(len(slots)), counts)
    place = np.frombuffer(b"".join(slots), np.uint16).astype(np.int64)
    tf = np.frombuffer(b"".join(tfs), np.uint32).astype(np.int64)
    table = np.zeros((lookups[0], len(slots)))
    table[place, owner] = impacts(tf, weights.m(sizes)[owner])
    # Sums of whole numbers far below 2**53 are exact in doubles.
    return np.stack([w @ table[at] for at, w in lookups[1]]) if lookups[1] else np.zeros((0, len(slots)))


def _lookups(queries: Queries, weights: Weights) -> list:
    """Number of slots, and per query its slots with the weights to multiply."""
    slot_of = queries.slots()
    slot = np.array([slot_of[queries.coordinate(t)] for t in queries.vocabulary], np.int64)
    each = []
    for terms in queries.terms:
        numbers = np.fromiter(terms, np.int64, len(terms))
        repeats = np.fromiter(terms.values(), np.int64, len(terms))
        each.append((slot[numbers], (weights.weights[numbers] * repeats).astype(float)))
    return [int(slot_of.max()) + 1, each]


def _seeds(sketches: DataFrame, queries: Queries, weights: Weights, keep: int) -> DataFrame:
    """``hash, rep, query, bound``: of every task and query the ``keep`` texts with the largest bounds."""
    lookups = _lookups(queries, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple]] = [{} for _ in queries.ids]  # hash to (bound, id)
        least = np.ones(len(best))
        for ids, hashes, bounds in _looked_up(batches, lookups, weights):
            for q, i in zip(*(x.tolist() for x in np.nonzero(bounds >= least[:, None]))):
                best[q][hashes[i]] = (int(bounds[q, i]), ids[i])
                if len(best[q]) >= 2 * keep:
                    best[q] = dict(heapq.nlargest(keep, best[q].items(), key=lambda x: (x[1][0], x[0])))
                    least[q] = min(b for b, _ in best[q].values())
        rows = [(h, i, q, b) for q, found in enumerate(best) for h, (b, i) in found.items()]
        yield _pairs(rows)

    return sketches.mapInArrow(run, "hash long, rep long, query int, bound long")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    types, names = (pa.int64(), pa.int64(), pa.int32(), pa.int64()), ["hash", "rep", "query", "bound"]
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _looked_up(batches: Iterator[pa.RecordBatch], lookups: list, weights: Weights) -> Iterator[tuple]:
    """Ids, hashes and bounds of some sketches at a time, those of texts the task has met left out."""
    met: set[int] = set()
    for batch in batches:
        for low in range(0, batch.num_rows, _BATCH):
            rows = list(zip(*(batch.column(i).slice(low, _BATCH).to_pylist() for i in range(5))))
            rows = [r for r in {r[1]: r for r in rows}.values() if r[1] not in met]
            if len(met) > _REMEMBERED:
                met.clear()
            met.update(r[1] for r in rows)
            if rows:
                ids, hashes, sizes, slots, tfs = map(list, zip(*rows))
                yield ids, hashes, _bounds(slots, tfs, sizes, lookups, weights)


def _open(sketches: DataFrame, queries: Queries, weights: Weights, thresholds: np.ndarray) -> DataFrame:
    """``hash, rep, query, bound`` of all texts with bounds at or above the thresholds."""
    lookups = _lookups(queries, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, bounds in _looked_up(batches, lookups, weights):
            found = zip(*(x.tolist() for x in np.nonzero(bounds >= thresholds[:, None])))
            yield _pairs([(hashes[i], ids[i], q, int(bounds[q, i])) for q, i in found])

    return sketches.mapInArrow(run, "hash long, rep long, query int, bound long")


def _rescored(
    pairs: DataFrame, docs: DataFrame, queries: Queries, weights: Weights, thresholds: np.ndarray, top: int
) -> DataFrame:
    """``hash, query, score`` of the pairs, those left out whose bound is below a threshold reached on the way.

    In every task texts come by descending bound, as a share of the threshold that the bound is held against.
    """
    floors = pairs.sparkSession.createDataFrame(list(enumerate(thresholds.tolist())), "query int, floor long")
    wanted = (
        pairs.join(F.broadcast(floors), "query")
        .groupBy("hash")
        .agg(
            F.min("rep").alias("rep"),
            F.max(F.col("bound") / F.col("floor")).alias("share"),
            F.collect_set(F.struct("query", "bound")).alias("asked"),
        )
    )
    wanted = stage(wanted, "wanted")
    small = wanted.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0] <= SENT_PAIRS
    keys = wanted.select(F.col("hash").alias("h"), "rep", "share", "asked")
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("h"))
    texts = docs.join(F.broadcast(keys) if small else keys, same)
    texts = texts.select("hash", "share", "asked", "text").dropDuplicates(["hash"])
    texts = texts.sortWithinPartitions(F.desc("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[list[int]] = [[] for _ in queries.ids]  # the best scores of this task
        least = thresholds.tolist()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                hashes, asked = part.column(0).to_pylist(), part.column(2).to_pylist()
                for h, pairs_of, text in zip(hashes, asked, byte_texts(part, "text")):
                    live = [p["query"] for p in pairs_of if p["bound"] >= least[p["query"]]]
                    if not live:
                        continue
                    words = terms_of(text)
                    counts = Counter(words)
                    m = int(weights.m([len(words)])[0])
                    part_of = {
                        queries.vocabulary[t]: 1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m)
                        for t in counts.keys() & queries.vocabulary.keys()
                    }
                    for q in live:
                        score = sum(
                            int(weights.weights[t]) * n * part_of[t] for t, n in queries.terms[q].items() if t in part_of
                        )
                        if score > 0:
                            rows.append((h, q, score))
                            heapq.heappush(own[q], score)
                            if len(own[q]) > top:
                                heapq.heappop(own[q])
                            if len(own[q]) == top:
                                least[q] = max(least[q], own[q][0])
                columns = list(zip(*rows)) if rows else [()] * 3
                types = (pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["hash", "query", "score"])

    return texts.mapInArrow(run, "hash long, query int, score long")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The ``top`` best texts of each query, and all that score as much as the last of these; tasks cut before they meet."""
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    return scored.withColumn("at", F.rank().over(order)).filter(F.col("at") <= top).drop("at")


def _thresholds(scored: DataFrame, count: int, top: int) -> np.ndarray:
    """The ``top``-th best score of each query, 1 where fewer texts have a score."""
    rows = _best(scored, top).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    out = np.ones(count, np.int64)
    for r in rows.filter(F.col("n") >= top).collect():  # one row for each query of the block
        out[r["query"]] = r["least"]
    return out


def _search_block(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``query, rank, doc_id, score`` of one block of queries."""
    made = stage(_sketches(docs, queries), "sketches")
    sketches = made.filter("n > 0").select("doc_id", "hash", "n", "slots", "tfs")
    sizes = sketches.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    found = made.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()
    frequencies = [0] * len(queries.vocabulary)  # one row for each term of the block
    for r in found:
        frequencies[r["term"]] = r["df"]
    weights = Weights.of(sizes["n"], sizes["l"], frequencies)
    ones = np.ones(len(queries.ids), np.int64)
    seeds = _seeds(sketches, queries, weights, SEEDS * top)
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "hash")
    seeds = seeds.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= SEEDS * top).drop("at")
    seeds = stage(seeds, "seeds")
    first = stage(_rescored(seeds, docs, queries, weights, ones, top), "scores")
    thresholds = _thresholds(first, len(queries.ids), top)
    rest = _open(sketches, queries, weights, thresholds).join(seeds.select("hash", "query"), ["hash", "query"], "left_anti")
    rest = stage(rest, "open")
    second = stage(_rescored(rest, docs, queries, weights, thresholds, top), "scores")
    best = stage(_best(first.union(second), top), "best")
    ids = sketches.select("doc_id", "hash").join(best.select("hash").distinct(), "hash", "left_semi")
    copies = Window.partitionBy("hash").orderBy(F.col("doc_id").asc_nulls_last())
    ids = stage(ids.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= top), "ids")
    # Of texts with equal scores those with the smallest ids stay; a text's first copy has its smallest.
    firsts = ids.filter(F.col("copy") == 1).select("hash", F.col("doc_id").alias("first"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("first").asc_nulls_last(), "hash")
    kept = best.join(firsts, "hash").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= top)
    ranks = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "hash", "copy")
    out = kept.join(ids, "hash").withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top)
    out = stage(out.select("query", "rank", "doc_id", "score"), "ranked")
    remove(made, seeds, first, rest, second, best, ids)
    return out


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of queries, each within ``BLOCK_BYTES`` or of one query."""
    sizes = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.max(F.length("text"))).first()
    parts, bound = 1, max(BLOCK_BYTES, sizes[1] or 0)
    part = F.lit(0)
    if sizes[0] > bound:
        while True:
            parts *= 2
            part = F.pmod(F.xxhash64("at"), F.lit(parts))
            if queries.groupBy(part).agg(F.sum(F.length("text")).alias("b")).agg(F.max("b")).first()[0] <= bound:
                break
    for i in range(parts):
        rows = queries.filter(part == i).orderBy("at").collect()
        if rows:
            yield [(r["item_id"], bytes(r["text"])) for r in rows]


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = 20,
    key: str = "doc_id",
    text: str = "text",
    query_key: str = "item_id",
    query_text: str = "text",
    width: int = WIDTH,
) -> DataFrame:
    """The ``top`` best documents of each query, against all documents.

    Columns: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``. Terms are runs of ASCII letters and digits and of
    characters beyond ASCII, A-Z in lower case. Equal scores are ranked by ascending id, null last; repeated rows
    are ranked one by one. Documents with score 0 are no results, so null, empty and wordless texts are found by
    nothing and find nothing; an empty table gives an empty result. Every query row is a query by itself, also if
    its id repeats or is null. Other columns are not looked at.

    ``width`` is the number of coordinates, at most 65,536; results do not depend on it.
    Queries go to all tasks in blocks of ``BLOCK_BYTES``; documents are read three times per block.
    """
    if not 1 <= width <= 1 << 16:
        raise ValueError("a sketch has 1 to 65536 coordinates")
    data = raw(text)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(data).alias("hash"), data.alias("text"))
    asked = queries.select(F.col(query_key).alias("item_id"), raw(query_text).alias("text"))
    asked = stage(asked.withColumn("at", F.monotonically_increasing_id()), "queries")
    spark = docs.sparkSession
    kind = asked.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for rows in _blocks(asked):
        block = Queries.of(rows, width)
        if not block.vocabulary:
            continue
        named = spark.createDataFrame(list(enumerate(block.ids)), f"query int, item_id {kind}")
        out = out.union(_search_block(docs, block, top).join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    return out
