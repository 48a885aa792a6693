"""Token counts of a sentence-piece model, huge documents by overlap resynchronisation.

No merge ever crosses a place between two characters that stand side by side in no piece of the
vocabulary, so the tokens on either side of such a place depend on that side alone: it is a provably
stable boundary. Two uses:

* Ordinary documents are split before spaces that follow other characters, if no piece has a space
  inside; each distinct part is encoded once while it is remembered.
* Huge documents become overlapping chunks, spread over tasks and encoded with offsets. Neighbours are
  spliced at the first stable place of their overlap that is a token boundary in both. Where an overlap has
  none, the document is done again with overlaps four times as wide, until it is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import byte_texts, portions, raw, stage

#: Bytes from which a document is cut; characters of a chunk and of half an overlap.
HUGE_BYTES, CHUNK, OVERLAP = 65_536, 16_384, 128
REMEMBERED_PARTS = 500_000
SPACE = "▁"


class PieceCounter:
    """Counts tokens as the library's ``encode`` gives them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [
            self.model.id_to_piece(i)
            for i in range(self.model.get_piece_size())
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        ]
        self.inside = {pair for p in pieces for pair in zip(p, p[1:])}
        self.splittable = not any(b == SPACE and a != SPACE for a, b in self.inside)
        # The shortcut holds for models that put one space before the text and change nothing else.
        probe = self.model.encode("a  b\nÅ c ", out_type=str)
        shown = "".join(chr(int(p[3:-1], 16)) if p.startswith("<0x") else p for p in probe)
        alone = self.model.piece_to_id(SPACE) != self.model.unk_id()
        self.plain = self.splittable and alone and shown == f"{SPACE}a{SPACE}{SPACE}b\nÅ{SPACE}c{SPACE}"
        self._forget()

    def _forget(self) -> None:
        self.known = {b"": 1}  # a space alone

    def stable(self, left: str, right: str) -> bool:
        """Whether no piece holds these two characters side by side."""
        left, right = (SPACE if c == " " else c for c in (left, right))
        return (left, right) not in self.inside

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.plain:
            return [len(x) for x in self.model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]
        if len(self.known) > REMEMBERED_PARTS:
            self._forget()
        parts = [self._parts(t) for t in texts]
        missing = sorted(set().union(*parts) - self.known.keys())
        if missing:
            # The model puts a space before each part, as there is one before it in the text.
            encoded = self.model.encode([m.decode("utf-8", "replace") for m in missing], num_threads=1)
            self.known.update(zip(missing, map(len, encoded)))
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in parts]

    def _parts(self, text: bytes) -> list[bytes]:
        """What follows the single spaces of a text, whose first space the model adds."""
        if not text:
            return []
        if b"  " in text or text[:1] == b" " or text[-1:] == b" " or SPACE.encode() in text:
            return self._runs(text)
        return text.split(b" ")

    def _runs(self, text: bytes) -> list[bytes]:
        """Parts of a text with runs of spaces: each run with the word that follows, less one space."""
        parts, run = [], 0
        words = text.replace(SPACE.encode(), b" ").split(b" ")
        for word in words[:-1]:
            if word:
                parts.append(b" " * run + word)
                run = 0
            else:
                run += 1
        return [*parts, b" " * run + words[-1]]

    def boundaries(self, text: str) -> np.ndarray:
        """Places of all token starts in code points, in order, the first at 0."""
        begins = np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        before = np.cumsum((data & 0xC0) != 0x80)  # the library's offsets are bytes
        return before[begins] - 1 if len(begins) else begins


@cache
def piece_counter(path: str) -> PieceCounter:
    """One for each Python worker, which keeps what it knows from task to task."""
    return PieceCounter(path)


def chunks_of(length: int, overlap: int, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """Start and end of the overlapping chunks of a text; one chunk once overlaps are as wide as it."""
    if overlap * 2 >= length:
        return [(0, length)]
    step = max(chunk, overlap * 4)
    borders = list(range(step, length - overlap, step))
    return [(max(0, a - overlap), min(length, b + overlap)) for a, b in zip([0, *borders], [*borders, length])]


def splice(counter: PieceCounter, text: str, start: int, end: int, length: int, overlap: int) -> tuple[int, int, int]:
    """Tokens of a chunk between its two cuts, and the cuts' places in the document (-1: none found).

    ``text`` is the chunk ``start:end`` of a document of ``length`` characters.
    """
    marks = counter.boundaries(text)
    known = set(marks.tolist())

    def cut(low: int, high: int) -> int:
        for at in range(low, high):
            if counter.stable(text[at - 1], text[at]) and at in known:
                return at
        return -1

    left = 0 if start == 0 else cut(1, 2 * overlap)
    right = len(text) if end == length else cut(len(text) - 2 * overlap + 1, len(text))
    if left < 0 or right < 0:
        return 0, -1, -1
    return int(((marks >= left) & (marks < right)).sum()), start + left, start + right


def _ordinary(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        for batch in batches:
            texts = byte_texts(batch, "text")
            counts = [n for low, high in portions(texts) for n in counter.count(texts[low:high])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _cut(huge: DataFrame, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), byte_texts(batch, "text")):
                decoded = text.decode("utf-8", "replace")
                spans = chunks_of(len(decoded), overlap)
                for low in range(0, len(spans), 64):
                    part = spans[low : low + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(part), pa.int64()),
                            pa.array([s for s, _ in part], pa.int64()),
                            pa.array([e for _, e in part], pa.int64()),
                            pa.array([len(decoded)] * len(part), pa.int64()),
                            pa.array([decoded[s:e] for s, e in part], pa.string()),
                        ],
                        ["row", "start", "end", "length", "text"],
                    )

    return huge.select("row", "text").mapInArrow(run, "row long, start long, end long, length long, text string")


def _spliced(chunks: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    schema = "row long, n long, low long, high long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        for batch in batches:
            rows, starts, ends, lengths, texts = (c.to_pylist() for c in batch.columns)
            found = [splice(counter, *x, overlap) for x in zip(texts, starts, ends, lengths)]
            columns = [rows, *(list(x) for x in zip(*found)), lengths] if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in schema.split(", ")]
            )

    return chunks.mapInArrow(run, schema)


def _resynchronised(huge: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    """``row, n_tokens`` of the staged huge documents."""
    done, pending = None, huge
    while True:
        chunks = _cut(pending, overlap)
        tasks = int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = _spliced(chunks.repartition(tasks, "row", "start"), tokenizer, overlap)
        # Cuts meet if every chunk ends where another one starts: then the lengths add up.
        whole = counted.groupBy("row").agg(
            F.sum("n").alias("n_tokens"),
            F.min("low").alias("least"),
            F.sum(F.col("high") - F.col("low")).alias("covered"),
            F.first("length").alias("length"),
        )
        whole = stage(whole, "spliced")
        good = whole.filter("least >= 0 and covered = length").select("row", "n_tokens")
        done = good if done is None else done.union(good)
        bad = whole.filter("not (least >= 0 and covered = length)").select("row")
        if bad.isEmpty():
            return done
        pending, overlap = stage(pending.join(bad, "row"), "again"), overlap * 4


def token_counts(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 4096, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per input row.

    Null and empty texts have no bytes and no tokens. Repeated rows come back as they go in, null ids
    stay null, an empty table gives an empty result, other columns are not looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = _ordinary(rows.filter(F.col("n_bytes") <= HUGE_BYTES), tokenizer)
    huge = rows.filter(F.col("n_bytes") > HUGE_BYTES).withColumn("row", F.monotonically_increasing_id())
    huge = stage(huge, "huge")
    if not huge.isEmpty():
        tokens = _resynchronised(huge, tokenizer, overlap)
        counted = counted.union(huge.join(tokens, "row").select("doc_id", "n_bytes", "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
