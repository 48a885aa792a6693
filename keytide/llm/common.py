"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.plans.cut import shared_folder

#: Words remembered by one Python worker; beyond it the memory starts anew.
REMEMBERED_WORDS = 300_000
#: Bytes after which Spark ends an Arrow batch for a Python worker; as much as ``slices`` turns into Python objects.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Let the session cut Arrow batches for Python workers by ``BATCH_BYTES``; a smaller bound of its own stays.

    Spark's own bound lets 10,000 documents into a batch. Executors pool the buffers of the longest batches, once for
    each thread that ever filled one, and give none back; workers hold a batch and read the next one.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    What several later steps read is then made once, the same for all of them, and outlives executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def remove(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote and no result still to be computed reads; other tables are left alone."""
    for df in staged:
        path = getattr(df, "staged_at", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``by``: the same ones on every run."""
    return df.orderBy(F.xxhash64(*by), *by).limit(rows)


def raw(column: str):
    """A text column as the bytes it holds, empty for null."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    return (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


@contextmanager
def task_memory(*caches: dict) -> Iterator[None]:
    """Empties the caches when a task is done with them and gives free memory back: Python workers live on."""
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _libc is not None:
            _libc.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, with free memory given back when a task is done."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            yield from run(batches)

    return tidied


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


class WordHashes(dict):
    """64-bit hash of each word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    v = values.copy()
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, in order."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count]
    return scramble(total)


def byte_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column of a batch as bytes, empty for null."""
    values = batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


def slices(batch: pa.RecordBatch, name: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column has about ``size`` bytes, at least one row each.

    Only a part at a time becomes Python objects.
    """
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(name))).fill_null(0)
    reach = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        done = reach[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(reach, done + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def portions(texts: list[bytes], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``size`` bytes, at least one text each."""
    low = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)
