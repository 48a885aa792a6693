"""From raw documents to packed training sequences, each stage on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read again as the next
one's ``docs``. All but the last return the columns of ``docs`` as they are:

1. quality rules: rows that the rules or the isolation forest reject go;
2. Jaccard join (five-word shingles, 80 %): of each group of linked rows the one with the smallest
   ``doc_id`` stays, of equal or no ids one of them;
3. decontamination: rows with a benchmark window go;
4. secrets: found spans are replaced by ``[SECRET]``, ``n_chars`` follows, no row goes;
5. packing: one row per piece of a document and its place.

Null texts count as empty; empty texts go in the first stage. Empty tables pass through all stages.
Columns that the stages do not know stay, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.ship import ship
from keytide.llm.common import read, remove, short_batches, stage, unused
from keytide.llm.decontaminate import drop_contaminated
from keytide.llm.jaccard import SENT_ROWS, jaccard_join
from keytide.llm.packing import pack
from keytide.llm.quality_rules import drop_low_quality
from keytide.llm.secrets import redact_secrets


def prepare(spark: SparkSession) -> None:
    """What any stage needs of its session."""
    ship(spark)
    short_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_low_quality(docs, read(spark, sf_dir, "labels"))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number for each row, the same whenever it is read.

    Rows of a table have it by their file and place there; what is not read straight from files is written first.
    """
    if "_metadata" not in docs.columns:
        try:
            path, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
            places = docs.select(path.alias("path"), at.alias("at"))
            once = places.groupBy("path", "at").count().filter("count > 1 or path is null or at is null").isEmpty()
            paths = sorted(r["path"] for r in places.select("path").distinct().collect()) if once else []
        except AnalysisException:
            paths = []
        if paths:
            spark, file = docs.sparkSession, unused(docs, "file_path")
            # As Arrow: rows from a list would pass through Python workers of another kind, which stay in memory.
            files = spark.createDataFrame(pa.table({file: paths, row: pa.array(range(len(paths)), pa.int64())}))
            found = docs.select("*", path.alias(file), at.alias(f"{row}_at")).join(F.broadcast(files), file)
            return found.select(*docs.columns, (F.col(row) * (1 << 40) + F.col(f"{row}_at")).alias(row))
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def marked(rows: DataFrame, row: str, numbers: DataFrame) -> DataFrame:
    """The ``rows`` whose number is among ``numbers``, each there once.

    Rows of a file have neighbouring numbers, so a bit for each of 64 of them makes the table small enough to be sent
    to all tasks; only beyond ``SENT_ROWS`` such words are whole rows shuffled.
    """
    word, bits = unused(rows, "word"), unused(rows, "bits")
    one = F.expr("shiftleft(1L, cast(number & 63 as int))")
    words = numbers.groupBy(F.shiftright("number", 6).alias(word)).agg(F.bit_or(one).alias(bits))
    words = stage(words, "kept")
    words = F.broadcast(words) if words.count() <= SENT_ROWS else words
    place = F.col(row).bitwiseAND(F.lit(63)).cast("int")
    found = rows.withColumn(word, F.shiftright(row, 6)).join(words, word)
    return found.filter(F.getbit(F.col(bits), place) == 1).select(*rows.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group: by id (null last), text hash and place in the table; wordless rows stay."""
    prepare(spark)
    # Rows are told apart by a number: ids may be null or repeat.
    row = unused(docs, "row_number")
    rows = numbered(docs, row)
    linked = jaccard_join(rows, key=row).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.col(row).alias("row"))
    firsts = rows.select(row, order.alias("order")).join(linked, row).groupBy("group").agg(F.min("order").alias("o"))
    return marked(rows, row, firsts.select(F.col("o.row").alias("number"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Models decide in two stages and a tokenizer's ids in the last, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        kept = stage(step(spark, docs, sf_dir), name)
        remove(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
