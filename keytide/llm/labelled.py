"""Labelled documents for fitting: bounded samples of one fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import bounded_sample, raw

#: Longer texts take no part in fitting, so that the bound on rows bounds the memory too.
LONGEST = 40_000


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: dict[int, int]
) -> tuple[DataFrame, dict[int, float]]:
    """``doc_id, text, label`` of at most ``rows[value]`` documents for each label value, and each one's weight.

    Only rows outside ``held_out`` are looked at. The ids are picked first, by their hash, so they are few and
    go to all tasks. Repeated ids count once. A weight is how many labelled rows one sampled row stands for.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.dropna().filter(~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for value, most in rows.items():
        part = bounded_sample(known.filter(F.col("label") == value), most, "doc_id")
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("text"))
    texts = texts.filter(F.length("text") <= LONGEST)
    sample = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    return sample, {v: sizes.get(v, 0) / max(1, min(n, sizes.get(v, 0))) for v, n in rows.items()}
