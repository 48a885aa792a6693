"""The event table: any table with a key and a size column is an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.patterns import check_pattern, key_matches

# Event types.
HIT, MISS = "hit", "miss"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_events(
    df: DataFrame,
    key: Column | str,
    size: Column | str,
    ts: Column | str | None = None,
    type: Column | str | None = None,
) -> DataFrame:
    """Project any table to ``(type, key, size[, ts])``."""
    columns = [
        (F.lit(HIT) if type is None else _column(type)).alias("type"),
        _column(key).cast("string").alias("key"),
        _column(size).cast("long").alias("size"),
    ]
    if ts is not None:
        columns.append(_column(ts).alias("ts"))
    return df.select(*columns)


def filter_keys(events: DataFrame, pattern: str = "") -> DataFrame:
    """Keep events whose key contains a match of ``pattern``; an empty pattern keeps all.

    A pattern that does not compile raises ``BadPattern`` before a plan is built, so the frame the
    caller already has stays as it is.
    """
    if not pattern:
        return events
    return events.filter(key_matches(F.col("key"), check_pattern(events.sparkSession, pattern)))


def hits_and_misses(events: DataFrame, include_misses: bool = True) -> DataFrame:
    """Misses count like hits of size 0 unless switched off."""
    return events if include_misses else events.filter(F.col("type") == HIT)
