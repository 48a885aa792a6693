"""Histogram percentiles: bucket, rank and overflow rules as Columns.

Values up to ``MAX_VALUE`` are counted in buckets that keep three significant digits: exact below
2048, then 1024 buckets for each doubling.  A key needs at most 17,409 buckets however many rows
it has, and bucket counts of two inputs merge by addition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracked range, precision and the value shown for anything beyond the range.
MAX_VALUE = 64 * 1024 * 1024
SIGNIFICANT_BITS = 11
OVERFLOW = 9223372036854775807


def bucket_top(size: Column) -> Column:
    """Largest value counted in the same bucket as ``size``; null for null, an error for a negative size."""
    v = F.least(size.cast("long"), F.lit(MAX_VALUE).cast("long"))
    # One for each power of two from 2^11 that the value reaches.
    shift = sum(
        ((v >= (1 << bit)).cast("int") for bit in range(SIGNIFICANT_BITS, MAX_VALUE.bit_length())),
        F.lit(0),
    )
    low = F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)
    top = low + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
    return F.when(size < 0, F.raise_error(F.lit("negative size in a percentile"))).when(
        size.isNotNull(), top
    )


def rank(quantile: float, rows: Column) -> Column:
    """How many rows a bucket's running count must reach to hold the percentile."""
    return F.greatest(
        F.lit(1).cast("long"), F.floor(F.lit(quantile) / 100.0 * rows + 0.5).cast("long")
    )


def shown(bucket: Column) -> Column:
    """Reported value of a percentile that fell in ``bucket``."""
    return F.when(bucket >= MAX_VALUE, F.lit(OVERFLOW).cast("long")).otherwise(bucket)
