"""Running aggregates over groups of any size.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.  Here rows are first
split into buckets along the order; each bucket is scanned by itself, bucket totals (one short row
per bucket) are scanned along the key, and the two are added.  A key with a third of all rows is
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _HASH = "__bucket", "__hash"


def _over(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carried)
    return (F.greatest if kind == "max" else F.least)(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    columns: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``/``max``/``min``/``last`` (non-null) columns per key.

    ``bucket`` must be non-decreasing along ``order`` and keys non-null.  ``columns`` maps each new
    column to ``(kind, value)``; with ``inclusive=False`` the current row is left out.  Ties in
    ``order`` must not occur.
    """
    # Sorting compares the hash first, which is much cheaper than comparing text keys.
    rows = df.withColumns({_HASH: F.xxhash64(*keys) if keys else F.lit(0), _BUCKET: bucket})
    group = [_HASH, *keys, _BUCKET]
    ordered = Window.partitionBy(*group).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[
            _over(kind, c).over(upto if inclusive else before).alias(f"__in_{n}")
            for n, (kind, c) in columns.items()
        ],
    )
    # The last row of a bucket holds its totals.
    totals = (
        rows.select(
            *group,
            *[_over(kind, c).over(upto).alias(f"__all_{n}") for n, (kind, c) in columns.items()],
            F.lead(F.lit(1)).over(ordered).alias("__more"),
        )
        .filter(F.col("__more").isNull())
        .drop("__more")
    )
    earlier = (
        Window.partitionBy(_HASH, *keys)
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *group,
        *[
            _over(kind, F.col(f"__all_{n}")).over(earlier).alias(f"__pre_{n}")
            for n, (kind, _) in columns.items()
        ],
    )
    return local.join(carried, group, "left").select(
        *df.columns,
        *[
            _combine(kind, F.col(f"__pre_{n}"), F.col(f"__in_{n}")).alias(n)
            for n, (kind, _) in columns.items()
        ],
    )
