"""Ranks in groups of any size, without a task that holds a whole group.

Rows are dealt out by ranges of their order, numbered inside each range, and counted per range and group;
a row's rank is its number plus the counts of the group's ranges before its own. Only those counts, one short
row per range and group, meet by group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.plans.cut import cut

_RANGE, _PLACE = "__range", "__place"


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the row's number, from 1, in its ``by`` group along ``order``.

    Null group columns make groups of their own. Rows that tie in ``order`` are numbered in any order, once and for
    all: the ranges are written to the checkpoint folder, so that counts and numbers are of the same rows.
    """
    within = Window.partitionBy(_RANGE, *by).orderBy(*order)
    dealt = df.repartitionByRange(*by, *order) if by else df.repartitionByRange(*order)
    dealt = cut(dealt.withColumn(_RANGE, F.spark_partition_id()))
    placed = dealt.withColumn(_PLACE, F.row_number().over(within))
    counts = dealt.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, _RANGE, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    same = [F.col(f"a.{_RANGE}") == F.col(f"b.{_RANGE}")]
    same += [F.col(f"a.`{b}`").eqNullSafe(F.col(f"b.`{b}`")) for b in by]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = placed.alias("a").join(before.alias("b"), condition)
    columns = [F.col(f"a.`{c}`") for c in df.columns]
    return joined.select(*columns, (F.col(f"a.{_PLACE}") + F.col("b.__before")).cast("long").alias(name))
