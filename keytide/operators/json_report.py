"""Reports as JSON: one object per interval with totals, rows and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.spec import DEFAULT_SPEC, ReportSpec, report_spec
from keytide.functions.text import percentage, rfc3339
from keytide.operators import report as R
from keytide.operators import stats as S
from keytide.plans.cut import cut

# Field names of a JSON report, in order (the spelling of the sixth word of the
# statistics is part of the format).
FIELDS = {
    "Timestamp": "Timestamp",
    "TotalKeys": "total_keys",
    "TotalBandwidth": "total_bytes",
    "ReportedKeys": "reported_keys",
    "ReportedBandwidth": "reported_bytes",
    "ReportedBandwidthPercentage": "reported_percentage",
    "Part": "Part",
    "Rows": "Rows",
}
#: Rows in one object; a longer report is several objects.
PART_ROWS = R.MAX_TOP
STATS_FIELDS = ("Culumative", "Incremental")
_BYTES = "sum(size)"


def row_struct(spec: ReportSpec):
    """A report row as name/value pairs, names in alphabetical order."""
    return F.struct(*[R.quoted(n).alias(n) for n in sorted(spec.columns)])


def json_reports(
    full: DataFrame,
    format: str | ReportSpec = DEFAULT_SPEC,
    by: Sequence[str] = (),
    stamp=None,
    top: int | None = None,
    threshold: int | None = None,
    rank_by: str | None = None,
    stats: DataFrame | tuple[dict[str, int], dict[str, int]] | None = None,
) -> DataFrame:
    """One row per interval (or one for ``by=()``) with the fields of a JSON report.

    All rows are reported unless ``top`` is given.  An array holds ``PART_ROWS`` rows; an interval with
    more has one row per array, with the same totals and its number as ``Part``, which is null else.  ``stamp`` is
    the report time, by default the interval's end.  ``stats`` holds per-interval counters to include, or the
    counters of a running query so far and since its last report; of these the first interval gets the change.
    Totals are of bytes whatever the rows are ranked by, so ``full`` needs ``sum(size)``; make it with
    ``spec.with_sum()`` if ``format`` does not list that.
    """
    spec = report_spec(format)
    if top is not None and top < 0:
        raise ValueError("top must not be negative")
    if _BYTES not in full.columns:
        raise ValueError(f"totals need {_BYTES}; make the report with with_sum()")
    rank_by = rank_by or spec.rank_by
    if rank_by is None:
        raise ValueError("a JSON report needs a value column")
    by = list(by)
    keys = by or ["__all"]
    if not by:
        full = full.withColumn("__all", F.lit(0))
    # Read twice below: once for the totals, once for the rows.
    full = cut(full)
    order = R.ranking(spec, rank_by)
    shown = R.top_per(
        R.above(full, spec, threshold, rank_by), keys, order, top, spec.key_names or keys
    )

    def counted(side: str) -> list[Column]:
        return [
            F.count(F.lit(1)).alias(f"{side}_keys"),
            F.sum(R.quoted(_BYTES)).alias(f"{side}_bytes"),
        ]

    rows = F.collect_list(F.struct(F.col("rank"), row_struct(spec).alias("row")))
    part = F.floor((F.col("rank") - 1) / PART_ROWS).alias("Part")
    listed = shown.groupBy(*keys, part).agg(F.array_sort(rows).getField("row").alias("Rows"))
    empty = F.array().cast(listed.schema["Rows"].dataType)
    out = full.groupBy(*keys).agg(*counted("total"))
    out = out.join(shown.groupBy(*keys).agg(*counted("reported")), keys, "left").join(listed, keys, "left")
    out = out.withColumns(
        {
            "Part": F.when(F.col("reported_keys") > PART_ROWS, F.col("Part")),
            "Rows": F.coalesce("Rows", empty),
            "reported_keys": F.coalesce("reported_keys", F.lit(0).cast("long")),
            "reported_bytes": F.coalesce("reported_bytes", F.lit(0).cast("long")),
        }
    ).withColumn(
        "reported_percentage", percentage(F.col("reported_bytes"), F.col("total_bytes"))
    )
    stamp = stamp if stamp is not None else F.col("window_end")
    out = out.withColumn("Timestamp", rfc3339(stamp))
    fields = [F.col(c).alias(n) for n, c in FIELDS.items()]
    if isinstance(stats, tuple):
        first = F.lit(True) if not by else F.col(by[0]) == full.agg(F.min(by[0])).scalar()
        so_far, change = (
            F.struct(*[F.when(now, F.lit(counted_[n])).otherwise(0).cast("long").alias(n) for n in S.COUNTERS])
            for counted_, now in zip(stats, (F.lit(True), first))
        )
        fields.append(F.struct(so_far.alias(STATS_FIELDS[0]), change.alias(STATS_FIELDS[1])).alias("Stats"))
    elif stats is not None:
        running = S.cumulative(stats).select(
            *by, F.struct(*S.COUNTERS).alias(STATS_FIELDS[0])
        )
        change = stats.select(*by, F.struct(*S.COUNTERS).alias(STATS_FIELDS[1]))
        both = running.join(change, by).select(*by, F.struct(*STATS_FIELDS).alias("Stats"))
        out = out.join(both, by, "left")
        fields.append(F.col("Stats"))
    return out.select(*by, *fields)


def as_json_lines(reports: DataFrame) -> DataFrame:
    """One JSON text per report, in a column named ``value``."""
    names = [n for n in [*FIELDS, "Stats"] if n in reports.columns]
    return reports.select(F.to_json(F.struct(*names)).alias("value"))
