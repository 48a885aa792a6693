"""Hot-key reports: group, aggregate, rank, cut, total."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.functions import hdr
from keytide.functions.spec import DEFAULT_SPEC, BadDescriptor, ReportSpec, aggregate_of, report_spec
from keytide.functions.text import percentage
from keytide.operators.events import filter_keys, hits_and_misses
from keytide.plans.ranks import ranked

# Rows of a report that becomes one JSON value, unless the caller asks for another number.
MAX_TOP = 65535

_ROWS = "__rows"
_BUCKET = "__hdr"


def quoted(name: str) -> Column:
    """Column whose name contains parentheses."""
    return F.col(f"`{name}`")


def _state_name(term_index: int, state_index: int) -> str:
    return f"__state_{term_index}_{state_index}"


def _percentile_field(spec: ReportSpec) -> str | None:
    fields = {t.field for t in spec.percentiles}
    if len(fields) > 1:
        raise BadDescriptor(",".join(sorted(fields)), "percentiles of more than one field")
    return next(iter(fields), None)


def _group_columns(spec: ReportSpec, by: Sequence[str]) -> list[str]:
    return [*by, *spec.key_names]


def _with_bucket(spec: ReportSpec, by: Sequence[str]) -> list[str]:
    return _group_columns(spec, by) + ([_BUCKET] if spec.percentiles else [])


def partial_report(
    events: DataFrame, spec: str | ReportSpec = DEFAULT_SPEC, by: Sequence[str] = ()
) -> DataFrame:
    """Mergeable state of a report: one row per group, or per group and histogram bucket.

    All aggregates and percentiles come from this single pass; Spark combines rows before the
    shuffle, so a key with a third of all rows sends one row (or its buckets) per input task.
    """
    spec = report_spec(spec)
    projected = [F.col(b) for b in by]
    projected += [F.col(t.field).cast("string").alias(t.name) for t in spec.keys]
    field = _percentile_field(spec)
    if field:
        projected.append(hdr.bucket_top(F.col(field)).alias(_BUCKET))
    inputs = sorted({t.field for t in spec.aggs})
    projected += [F.col(f).cast("long").alias(f"__in_{f}") for f in inputs]
    aggregates = [F.count(F.lit(1)).alias(_ROWS)]
    for i, term in enumerate(spec.aggs):
        for j, state in enumerate(aggregate_of(term).states):
            aggregates.append(state.partial(F.col(f"__in_{term.field}")).alias(_state_name(i, j)))
    return events.select(*projected).groupBy(*_with_bucket(spec, by)).agg(*aggregates)


def _merge_columns(spec: ReportSpec) -> list[Column]:
    merged = [F.sum(_ROWS).alias(_ROWS)]
    for i, term in enumerate(spec.aggs):
        for j, state in enumerate(aggregate_of(term).states):
            name = _state_name(i, j)
            merged.append(state.merge(F.col(name)).alias(name))
    return merged


def merge_partials(
    *partials: DataFrame, spec: str | ReportSpec = DEFAULT_SPEC, by: Sequence[str] = ()
) -> DataFrame:
    """Union of partial states, merged per group."""
    spec = report_spec(spec)
    union = reduce(DataFrame.unionByName, partials)
    return union.groupBy(*_with_bucket(spec, by)).agg(*_merge_columns(spec))


def _percentile_columns(spec: ReportSpec, total: Column, reached: Column) -> list[Column]:
    return [
        F.min(F.when(reached >= hdr.rank(t.quantile, total), F.col(_BUCKET))).alias(t.name)
        for t in spec.percentiles
    ]


def finished_value(spec: ReportSpec, name: str) -> Column:
    """Reported value of the column ``name`` from merged states."""
    for i, term in enumerate(spec.aggs):
        if term.name == name:
            aggregate = aggregate_of(term)
            states = [F.col(_state_name(i, j)) for j in range(len(aggregate.states))]
            return aggregate.finish(*states).cast("long").alias(name)
    return hdr.shown(quoted(name)).alias(name)


def finish_report(
    partials: DataFrame, spec: str | ReportSpec = DEFAULT_SPEC, by: Sequence[str] = ()
) -> DataFrame:
    """Report columns from partial state; empty input gives no rows."""
    spec = report_spec(spec)
    groups = _group_columns(spec, by)
    if spec.percentiles:
        along = Window.partitionBy(*groups).orderBy(_BUCKET)
        whole = Window.partitionBy(*groups)
        # Null sizes have no bucket and no rank.
        sized = F.when(F.col(_BUCKET).isNotNull(), F.col(_ROWS)).otherwise(0)
        partials = (
            partials.withColumn("__reached", F.sum(sized).over(along))
            .withColumn("__total", F.sum(sized).over(whole))
            .groupBy(*groups)
            .agg(
                *_merge_columns(spec),
                *_percentile_columns(spec, F.col("__total"), F.col("__reached")),
            )
        )
    if not groups:
        partials = partials.filter(F.col(_ROWS) > 0)
    return partials.select(
        *[F.col(g) for g in groups], *[finished_value(spec, n) for n in spec.value_names]
    )


def report(
    events: DataFrame, spec: str | ReportSpec = DEFAULT_SPEC, by: Sequence[str] = ()
) -> DataFrame:
    """Every group of the events with its aggregates, unordered."""
    spec = report_spec(spec)
    if not spec.value_names:
        keys = [F.col(t.field).cast("string").alias(t.name) for t in spec.keys]
        return events.select(*[F.col(b) for b in by], *keys).distinct()
    return finish_report(partial_report(events, spec, by), spec, by)


def merge_reports(*reports: DataFrame, spec: str | ReportSpec = DEFAULT_SPEC) -> DataFrame:
    """Union of finished reports, merged per group.

    Only ``max``, ``min`` and ``sum`` can be merged from finished values; for the rest keep partial
    reports and use :func:`merge_partials`.
    """
    spec = report_spec(spec)
    functions = {"max": F.max, "min": F.min, "sum": F.sum}
    for term in spec.terms:
        if not term.is_key and term.aggregate not in functions:
            raise BadDescriptor(term.name, "cannot be merged from finished reports")
    union = reduce(DataFrame.unionByName, reports)
    values = [functions[t.aggregate](quoted(t.name)).alias(t.name) for t in spec.aggs]
    merged = union.groupBy(*spec.key_names).agg(F.count(F.lit(1)).alias(_ROWS), *values)
    return merged.filter(F.col(_ROWS) > 0).drop(_ROWS)


def sort_columns(spec: ReportSpec, *columns: int | str) -> list[Column]:
    """Sort order from column names (``-name`` descends) or signed positions.

    Positions count key columns first, then value columns, from 0; a negative one descends.  Ties
    are broken by the key columns, ascending.
    """
    order = []
    for c in columns:
        if isinstance(c, int):
            name, descending = spec.columns[abs(c)], c < 0
        else:
            name, descending = c.removeprefix("-"), c.startswith("-")
        order.append(quoted(name).desc() if descending else quoted(name).asc())
    return order + [quoted(k).asc() for k in spec.key_names]


def sort_by(df: DataFrame, spec: str | ReportSpec, *columns: int | str) -> DataFrame:
    return df.orderBy(*sort_columns(report_spec(spec), *columns))


def ranking(spec: ReportSpec, rank_by: str | None = None) -> list[Column]:
    """Default order: the ranked value descending, then the keys."""
    rank_by = rank_by or spec.rank_by
    return sort_columns(spec, *([f"-{rank_by}"] if rank_by else []))


def above(
    df: DataFrame, spec: ReportSpec, threshold: int | None, rank_by: str | None = None
) -> DataFrame:
    """Rows whose ranked value is at least ``threshold``."""
    rank_by = rank_by or spec.rank_by
    if threshold is None or rank_by is None:
        return df
    return df.filter(quoted(rank_by) >= threshold)


def top_per(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    top: int | None,
    spread: Sequence[str],
    parts: int = 64,
) -> DataFrame:
    """First ``top`` rows of each ``by`` group, or all, with their ``rank``.

    Groups are cut in two steps: each of ``parts`` hash slices of a group keeps its first ``top``
    rows, and only those meet in one task, so no task holds a whole interval's keys. Without ``top``
    rows are ranked in ranges (``plans.ranks``), so no task does then either.
    """
    if top is None:
        return ranked(df, by, order)
    sliced = df.withColumn("__part", F.pmod(F.xxhash64(*[quoted(s) for s in spread]), F.lit(parts)))
    first = Window.partitionBy(*by, "__part").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        sliced.withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") <= top)
        .drop("__rank", "__part")
        .withColumn("rank", F.row_number().over(final).cast("long"))
        .filter(F.col("rank") <= top)
    )


@dataclass(frozen=True)
class HotKeys:
    """Options of a hot-key report; ``run`` applies them to a table of events."""

    format: str | ReportSpec = DEFAULT_SPEC
    filter: str = ""
    top: int | None = None
    threshold: int | None = None
    rank_by: str | None = None
    include_misses: bool = True

    def __post_init__(self):
        spec = report_spec(self.format)
        if self.top is not None and self.top < 0:
            raise ValueError("top must not be negative")
        if self.rank_by is not None and self.rank_by not in spec.value_names:
            raise BadDescriptor(self.rank_by, "not a value of the report")

    @property
    def spec(self) -> ReportSpec:
        return report_spec(self.format)

    def with_filter(self, pattern: str) -> HotKeys:
        """The same report over other keys; results start afresh when it is run."""
        return replace(self, filter=pattern)

    def select(self, events: DataFrame) -> DataFrame:
        return filter_keys(hits_and_misses(events, self.include_misses), self.filter)

    def full(self, events: DataFrame) -> DataFrame:
        """All groups, before threshold and top."""
        return report(self.select(events), self.spec)

    def run(self, events: DataFrame) -> DataFrame:
        """Groups at or above the threshold, ranked, at most ``top`` if that is given."""
        return self.ranked(self.full(events))

    def ranked(self, full: DataFrame) -> DataFrame:
        """All groups of a report cut to the threshold and ranked.

        With ``top`` every task keeps its first rows and one task merges those; without, the whole
        report is sorted in ranges.
        """
        kept = above(full, self.spec, self.threshold, self.rank_by)
        ranked = kept.orderBy(*ranking(self.spec, self.rank_by))
        return ranked if self.top is None else ranked.limit(self.top)


def hot_keys(
    events: DataFrame,
    format: str | ReportSpec = DEFAULT_SPEC,
    *,
    filter: str = "",
    top: int | None = None,
    threshold: int | None = None,
    rank_by: str | None = None,
    include_misses: bool = True,
) -> DataFrame:
    """Busiest keys of a table of events."""
    return HotKeys(format, filter, top, threshold, rank_by, include_misses).run(events)


def totals(full: DataFrame, shown: DataFrame, bytes_column: str, by: Sequence[str] = ()) -> DataFrame:
    """Keys and bytes of a report before and after it was cut, and the share that is left.

    Both sides are reduced to one short row per interval and met in a second aggregation.
    """
    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        counted = df.groupBy(*by).agg(
            F.count(F.lit(1)).alias(f"{mine}_keys"),
            F.coalesce(F.sum(quoted(bytes_column)), F.lit(0)).alias(f"{mine}_bytes"),
        )
        zero = F.lit(0).cast("long")
        return counted.withColumns({f"{other}_keys": zero, f"{other}_bytes": zero})

    names = ["total_keys", "total_bytes", "reported_keys", "reported_bytes"]
    both = side(full, "total", "reported").unionByName(side(shown, "reported", "total"))
    return (
        both.groupBy(*by)
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("reported_percentage", percentage(F.col("reported_bytes"), F.col("total_bytes")))
    )
