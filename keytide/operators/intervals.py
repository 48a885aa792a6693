"""Reports per event-time interval, and running reports at every interval's end."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytide.functions.spec import DEFAULT_SPEC, ReportSpec, report_spec
from keytide.operators import report as R
from keytide.plans.cut import cut

WINDOW = ["window_start", "window_end"]


def in_intervals(events: DataFrame, every: str) -> DataFrame:
    """Add the interval each event falls in; intervals are aligned to the epoch in UTC."""
    return (
        events.withColumn("__window", F.window("ts", every))
        .withColumn("window_start", F.col("__window.start"))
        .withColumn("window_end", F.col("__window.end"))
        .drop("__window")
    )


def interval_report(
    events: DataFrame, format: str | ReportSpec = DEFAULT_SPEC, every: str = "1 second"
) -> DataFrame:
    """One report per interval, every interval starting from nothing."""
    return R.report(in_intervals(events, every), format, WINDOW)


def ranked_intervals(
    reports: DataFrame,
    format: str | ReportSpec = DEFAULT_SPEC,
    top: int | None = None,
    threshold: int | None = None,
    rank_by: str | None = None,
) -> DataFrame:
    """Rank the rows of each interval and keep the first ``top`` at or above the threshold."""
    spec = report_spec(format)
    kept = R.above(reports, spec, threshold, rank_by)
    order = R.ranking(spec, rank_by)
    return R.top_per(kept, WINDOW, order, top, spec.key_names or WINDOW)


def cumulative_report(
    events: DataFrame, format: str | ReportSpec = DEFAULT_SPEC, every: str = "1 second"
) -> DataFrame:
    """One report per interval over everything up to that interval's end.

    Events are first reduced to one row per key and interval (and histogram bucket), which is written to the
    checkpoint folder, so events are read once. A key that is idle in an interval repeats its last values, up to
    the last interval of the input. Intervals are counted in microseconds, so clock changes do not matter.
    """
    spec = report_spec(format)
    partials = R.partial_report(in_intervals(events, every), spec, WINDOW)
    local = isinstance(partials.schema["window_start"].dataType, T.TimestampNTZType)
    start, end = (_micros(F.col(c), local) for c in WINDOW)
    partials = cut(partials.select(start.alias(_START), (end - start).alias(_STEP), "*").drop(*WINDOW))
    states = partials
    if spec.percentiles:
        states = partials.groupBy(_START, _STEP, *spec.key_names).agg(*R._merge_columns(spec))
    order = Window.partitionBy(*spec.key_names).orderBy(_START)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    accumulated = states.select(
        *spec.key_names,
        _START,
        _STEP,
        F.lead(_START).over(order).alias("__next"),
        *[
            state.merge(F.col(R._state_name(i, j))).over(so_far).alias(R._state_name(i, j))
            for i, term in enumerate(spec.aggs)
            for j, state in enumerate(R.aggregate_of(term).states)
        ],
    )
    if spec.percentiles:
        quantiles = _running_percentiles(partials, spec)
        renamed = {c: f"{c}__" for c in [*spec.key_names, _START]}
        accumulated = accumulated.join(quantiles.withColumnsRenamed(renamed), _same(renamed))
    last = partials.agg(F.max(_START)).scalar()
    until = F.coalesce(F.col("__next") - F.col(_STEP), last)
    return accumulated.withColumn(_START, F.explode(F.sequence(F.col(_START), until, F.col(_STEP)))).select(
        _time(F.col(_START), local).alias("window_start"),
        _time(F.col(_START) + F.col(_STEP), local).alias("window_end"),
        *spec.key_names,
        *[R.finished_value(spec, n) for n in spec.value_names],
    )


_START, _STEP, _SLICE = "__start", "__step", "__slice"
#: Intervals whose running percentiles are made together.
SLICE_INTERVALS = 64
_BEFORE = -(1 << 62)


def _micros(time: Column, local: bool) -> Column:
    """Microseconds since 1970, of a local time as if in UTC."""
    return F.unix_micros(F.concat(time.cast("string"), F.lit("Z")).cast("timestamp") if local else time)


def _time(micros: Column, local: bool) -> Column:
    if not local:
        return F.timestamp_micros(micros)
    seconds = (micros.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _same(renamed: dict[str, str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in renamed.items()])


def _running_percentiles(partials: DataFrame, spec: ReportSpec) -> DataFrame:
    """Percentiles of each key over all intervals so far, at each interval the key occurs in.

    Intervals are taken in slices. The histogram with which a slice begins is the sum of those before it, bucket
    by bucket, so a key is spread over its buckets; from there a slice is worked on by itself, so a key is
    spread over its slices. No task holds more than one histogram for each interval of a slice.
    """
    keys, quantiles = spec.key_names, [(t.name, t.quantile) for t in spec.percentiles]
    sized = F.col(R._BUCKET).isNotNull()  # null sizes keep their key's row and count for nothing
    rows = partials.select(
        *keys,
        F.floor(F.col(_START) / (F.col(_STEP) * SLICE_INTERVALS)).alias(_SLICE),
        _START,
        F.when(sized, F.col(R._BUCKET)).otherwise(0).alias(R._BUCKET),
        F.when(sized, F.col(R._ROWS)).otherwise(0).alias(R._ROWS),
    )
    counted = rows.groupBy(*keys, _SLICE, R._BUCKET).agg(F.sum(R._ROWS).alias(R._ROWS))
    order = Window.partitionBy(*keys, R._BUCKET).orderBy(_SLICE)
    summed = counted.select(
        *keys, _SLICE, R._BUCKET,
        F.sum(R._ROWS).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(R._ROWS),
        F.lead(_SLICE).over(order).alias("__next"),
    )
    # A sum holds for the slices up to the bucket's next one, or up to the key's last one.
    if keys:
        renamed = {c: f"{c}__" for c in keys}
        lasts = rows.groupBy(*keys).agg(F.max(_SLICE).alias("__last")).withColumnsRenamed(renamed)
        summed = summed.join(lasts, _same(renamed)).drop(*renamed.values())
    else:
        summed = summed.withColumn("__last", rows.agg(F.max(_SLICE)).scalar())
    until = F.coalesce("__next", "__last")
    later = F.explode(F.sequence(F.col(_SLICE) + 1, until))
    before = summed.filter(F.col(_SLICE) < until).withColumn(_SLICE, later)
    before = before.withColumn(_START, F.lit(_BEFORE)).select(*rows.columns)
    together = rows.unionByName(before).repartition(*keys, _SLICE)
    together = together.sortWithinPartitions(*keys, _SLICE)
    out = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField(_START, T.LongType())]
        + [T.StructField(name, T.LongType()) for name, _ in quantiles]
    )
    width = len(keys) + 1  # what tells one slice of a key from another

    def percentiles(starts: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list]:
        """At each interval of a slice; counts before the slice stand at ``_BEFORE``."""
        ticks = np.unique(starts[starts != _BEFORE])
        tops, at = np.unique(buckets, return_inverse=True)
        table = np.zeros((len(tops), len(ticks) + 1), np.int64)
        np.add.at(table, (at, np.where(starts == _BEFORE, 0, np.searchsorted(ticks, starts) + 1)), counts)
        reached = table.cumsum(1)[:, 1:].cumsum(0)
        found = []
        for _, q in quantiles:
            ranks = np.maximum(1, np.floor(q / 100.0 * reached[-1] + 0.5)).astype(np.int64)
            tops_at = tops[(reached >= ranks).argmax(0)]
            found.append(pa.array(tops_at, mask=ranks > reached[-1]))
        return ticks, found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the slice that is being read

        def done(table: pa.Table) -> pa.RecordBatch:
            starts, buckets, counts = (table.column(i).to_numpy() for i in range(width, width + 3))
            ticks, found = percentiles(starts, buckets, counts)
            key = [pa.repeat(table.column(i)[0], len(ticks)) for i in range(width - 1)]
            return pa.RecordBatch.from_arrays([*key, pa.array(ticks), *found], names=out.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            edges = np.zeros(batch.num_rows - 1, bool)
            for i in range(width):
                codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                edges |= np.diff(codes) != 0
            borders = [0, *(np.flatnonzero(edges) + 1).tolist(), batch.num_rows]
            for low, high in zip(borders, borders[1:]):
                part = batch.slice(low, high - low)
                if held and any(part.column(i)[0].as_py() != held[0].column(i)[0].as_py() for i in range(width)):
                    yield done(pa.Table.from_batches(held))
                    held.clear()
                held.append(part)
        if held:
            yield done(pa.Table.from_batches(held))

    return together.mapInArrow(scan, out)
