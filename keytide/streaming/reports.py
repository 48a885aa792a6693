"""Hot-key reports over streams of events."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce
from operator import and_
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keytide.operators import json_report as J
from keytide.operators import report as R
from keytide.operators.intervals import WINDOW, ranked_intervals
from keytide.sources.jsonl import write_reports
from keytide.streaming.stats import RunningCounters

Sink = Callable[[DataFrame, int], None]


def interval_states(events: DataFrame, hot: R.HotKeys, every: str, delay: str = "0 seconds") -> DataFrame:
    """Partial report per closed interval, for append mode.

    An interval closes when the watermark (latest event time minus ``delay``) passes its end; its
    state is then dropped, and events that come later are dropped and counted by Spark.
    """
    selected = hot.select(events.withWatermark("ts", delay))
    windowed = selected.withColumn("__window", F.window("ts", every))
    states = R.partial_report(windowed, hot.spec, ["__window"])
    return states.select(
        F.col("__window.start").alias("window_start"),
        F.col("__window.end").alias("window_end"),
        *[c for c in states.columns if c != "__window"],
    )


def running_states(events: DataFrame, hot: R.HotKeys) -> DataFrame:
    """Partial report over everything so far, for complete or update mode."""
    return R.partial_report(hot.select(events), hot.spec)


def start_interval_reports(
    events: DataFrame, hot: R.HotKeys, every: str, checkpoint: str, sink: Sink,
    delay: str = "0 seconds", **trigger,
) -> StreamingQuery:
    """Hand each closed interval's ranked report to ``sink(report, batch)``."""

    def emit(states: DataFrame, batch: int) -> None:
        full = R.finish_report(states, hot.spec, WINDOW)
        sink(ranked_intervals(full, hot.spec, hot.top, hot.threshold, hot.rank_by), batch)

    return _start(interval_states(events, hot, every, delay), "append", emit, checkpoint, trigger)


def start_json_reports(
    events: DataFrame, hot: R.HotKeys, every: str, checkpoint: str, path: str | None = None,
    delay: str = "0 seconds", **trigger,
) -> StreamingQuery:
    """Append one JSON line per closed interval to ``path``, or print it.

    Every line has the run's statistics so far and since the last one, from the query's own progress: what was
    counted on the way (``streaming.stats.observe_packets``, ``observe_events``), without that the rows that came
    in, and the rows that came too late.
    """
    counted = replace(hot, format=hot.spec.with_sum())
    counters = _Counters(events.sparkSession, checkpoint)

    def emit(states: DataFrame, batch: int) -> None:
        full = R.finish_report(states, counted.spec, WINDOW)
        _write_json(full, hot, WINDOW, None, path, batch, counters.at(batch, not states.isEmpty()))

    states = interval_states(events, counted, every, delay)
    return counters.of(_start(states, "append", emit, checkpoint, trigger))


def start_running_json_reports(
    events: DataFrame, hot: R.HotKeys, checkpoint: str, path: str | None = None, **trigger
) -> StreamingQuery:
    """Append one JSON line per trigger, over all events so far and stamped with the trigger's time.

    Lines have statistics as those of :func:`start_json_reports`.
    """
    counted = replace(hot, format=hot.spec.with_sum())
    counters = _Counters(events.sparkSession, checkpoint)

    def emit(states: DataFrame, batch: int) -> None:
        full = R.finish_report(states, counted.spec)
        _write_json(full, hot, (), F.current_timestamp(), path, batch, counters.at(batch, True))

    states = running_states(events, counted)
    return counters.of(_start(states, "complete", emit, checkpoint, trigger))


class _Counters:
    """The counters of a query that is about to start."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.running, self.query, self.started = RunningCounters(spark, checkpoint), None, Event()

    def of(self, query: StreamingQuery) -> StreamingQuery:
        self.query = query
        self.started.set()
        return query

    def at(self, batch: int, reported: bool) -> tuple[dict[str, int], dict[str, int]] | None:
        """Counters when ``batch`` is reported; a batch without a report leaves the change to the next one."""
        self.started.wait()
        self.running.advance([json.loads(p.json) for p in self.query.recentProgress])
        return self.running.report(batch) if reported else None


def _write_json(
    full: DataFrame, hot: R.HotKeys, by: Sequence[str], stamp: Column | None, path: str | None, batch: int, stats
) -> None:
    reports = J.json_reports(
        full, hot.spec, by, stamp=stamp, top=hot.top, threshold=hot.threshold, rank_by=hot.rank_by, stats=stats
    )
    # A batch that is repeated after a failure replaces its own files.
    write_reports(reports, path and f"{path}/batch={batch}", "overwrite")


def start_running_reports(
    events: DataFrame, hot: R.HotKeys, checkpoint: str, sink: Sink, **trigger
) -> StreamingQuery:
    """Hand the report over all events so far to ``sink`` at every trigger.

    A top by ``max`` or ``sum`` without percentiles is kept from trigger to trigger: only keys that changed are handed
    over, and meet the last top. That is exact because such values never fall; a negative size, which could lower
    a sum, is an error there. Other reports are made from all keys each time.
    """
    if hot.top is not None and not hot.spec.percentiles and _rising(hot):
        return _start_running_top(events, hot, checkpoint, sink, trigger)

    def emit(states: DataFrame, batch: int) -> None:
        full = R.finish_report(states, hot.spec)
        sink(hot.ranked(full), batch)

    return _start(running_states(events, hot), "complete", emit, checkpoint, trigger)


def _rising(hot: R.HotKeys) -> bool:
    """Whether the ranked value of a key can only grow."""
    name = hot.rank_by or hot.spec.rank_by
    return any(t.name == name and t.aggregate in ("max", "sum") for t in hot.spec.aggs) and bool(hot.spec.key_names)


def _start_running_top(events: DataFrame, hot: R.HotKeys, checkpoint: str, sink: Sink, trigger: dict) -> StreamingQuery:
    """The top of a running report from the keys that changed and the top of the trigger before.

    A key that did not change and was not in the last top ranks behind all of that top, whose values have only
    grown since, so it is in no later top before it changes. Tops are written beside the checkpoint under their
    batch's number, so a batch that is repeated starts from the same one.
    """
    ranked_field = next(t.field for t in hot.spec.aggs if t.name == (hot.rank_by or hot.spec.rank_by))
    size = F.col(ranked_field)
    error = F.raise_error(F.lit("negative size in a running top"))
    checked = events.withColumn(ranked_field, F.when(size < 0, error.cast("long")).otherwise(size))
    folder = f"{checkpoint}-top"

    def emit(states: DataFrame, batch: int) -> None:
        spark = states.sparkSession
        changed = R.finish_report(states, hot.spec)
        last = _newest(spark, folder, batch)
        if last is not None:
            same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in hot.spec.key_names]
            old = spark.read.schema(changed.schema).parquet(f"{folder}/batch={last}")
            changed = changed.unionByName(old.alias("o").join(changed.alias("c"), reduce(and_, same), "left_anti"))
        hot.ranked(changed).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        top = spark.read.schema(changed.schema).parquet(f"{folder}/batch={batch}")
        sink(hot.ranked(top), batch)
        _drop_before(spark, folder, batch)

    return _start(running_states(checked, hot), "update", emit, checkpoint, trigger)


def _batches(spark: SparkSession, folder: str) -> dict[int, object]:
    """Numbers and places of the batches in a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(place)] if files.exists(place) else []
    return {int(p.getName().split("=")[1]): p for p in found if p.getName().startswith("batch=")}


def _newest(spark: SparkSession, folder: str, batch: int) -> int | None:
    return max((n for n in _batches(spark, folder) if n < batch), default=None)


def _drop_before(spark: SparkSession, folder: str, batch: int) -> None:
    """Remove tops that no repeated batch can ask for: all but the last two."""
    kept = _batches(spark, folder)
    for n in sorted(kept)[:-2]:
        if n < batch:
            path = kept[n]
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def start_events(
    events: DataFrame, handler: Sink, checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand every batch of events to ``handler(events, batch)``."""
    return _start(events, "append", handler, checkpoint, trigger)


def _start(states: DataFrame, mode: str, emit: Sink, checkpoint: str, trigger: dict) -> StreamingQuery:
    def once(batch: DataFrame, number: int) -> None:
        # A sink may read the batch more than once; the stateful part runs only once.
        batch.persist()
        try:
            emit(batch, number)
        finally:
            batch.unpersist()

    writer = states.writeStream.outputMode(mode).foreachBatch(once)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
