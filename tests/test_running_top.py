"""Running tops: equal to the batch report, from the keys that changed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keytide.operators import report as R
from keytide.operators.report import HotKeys, hot_keys
from keytide.streaming import reports as SR
from tests.test_streaming import EVENT_SCHEMA, file_stream, write_batches

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows_of(rng, n, keys):
    weights = [1 / (i + 1) for i in range(keys)]
    names = rng.choices([None, *(f"k{i:04d}" for i in range(1, keys))], weights, k=n)
    return [(DAY + dt.timedelta(seconds=i), k, rng.choice([None, 0, rng.randrange(500)])) for i, k in enumerate(names)]


@pytest.mark.parametrize("spec, rank_by", [("key,max(size),sum(size),avg(size)", None), ("key,sum(size),max(size)", "max(size)")])
def test_top_is_that_of_the_batch_report(spark, tmp_path, monkeypatch, spec, rank_by):
    rng, handed = random.Random(3), []
    rows, sizes = rows_of(rng, 4000, 900), [3000, 200, 50, 700, 50]
    write_batches(spark, rows, EVENT_SCHEMA, f"{tmp_path}/in", sizes)
    hot = HotKeys(spec, top=15, rank_by=rank_by, threshold=3)
    finish = R.finish_report

    def counted(states, *rest):
        handed.append(states.count())
        return finish(states, *rest)

    monkeypatch.setattr(R, "finish_report", counted)
    seen = {}

    def run(times):
        events = file_stream(spark, f"{tmp_path}/in", EVENT_SCHEMA).withColumn("type", F.lit("hit"))
        SR.start_running_reports(
            events, hot, f"{tmp_path}/state", lambda report, batch: seen.update({batch: report.collect()}), availableNow=True
        ).awaitTermination()

    run(1)
    monkeypatch.undo()
    at = 0
    for batch, size in enumerate(sizes):
        at += size
        table = spark.createDataFrame(rows[:at], EVENT_SCHEMA).withColumn("type", F.lit("hit"))
        expected = hot_keys(table, spec, top=15, rank_by=rank_by, threshold=3).collect()
        assert seen[batch] == expected and len(expected) == 15, batch
    # Only the keys of a batch's rows are handed over.
    assert handed[: len(sizes)] == [len({r[1] for r in rows[sum(sizes[:i]) : sum(sizes[: i + 1])]}) for i in range(len(sizes))]


def test_negative_sizes_are_refused_and_other_reports_use_all_keys(spark, tmp_path):
    write_batches(spark, [(DAY, "a", 5), (DAY, "b", -1)], EVENT_SCHEMA, f"{tmp_path}/in", [1, 1])
    events = file_stream(spark, f"{tmp_path}/in", EVENT_SCHEMA).withColumn("type", F.lit("hit"))
    query = SR.start_running_reports(
        events, HotKeys("key,sum(size)", top=2), f"{tmp_path}/s1", lambda report, batch: report.collect(), availableNow=True
    )
    with pytest.raises(Exception, match="negative size"):
        query.awaitTermination()
    seen = {}
    SR.start_running_reports(
        events, HotKeys("key,avg(size)", top=2), f"{tmp_path}/s2", lambda report, batch: seen.update({batch: report.collect()}),
        availableNow=True,
    ).awaitTermination()
    assert [tuple(r) for r in seen[1]] == [("a", 5), ("b", -1)]
