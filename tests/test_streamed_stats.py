"""Statistics in streamed JSON reports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from keytide.operators.report import HotKeys
from keytide.operators.stats import COUNTERS
from keytide.streaming import reports as SR
from keytide.streaming.stats import observe_events, observe_packets
from tests.test_streaming import EVENT_SCHEMA, file_stream, write_batches

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows_of(*minutes):
    return [(DAY + dt.timedelta(minutes=m), f"k{i % 3}", 10 + i) for i, m in enumerate(minutes)]


def lines_of(spark, folder):
    rows = spark.read.text(f"{folder}/out").collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda o: o["Timestamp"])


@pytest.mark.parametrize("observed", [False, True])
def test_each_line_has_both_parts(spark, tmp_path, observed):
    # The third batch has three rows of one minute and key that is over; the fourth closes two intervals at once.
    batches = [rows_of(0, 0, 1), rows_of(2, 2), rows_of(0, 0, 0, 3)[:1] * 3 + rows_of(3), rows_of(6), rows_of(9)]
    write_batches(spark, sum(batches, []), EVENT_SCHEMA, f"{tmp_path}/in", [len(b) for b in batches])

    def run():
        stream = file_stream(spark, f"{tmp_path}/in", EVENT_SCHEMA)
        if observed:
            stream = observe_packets(stream, F.col("key") != "k2", F.col("key") == "k1")
            stream = observe_events(stream.filter("key <> 'k2'"))
        events = stream.withColumn("type", F.lit("hit"))
        SR.start_json_reports(
            events, HotKeys("key,sum(size)"), "1 minute", f"{tmp_path}/state", f"{tmp_path}/out", availableNow=True
        ).awaitTermination()

    run()
    first = lines_of(spark, tmp_path)
    write_batches(spark, rows_of(12) + rows_of(15), EVENT_SCHEMA, f"{tmp_path}/in/more", [1, 1])
    run()  # goes on from the counters that were kept
    lines = lines_of(spark, tmp_path)
    assert len(first) >= 4 and lines[: len(first)] == first and len(lines) > len(first)
    so_far = dict.fromkeys(COUNTERS, 0)
    for line in lines:
        assert list(line["Stats"]) == ["Culumative", "Incremental"]
        change = line["Stats"]["Incremental"]
        assert list(change) == COUNTERS
        so_far = {n: v + change[n] for n, v in so_far.items()}
        if any(change.values()):
            assert so_far == line["Stats"]["Culumative"]
    assert so_far == lines[-1]["Stats"]["Culumative"]
    if observed:
        assert 0 < so_far["PacketsDroppedParser"] < so_far["PacketsCaptured"] < so_far["PacketsEnteredFilter"]
    else:
        assert so_far["PacketsEnteredFilter"] == so_far["ResponsesParsed"] >= sum(map(len, batches)) - 1
        assert so_far["PacketsDroppedAnalysis"] >= 1


def test_running_reports_have_statistics(spark, tmp_path):
    write_batches(spark, rows_of(0, 1, 2, 3), EVENT_SCHEMA, f"{tmp_path}/in", [2, 1, 1])
    events = file_stream(spark, f"{tmp_path}/in", EVENT_SCHEMA).withColumn("type", F.lit("hit"))
    SR.start_running_json_reports(
        events, HotKeys("key,sum(size)"), f"{tmp_path}/state", f"{tmp_path}/out", availableNow=True
    ).awaitTermination()
    seen = [line["Stats"]["Culumative"]["ResponsesParsed"] for line in lines_of(spark, tmp_path)]
    assert seen == sorted(seen) and seen[0] == 0 and len(seen) >= 3 and seen[-1] >= 3
