"""Streams: the same results as batch, whatever the batches are."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keytide.operators.conversations import extract_events
from keytide.operators.events import as_events
from keytide.operators.intervals import interval_report, ranked_intervals
from keytide.operators.report import HotKeys, hot_keys
from keytide.streaming import reports as SR
from keytide.streaming.decode import cache_events, stream_events
from keytide.streaming.stats import StatsListener, observe_events, observe_packets
from tests.traffic import SCHEMA, Wire, bulk, events, random_exchanges, resp

EVENT_SCHEMA = "ts timestamp, key string, size long"


def write_batches(spark, rows, schema, folder, sizes):
    """Write consecutive rows as one file per batch."""
    at = 0
    for i, size in enumerate(sizes):
        part = rows[at : at + size]
        at += size
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/b{i:03d}")
    assert at >= len(rows)


def file_stream(spark, folder, schema):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(str(folder))
    )


def run_memory(stream, name, checkpoint, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def conversations(seed):
    exchanges, want = random_exchanges(seed, 30)
    wire = Wire()
    wire.talk(exchanges, piece=131, isn=(2**32 - 700, 2**32 - 2000), rng=random.Random(seed))
    wire.talk(
        [
            (resp(b"get", b"a") + resp(b"PING") + resp(b"MGET", b"x", b"y"),
             bulk(b"1" * 500) + b"+PONG\r\n*2\r\n$-1\r\n" + bulk(b"22")),
            (resp(b"LRANGE", b"l"), b"*2\r\n*1\r\n" + bulk(b"q") + b"*0\r\n"),
            (resp(b"SET", b"k", b"v" * 3000), b"+OK\r\n"),
            (resp(b"get", b"none"), b"$-1\r\n"),
        ],
        port=6379, client_port=41000, piece=70,
    )
    want += [("hit", "a", 500), ("miss", "x", 0), ("hit", "y", 2), ("miss", "none", 0)]
    rows = sorted(wire.rows, key=lambda r: (r[2], r[1]))
    return rows, sorted(want)


@pytest.mark.parametrize("seed,size", [(11, 40), (12, 1000)])
def test_stream_decode_equals_batch(spark, tmp_path, seed, size):
    rows, want = conversations(seed)
    write_batches(spark, rows, SCHEMA, tmp_path / "in", [size] * (len(rows) // size + 1))
    stream = stream_events(file_stream(spark, tmp_path / "in", SCHEMA))
    found = run_memory(cache_events(stream), f"decode{seed}", tmp_path / "ck")
    assert events(found) == want
    assert events(extract_events(spark.createDataFrame(rows, SCHEMA))) == want


def test_stream_loss_overflow_and_idle(spark, tmp_path):
    """A lost packet is given up once too much waits behind it; an idle connection is closed."""
    wire = Wire()
    exchanges = [(b"get k%d\r\n" % i, b"VALUE k%d 0 400\r\n%s\r\nEND\r\n" % (i, b"x" * 400)) for i in range(30)]
    wire.talk(exchanges, piece=100000)
    lost = next(r for r in wire.rows if r[12].startswith(b"VALUE k5 "))
    rows = [r for r in wire.rows if r is not lost]
    other = Wire()
    other.talk([(b"get z\r\n", b"VALUE z 0 1\r\n1\r\nEND\r\n")], client_port=45000, us=300_000_000)
    other.talk([(b"get z\r\n", b"VALUE z 0 1\r\n1\r\nEND\r\n")], client_port=45001, us=600_000_000)
    write_batches(spark, rows + other.rows, SCHEMA, tmp_path / "in", [len(rows), 4, 4])
    stream = stream_events(file_stream(spark, tmp_path / "in", SCHEMA), max_pending=2000)
    found = run_memory(stream, "losses", tmp_path / "ck")
    lost_rows = found.filter("type = 'lost'").agg({"lost": "sum"}).first()[0]
    assert lost_rows == len(lost[12])
    keys = {r["key"] for r in found.filter("type = 'hit'").collect()}
    assert {f"k{i}" for i in range(5)} <= keys and "k5" not in keys and "k29" in keys and "z" in keys


def test_interval_reports_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    base = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS t").first()["t"]
    import datetime as dt

    rows = [(base + dt.timedelta(seconds=i / 10), f"k{rng.randrange(5)}", rng.randrange(5000)) for i in range(600)]
    closing = [(base + dt.timedelta(hours=1), "last", 1)]
    write_batches(spark, rows + closing, EVENT_SCHEMA, tmp_path / "in", [250, 250, 101])
    hot = HotKeys("key,max(size),sum(size),avg(size),p50(size),p95(size)", top=3, threshold=10)
    stream = as_events(file_stream(spark, tmp_path / "in", EVENT_SCHEMA), "key", "size", "ts")
    out = str(tmp_path / "out")
    SR.start_interval_reports(
        stream, hot, "10 seconds", str(tmp_path / "ck"),
        lambda report, batch: report.write.mode("overwrite").parquet(f"{out}/batch={batch}"),
        availableNow=True,
    ).awaitTermination()
    found = spark.read.parquet(out).drop("batch")
    batch = as_events(spark.createDataFrame(rows, EVENT_SCHEMA), "key", "size", "ts")
    want = ranked_intervals(interval_report(batch, hot.spec, "10 seconds"), hot.spec, 3, 10)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_json_lines_per_interval(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(base, "a", 10), (base, "b", 5), (base + dt.timedelta(seconds=1), "a", 1),
            (base + dt.timedelta(seconds=60), "z", 1)]
    write_batches(spark, rows, EVENT_SCHEMA, tmp_path / "in", [2, 2])
    stream = as_events(file_stream(spark, tmp_path / "in", EVENT_SCHEMA), "key", "size", "ts")
    SR.start_json_reports(
        stream, HotKeys(top=1), "1 second", str(tmp_path / "ck"), str(tmp_path / "out"), availableNow=True
    ).awaitTermination()
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    lines.sort(key=lambda x: x["Timestamp"])
    assert [x["Timestamp"] for x in lines] == ["2024-01-01T00:00:01Z", "2024-01-01T00:00:02Z"]
    assert lines[0]["TotalKeys"] == 2 and lines[0]["ReportedKeys"] == 1
    assert lines[0]["TotalBandwidth"] == 15 and lines[0]["ReportedBandwidth"] == 10
    assert lines[0]["Rows"] == [{"key": "a", "max(size)": 10, "sum(size)": 10}]


def test_running_reports(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(base, f"k{i % 3}", i) for i in range(30)]
    write_batches(spark, rows, EVENT_SCHEMA, tmp_path / "in", [10, 20])
    stream = as_events(file_stream(spark, tmp_path / "in", EVENT_SCHEMA), "key", "size", "ts")
    seen = []
    SR.start_running_reports(
        stream, HotKeys("key,sum(size),p50(size)"), str(tmp_path / "ck"),
        lambda report, batch: seen.append(list(map(tuple, report.collect()))), availableNow=True,
    ).awaitTermination()
    batch = as_events(spark.createDataFrame(rows, EVENT_SCHEMA), "key", "size")
    assert len(seen) == 2
    assert seen[-1] == list(map(tuple, hot_keys(batch, "key,sum(size),p50(size)").collect()))


def test_running_json_reports(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(base, f"k{i % 3}", i) for i in range(30)]
    write_batches(spark, rows, EVENT_SCHEMA, tmp_path / "in", [10, 20])
    stream = as_events(file_stream(spark, tmp_path / "in", EVENT_SCHEMA), "key", "size", "ts")
    SR.start_running_json_reports(
        stream, HotKeys("key,max(size)", top=1), str(tmp_path / "ck"), str(tmp_path / "out"), availableNow=True
    ).awaitTermination()
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).orderBy("batch").collect()]
    assert [x["TotalBandwidth"] for x in lines] == [sum(range(10)), sum(range(30))]
    assert [x["Rows"] for x in lines] == [[{"key": "k0", "max(size)": 9}], [{"key": "k2", "max(size)": 29}]]


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    # Spark compares events with the watermark of the batch before, hence the batch in between.
    rows = [(base, "a", 1), (base + dt.timedelta(seconds=100), "b", 1), (base + dt.timedelta(seconds=101), "d", 1),
            (base, "late", 1), (base + dt.timedelta(seconds=200), "c", 1)]
    write_batches(spark, rows, EVENT_SCHEMA, tmp_path / "in", [2, 1, 1, 1])
    seen = []
    listener = StatsListener(lambda total, change: seen.append((total, change)))
    spark.streams.addListener(listener)
    try:
        raw = file_stream(spark, tmp_path / "in", EVENT_SCHEMA)
        raw = observe_packets(raw, F.col("key") != "b", F.col("key") == "a")
        stream = observe_events(as_events(raw, "key", "size", "ts"))
        out = []
        SR.start_interval_reports(
            stream, HotKeys(), "1 second", str(tmp_path / "ck"),
            lambda report, batch: out.extend(r["key"] for r in report.collect()), availableNow=True,
        ).awaitTermination()
        for _ in range(50):
            if seen and seen[-1][0]["PacketsEnteredFilter"] == 5 and seen[-1][0]["PacketsDroppedAnalysis"]:
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert "late" not in out and "a" in out
    total = seen[-1][0]
    assert total["PacketsEnteredFilter"] == 5 and total["PacketsCaptured"] == 4
    assert total["ResponsesParsed"] == 5 and total["PacketsDroppedParser"] == 1
    assert total["PacketsDroppedAnalysis"] == 1 and total["PacketsDroppedTotal"] == 2


def test_event_handler(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1), "a", i) for i in range(5)]
    write_batches(spark, rows, EVENT_SCHEMA, tmp_path / "in", [2, 3])
    counts = []
    stream = as_events(file_stream(spark, tmp_path / "in", EVENT_SCHEMA), "key", "size", "ts")
    SR.start_events(
        stream, lambda frame, batch: counts.append(frame.count()), str(tmp_path / "ck"), availableNow=True
    ).awaitTermination()
    assert counts == [2, 3]
