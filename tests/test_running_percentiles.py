"""Running percentiles: hot and missing keys, clock changes, null keys and sizes, one reading of the events."""

import datetime as dt
import math
import random

import pytest

from keytide.functions.hdr import MAX_VALUE, OVERFLOW
from keytide.operators import intervals as I

UTC = dt.timezone.utc


def top_of(size):
    size = min(size, MAX_VALUE)
    shift = max(0, size.bit_length() - 11)
    return (size >> shift << shift) + (1 << shift) - 1


def brute(rows, step, quantiles, keyed):
    """``(start, key) -> values`` at every interval from a key's first to the last of all."""
    start = lambda ts: int(ts.timestamp()) // step * step
    last, out = max(start(r[2]) for r in rows), {}
    for key in {r[0] if keyed else "" for r in rows}:
        own = [r for r in rows if not keyed or r[0] == key]
        for tick in range(min(start(r[2]) for r in own), last + 1, step):
            sizes = sorted(r[1] for r in own if start(r[2]) <= tick and r[1] is not None)
            values = []
            for q in quantiles:
                rank = max(1, math.floor(q / 100 * len(sizes) + 0.5))
                top = top_of(sizes[rank - 1]) if rank <= len(sizes) else None
                values.append(OVERFLOW if top is not None and top >= MAX_VALUE else top)
            out[tick, key] = (max(sizes, default=None), *values)
    return out


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("spec, keyed", [("key,max(size),p50(size),p99(size)", True), ("max(size),p50(size),p99(size)", False)])
def test_running_percentiles_match_brute_force(spark, monkeypatch, zone, spec, keyed):
    monkeypatch.setattr(I, "SLICE_INTERVALS", 3)
    rng, rows = random.Random(7), []
    first = dt.datetime(2024, 11, 2, 20, tzinfo=UTC)  # New York's clocks are set back ten hours later
    for _ in range(400):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        size = rng.choice([None, 0, rng.randrange(2000), rng.randrange(10**5), 2**26 + 5])
        rows.append((key, size, first + dt.timedelta(seconds=rng.randrange(60 * 3600) ** 2 // (60 * 3600))))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = spark.createDataFrame(rows, "key string, size long, ts timestamp")
        found = I.cumulative_report(events, spec, "1 hour").selectExpr(
            "unix_seconds(window_start) AS s", "unix_seconds(window_end) AS e", "*").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert all(r["e"] - r["s"] == 3600 for r in found)
    mine = {(r["s"], r["key"] if keyed else ""): (r["max(size)"], r["p50(size)"], r["p99(size)"]) for r in found}
    assert len(mine) == len(found) and mine == brute(rows, 3600, (50, 99), keyed)


def test_empty_input(spark):
    events = spark.createDataFrame([], "key string, size long, ts timestamp")
    assert I.cumulative_report(events, "key,sum(size),p50(size)", "1 hour").count() == 0
    assert I.cumulative_report(events, "sum(size),p50(size)", "1 hour").count() == 0


def test_events_are_read_once(spark, tmp_path):
    rows = [(f"k{i % 5}", i, dt.datetime(2024, 1, 1, i % 24, tzinfo=UTC)) for i in range(100)]
    spark.createDataFrame(rows, "key string, size long, ts timestamp").write.parquet(f"{tmp_path}/e.parquet")
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    events = spark.read.parquet(f"{tmp_path}/e.parquet")
    events = events.mapInArrow(counted, events.schema)
    assert I.cumulative_report(events, "key,sum(size),p50(size)", "1 hour").count() > 100
    assert counter.value == 100
