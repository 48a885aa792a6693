"""Specs, aggregates, filters, order, totals, intervals, JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keytide.functions import hdr, text
from keytide.functions.patterns import BadPattern, check_pattern, java_pattern
from keytide.functions.spec import BadDescriptor, quantile_of, report_spec
from keytide.operators import intervals as I
from keytide.operators import json_report as J
from keytide.operators import report as R
from keytide.operators.events import as_events, filter_keys
from keytide.plans.scan import running
from keytide.sources.jsonl import write_reports


def sizes(spark, rows):
    return as_events(spark.createDataFrame(rows, "k string, s long"), "k", "s")


def test_flat_key(spark):
    row = spark.sql("SELECT 'key1' AS key, 20L AS size").select(text.flat_key(F.col("key"), F.col("size"))).first()
    assert row[0] == "key1\0" + "20\0"


def test_max_sum_avg(spark):
    events = sizes(spark, [("key1", n) for n in (10, 10, 10, 10, 60)])
    assert R.report(events, "key, max(size), sum(size), avg(size)").collect() == [("key1", 60, 100, 20)]


def test_percentiles_without_key(spark):
    events = sizes(spark, [("a", n) for n in (0, 10, 20, 30, 40)])
    assert R.report(events, "p50(size), p90(size)").collect() == [(20, 40)]


def test_average_truncates_toward_zero(spark):
    events = sizes(spark, [("a", -3), ("a", -4), ("b", 7), ("b", 8)])
    assert sorted(R.report(events, "key,avg(size)").collect()) == [("a", -3), ("b", 7)]


def test_percentile_rank_and_range(spark):
    three = sizes(spark, [("a", n) for n in (1, 2, 3)])
    assert R.report(three, "p75(size)").collect() == [(2,)]
    large = sizes(spark, [("a", 3000), ("a", hdr.MAX_VALUE), ("a", 10**12)])
    assert R.report(large, "p10(size),p99(size)").collect() == [(3001, hdr.OVERFLOW)]
    with pytest.raises(Exception, match="negative"):
        R.report(sizes(spark, [("a", -1)]), "p50(size)").collect()


def test_sum_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        R.report(sizes(spark, [("a", 2**62)] * 3), "key,sum(size)").collect()


def test_empty_input(spark):
    none = sizes(spark, [])
    for spec in ("key,max(size)", "max(size)", "p50(size)", "key"):
        assert R.report(none, spec).collect() == []


@pytest.mark.parametrize(
    "spec",
    ["", "keys", "Key", "max(key)", "mean(size)", "p5(size)", "px(size)", "max( size)", "key,key",
     "max(size),max(size)", "MAX(size)", "max(size", "p(size)", "max(other)"],
)
def test_bad_specs(spec):
    with pytest.raises(BadDescriptor):
        report_spec(spec)


def test_percentile_descriptors():
    assert [quantile_of(p) for p in ("p50", "p995", "p9999", "p100", "p005")] == [50.0, 99.5, 99.99, 10.0, 0.5]


def test_values_follow_spec_order(spark):
    spec = report_spec("size, key, sum(size)")
    assert spec.columns == ["size", "key", "sum(size)"]
    assert R.report(sizes(spark, [("a", 1), ("a", 1)]), spec).collect() == [("1", "a", 2)]


@pytest.mark.parametrize(
    "pattern,key,kept",
    [("", "hello", True), ("", "", True), ("world", "hello world", True), ("world", "hello nurse", False),
     ("(?P<a>x)y", "xy", True), ("[[:alpha:]]+$", "12ab", True), ("[[:^digit:]]", "12", False), ("a$", "a\n", False),
     (r"[a[&&]", "[", True), (r"^\Qa.b\E", "a.b", True), ("(?m)^b$", "a\nb\nc", True), ("a.b", "a\rb", True),
     ("a.b", "a\nb", False), ("[]a]", "]", True), (r"\$", "$", True), ("[$]", "$", True),
     (r"\s", "\v", False), (r"\s", "\t", True), (r"[\s]", "\v", False), (r"\S", "\v", True),
     (r"[^\S]", "\v", False), (r"[^\S]", " ", True), (r"\v", "\n", False), (r"\v", "\v", True),
     (r"^\x41+$", "AA", True), (r"^\x{41}+$", "AA", True), (r"^\101\0$", "A\0", True),
     (r"^\p{Greek}+$", "αβ", True), (r"\p{Greek}", "a", False), (r"\PL", "a", False),
     (r"\p{^L}", "1", True), (r"\pL", "a", True), (r"\-\_", "-_", True)],
)
def test_patterns(spark, pattern, key, kept):
    events = sizes(spark, [(key, 1)])
    assert (filter_keys(events, pattern).count() == 1) is kept


@pytest.mark.parametrize("pattern", ["[abc", "(a", "a**", r"(a)\1", "(?=a)", "(?<!a)b", "a++", "[[:nope:]]"])
def test_bad_patterns(spark, pattern):
    events = sizes(spark, [("foobar", 1)])
    with pytest.raises(BadPattern):
        filter_keys(events, pattern)
    assert events.count() == 1
    with pytest.raises(BadPattern):
        check_pattern(spark, pattern)


@pytest.mark.parametrize("letter", "CEGHIJKLMNORTUVXYZceghijklmoquwyZ89".replace("w", ""))
def test_unknown_escapes(letter):
    with pytest.raises(BadPattern):
        java_pattern(f"a\\{letter}")


@pytest.mark.parametrize("pattern", [r"[\b]", r"[\A]", r"[\Qa\E]", r"\x4", r"\p", "é\\é", "a\\"])
def test_bad_escapes(pattern):
    with pytest.raises(BadPattern):
        java_pattern(pattern)


def test_posix_only_inside_class():
    assert java_pattern("[:alpha:]") == "(?d)[:alpha:]"


def test_sort_positions_and_ties(spark):
    events = sizes(spark, [("a", 1), ("b", 5), ("c", 5), ("d", 2), ("d", 3)])
    spec = report_spec("key,max(size),sum(size)")
    rows = R.sort_by(R.report(events, spec), spec, -2, 1).collect()
    assert [r["key"] for r in rows] == ["d", "b", "c", "a"]
    rows = R.sort_by(R.report(events, spec), spec, "-key").collect()
    assert [r["key"] for r in rows] == ["d", "c", "b", "a"]


def test_threshold_and_top(spark):
    events = sizes(spark, [(f"k{i}", i) for i in range(10)])
    assert [r[0] for r in R.hot_keys(events, threshold=7).collect()] == ["k9", "k8", "k7"]
    assert [r[0] for r in R.hot_keys(events, top=2).collect()] == ["k9", "k8"]
    assert [r[0] for r in R.hot_keys(events, "key,min(size)", threshold=9).collect()] == ["k9"]
    assert R.hot_keys(events, top=0).collect() == []
    with pytest.raises(ValueError):
        R.HotKeys(top=-1)
    with pytest.raises(BadDescriptor):
        R.HotKeys(rank_by="max(other)")


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_reports_are_whole_at_any_partition_count(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        events = sizes(spark, [("a", 5), ("b", None), (None, 7), ("c", 1), ("a", None)])
        found = R.hot_keys(events, "key,max(size),p50(size)").collect()
        assert [tuple(r) for r in found] == [(None, 7, 7), ("a", 5, 5), ("c", 1, 1), ("b", None, None)]
        assert [r[0] for r in R.hot_keys(events, "key,max(size)", top=2).collect()] == [None, "a"]
        many = events.sparkSession.range(70_000).selectExpr(
            "cast(id as string) AS key", "id + 1 AS size", "'hit' AS type", "timestamp_seconds(0) AS ts"
        )
        assert R.hot_keys(many, "key,sum(size)", threshold=1).count() == 70_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_with_filter_starts_afresh(spark):
    events = sizes(spark, [("a1", 1), ("b1", 2)])
    hot = R.HotKeys(filter="^a")
    assert [r[0] for r in hot.run(events).collect()] == ["a1"]
    assert [r[0] for r in hot.with_filter("^b").run(events).collect()] == ["b1"]


def test_one_key_holds_most_rows(spark):
    """A hot key next to many others gives the same report however the rows are spread."""
    rows = [("hot", i % 5000) for i in range(20000)] + [(f"k{i}", i) for i in range(3000)]
    spec = "key,max(size),sum(size),avg(size),p50(size),p99(size)"
    events = sizes(spark, rows)
    found = [sorted(R.report(events.repartition(n), spec).collect()) for n in (1, 7, 40)]
    assert found[0] == found[1] == found[2]
    hot = next(r for r in found[0] if r[0] == "hot")
    assert hot[1:4] == (4999, sum(i % 5000 for i in range(20000)), 2499)


def test_merge_of_finished_reports(spark):
    a, b = sizes(spark, [("x", 1), ("y", 5)]), sizes(spark, [("x", 4)])
    spec = "key,max(size),min(size),sum(size)"
    merged = R.merge_reports(R.report(a, spec), R.report(b, spec), spec=spec)
    assert sorted(merged.collect()) == [("x", 4, 1, 5), ("y", 5, 5, 5)]
    with pytest.raises(BadDescriptor):
        R.merge_reports(R.report(a, "key,avg(size)"), spec="key,avg(size)")


def test_cumulative_keeps_idle_keys(spark):
    rows = [("a", 1, 0), ("b", 2, 1), ("a", 3, 3)]
    frame = spark.createDataFrame(rows, "k string, s long, t long").withColumn("ts", F.timestamp_seconds("t"))
    found = I.cumulative_report(as_events(frame, "k", "s", "ts"), "key,sum(size),p50(size)", "1 second")
    seconds = found.select(F.unix_seconds("window_end").alias("t"), "key", "`sum(size)`", "`p50(size)`")
    assert sorted(map(tuple, seconds.collect())) == [
        (1, "a", 1, 1), (2, "a", 1, 1), (2, "b", 2, 2), (3, "a", 1, 1), (3, "b", 2, 2), (4, "a", 4, 1), (4, "b", 2, 2),
    ]


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_brute_force(spark, bucket_rows, inclusive):
    rng = random.Random(bucket_rows)
    rows = [(rng.choice("aab"), i, rng.randrange(-5, 9), rng.choice([None, i])) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, i long, v long, o long")
    kinds = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "la": ("last", F.col("o"))}
    found = running(frame, ["k"], F.floor(F.col("i") / bucket_rows), [F.col("i")], kinds, inclusive)
    for r in found.collect():
        before = [x for x in rows if x[0] == r["k"] and (x[1] < r["i"] or inclusive and x[1] == r["i"])]
        values, known = [x[2] for x in before], [x[3] for x in before if x[3] is not None]
        assert r["s"] == sum(values)
        assert (r["hi"], r["lo"]) == ((max(values), min(values)) if values else (None, None))
        assert r["la"] == (known[-1] if known else None)


def test_json_report_lines(spark, tmp_path):
    events = sizes(spark, [("b", 5), ("a", 10), ("c", 1)])
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp")
    reports = J.json_reports(R.report(events), stamp=stamp, top=2)
    for _ in range(2):
        write_reports(reports, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 2
    assert lines[0] == {
        "Timestamp": "2024-05-06T07:08:09Z", "TotalKeys": 3, "TotalBandwidth": 16, "ReportedKeys": 2,
        "ReportedBandwidth": 15, "ReportedBandwidthPercentage": 93.75,
        "Rows": [{"key": "a", "max(size)": 10, "sum(size)": 10}, {"key": "b", "max(size)": 5, "sum(size)": 5}],
    }


def test_json_report_without_rows(spark, capsys):
    events = sizes(spark, [("b", 5)])
    reports = J.json_reports(R.report(events), stamp=F.lit("2024-05-06").cast("timestamp"), threshold=9)
    row = reports.first()
    assert row["Rows"] == [] and row["ReportedBandwidthPercentage"] == 0.0 and row["TotalKeys"] == 1
    write_reports(reports)
    assert "TotalKeys" in capsys.readouterr().out


def test_resp_values(spark):
    from keytide.operators.resp import decode_resp

    cases = [
        (b"+OK\r\n", 0, [([], "status", b"OK", None, None)]),
        (b"-ERR x\r\n", 0, [([], "error", b"ERR x", None, None)]),
        (b":123\r\n", 0, [([], "int", None, 123, None)]),
        (b":1", 0, [([], "short", None, None, None)]),
        (b"*2\r\n*1\r\n$7\r\nValue 1\r\n*2\r\n+hello\r\n+world\r\n", 9, [
            ([0, 0], "bulk", b"Value 1", None, 7), ([1, 0], "status", b"hello", None, None),
            ([1, 1], "status", b"world", None, None)]),
        (b"$5\r\nhello\r\n", 1024, [([], "bulk", b"hello", None, 5)]),
        (b"$65536\r\n" + b"\0" * 65536 + b"\r\n", 1024, [([], "bulk", None, None, 65536)]),
        (b"$65536\r\n" + b"\0" * 65536 + b"\r\n", 65536, [([], "bulk", b"\0" * 65536, None, 65536)]),
        (b"*1\r\n" * 8 + b":1\r\n", 0, [([0] * 7, "bad", None, None, None)]),
        (b"*1\r\n" * 6 + b":1\r\n", 0, [([0] * 6, "int", None, 1, None)]),
        (b"*0\r\n", 0, [([], "array", None, None, 0)]),
        (b"*-1\r\n", 0, [([], "nil", None, None, None)]),
        (b"hello\r\n", 0, [([], "bad", None, None, None)]),
    ]
    for data, limit, want in cases:
        frame = spark.createDataFrame([(1, data)], "id int, payload binary")
        rows = decode_resp(frame, capture=limit).collect()
        found = [(r["path"], r["tag"], r["bytes"] and bytes(r["bytes"]), r["number"], r["length"]) for r in rows]
        assert found == want


def test_lines_of_text(spark):
    from keytide.operators.lines import split_lines

    frame = spark.createDataFrame([("hello\nworld\n",), ("hello\r\n\nrest",), ("hello",)], "text string")
    assert [r["line"] for r in split_lines(frame).collect()] == ["hello", "world", "hello", ""]


def test_own_protocol(spark):
    """A registered protocol takes part like a built-in one."""
    from keytide.functions import protocols as P
    from keytide.operators.conversations import extract_events
    from tests.traffic import Wire, events

    def request(data, at):
        text, end = P.line(data, at)
        return P.Message("get", end, end, unit=True)

    def reply(data, at):
        text, end = P.line(data, at)
        if text.startswith(b"="):
            return P.Message("value", end, end, text[1:], len(text) - 1)
        return P.Message("line", end, end, unit=True)

    P.register_protocol("toy", P.Protocol(request, reply))
    try:
        wire = Wire()
        wire.talk([(b"?\n", b"=abc\n=de\n.\n"), (b"?\n", b".\n")])
        assert events(extract_events(wire.table(spark), "toy")) == [("hit", "abc", 3), ("hit", "de", 2)]
    finally:
        P._PROTOCOLS.pop("toy")


def test_cut_needs_a_shared_folder(spark):
    from keytide.plans.cut import cut

    frame = spark.range(5)
    assert cut(frame).count() == 5


def test_lines_pair_by_ordinal_until_quit(spark):
    from keytide.operators.lines import events_of_lines

    client = ["get a b", "set a 0 0 3 noreply", "stats", "?!", "get c", "quit", "get d"]
    server = ["VALUE a 0 1", "VALUE b 0 2", "END", "STAT x 1", "END", "VALUE c 0 3", "END", "VALUE d 0 4", "END"]
    rows = [("x", False, i, line) for i, line in enumerate(client)]
    rows += [("x", True, i, line) for i, line in enumerate(server)]
    lines = spark.createDataFrame(rows, "conn string, from_server boolean, msg_no long, line string")
    found = events_of_lines(lines).select("key", "size").collect()
    assert sorted(found) == [("a", 1), ("b", 2), ("c", 3)]


def test_connection_labels(spark):
    from keytide.operators.frames import conn_label, peer_label, with_connection

    rows = [("10.0.0.1", 6379, "10.0.0.2", 40000), ("10.0.0.2", 40000, "10.0.0.1", 6379)]
    packets = spark.createDataFrame(rows, "src_ip string, src_port int, dst_ip string, dst_port int")
    found = with_connection(packets).select("from_server", conn_label(F.col("conn")), peer_label(F.col("conn")))
    label = "10.0.0.1:6379 -> 10.0.0.2:40000"
    assert sorted(found.collect()) == [(False, label, "10.0.0.2:40000"), (True, label, "10.0.0.2:40000")]


def test_drop_label(spark):
    row = spark.range(1).select(
        text.drop_label(F.lit(1), F.lit(2), F.lit(0), F.lit(1000)).alias("label"),
        text.drop_rate(F.lit(3), F.lit(0)).alias("none"),
    ).first()
    assert row["label"] == "Dropped: 1+2+0=3 ( 0.30%)" and row["none"] == 0.0


def test_cumulative_percentiles_keep_null_keys_and_sizes(spark):
    rows = [(None, 7, 0), ("a", 1, 0), ("a", None, 1), ("b", None, 0)]
    events = spark.createDataFrame(rows, "key string, size long, s long").selectExpr(
        "key", "size", "'hit' AS type", "timestamp_seconds(s) AS ts"
    )
    found = I.cumulative_report(events, "key,max(size),p50(size)", "1 second").drop("window_end")
    got = sorted(((str(r[1]), r[2], r[3]) for r in found.collect()), key=repr)
    assert got == sorted([("None", 7, 7), ("a", 1, 1), ("b", None, None)] * 2, key=repr)


def test_json_totals_are_bytes(spark):
    events = sizes(spark, [("a", 1 << 40), ("b", 1 << 41), ("b", 1)])
    spec = report_spec("key,p95(size)")
    stamp = F.lit("2024-05-06").cast("timestamp")
    row = J.json_reports(R.report(events, spec.with_sum()), spec, stamp=stamp, top=1).first()
    assert (row["TotalKeys"], row["TotalBandwidth"]) == (2, (1 << 40) + (1 << 41) + 1)
    assert [r.asDict() for r in row["Rows"]] == [{"key": "a", "p95(size)": (1 << 63) - 1}]
    with pytest.raises(ValueError):
        J.json_reports(R.report(events, spec), spec, stamp=stamp)


def test_json_report_without_top_has_all_rows(spark, monkeypatch):
    events = spark.range(70_000).selectExpr("concat('k', id) AS key", "id AS size", "timestamp'2024-01-01' AS ts")
    stamp = F.lit("2024-05-06").cast("timestamp")
    lines = [json.loads(r["value"]) for r in J.as_json_lines(J.json_reports(R.report(events), stamp=stamp)).collect()]
    lines.sort(key=lambda x: x["Part"])
    assert [x["Part"] for x in lines] == [0, 1] and {x["ReportedKeys"] for x in lines} == {70_000}
    assert [len(x["Rows"]) for x in lines] == [65_535, 70_000 - 65_535]
    assert [r["key"] for x in lines for r in x["Rows"]] == [f"k{i}" for i in range(69_999, -1, -1)]
