"""Registered queries of connections: ends, pauses, losses, binary and chosen protocols, several triggers, checks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks import report_queries as r
from checks import tables as t
from checks import traffic as w
from checks.packet_queries import order_frames
from checks.stream_queries import source_messages
from checks.streaming_queries import land, run_folder, streamed_user_events, user_events_of
from keytide.functions import protocols as P
from keytide.functions.patterns import BadPattern
from keytide.functions.spec import BadDescriptor
from keytide.operators import conversations as C
from keytide.operators import frames as D
from keytide.operators import report as R
from keytide.operators import segments as S
from keytide.plans.capture import raw_packets
from keytide.streaming import reports as SR
from keytide.streaming.decode import cache_events, stream_events

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def _refused(error: type[Exception], run) -> None:
    """The call must raise ``error``."""
    try:
        run()
    except error:
        return
    raise AssertionError(f"no {error.__name__}")


def with_ends(messages, packets, reset=None):
    """Both directions end after every exchange; where ``reset`` holds, the server resets instead."""
    micros = F.unix_micros(F.lit(w.START).cast("timestamp")) + F.col("at") * 1_000_000 + 900_000
    reset = F.lit(False) if reset is None else reset
    ends = (
        messages.select("client", "client_port", "port", "at").distinct()
        .withColumn("from_server", F.explode(F.array(F.lit(False), F.lit(True))))
        .filter(~(reset & ~F.col("from_server")))
        .withColumn("us", micros + F.col("from_server").cast("int") * 10)
    )
    client, server, port = t.address("client"), F.lit("10.9.9.9"), F.col("port").cast("int")
    mine, theirs = F.col("client_port").cast("int"), F.col("from_server")
    ends = ends.select(
        F.lit("derived").alias("file"), F.xxhash64("client", "at", "from_server", F.lit("end")).alias("ord"),
        F.timestamp_micros("us").alias("ts"),
        F.when(theirs, server).otherwise(client).alias("src_ip"), F.when(theirs, client).otherwise(server).alias("dst_ip"),
        F.when(theirs, port).otherwise(mine).alias("src_port"), F.when(theirs, mine).otherwise(port).alias("dst_port"),
        F.lit(w.FIRST_SEQ + 1).cast("long").alias("seq"), F.lit(False).alias("syn"), F.lit(b"").alias("payload"),
        (~reset).alias("fin"), reset.alias("rst"),
    )
    no = F.lit(False)
    return packets.withColumns({"fin": no, "rst": no}).unionByName(ends)


@check("r8_events_across_ends", f"SELECT key, type, size FROM ({w.REDIS_EVENTS})")
def events_across_ends(spark, sf):
    """Every document's exchange is a connection of its own on the same ports, ended by both sides or reset."""
    messages = w.redis_messages(spark, sf)
    packets = with_ends(messages, w.packets_of(messages), F.pmod("at", F.lit(4)) == 1)
    return C.extract_events(packets, P.REDIS, idle_seconds=10**9).select("key", "type", "size")


@check(
    "r8_incarnations",
    "SELECT source, count(*) AS incarnations FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY source",
)
def incarnations(spark, sf):
    messages = source_messages(spark, sf)
    placed = S.placed_segments(with_ends(messages, w.packets_of(messages)), idle_seconds=10**9)
    sources = t.read(spark, sf, "documents").select("source").distinct().withColumn("client", F.crc32(F.encode("source", "utf-8")))
    sources = sources.select("source", F.concat(t.address("client"), F.lit(":40003")).alias("peer"))
    counted = placed.groupBy(F.split_part(S.conn_of("flow"), F.lit(" -> "), F.lit(2)).alias("peer"))
    counted = counted.agg(F.count_distinct("flow").alias("incarnations"))
    return counted.join(sources, "peer").select("source", "incarnations")


@check(
    "r9_idle_incarnations",
    """SELECT host, count(*) FILTER (before IS NULL OR page_id - before > 60) AS incarnations
       FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, page_id,
                    lag(page_id) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS before
             FROM pages) GROUP BY host""",
)
def idle_incarnations(spark, sf):
    """A minute of packet time without packets ends a connection."""
    placed = S.placed_segments(w.packets_of(w.mctext_messages(spark, sf)))
    hosts = t.read(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).distinct()
    hosts = hosts.withColumn("client", F.crc32(F.encode("host", "utf-8")))
    hosts = hosts.select("host", F.concat(t.address("client"), F.lit(":40002")).alias("peer"))
    counted = placed.groupBy(F.split_part(S.conn_of("flow"), F.lit(" -> "), F.lit(2)).alias("peer"))
    counted = counted.agg(F.count_distinct("flow").alias("incarnations"))
    return counted.join(hosts, "peer").select("host", "incarnations")


LOST = "doc_id % 9 = 4"


@check(
    "r10_r11_resync_after_loss",
    f"""SELECT 'doc:' || doc_id AS key, 'hit' AS type, octet_length(encode(text)) AS size
        FROM (SELECT *, lag({LOST}) OVER (PARTITION BY source ORDER BY doc_id) AS before
              FROM documents WHERE octet_length(encode(text)) BETWEEN 1 AND 1200)
        WHERE NOT ({LOST}) AND NOT coalesce(before, false)""",
)
def resync_after_loss(spark, sf):
    """Some replies never arrive. The loss shows with the next reply; both are dropped, the one after counts again."""
    docs = t.read(spark, sf, "documents").filter(F.octet_length("text").between(1, 1200))
    text, key = F.col("text"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    bulk = F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n"))
    messages = w._exchange(
        docs, [(w.resp_array(F.lit("GET"), key), bulk)], "doc_id",
        client=F.crc32(F.encode("source", "utf-8")), client_port=F.lit(40001), port=F.lit(6379),
    )
    dropped = F.col("from_server") & (F.pmod("at", F.lit(9)) == 4)
    events = C.extract_events(w.packets_of(messages, dropped=dropped), P.REDIS, idle_seconds=10**9)
    return events.select("key", "type", "size")


@check(
    "p5_binary_connections",
    f"""SELECT key, type, size FROM ({w.MCTEXT_EVENTS})
        WHERE length(regexp_extract(key, '^[a-z]+://([^/]+)', 1)) % 2 = 0""",
)
def binary_connections(spark, sf):
    """Hosts with names of odd length speak the binary protocol first; their connections are left alone."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    pages = t.read(spark, sf, "pages").filter(F.length(host) % 2 == 1)
    first = pages.groupBy(F.crc32(F.encode(host, "utf-8")).alias("client")).agg((F.min("page_id") - 1).alias("at"))
    hello = first.select(
        "client", F.lit(40002).alias("client_port"), F.lit(11211).alias("port"), "at", F.lit(False).alias("from_server"),
        F.lit(0).alias("part"), F.unhex(F.lit("80" + "0a" + "00" * 22)).alias("bytes"),
    )
    messages = w.mctext_messages(spark, sf)
    packets = w.packets_of(messages.unionByName(hello.select(*messages.columns)))
    return C.extract_events(packets, P.INFER, idle_seconds=10**9).select("key", "type", "size")


@check("p10_chosen_protocol", f"SELECT key, type, size FROM ({w.REDIS_EVENTS})")
def chosen_protocol(spark, sf):
    """One protocol for all connections: those that speak another give no events; unknown names are refused."""
    messages = w.redis_messages(spark, sf).unionByName(w.mctext_messages(spark, sf))
    packets = w.packets_of(messages)
    _refused(ValueError, lambda: C.extract_events(packets, "memcache"))
    return C.extract_events(packets, P.REDIS).select("key", "type", "size")


@check("e2_registered_protocol", f"SELECT key, type, size, 'pages' AS protocol FROM ({w.MCTEXT_EVENTS})")
def registered_protocol(spark, sf):
    """A protocol of the user's own, here the text protocol under another name, chosen by that name."""
    P.register_protocol("pages", P.Protocol(P.mctext_request, P.mctext_reply))
    events = C.extract_events(w.packets_of(w.mctext_messages(spark, sf)), "pages")
    return events.select("key", "type", "size", "protocol")


@check(
    "f3_invalid_pattern",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size FROM ({r.URL_SQL})
        WHERE key LIKE 'https://%' GROUP BY key""",
)
def invalid_pattern(spark, sf):
    """A pattern that does not compile is refused, and the one before stays in force."""
    events, hot = t.url_events(spark, sf), R.HotKeys(filter="^https://")
    for pattern in ("(", "[z-a]", "a{2,1}", "(?<=x)y", r"\1"):
        _refused(BadPattern, lambda: hot.with_filter(pattern).run(events))  # noqa: B023
    return t.flat(hot.run(events))


@check(
    "a12_checked_descriptors",
    """SELECT source AS key, min(n_chars) AS min_size, CAST(sum(n_chars) AS BIGINT) AS sum_size
       FROM documents GROUP BY source""",
)
def checked_descriptors(spark, sf):
    """Unknown aggregates and fields, aggregates over text and repeated columns are refused when the report is made."""
    events = t.document_events(spark, sf)
    for bad in ("key,mean(size)", "key,max(key)", "key,sum(bytes)", "key,p5(size)", "key,max(size),max(size)", "key,,sum(size)"):
        _refused(BadDescriptor, lambda: R.hot_keys(events, bad))  # noqa: B023
    return t.flat(R.hot_keys(events, "key,min(size),sum(size)"))


@check(
    "s3_one_source",
    """SELECT CAST(src_port IN (6379, 11211) OR dst_port IN (6379, 11211) AS BOOLEAN) AS on_ports, count(*) AS n
       FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN 6379 WHEN 1 THEN 11211 ELSE 80 END AS src_port, 0 AS dst_port
             FROM orders WHERE o_orderkey % 8 <> 6) GROUP BY ALL""",
)
def one_source(spark, sf):
    """Exactly one source and at least one port, checked before anything is read."""
    table = order_frames(spark, sf)
    for wrong in ({}, {"path": sf, "packets": table}, {"packets": table, "ports": []}, {"packets": table, "ports": [70000]}):
        _refused(ValueError, lambda: raw_packets(spark, **wrong))  # noqa: B023
    packets = D.tcp_only(D.decode_frames(raw_packets(spark, packets=table)))
    return packets.groupBy(D.on_ports().alias("on_ports")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "s4_json_lines",
    f"""SELECT window_end AS stamp, key, sum_size, count(*) OVER (PARTITION BY window_end) AS total_keys,
               CAST(sum(sum_size) OVER (PARTITION BY window_end) AS BIGINT) AS total_bytes
        FROM ({r.interval_sql("1 day", r.MAX_SUM)}) WHERE window_end <= (SELECT max(ts) FROM events)""",
)
def json_lines(spark, sf):
    """A stream of events reported as JSON lines, one object per day, read back from the files."""
    folder = run_folder(spark)
    SR.start_json_reports(
        streamed_user_events(spark, sf), R.HotKeys("key,sum(size)"), "1 day", f"{folder}/state", f"{folder}/out", availableNow=True
    ).awaitTermination()
    rows = "Rows ARRAY<STRUCT<key: STRING, `sum(size)`: BIGINT>>"
    lines = spark.read.schema(f"Timestamp STRING, TotalKeys BIGINT, TotalBandwidth BIGINT, {rows}").json(f"{folder}/out")
    found = lines.select("*", F.explode("Rows").alias("row"))
    return found.select(
        F.col("Timestamp").cast("timestamp").cast("timestamp_ntz").alias("stamp"), F.col("row.key").alias("key"),
        F.col("row").getField("sum(size)").alias("sum_size"), F.col("TotalKeys").alias("total_keys"),
        F.col("TotalBandwidth").alias("total_bytes"),
    )


@check("t4_t5_several_triggers", f"SELECT key, type, size FROM ({w.REDIS_EVENTS}) UNION ALL {w.MCTEXT_EVENTS}")
def several_triggers(spark, sf):
    """Connections over four triggers, with idle ones expired by timers and reopened later."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folder = run_folder(spark)
    messages = w.redis_messages(spark, sf).unionByName(w.mctext_messages(spark, sf))
    # Live, a connection that is taken up again begins with the packet that comes first.
    packets = w.packets_of(messages, delays=False).withColumns({"fin": F.lit(False), "rst": F.lit(False)})
    packets.write.parquet(f"{folder}/all")
    packets = spark.read.parquet(f"{folder}/all")
    ends = packets.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    second = lambda at: F.date_trunc("second", F.lit(at)) + F.expr("INTERVAL 950 MILLISECONDS")
    parts = []
    for i in range(4):  # in order of time, as captures land; borders between exchanges
        low, high = (ends["low"] + (ends["high"] - ends["low"]) * k / 4 for k in (i, i + 1))
        part = (F.lit(i == 0) | (F.col("ts") >= second(low))) & (F.lit(i == 3) | (F.col("ts") < second(high)))
        parts.append(packets.filter(part))
    files = land(parts, f"{folder}/packets", "ord")
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/packets")
    SR.start_events(
        cache_events(stream_events(stream)),
        lambda found, batch: found.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"),
        f"{folder}/state", availableNow=True,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key", "type", "size")


@check(
    "r7_overlong_requests",
    "SELECT url AS key, 'hit' AS type, octet_length(encode(html)) AS size FROM pages WHERE page_id % 2 = 0",
)
def overlong_requests(spark, sf):
    """Every second request line is longer than the limit: it and its reply are dropped, the next ones count."""
    pages = t.read(spark, sf, "pages")
    url, html, end = F.col("url"), F.col("html"), F.lit("\r\n")
    asked = F.when(F.pmod("page_id", F.lit(2)) == 0, url).otherwise(F.concat(url, F.repeat(F.lit("x"), F.lit(9000))))
    size = F.octet_length("html").cast("string")
    reply = F.concat(F.lit("VALUE "), url, F.lit(" 0 "), size, end, html, end, F.lit("END"), end)
    messages = w._exchange(
        pages, [(F.concat(F.lit("get "), asked, end), reply)], "page_id",
        client=F.crc32(F.encode(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), "utf-8")),
        client_port=F.lit(40002), port=F.lit(11211),
    )
    events = C.extract_events(w.packets_of(messages), P.MCTEXT, idle_seconds=10**9, line_limit=4096)
    return events.select("key", "type", "size")


MIDDLE = "(SELECT time_bucket(INTERVAL '1 day', min(ts) + (max(ts) - min(ts)) / 2, TIMESTAMP '1970-01-01') FROM events)"


@check(
    "t3_late_events",
    f"""SELECT window_start, key, max_size, sum_size, row_number() OVER (PARTITION BY window_start ORDER BY sum_size DESC, key) AS rank
        FROM ({r.interval_sql("1 day", r.MAX_SUM)})
        WHERE window_start >= {MIDDLE} AND window_end <= (SELECT max(ts) FROM events)""",
)
def late_events(spark, sf):
    """The later half of the events comes first, in two parts; the earlier half is late then, counted and left out.

    Rows are held against the watermark of the trigger before, so the second part is not late yet.
    """
    folder = run_folder(spark)
    events = t.read(spark, sf, "events")
    seconds = [events.agg(f(F.unix_seconds(F.col("ts").cast("timestamp")))).scalar() for f in (F.min, F.max)]
    day = F.unix_seconds(F.col("ts").cast("timestamp")) >= F.floor((seconds[0] + seconds[1]) / 2 / 86400) * 86400
    even = F.pmod("user_id", F.lit(2)) == 0
    files = land([events.filter(part) for part in (day & even, day & ~even, ~day)], f"{folder}/in", "event_id")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    found = user_events_of(stream)
    query = SR.start_interval_reports(
        found, R.HotKeys(), "1 day", f"{folder}/state",
        lambda report, batch: report.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"),
        availableNow=True,
    )
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])
    if not late:
        raise AssertionError("no late rows were counted")
    out = t.flat(spark.read.parquet(f"{folder}/out").drop("batch", "window_end"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
