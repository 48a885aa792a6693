"""Cache traffic derived from the driver tables: messages, then packets, then frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import tables as t
from checks import wire as w
from keytide.plans.cut import cut
from keytide.plans.scan import running

PIECE = 1460
FIRST_SEQ = 2**32 - 5000
START = "2024-01-01 00:00:00"


def packets_of(
    messages: DataFrame, group_rows: int = 64, copies: bool = True, dropped=None, delays: bool = True
) -> DataFrame:
    """Packets of messages ``(client, client_port, port, from_server, at, part, bytes)``.

    ``at`` orders the messages of a connection (one second each), ``part`` orders messages within
    it.  Streams start with a SYN shortly before the sequence number wraps.  Pieces are delayed a
    little (so neighbours swap) unless ``delays`` is off, some are sent twice, and those matching ``dropped`` are left out.
    """
    stream = ["client", "client_port", "port", "from_server"]
    sized = messages.withColumn("len", F.octet_length("bytes").cast("long"))
    placed = running(
        sized, stream, F.floor(F.col("at") / group_rows), [F.col("at"), F.col("part")],
        {"end": ("sum", F.col("len"))},
    ).withColumn("start", F.col("end") - F.col("len"))
    pieces = w.cut_segments(placed, PIECE)
    if dropped is not None:
        pieces = pieces.filter(~dropped)
    base = F.unix_micros(F.lit(START).cast("timestamp"))
    mixed = F.pmod(F.xxhash64("client", "at", "part", "piece"), F.lit(21))
    us = base + F.col("at") * 1_000_000 + F.col("part") * 100_000 + F.col("piece") * 10
    us += F.pmod(mixed, F.lit(3)) * (15 if delays else 0)
    twice = F.array(F.lit(0)) if not copies else F.when(
        F.pmod(mixed, F.lit(7)) == 0, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    data = (
        pieces.withColumn("copy", F.explode(twice))
        .select(
            *stream,
            (us + F.col("copy") * 3000).alias("us"),
            (F.lit(FIRST_SEQ + 1) + F.col("offset")).alias("seq"),
            F.lit(False).alias("syn"),
            "payload",
            F.xxhash64("at", "part", "piece", "copy", *stream).alias("ord"),
        )
    )
    opening = (
        messages.groupBy("client", "client_port", "port").agg(F.min("at").alias("at"))
        .withColumn("from_server", F.explode(F.array(F.lit(False), F.lit(True))))
        .select(
            *stream,
            (base + F.col("at") * 1_000_000 - F.when(F.col("from_server"), 500).otherwise(1000)).alias("us"),
            F.lit(FIRST_SEQ).cast("long").alias("seq"),
            F.lit(True).alias("syn"),
            F.lit(b"").alias("payload"),
            F.xxhash64(*stream).alias("ord"),
        )
    )
    both = data.unionByName(opening)
    server = F.col("from_server")
    client_ip, server_ip = t.address("client"), F.lit("10.9.9.9")

    def pick(a: Column, b: Column) -> Column:
        return F.when(server, a).otherwise(b)

    return both.select(
        F.lit("derived").alias("file"),
        "ord",
        F.timestamp_micros("us").alias("ts"),
        pick(server_ip, client_ip).alias("src_ip"),
        pick(client_ip, server_ip).alias("dst_ip"),
        pick(F.col("port"), F.col("client_port")).cast("int").alias("src_port"),
        pick(F.col("client_port"), F.col("port")).cast("int").alias("dst_port"),
        F.pmod(F.col("seq"), F.lit(2**32)).alias("seq"),
        "syn",
        "payload",
    )


def frames_of(packets: DataFrame) -> DataFrame:
    """Raw Ethernet frames of IPv4 packets, written out once like a capture."""
    def numeric(ip: str) -> Column:
        parts = F.split(ip, r"\.")
        total = F.lit(0).cast("long")
        for i in range(4):
            total = total * 256 + parts[i].cast("long")
        return total

    flags = F.when(F.col("syn"), 0x02).otherwise(0x18)
    body = F.octet_length("payload") + 20
    data = w.frame(
        w.ethernet(F.lit("0800"), F.lit(None).cast("int")),
        w.ipv4_header(numeric("src_ip"), numeric("dst_ip"), body, F.lit(0), F.lit(6)),
        w.tcp_header(F.col("src_port"), F.col("dst_port"), F.col("seq"), F.lit(0), flags),
        F.col("payload"),
    )
    framed = packets.select("file", "ord", "ts", data.alias("data"))
    size = F.octet_length("data")
    return cut(
        framed.select(
            "file", "ord", "ts", size.alias("caplen"), size.alias("wirelen"), F.lit(1).alias("linktype"), "data"
        )
    )


def resp_array(*items: Column) -> Column:
    """A RESP array of bulk strings, as text."""
    parts = [F.lit(f"*{len(items)}\r\n")]
    for item in items:
        size = F.octet_length(item).cast("string")
        parts += [F.lit("$"), size, F.lit("\r\n"), item, F.lit("\r\n")]
    return F.concat(*parts)


def _exchange(rows: DataFrame, requests: list[tuple[Column, Column]], at: str, **conn: Column) -> DataFrame:
    """Messages of a list of (request text, reply text) per row; a null request leaves both out."""
    sides = []
    for i, (request, reply) in enumerate(requests):
        for server, text in ((False, request), (True, reply)):
            sides.append(
                F.struct(
                    F.lit(server).alias("from_server"),
                    F.lit(2 * i + int(server)).alias("part"),
                    F.when(request.isNotNull(), F.encode(text, "utf-8")).alias("bytes"),
                )
            )
    return (
        rows.select(*[c.alias(n) for n, c in conn.items()], F.col(at).alias("at"), F.inline(F.array(*sides)))
        .filter(F.octet_length("bytes") > 0)
    )


def redis_messages(spark, sf: str) -> DataFrame:
    """One connection per document source: get every text (some are nil), set it, get two at once."""
    docs = t.read(spark, sf, "documents").filter(F.col("text").isNotNull())
    text, doc = F.col("text"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    bulk = F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n"))
    nil = F.pmod("doc_id", F.lit(10)) == 3
    some = F.pmod("doc_id", F.lit(7)) == 0
    return _exchange(
        docs,
        [
            (resp_array(F.lit("GET"), doc), F.when(nil, F.lit("$-1\r\n")).otherwise(bulk)),
            (F.when(some, resp_array(F.lit("SET"), doc, text)), F.lit("+OK\r\n")),
            (
                F.when(some, resp_array(F.lit("mget"), doc, F.lit("none"), F.lit("copy"))),
                F.concat(F.lit("*3\r\n"), bulk, F.lit("$-1\r\n"), bulk),
            ),
            (F.when(nil, resp_array(F.lit("get"), F.lit("wrong"))), F.lit("-WRONGTYPE not a string\r\n")),
        ],
        "doc_id",
        client=F.crc32(F.encode("source", "utf-8")),
        client_port=F.lit(40001),
        port=F.lit(6379),
    )


REDIS_EVENTS = """
    SELECT 'doc:' || doc_id AS key, CASE WHEN doc_id % 10 = 3 THEN 'miss' ELSE 'hit' END AS type,
           CASE WHEN doc_id % 10 = 3 THEN 0 ELSE octet_length(encode(text)) END AS size, source, doc_id
    FROM documents WHERE text IS NOT NULL
    UNION ALL
    SELECT unnest(['doc:' || doc_id, 'none', 'copy']), unnest(['hit', 'miss', 'hit']),
           unnest([octet_length(encode(text)), 0, octet_length(encode(text))]), source, doc_id
    FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0
"""


def mctext_messages(spark, sf: str) -> DataFrame:
    """One connection per host: set, quiet set, missing get or another command, then get the page."""
    pages = t.read(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    url, html, size = F.col("url"), F.col("html"), F.octet_length("html").cast("string")
    end = F.lit("\r\n")
    stored = F.concat(url, F.lit(" 0 0 "), size)
    kind = F.pmod("page_id", F.lit(5))
    first = (
        F.when(kind == 0, F.concat(F.lit("set "), stored, end, html, end))
        .when(kind == 1, F.concat(F.lit("set "), stored, F.lit(" noreply"), end, html, end))
        .when(kind == 2, F.concat(F.lit("get missing:"), url, end))
        .when(kind == 3, F.concat(F.lit("touch "), url, F.lit(" 0"), end))
        .otherwise(F.lit("stats\r\n"))
    )
    answer = (
        F.when(kind == 0, F.lit("STORED\r\n")).when(kind == 1, F.lit(""))
        .when(kind == 2, F.lit("END\r\n")).when(kind == 3, F.lit("TOUCHED\r\n"))
        .otherwise(F.lit("STAT pid 1\r\nSTAT uptime 2\r\nEND\r\n"))
    )
    value = F.concat(F.lit("VALUE "), url, F.lit(" 0 "), size, end, html, end)
    return _exchange(
        pages,
        [
            (first, answer),
            (F.concat(F.lit("get "), url, F.lit(" other"), end), F.concat(value, F.lit("END\r\n"))),
        ],
        "page_id",
        client=F.crc32(F.encode(host, "utf-8")),
        client_port=F.lit(40002),
        port=F.lit(11211),
    )


MCTEXT_EVENTS = "SELECT url AS key, 'hit' AS type, octet_length(encode(html)) AS size FROM pages"
