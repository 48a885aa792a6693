"""Registered queries of reassembly and event extraction, on traffic derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks import traffic as w
from keytide.functions.protocols import INFER, MCTEXT, REDIS
from keytide.operators import conversations as C
from keytide.operators import segments as S
from keytide.operators.report import HotKeys
from keytide.plans.capture import capture_hot_keys

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def source_messages(spark, sf):
    """One server stream per document source: all its texts, one after the other."""
    docs = t.read(spark, sf, "documents").filter(F.octet_length("text") > 0)
    return docs.select(
        F.crc32(F.encode("source", "utf-8")).alias("client"), F.lit(40003).alias("client_port"),
        F.lit(6379).alias("port"), F.lit(True).alias("from_server"), F.col("doc_id").alias("at"),
        F.lit(0).alias("part"), F.encode("text", "utf-8").alias("bytes"),
    )


PIECES = """
    WITH d AS (SELECT source, doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS len,
                      CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT)
                        - octet_length(encode(text)) AS start
               FROM documents WHERE octet_length(encode(text)) > 0),
         p AS (SELECT *, unnest(range(0, len, 1460)) AS o FROM d)"""


@check(
    "r1_segments_in_order",
    PIECES
    + """ SELECT start + o AS rel_start, CAST(least(1460, len - o) AS BIGINT) AS len, CAST(0 AS BIGINT) AS skip,
                 md5(h[2 * o + 1 : 2 * (o + least(1460, len - o))]) AS digest FROM p""",
)
def segments_in_order(spark, sf):
    """Texts cut into packets, some swapped, some sent twice, sequence numbers past 2^32."""
    found = S.segments(w.packets_of(source_messages(spark, sf)))
    return found.select("rel_start", "len", "skip", F.md5(F.encode(F.hex("bytes"), "utf-8")).alias("digest"))


DROPPED = "(doc_id * 31 + o // 1460) % 11 = 0 AND o + 1460 < len"


@check(
    "r2_lost_bytes",
    PIECES
    + f""" SELECT source, CAST(sum(least(1460, len - o)) FILTER (NOT ({DROPPED})) AS BIGINT) AS bytes,
                  CAST(coalesce(sum(least(1460, len - o)) FILTER ({DROPPED}), 0) AS BIGINT) AS lost
           FROM p GROUP BY source""",
)
def lost_bytes(spark, sf):
    dropped = (F.pmod(F.col("at") * 31 + F.col("piece"), F.lit(11)) == 0) & (
        (F.col("piece") + 1) * w.PIECE < F.col("len")
    )
    placed = S.placed_segments(w.packets_of(source_messages(spark, sf), dropped=dropped))
    sources = t.read(spark, sf, "documents").select("source").distinct().withColumn(
        "client", F.crc32(F.encode("source", "utf-8"))
    )
    flows = sources.select("source", F.concat(t.address("client"), F.lit(":40003")).alias("peer"))
    lost = S.lost_bytes(placed).withColumn("peer", F.split_part(S.conn_of("flow"), F.lit(" -> "), F.lit(2)))
    return lost.join(flows, "peer").select("source", "bytes", "lost")


@check(
    "r3_mid_conversation_start",
    PIECES
    + """ SELECT min(start + o) FILTER (NOT first_dropped) - min(start + o) FILTER (NOT first_dropped) AS low,
                 CAST(sum(least(1460, len - o)) FILTER (NOT first_dropped) AS BIGINT) AS bytes, source
          FROM (SELECT *, start + o < 3000 AS first_dropped FROM p) GROUP BY source""",
)
def mid_conversation_start(spark, sf):
    """Without SYN and without the first packets, the lowest byte seen starts the stream."""
    messages = source_messages(spark, sf)
    packets = w.packets_of(messages, dropped=F.col("offset") < 3000).filter(~F.col("syn"))
    placed = S.placed_segments(packets)
    sources = t.read(spark, sf, "documents").select("source").distinct().withColumn(
        "client", F.crc32(F.encode("source", "utf-8"))
    )
    flows = sources.select("source", F.concat(t.address("client"), F.lit(":40003")).alias("peer"))
    per_flow = placed.groupBy("flow").agg(F.min("rel_start").alias("low"), F.sum("len").alias("bytes"))
    per_flow = per_flow.withColumn("peer", F.split_part(S.conn_of("flow"), F.lit(" -> "), F.lit(2)))
    return per_flow.join(flows, "peer").select("low", "bytes", "source")


@check(
    "j1_paired_halves",
    """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
              CAST(sum(octet_length(encode(CASE page_id % 5
                  WHEN 0 THEN 'set ' || url || ' 0 0 ' || octet_length(encode(html)) || '..' || html || '..'
                  WHEN 1 THEN 'set ' || url || ' 0 0 ' || octet_length(encode(html)) || ' noreply..' || html || '..'
                  WHEN 2 THEN 'get missing:' || url || '..' WHEN 3 THEN 'touch ' || url || ' 0..'
                  ELSE 'stats..' END || 'get ' || url || ' other..'))) AS BIGINT) AS client_bytes,
              CAST(sum(octet_length(encode(CASE page_id % 5 WHEN 0 THEN 'STORED..' WHEN 1 THEN ''
                  WHEN 2 THEN 'END..' WHEN 3 THEN 'TOUCHED..' ELSE 'STAT pid 1..STAT uptime 2..END..' END
                  || 'VALUE ' || url || ' 0 ' || octet_length(encode(html)) || '..' || html || '..END..')))
                AS BIGINT) AS server_bytes
       FROM pages GROUP BY ALL""",
)
def paired_halves(spark, sf):
    packets = w.packets_of(w.mctext_messages(spark, sf))
    # Hosts with long pauses come back as new incarnations: add them up per connection.
    halves = S.pair_halves(S.placed_segments(packets, idle_seconds=10**9))
    hosts = t.read(spark, sf, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")
    ).distinct().withColumn("client", F.crc32(F.encode("host", "utf-8")))
    hosts = hosts.select("host", F.concat(t.address("client"), F.lit(":40002")).alias("peer"))
    halves = halves.withColumn("peer", F.split_part(S.conn_of("flow"), F.lit(" -> "), F.lit(2)))
    return halves.join(hosts, "peer").select("host", "client_bytes", "server_bytes")


def _events(events):
    return events.select("key", "type", "size")


@check("p1_p5_j3_mctext_events", w.MCTEXT_EVENTS)
def mctext_events(spark, sf):
    return _events(C.extract_events(w.packets_of(w.mctext_messages(spark, sf)), MCTEXT))


@check("p6_p8_j2_redis_events", f"SELECT key, type, size FROM ({w.REDIS_EVENTS})")
def redis_events(spark, sf):
    return _events(C.extract_events(w.packets_of(w.redis_messages(spark, sf)), REDIS))


@check(
    "p9_inferred_protocols",
    f"""SELECT 'redis' AS protocol, key, type, size FROM ({w.REDIS_EVENTS})
        UNION ALL SELECT 'mctext', key, type, size FROM ({w.MCTEXT_EVENTS})""",
)
def inferred_protocols(spark, sf):
    """Both protocols in one capture; chunks of 8 KiB, so that streams span many of them."""
    messages = w.redis_messages(spark, sf).unionByName(w.mctext_messages(spark, sf))
    events = C.extract_events(w.packets_of(messages), INFER, chunk_bytes=8192, line_limit=4096)
    return events.select("protocol", "key", "type", "size")


@check(
    "entry_a_capture_to_report",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size
        FROM (SELECT key, size FROM ({w.REDIS_EVENTS}) UNION ALL SELECT key, size FROM ({w.MCTEXT_EVENTS}))
        WHERE regexp_matches(key, '^(doc:[0-9]*[02468]$|https:)') GROUP BY key
        HAVING sum(size) >= 100 ORDER BY sum_size DESC, key LIMIT 500""",
)
def capture_to_report(spark, sf):
    """Raw frames of both protocols, decoded, reassembled, read, filtered and ranked."""
    messages = w.redis_messages(spark, sf).unionByName(w.mctext_messages(spark, sf))
    raw = w.frames_of(w.packets_of(messages))
    hot = HotKeys(filter="^(doc:[0-9]*[02468]$|https:)", threshold=100, top=500)
    return t.flat(capture_hot_keys(raw, hot))
