"""Registered queries on message tables: lines, commands, ordinals, RESP values."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks import traffic as w
from keytide.functions.text import try_int
from keytide.operators import lines as L
from keytide.operators.conversations import events_of_messages
from keytide.operators.messages import read_messages
from keytide.operators.resp import decode_resp
from keytide.plans.cut import cut
from keytide.plans.scan import running

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


@check(
    "r5_lines",
    r"""SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, parts[n] AS line
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS n
              FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS parts FROM documents))""",
)
def lines(spark, sf):
    return L.split_lines(t.read(spark, sf, "documents").select("doc_id", "text"))


COMMANDS = """
    SELECT p_partkey AS msg_no, CASE p_partkey % 9
        WHEN 0 THEN 'get part:' || p_partkey || ' ' || replace(p_name, ' ', '_')
        WHEN 1 THEN 'set part:' || p_partkey || ' 0 0 ' || p_size
        WHEN 2 THEN 'cas part:' || p_partkey || ' 0 0 ' || p_size || ' 7 noreply'
        WHEN 3 THEN 'append part:' || p_partkey || ' 0 0 big'
        WHEN 4 THEN 'gets'
        WHEN 5 THEN 'Get part:' || p_partkey
        WHEN 6 THEN '*2 ' || p_name
        WHEN 7 THEN 'quit'
        ELSE 'incr part:' || p_partkey || '  1' END AS line FROM part"""


def part_commands(spark, sf):
    key = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    size, kind = F.col("p_size").cast("string"), F.pmod("p_partkey", F.lit(9))
    line = (
        F.when(kind == 0, F.concat(F.lit("get "), key, F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_"))))
        .when(kind == 1, F.concat(F.lit("set "), key, F.lit(" 0 0 "), size))
        .when(kind == 2, F.concat(F.lit("cas "), key, F.lit(" 0 0 "), size, F.lit(" 7 noreply")))
        .when(kind == 3, F.concat(F.lit("append "), key, F.lit(" 0 0 big")))
        .when(kind == 4, F.lit("gets"))
        .when(kind == 5, F.concat(F.lit("Get "), key))
        .when(kind == 6, F.concat(F.lit("*2 "), F.col("p_name")))
        .when(kind == 7, F.lit("quit"))
        .otherwise(F.concat(F.lit("incr "), key, F.lit("  1")))
    )
    return t.read(spark, sf, "part").select(F.col("p_partkey").alias("msg_no"), line.alias("line"))


@check(
    "p2_p3_f6_f7_commands",
    f"""SELECT msg_no, w[1] AS verb, CAST(len(w) - 1 AS INTEGER) AS n_args,
               regexp_full_match(w[1], '[a-zA-Z]+') AS valid,
               CASE WHEN w[1] IN ('get', 'gets') THEN 'get'
                    WHEN w[1] IN ('set', 'add', 'replace', 'append', 'prepend', 'cas') THEN 'store'
                    WHEN w[1] = 'quit' THEN 'quit' ELSE 'other' END AS cmd_class,
               CASE WHEN msg_no % 9 IN (1, 2) THEN CAST(w[5] AS BIGINT) END AS body_size,
               msg_no % 9 NOT IN (2, 7) AS has_reply
        FROM (SELECT msg_no, string_split(line, ' ') AS w FROM ({COMMANDS}))""",
)
def commands(spark, sf):
    parsed = L.parse_commands(part_commands(spark, sf))
    return parsed.select(
        "msg_no", "verb", F.size("args").alias("n_args"), "valid", "cmd_class", "body_size", "has_reply"
    )


@check(
    "p4_until_quit",
    """SELECT o_custkey AS conn, o_orderkey AS msg_no FROM orders
       QUALIFY NOT coalesce(bool_or(o_orderpriority = '5-LOW')
                 OVER (PARTITION BY o_custkey ORDER BY o_orderkey), false)""",
)
def until_quit(spark, sf):
    """Orders of a customer as its commands; a low-priority order quits."""
    verb = F.when(F.col("o_orderpriority") == "5-LOW", "quit").otherwise("get k")
    orders = t.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("conn"), F.col("o_orderkey").alias("msg_no"), verb.alias("line")
    )
    return L.until_quit(L.parse_commands(orders)).select("conn", "msg_no")


@check(
    "p1_j3_line_events",
    """SELECT CAST(l_suppkey AS VARCHAR) AS conn, 'part:' || l_partkey AS key,
              CAST(l_quantity AS BIGINT) AS size
       FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n
             FROM lineitem) WHERE l_returnflag = 'N'""",
)
def line_events(spark, sf):
    """A supplier's line items as its requests: N is a hit, A a miss, R a command of another kind."""
    used = ["l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity"]
    # Numbered along the supplier's requests: several line items may have one place in one order.
    items = running(
        t.read(spark, sf, "lineitem").select("l_suppkey", *used), ["l_suppkey"], F.floor(F.col("l_orderkey") / 2048),
        [F.col(c) for c in used], {"at": ("sum", F.lit(1))},
    )
    flag, part = F.col("l_returnflag"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    request = F.when(flag == "R", F.concat(F.lit("incr "), part, F.lit(" 1"))).otherwise(
        F.concat(F.lit("get "), part)
    )
    value = F.concat(F.lit("VALUE "), part, F.lit(" 0 "), F.col("l_quantity").cast("int").cast("string"))
    reply = (
        F.when(flag == "N", F.array(value, F.lit("END")))
        .when(flag == "A", F.array(F.lit("END")))
        .otherwise(F.array(F.lit("1")))
    )
    both = F.array(
        F.struct(F.lit(False).alias("from_server"), F.array(request).alias("texts")),
        F.struct(F.lit(True).alias("from_server"), reply.alias("texts")),
    )
    lines = items.select(F.col("l_suppkey").cast("string").alias("conn"), "at", F.inline(both))
    lines = lines.select("conn", "from_server", "at", F.posexplode("texts").alias("n", "line"))
    lines = lines.withColumn("msg_no", F.col("at") * 2 + F.col("n"))
    return L.events_of_lines(lines).select("conn", "key", "size")


@check(
    "j2_paired_turns",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS nth
                  FROM conversations WHERE role IN ('user', 'assistant'))
       SELECT u.conv_id, u.nth, u.text AS request_text, a.text AS reply_text
       FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.nth = a.nth
       WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def paired_turns(spark, sf):
    talk = t.read(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    return L.pair_in_order(talk, "conv_id", "turn", F.col("role") == "assistant", "text", "text")


@check(
    "p6_p7_resp_values",
    """SELECT doc_id, unnest([0, 1, 2, 3, 3, 3, 4]) AS leaf_no,
              unnest(['bulk', 'int', 'status', 'bulk', 'nil', 'array', 'error']) AS tag,
              unnest([1, 1, 1, 2, 2, 2, 1]) AS depth, unnest([0, 0, 0, 0, 1, 2, 0]) AS inner_no,
              unnest([CASE WHEN octet_length(encode(text)) <= 400 THEN md5(text) END, NULL, md5(lang),
                      md5(source), NULL, NULL, md5('ERR ' || doc_id)]) AS digest,
              unnest([NULL, n_chars, NULL, NULL, NULL, NULL, NULL]) AS number,
              unnest([octet_length(encode(text)), NULL, NULL, octet_length(encode(source)), NULL, 0, NULL]) AS length
       FROM documents""",
)
def resp_values(spark, sf):
    """Every document as one nested RESP value; bulk strings up to 400 bytes are kept."""
    docs = t.read(spark, sf, "documents")

    def bulk(c):
        return F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c, F.lit("\r\n"))

    text = F.concat(
        F.lit("*5\r\n"), bulk(F.col("text")), F.lit(":"), F.col("n_chars").cast("string"),
        F.lit("\r\n+"), F.col("lang"), F.lit("\r\n*3\r\n"), bulk(F.col("source")),
        F.lit("$-1\r\n*0\r\n-ERR "), F.col("doc_id").cast("string"), F.lit("\r\n"),
    )
    decoded = decode_resp(docs.select("doc_id", F.encode(text, "utf-8").alias("payload")), capture=400)
    return decoded.select(
        "doc_id", F.col("path")[0].alias("leaf_no"), "tag", "depth",
        F.coalesce(F.get("path", F.lit(1)), F.lit(0)).alias("inner_no"),
        F.md5("bytes").alias("digest"), "number", "length",
    )


@check(
    "r5_p1_lines_with_bodies",
    w.MCTEXT_EVENTS,
)
def lines_with_bodies(spark, sf):
    """Pages as rows of protocol lines, bodies cut at their own newlines, read as one stream."""
    pages = t.read(spark, sf, "pages")
    end = F.lit("\r\n")
    value = F.concat(
        F.lit("VALUE "), F.col("url"), F.lit(" 0 "), F.octet_length("html").cast("string"), end,
        F.col("html"), end, F.lit("END"),
    )
    sides = F.array(
        F.struct(F.lit(False).alias("from_server"), F.concat(F.lit("get "), F.col("url")).alias("text")),
        F.struct(F.lit(True).alias("from_server"), value.alias("text")),
    )
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    rows = pages.select(host.alias("conn"), "page_id", F.inline(sides))
    # Lines are cut at CRLF only, so that joining them again restores the stream.
    rows = rows.select(
        "conn", "from_server", "page_id", F.posexplode(F.split("text", "\r\n", -1)).alias("n", "line")
    )
    rows = rows.withColumns(
        {
            "msg_no": F.col("page_id") * 100000 + F.col("n"),
            "ts": F.timestamp_seconds(F.col("page_id") * 2 + F.col("from_server").cast("int")),
        }
    )
    messages = read_messages(L.as_segments(rows, "mctext"), chunk_bytes=16384, line_limit=8192)
    return events_of_messages(cut(messages), ["mctext"]).select("key", "type", "size")


@check(
    "x2_whole_numbers",
    """SELECT doc_id, CASE WHEN regexp_full_match(w, '[+-]?[0-9]+') THEN CAST(w AS BIGINT) END AS n
       FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '+' || doc_id WHEN 1 THEN '-' || doc_id
                    WHEN 2 THEN doc_id || '.5' WHEN 3 THEN lang ELSE '00' || doc_id END AS w FROM documents)""",
)
def whole_numbers(spark, sf):
    doc, kind = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(5))
    text = (
        F.when(kind == 0, F.concat(F.lit("+"), doc)).when(kind == 1, F.concat(F.lit("-"), doc))
        .when(kind == 2, F.concat(doc, F.lit(".5"))).when(kind == 3, F.col("lang"))
        .otherwise(F.concat(F.lit("00"), doc))
    )
    return t.read(spark, sf, "documents").select("doc_id", try_int(text).alias("n"))
