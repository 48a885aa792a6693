"""Memcached text protocol on message tables: one row per protocol line, native columns only.

The input has ``conn``, ``from_server``, ``msg_no`` (order within one direction of a connection) and
``line``.  Use this where lines are already separated (proxy logs, parsed captures) and item bodies
are left out; :func:`as_segments` turns lines that include bodies into streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.protocols import GET_VERBS, QUIT_VERB, STORE_VERBS
from keytide.functions.text import ascii_word, strip_line_end, try_int, words
from keytide.operators.events import HIT
from keytide.plans.scan import running

_SLICE_ROWS = 65536


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of ``text``: cut at newlines, a trailing carriage return removed.

    What follows the last newline is an unfinished line and is left out.
    """
    lines = F.split(F.col(text), "\r?\n", -1)
    finished = F.slice(lines, 1, F.size(lines) - 1)
    return df.select("*", F.posexplode(finished).alias("line_no", "line")).drop(text)


def command_class(verb: Column) -> Column:
    """``get``, ``store``, ``quit`` or ``other``; verbs are case-sensitive."""
    return (
        F.when(verb.isin(*GET_VERBS), "get")
        .when(verb.isin(*STORE_VERBS), "store")
        .when(verb == QUIT_VERB, "quit")
        .otherwise("other")
    )


def parse_commands(lines: DataFrame) -> DataFrame:
    """Verb, arguments, class, body size and whether a reply follows, of request lines.

    ``valid`` is false where the line does not start with a word of letters.  Only a store command
    with a whole number as fourth argument has a body.
    """
    parts = words(strip_line_end(F.col("line")))
    verb, args = F.get(parts, F.lit(0)), F.slice(parts, 2, F.size(parts))
    kind = command_class(verb)
    quiet = F.coalesce(F.try_element_at("args", F.lit(-1)) == "noreply", F.lit(False))
    body = F.when(F.col("cmd_class") == "store", try_int(F.get(F.col("args"), F.lit(3))))
    return lines.select(
        "*", verb.alias("verb"), args.alias("args"), kind.alias("cmd_class"),
        ascii_word(verb).alias("valid"),
    ).select(
        "*",
        body.alias("body_size"),
        (~quiet & (F.col("cmd_class") != "quit")).alias("has_reply"),
    )


def parse_replies(lines: DataFrame) -> DataFrame:
    """Key and size of ``VALUE`` lines, and which lines end a reply."""
    parts = words(F.col("line"))
    size = try_int(F.get(parts, F.lit(3)))
    is_value = (F.get(parts, F.lit(0)) == "VALUE") & (F.size(parts) >= 4) & size.isNotNull()
    return lines.select(
        "*",
        F.when(is_value, F.get(parts, F.lit(1))).alias("key"),
        F.when(is_value, size).alias("size"),
        (~is_value & (F.get(parts, F.lit(0)) != "STAT")).alias("ends_reply"),
    )


def until_quit(commands: DataFrame) -> DataFrame:
    """Commands of each connection before its first ``quit``.

    Adds ``nth``, the number of valid commands with a reply before each.
    """
    unit = (F.col("valid") & F.col("has_reply")).cast("long")
    seen = running(
        commands, ["conn"], F.floor(F.col("msg_no") / _SLICE_ROWS), [F.col("msg_no")],
        {"quits": ("max", (F.col("cmd_class") == "quit").cast("int")), "units": ("sum", unit)},
    )
    return seen.filter(F.col("quits") == 0).select(
        *commands.columns, (F.col("units") - unit).alias("nth")
    )


def number_units(messages: DataFrame, keys: list[str], order: str, unit: Column, name: str) -> DataFrame:
    """Count ``unit`` rows before each row, per key and in order."""
    counted = running(
        messages, keys, F.floor(F.col(order) / _SLICE_ROWS), [F.col(order)],
        {name: ("sum", unit.cast("long"))}, inclusive=False,
    )
    return counted


def events_of_lines(lines: DataFrame) -> DataFrame:
    """Hits from request and reply lines: each value of the n-th reply belongs to the n-th request."""
    asked = until_quit(parse_commands(lines.filter(~F.col("from_server"))))
    gets = asked.filter((F.col("cmd_class") == "get") & (F.size("args") > 0)).select("conn", "nth")
    replies = parse_replies(lines.filter(F.col("from_server")))
    values = number_units(replies, ["conn"], "msg_no", F.col("ends_reply"), "nth")
    hits = values.filter(F.col("key").isNotNull()).join(gets, ["conn", "nth"])
    return hits.select("conn", "msg_no", F.lit(HIT).alias("type"), "key", "size")


def pair_in_order(
    messages: DataFrame, key: str, order: str, is_reply: Column, request: str, reply: str
) -> DataFrame:
    """Join the n-th request with the n-th reply of each key.

    ``request`` and ``reply`` name the column taken from either side (as ``request_…`` and
    ``reply_…``); requests or replies without a partner are left out.
    """
    sided = messages.withColumn("__reply", is_reply)
    numbered = number_units(sided, [key, "__reply"], order, F.lit(1), "nth")
    asked = numbered.filter(~F.col("__reply")).select(key, "nth", F.col(request).alias(f"request_{request}"))
    answered = numbered.filter(F.col("__reply")).select(key, "nth", F.col(reply).alias(f"reply_{reply}"))
    return asked.join(answered, [key, "nth"])


def as_segments(lines: DataFrame, protocol: str, ending: str = "\r\n") -> DataFrame:
    """Lines (bodies included) as placed segments, ready for ``read_messages``.

    ``ts`` gives the time a line was ready.
    """
    sized = lines.withColumn(
        "bytes", F.concat(F.col("line").cast("binary"), F.encode(F.lit(ending), "utf-8"))
    )
    stream = ["conn", "from_server"]
    slices = F.floor(F.col("msg_no") / _SLICE_ROWS)
    placed = running(
        sized, stream, slices, [F.col("msg_no")],
        {"end": ("sum", F.octet_length("bytes").cast("long"))},
    )
    return placed.select(
        F.concat("conn", F.lit("#-1.0")).alias("flow"),
        "from_server",
        F.lit(protocol).alias("protocol"),
        # Whether a stream is long is not known here, so every stream is linked.
        F.lit(1 << 62).alias("stream_len"),
        (F.col("end") - F.octet_length("bytes")).alias("rel_start"),
        F.unix_micros("ts").alias("ready"),
        "bytes",
    )
