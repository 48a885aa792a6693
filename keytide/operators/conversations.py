"""Cache events from the messages of both directions of each connection.

Requests and replies meet by their ordinal: the n-th request that gets a reply with the n-th reply.
Ordinals restart after a mark (lost or unreadable bytes) on either side, and replies that were ready
before the first request after a mark belong to nothing and are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.protocols import INFER, LINE_LIMIT, REDIS_GET_VERBS, check_protocol, protocols
from keytide.operators.events import HIT, MISS
from keytide.operators.frames import DEFAULT_PORTS, check_ports
from keytide.operators.messages import CHUNK_BYTES, chosen_protocol, read_messages
from keytide.operators.segments import IDLE_SECONDS, conn_of, placed_segments, with_bytes
from keytide.plans.cut import cut
from keytide.plans.scan import running

_SLICE_US = 10_000_000


def _arrival() -> list[Column]:
    return [F.col(c) for c in ("us", "from_server", "pos", "mark")]


def with_frames(messages: DataFrame) -> DataFrame:
    """Mark the first value of every top-level RESP value, and count the values still to come.

    Running sums over the values' child counts do what a parser's stack would: a value at a new
    minimum of the sum opens a frame, and the distance to that minimum is ``remaining``.
    """
    stream = ["flow", "from_server"]
    order = [F.col("pos"), F.col("mark")]
    summed = running(
        messages.withColumn("delta", F.coalesce("delta", F.lit(0).cast("long"))),
        stream, F.col("chunk"), order,
        {"span": ("sum", F.col("mark").cast("long")), "sum_after": ("sum", F.col("delta"))},
    ).withColumn("sum_before", F.col("sum_after") - F.col("delta"))
    lowest = running(
        summed, [*stream, "span"], F.col("chunk"), order,
        {"lowest": ("min", F.when(~F.col("mark"), F.col("sum_before")))}, inclusive=False,
    )
    opens = ~F.col("mark") & (F.col("lowest").isNull() | (F.col("sum_before") < F.col("lowest")))
    return lowest.withColumns(
        {
            "unit": opens,
            "remaining": F.when(opens, F.lit(0)).otherwise(F.col("sum_before") - F.col("lowest")),
        }
    ).select(*messages.columns, "remaining")


def with_ordinals(messages: DataFrame) -> DataFrame:
    """Number requests and replies within each span between marks.

    Adds ``epoch``, ``ordinal``, and for each message the verb and length of the request it is part
    of.  Messages after a ``quit`` and replies without a request before them are dropped.
    """
    client = ~F.col("from_server")
    event = F.when(F.col("mark"), F.lit("mark")).when(
        client & (F.col("unit") | F.col("kind").isin("get", "store", "other")), F.lit("request")
    )
    slices = F.floor(F.col("us") / F.lit(_SLICE_US))
    seen = running(
        messages, ["flow"], slices, _arrival(),
        {
            "epoch": ("sum", F.col("mark").cast("long")),
            "latest": ("last", event),
            "quit": ("max", (F.col("kind") == "quit").cast("int")),
        },
    )
    live = seen.filter(
        ~F.col("mark")
        & (F.coalesce("quit", F.lit(0)) == 0)
        & (client | F.coalesce(F.col("latest") == "request", F.lit(False)))
    )
    numbered = running(
        live, ["flow", "epoch", "from_server"], slices, _arrival(),
        {
            "units": ("sum", F.col("unit").cast("long")),
            "verb": ("last", F.when(F.col("unit"), F.coalesce(F.col("key"), F.lit("")))),
            "arity": ("last", F.when(F.col("unit"), F.coalesce(F.col("size"), F.lit(-1).cast("long")))),
        },
    )
    # The entries of a listing come before the line that closes their reply.
    before_end = (F.col("kind") == "value") & F.col("from_server")
    return numbered.withColumn("ordinal", F.col("units") - F.when(before_end, 0).otherwise(1))


def _event_columns(kind: Column, key: str, size: Column) -> list[Column]:
    return [
        F.timestamp_micros("r.us").alias("ts"),
        conn_of(F.col("r.flow")).alias("conn"),
        F.col("r.protocol").alias("protocol"),
        kind.alias("type"),
        F.col(key).alias("key"),
        size.cast("long").alias("size"),
    ]


def listing_events(numbered: DataFrame) -> DataFrame:
    """Hits of unframed protocols: each entry in the reply to a get, under the key it names."""
    gets = numbered.filter(~F.col("from_server") & (F.col("kind") == "get"))
    values = numbered.filter(F.col("from_server") & (F.col("kind") == "value"))
    meet = ["flow", "epoch", "ordinal"]
    asked = gets.select(*meet).alias("q")
    return (
        values.alias("r")
        .join(asked, [F.col(f"r.{c}") == F.col(f"q.{c}") for c in meet])
        .select(*_event_columns(F.lit(HIT), "r.key", F.col("r.size")))
    )


def framed_events(numbered: DataFrame) -> DataFrame:
    """Hits and misses of Redis: the key of a get, or each key of an mget with its element.

    A nil reply is a miss of size 0; errors, statuses and integers are no events.
    """
    wanted = F.col("verb").isin(*REDIS_GET_VERBS)
    is_key = (F.col("kind") == "bulk") & ~F.col("unit") & (F.col("remaining") < F.col("arity") - 1)
    meet = ["flow", "epoch", "ordinal", "remaining"]
    keys = numbered.filter(~F.col("from_server") & wanted & is_key).select(
        *meet, "verb", F.coalesce("key", F.lit("")).alias("asked")
    )
    answers = numbered.filter(F.col("from_server") & F.col("kind").isin("bulk", "nil"))
    one = F.col("q.verb") == REDIS_GET_VERBS[0]
    nil = F.col("r.kind") == "nil"
    return (
        answers.alias("r")
        .join(
            keys.alias("q"),
            [*[F.col(f"r.{c}") == F.col(f"q.{c}") for c in meet], one == F.col("r.unit")],
        )
        .select(
            *_event_columns(
                F.when(nil, MISS).otherwise(HIT), "q.asked", F.coalesce("r.size", F.lit(0))
            )
        )
    )


def events_of_messages(messages: DataFrame, names: Sequence[str]) -> DataFrame:
    """Events from messages of the given protocols."""
    known = protocols()
    framed = [n for n in names if known[n].framed]
    plain = [n for n in names if not known[n].framed]
    parts = []
    if plain:
        lines = messages.filter(F.col("protocol").isin(*plain))
        parts.append(listing_events(cut(with_ordinals(lines))))
    if framed:
        values = messages.filter(F.col("protocol").isin(*framed))
        parts.append(framed_events(cut(with_ordinals(cut(with_frames(values))))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def extract_events(
    packets: DataFrame,
    protocol: str = INFER,
    ports: Sequence[int] = DEFAULT_PORTS,
    idle_seconds: int = IDLE_SECONDS,
    chunk_bytes: int = CHUNK_BYTES,
    line_limit: int = LINE_LIMIT,
) -> DataFrame:
    """Cache events ``(ts, conn, protocol, type, key, size)`` from decoded packets.

    Header-sized tables are written to the checkpoint folder between the steps; payloads are
    shuffled twice (to their place in the stream, and to their chunk) and never written.
    """
    check_protocol(protocol)
    check_ports(ports)
    placed = placed_segments(packets, ports, idle_seconds)
    placed = placed.withColumn("protocol", chosen_protocol(F.col("client_byte"), protocol))
    messages = cut(read_messages(with_bytes(placed, packets, ports), chunk_bytes, line_limit))
    return events_of_messages(messages, list(protocols()) if protocol == INFER else [protocol])
