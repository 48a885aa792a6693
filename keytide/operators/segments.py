"""In-order byte streams from TCP packets, with lost bytes marked.

A connection may carry any share of all packets, so nothing here gathers one connection in a task:
order-dependent values are computed inside slices (a span of time, then a span of stream offsets)
and carried from slice to slice through one short summary row each.  Only packet headers take part;
payloads are joined back at the end, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.operators.frames import DEFAULT_PORTS, conn_label, port_filter, with_connection
from keytide.plans.cut import cut
from keytide.plans.scan import running

# Packets of a connection are scanned in slices of this many seconds of capture time, and of this
# many bytes of its streams.
SLICE_SECONDS = 10
SLICE_BYTES = 1 << 20
IDLE_SECONDS = 60

_WRAP = 1 << 32


def packet_index(packets: DataFrame, ports: Sequence[int] = DEFAULT_PORTS) -> DataFrame:
    """Header facts of the packets that matter to reassembly: about 100 bytes each, no payload.

    These are packets with a payload, and those that open or end a connection (``fin`` and ``rst`` are
    false where ``packets`` has no such columns); bare acknowledgements are left out. Arrival order is ``us`` (time in microseconds), then ``source`` and ``ord`` (position in the
    capture; ``source`` is a hash of the file name).
    """
    kept = with_connection(port_filter(packets, ports), ports)
    size = F.octet_length("payload")
    ends = {n: F.coalesce(F.col(n), F.lit(False)) if n in packets.columns else F.lit(False) for n in ("fin", "rst")}
    return kept.filter((size > 0) | F.col("syn") | ends["fin"] | ends["rst"]).select(
        conn_label(F.col("conn")).alias("conn"),
        "from_server",
        F.unix_micros("ts").alias("us"),
        F.xxhash64("file").alias("source"),
        "ord",
        "seq",
        size.cast("long").alias("len"),
        "syn",
        *[c.alias(n) for n, c in ends.items()],
        F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int").alias("first_byte"),
    )


def _wrap_step(seq: Column, before: Column) -> Column:
    """+1 or -1 where the 32-bit sequence number passed its end between neighbours."""
    return (
        F.when(seq - before < -(_WRAP // 2), 1).when(seq - before > _WRAP // 2, -1).otherwise(0)
    ).cast("long")


def with_flows(
    index: DataFrame, idle_seconds: int = IDLE_SECONDS, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Add ``flow`` (connection and incarnation) and ``unwrapped`` (sequence number past 2^32).

    A new incarnation starts at a client SYN with another sequence number (reused ports) and after
    ``idle_seconds`` without packets; ``split_at_closes`` adds those that follow an end or a reset.  Neighbours in arrival order must be less than 2 GiB apart
    in their stream.
    """
    idle = idle_seconds * 1_000_000
    # Hashes lead the keys because sorting compares them much faster than text.
    slices = ["conn_id", "conn", "slice"]
    order = Window.partitionBy(*slices).orderBy("us", "source", "ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ways = {"client": ~F.col("from_server"), "server": F.col("from_server")}
    seq, us = F.col("seq"), F.col("us")
    local = index.withColumns(
        {
            "conn_id": F.xxhash64("conn"),
            "slice": F.floor(us / F.lit(slice_seconds * 1_000_000)),
        }
    ).select(
        "*",
        F.when(us - F.lag("us").over(order) > idle, us).alias("pause"),
        F.last(F.when(F.col("syn") & ways["client"], seq), True).over(upto).alias("syn_here"),
        F.first("us").over(upto).alias("first_us"),
        F.lead("us").over(order).isNull().alias("is_last"),
        *[F.first(F.when(way, seq), True).over(upto).alias(f"first_{n}") for n, way in ways.items()],
        *[F.last(F.when(way, seq), True).over(upto).alias(f"last_{n}") for n, way in ways.items()],
        *[F.last(F.when(way, seq), True).over(earlier).alias(f"prev_{n}") for n, way in ways.items()],
    )
    local = local.select(
        "*",
        F.last("pause", True).over(upto).alias("pause_here"),
        *[
            F.sum(
                F.when(way, F.coalesce(_wrap_step(seq, F.col(f"prev_{n}")), F.lit(0))).otherwise(0)
            ).over(upto).alias(f"steps_{n}")
            for n, way in ways.items()
        ],
    )
    # One row per slice carries what later slices need to know.
    summary = local.filter("is_last").select(
        *slices, "first_us", F.col("us").alias("last_us"), "pause_here", "syn_here",
        *[f"{what}_{n}" for what in ("first", "last", "steps") for n in ways],
    )
    along = Window.partitionBy("conn_id", "conn").orderBy("slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {
            "pause_first": F.when(
                F.col("first_us") - F.lag("last_us").over(along) > idle, F.col("first_us")
            ),
            **{
                f"cross_{n}": F.coalesce(
                    _wrap_step(F.col(f"first_{n}"), F.last(f"last_{n}", True).over(before)), F.lit(0)
                )
                for n in ways
            },
        }
    )
    carried = summary.select(
        *slices,
        "pause_first",
        F.last(F.coalesce("pause_here", "pause_first"), True).over(before).alias("pause_before"),
        F.last("syn_here", True).over(before).alias("syn_before"),
        *[
            (
                F.sum(f"cross_{n}").over(along.rowsBetween(Window.unboundedPreceding, 0))
                + F.coalesce(F.sum(f"steps_{n}").over(before), F.lit(0))
            ).alias(f"carried_{n}")
            for n in ways
        ],
    )
    steps = F.when(
        F.col("from_server"), F.col("steps_server") + F.col("carried_server")
    ).otherwise(F.col("steps_client") + F.col("carried_client"))
    opened = F.coalesce("syn_here", "syn_before", F.lit(-1))
    resumed = F.coalesce("pause_here", "pause_first", "pause_before", F.lit(0))
    return local.join(carried, slices).select(
        F.concat("conn", F.lit("#"), opened.cast("string"), F.lit("."), resumed.cast("string"))
        .alias("flow"),
        "from_server",
        "us",
        "source",
        "ord",
        (seq + steps * _WRAP).alias("unwrapped"),
        "len",
        "syn",
        "fin",
        "rst",
        "first_byte",
    )


_ARRIVAL = ("us", "source", "ord")


def closing_packets(flows: DataFrame) -> DataFrame:
    """``source, ord`` of the packets that end a connection: a reset, or the end of the second direction.

    Only ends and resets are looked at. Between two resets the ends of a connection, in arrival order, form runs
    of one direction. The first end of a run closes the connection if the other direction had ended since the
    last close. Had it? After a run of several ends it had, for at most its first end was used up by a close.
    After a run of one end it had if that end closed nothing. So the answer turns over from run to run and is
    known anew behind every long run: a count of runs and the last known answer carry it over any distance.
    """
    slices = F.floor(F.col("us") / F.lit(SLICE_SECONDS * 1_000_000))
    order = [F.col(c) for c in _ARRIVAL]
    ends = flows.filter(F.col("fin") | F.col("rst")).select("flow", "from_server", *_ARRIVAL, "fin", "rst")
    ends = cut(ends)
    reset = F.col("rst").cast("long")
    eras = running(ends, ["flow"], slices, order, {"era": ("sum", reset)}, inclusive=False)
    eras = eras.withColumn("era", F.coalesce("era", F.lit(0).cast("long")))
    closed = eras.filter("rst").select("source", "ord")
    fins = eras.filter("fin and not rst")
    keys = ["flow", "era"]
    fins = running(fins, keys, slices, order, {"before": ("last", F.col("from_server"))}, inclusive=False)
    fins = fins.withColumn("opens", F.col("before").isNull() | (F.col("before") != F.col("from_server")))
    fins = running(fins, keys, slices, order, {"after_open": ("last", F.col("opens"))}, inclusive=False)
    fins = running(fins, keys, slices, order, {"runs": ("sum", F.col("opens").cast("long"))})
    # Known at a run's first end: nothing had ended before the first run, something behind a long one.
    known = F.when(F.col("before").isNull(), 2 * F.col("runs")).when(
        F.col("opens") & ~F.col("after_open"), 2 * F.col("runs") + 1
    )
    fins = running(fins, keys, slices, order, {"known": ("last", known)})
    turned = F.pmod(F.col("runs") - F.floor(F.col("known") / 2), F.lit(2))
    had = F.pmod(F.col("known") + turned, F.lit(2)) == 1
    return closed.union(fins.filter(F.col("opens") & had).select("source", "ord"))


def split_at_closes(flows: DataFrame, index: DataFrame) -> DataFrame:
    """Packets behind the one that closes a connection belong to a new incarnation of it.

    Adds the number of closes so far to ``flow``. Without ends and resets in the ``index`` that ``flows`` were made
    of nothing is ordered again.
    """
    if index.filter(F.col("fin") | F.col("rst")).isEmpty():
        return flows.drop("fin", "rst")
    flows = cut(flows)  # read three times
    plain = flows.drop("fin", "rst")
    closing = closing_packets(flows).withColumn("closes", F.lit(1).cast("long"))
    marked = plain.join(closing, ["source", "ord"], "left")
    slices = F.floor(F.col("us") / F.lit(SLICE_SECONDS * 1_000_000))
    order = [F.col(c) for c in _ARRIVAL]
    counted = running(marked, ["flow"], slices, order, {"closed": ("sum", F.col("closes"))}, inclusive=False)
    flow = F.concat("flow", F.lit("."), F.coalesce("closed", F.lit(0)).cast("string")).alias("flow")
    # An end without payload has no place in the stream.
    return counted.filter((F.col("len") > 0) | F.col("syn")).select(flow, *[c for c in plain.columns if c != "flow"])


def conn_of(flow: Column | str) -> Column:
    return F.split_part(F.col(flow) if isinstance(flow, str) else flow, F.lit("#"), F.lit(1))


def segment_index(flows: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Place every packet in its stream, drop repeats, and measure overlap and loss.

    ``rel_start`` counts from the first byte after the SYN, or from the lowest byte seen if there
    was none.  ``skip`` bytes before the segment never arrived; its first ``cut`` payload bytes were
    delivered before.  ``ready`` is when the segment could be read: once everything before it had
    arrived.  ``stream_len`` is where the stream ends, ``client_byte`` the first byte the client sent.
    """
    stream = ["flow_id", "flow", "from_server"]
    slices = [*stream, "slice"]
    # Copies of a packet meet in one row before anything is ordered.
    packets = (
        flows.withColumns(
            {
                "flow_id": F.xxhash64("flow"),
                "start": F.col("unwrapped") + F.col("syn").cast("long"),
            }
        )
        .groupBy(*stream, "start", "len")
        .agg(
            F.min(F.struct("us", "source", "ord")).alias("__first"),
            F.max("syn").alias("syn"),
            F.min("first_byte").alias("first_byte"),
        )
        .select(*stream, "start", "len", "__first.*", "syn", "first_byte")
        .withColumn("slice", F.floor(F.col("start") / F.lit(slice_bytes)))
    )
    end = F.col("start") + F.col("len")
    order = Window.partitionBy(*slices).orderBy("start", "us", "len")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sent = ~F.col("from_server") & (F.col("len") > 0)
    local = packets.select(
        "*",
        F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("end_here"),
        F.max(end).over(upto).alias("max_end"),
        F.max("us").over(upto).alias("ready_here"),
        F.max(F.when(F.col("syn"), F.col("start"))).over(upto).alias("syn_start"),
        F.first("start").over(upto).alias("min_start"),
        F.first(F.when(sent, F.col("start")), True).over(upto).alias("sent_start"),
        F.first(F.when(sent, F.col("first_byte")), True).over(upto).alias("sent_byte"),
        F.lead("start").over(order).isNull().alias("is_last"),
    )
    summary = local.filter("is_last")
    whole = Window.partitionBy(*stream)
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn(
        "client_byte", F.min_by("sent_byte", "sent_start").over(Window.partitionBy("flow_id", "flow"))
    ).select(
        *slices,
        "client_byte",
        F.max("max_end").over(before).alias("end_before"),
        F.max("ready_here").over(before).alias("ready_before"),
        F.coalesce(F.max("syn_start").over(whole), F.min("min_start").over(whole)).alias("base"),
        F.max("max_end").over(whole).alias("stream_end"),
    )
    covered = F.greatest("end_here", "end_before", "base")
    kept = local.select(*packets.columns, "end_here", "ready_here")
    return (
        kept.join(carried, slices)
        .withColumn("cut", F.greatest(covered - F.col("start"), F.lit(0)))
        .filter(F.col("cut") < F.col("len"))
        .select(
            *stream,
            "client_byte",
            (F.col("stream_end") - F.col("base")).alias("stream_len"),
            (F.col("start") + F.col("cut") - F.col("base")).alias("rel_start"),
            F.greatest(F.col("start") - covered, F.lit(0)).alias("skip"),
            "cut",
            (F.col("len") - F.col("cut")).alias("len"),
            F.greatest("ready_here", "ready_before").alias("ready"),
            "us",
            "source",
            "ord",
        )
    )


def with_bytes(
    segments: DataFrame, packets: DataFrame, ports: Sequence[int] = DEFAULT_PORTS
) -> DataFrame:
    """Join payloads to placed segments by their position in the capture."""
    payloads = port_filter(packets, ports).filter(F.octet_length("payload") > 0)
    payloads = payloads.select(F.xxhash64("file").alias("source"), "ord", "payload")
    return segments.join(payloads, ["source", "ord"]).select(
        *segments.columns,
        F.substring("payload", F.col("cut") + 1, F.col("len")).alias("bytes"),
    )


def placed_segments(
    packets: DataFrame,
    ports: Sequence[int] = DEFAULT_PORTS,
    idle_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """Segments of all connections without their bytes, written out for the steps that follow."""
    index = cut(packet_index(packets, ports))
    return cut(segment_index(split_at_closes(with_flows(index, idle_seconds), index)))


def segments(
    packets: DataFrame,
    ports: Sequence[int] = DEFAULT_PORTS,
    idle_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """In-order, non-overlapping segments with bytes of every connection and direction."""
    placed = placed_segments(packets, ports, idle_seconds)
    return with_bytes(placed, packets, ports).withColumn("conn", conn_of(F.col("flow")))


def lost_bytes(placed: DataFrame) -> DataFrame:
    """Bytes that arrived, bytes that never did, and gaps, per connection direction."""
    return placed.groupBy("flow", "from_server").agg(
        F.sum("len").alias("bytes"),
        F.sum("skip").alias("lost"),
        F.count_if(F.col("skip") > 0).alias("gaps"),
    )


def pair_halves(placed: DataFrame) -> DataFrame:
    """Both directions of each connection in one row; a side that was never seen is null."""
    def side(is_server: bool, name: str) -> list[Column]:
        mine = F.col("from_server") if is_server else ~F.col("from_server")
        return [
            F.sum(F.when(mine, F.col("len"))).alias(f"{name}_bytes"),
            F.timestamp_micros(F.min(F.when(mine, F.col("us")))).alias(f"{name}_first"),
        ]

    return placed.groupBy("flow").agg(*side(False, "client"), *side(True, "server"))
