"""Cache events from a stream of packets, with state per connection."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keytide.functions.protocols import INFER, LINE_LIMIT, check_protocol, protocols
from keytide.operators.frames import DEFAULT_PORTS, check_ports, conn_label, port_filter, with_connection
from keytide.operators.segments import IDLE_SECONDS
from keytide.streaming.connection import Connection, Follower

EVENT_SCHEMA = "ts timestamp, conn string, protocol string, type string, key string, size long, lost long"


class ConnectionProcessor(StatefulProcessor):
    """Feeds each connection's packets, in arrival order, to its state.

    State per connection is bounded: unread header bytes and out-of-order packets of at most
    ``max_pending`` bytes per direction, and the requests under way.  Value bodies are skipped by
    count.  A connection silent for ``idle_seconds`` of event time is closed by a timer.
    """

    def __init__(self, protocol: str, idle_seconds: int, max_pending: int):
        self.protocol, self.idle_us, self.max_pending = protocol, idle_seconds * 1_000_000, max_pending
        self.steps = protocols()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("connection", "state binary")

    def _load(self) -> Connection:
        if self.state.exists():
            return pickle.loads(self.state.get()[0])
        return Connection(self.protocol, self.max_pending)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        follower = Follower(self.steps, self.idle_us, self._load())
        packets = pd.concat(list(rows)).sort_values(["us", "file", "ord"], kind="stable")
        lost = follower.connection.lost
        columns = ["us", "from_server", "seq", "syn", "fin", "rst", "payload"]
        rows = packets[columns].itertuples(index=False, name=None)
        out = [self._row(key, found) for row in rows for found in follower.take(*row)]
        connection = follower.connection
        lost = connection.lost - lost
        if lost:
            out.append((connection.last_us, key[0], connection.protocol, "lost", None, 0, lost))
        self.state.update((pickle.dumps(connection),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((connection.last_us + self.idle_us) // 1000)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        follower = Follower(self.steps, self.idle_us, self._load())
        rows = [self._row(key, found) for found in follower.finish(follower.connection.last_us)]
        self.state.clear()
        yield self._frame(rows)

    def close(self) -> None:
        pass

    def _row(self, key, found: tuple) -> tuple:
        us, protocol, *event = found
        return (us, key[0], protocol, *event, 0)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split(" ")[0] for f in EVENT_SCHEMA.split(", ")]
        frame = pd.DataFrame(rows, columns=names)
        frame["ts"] = pd.to_datetime(frame["ts"], unit="us", utc=True)
        return frame


def stream_events(
    packets: DataFrame,
    protocol: str = INFER,
    ports: Sequence[int] = DEFAULT_PORTS,
    delay: str = "10 seconds",
    idle_seconds: int = IDLE_SECONDS,
    max_pending: int = LINE_LIMIT,
) -> DataFrame:
    """Events from a streaming table of decoded packets.

    Besides hits and misses there is one ``lost`` row per batch in which a connection lost bytes.
    The session needs the RocksDB state store provider.
    """
    check_protocol(protocol)
    kept = with_connection(port_filter(packets, check_ports(ports)), ports)
    # Bare acknowledgements say nothing, also not that a connection is alive.
    kept = kept.filter((F.octet_length("payload") > 0) | F.col("syn") | F.col("fin") | F.col("rst"))
    rows = kept.select(
        conn_label(F.col("conn")).alias("conn"),
        "ts",
        F.unix_micros("ts").alias("us"),
        "file",
        "ord",
        "from_server",
        "seq",
        "syn",
        "fin",
        "rst",
        "payload",
    ).withWatermark("ts", delay)
    return rows.groupBy("conn").transformWithStateInPandas(
        statefulProcessor=ConnectionProcessor(protocol, idle_seconds, max_pending),
        outputStructType=EVENT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def cache_events(events: DataFrame) -> DataFrame:
    """Hits and misses of :func:`stream_events`, without its loss rows."""
    return events.filter(F.col("type") != "lost").drop("lost")
