"""From captures to reports in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from keytide.functions.protocols import INFER, check_protocol
from keytide.operators.conversations import extract_events
from keytide.operators.frames import DEFAULT_PORTS, check_ports, decode_frames
from keytide.operators.intervals import cumulative_report, interval_report, ranked_intervals
from keytide.operators.report import HotKeys
from keytide.sources.captures import RAW_SCHEMA, read_captures


def raw_packets(
    spark: SparkSession,
    path: str | None = None,
    packets: DataFrame | None = None,
    ports: Sequence[int] = DEFAULT_PORTS,
) -> DataFrame:
    """Raw packets from exactly one source: capture files, or any table with their columns.

    Of capture files only packets on ``ports`` are read.
    """
    if (path is None) == (packets is None):
        raise ValueError("give either a path or a table of packets")
    check_ports(ports)
    if path is not None:
        return read_captures(spark, path, ports=ports)
    missing = [c for c in RAW_SCHEMA.names if c not in packets.columns]
    if missing:
        raise ValueError(f"packets lack the columns {missing}")
    return packets.select(*RAW_SCHEMA.names)


def capture_events(
    raw: DataFrame, protocol: str = INFER, ports: Sequence[int] = DEFAULT_PORTS, **options
) -> DataFrame:
    """Cache events from raw packets (``file, ord, ts, caplen, wirelen, linktype, data``)."""
    check_protocol(protocol)
    return extract_events(decode_frames(raw), protocol, ports, **options)


def capture_hot_keys(
    raw: DataFrame,
    hot: HotKeys = HotKeys(),
    protocol: str = INFER,
    ports: Sequence[int] = DEFAULT_PORTS,
    interval: str | None = None,
    cumulative: bool = False,
    **options,
) -> DataFrame:
    """Hot keys of a capture: over all of it, or per interval (optionally running on)."""
    events = capture_events(raw, protocol, ports, **options)
    if interval is None:
        return hot.run(events)
    build = cumulative_report if cumulative else interval_report
    reports = build(hot.select(events), hot.spec, interval)
    return ranked_intervals(reports, hot.spec, hot.top, hot.threshold, hot.rank_by)
