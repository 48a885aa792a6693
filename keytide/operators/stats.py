"""Run statistics: how many packets were seen, kept and dropped, and how many replies parsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.functions.text import drop_label, drop_rate
from keytide.plans.scan import running

# The eight counters, by the names used in JSON reports.
COUNTERS = [
    "PacketsEnteredFilter",
    "PacketsPassedFilter",
    "PacketsCaptured",
    "PacketsDroppedKernel",
    "PacketsDroppedParser",
    "PacketsDroppedAnalysis",
    "PacketsDroppedTotal",
    "ResponsesParsed",
]
MEASURED = [
    "PacketsEnteredFilter",
    "PacketsCaptured",
    "PacketsDroppedKernel",
    "PacketsDroppedParser",
    "PacketsDroppedAnalysis",
    "ResponsesParsed",
]
# Intervals scanned together when counters are accumulated or differenced.
_INTERVALS_PER_BUCKET = 4096


def with_derived(df: DataFrame) -> DataFrame:
    """Add the counters that follow from the measured ones."""
    dropped = [F.col(f"PacketsDropped{where}") for where in ("Kernel", "Parser", "Analysis")]
    return df.withColumns(
        {
            "PacketsPassedFilter": F.col("PacketsDroppedKernel") + F.col("PacketsCaptured"),
            "PacketsDroppedTotal": dropped[0] + dropped[1] + dropped[2],
        }
    )


def counted(df: DataFrame, every: str, **flags) -> DataFrame:
    """Counters per interval from rows with ``ts``; ``flags`` maps a counter to a condition.

    Counters not given are 0.
    """
    zero = F.lit(0).cast("long")
    rows = df.select(
        F.col("ts"), *[f.cast("long").alias(n) for n, f in flags.items()]
    ).groupBy(F.window("ts", every).alias("__window"))
    sums = rows.agg(*[F.sum(n).alias(n) for n in flags])
    measured = [F.col(n) if n in flags else zero.alias(n) for n in MEASURED]
    return with_derived(
        sums.select(
            F.col("__window.start").alias("window_start"),
            F.col("__window.end").alias("window_end"),
            *measured,
        )
    ).select("window_start", "window_end", *COUNTERS)


def run_stats(
    packets: DataFrame, events: DataFrame, every: str, passed=None, truncated=None
) -> DataFrame:
    """The eight counters per interval of a batch run.

    ``passed`` and ``truncated`` are conditions on packets (default: all, none).  Nothing is shed
    under load, so the kernel and analysis counters stay 0.
    """
    passed = F.lit(True) if passed is None else passed
    truncated = F.lit(False) if truncated is None else truncated
    zero = F.lit(0)
    seen = packets.select(
        "ts",
        F.lit(1).alias("entered"),
        F.coalesce(passed, F.lit(False)).cast("int").alias("captured"),
        (F.coalesce(passed, F.lit(False)) & F.coalesce(truncated, F.lit(False)))
        .cast("int").alias("parser"),
        zero.alias("parsed"),
    )
    parsed = events.select(
        "ts", zero.alias("entered"), zero.alias("captured"), zero.alias("parser"),
        F.lit(1).alias("parsed"),
    )
    return counted(
        seen.unionByName(parsed),
        every,
        PacketsEnteredFilter=F.col("entered"),
        PacketsCaptured=F.col("captured"),
        PacketsDroppedParser=F.col("parser"),
        ResponsesParsed=F.col("parsed"),
    )


def _bucket(at: str):
    return F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / _INTERVALS_PER_BUCKET)


def cumulative(
    stats: DataFrame, at: str = "window_start", counters: Sequence[str] = tuple(COUNTERS)
) -> DataFrame:
    """Running totals of per-interval counters."""
    totals = {f"__{n}": ("sum", F.col(n)) for n in counters}
    scanned = running(stats, [], _bucket(at), [F.col(at)], totals)
    return scanned.withColumns({n: F.col(f"__{n}") for n in counters}).drop(*totals)


def incremental(
    snapshots: DataFrame, at: str = "window_start", counters: Sequence[str] = tuple(COUNTERS)
) -> DataFrame:
    """Each snapshot of running counters minus the one before it."""
    previous = {f"__{n}": ("last", F.col(n)) for n in counters}
    scanned = running(snapshots, [], _bucket(at), [F.col(at)], previous, inclusive=False)
    return scanned.withColumns(
        {n: F.col(n) - F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in counters}
    ).drop(*previous)


def with_drop_label(stats: DataFrame) -> DataFrame:
    """Add the drop rate and its one-line text."""
    c = {n: F.col(n) for n in COUNTERS}
    return stats.withColumns(
        {
            "drop_rate": drop_rate(c["PacketsDroppedTotal"], c["PacketsPassedFilter"]),
            "drop_label": drop_label(
                c["PacketsDroppedKernel"],
                c["PacketsDroppedParser"],
                c["PacketsDroppedAnalysis"],
                c["PacketsPassedFilter"],
            ),
        }
    )
