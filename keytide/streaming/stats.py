"""Run statistics of streaming queries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from keytide.operators.stats import COUNTERS

PACKETS, EVENTS = "keytide_packets", "keytide_events"


def observe_packets(packets: DataFrame, passed: Column, truncated: Column) -> DataFrame:
    """Count packets as they stream by: all, those that pass the filter, and truncated ones."""
    ok = F.coalesce(passed, F.lit(False))
    return packets.observe(
        PACKETS,
        F.count(F.lit(1)).alias("PacketsEnteredFilter"),
        F.count_if(ok).alias("PacketsCaptured"),
        F.count_if(ok & F.coalesce(truncated, F.lit(False))).alias("PacketsDroppedParser"),
    )


def observe_events(events: DataFrame) -> DataFrame:
    """Count parsed replies as they stream by."""
    return events.observe(EVENTS, F.count(F.lit(1)).alias("ResponsesParsed"))


def counters_of(progress: dict) -> dict[str, int]:
    """The eight counters of one batch from its progress (parsed JSON).

    Rows dropped for being later than the watermark count as dropped by analysis.
    """
    found = dict.fromkeys(COUNTERS, 0)
    for metrics in (progress.get("observedMetrics") or {}).values():
        for name, value in (metrics or {}).items():
            if name in found:
                found[name] += int(value or 0)
    late = sum(op.get("numRowsDroppedByWatermark", 0) for op in progress.get("stateOperators", []))
    found["PacketsDroppedAnalysis"] += late
    found["PacketsPassedFilter"] = found["PacketsDroppedKernel"] + found["PacketsCaptured"]
    found["PacketsDroppedTotal"] = sum(
        found[f"PacketsDropped{where}"] for where in ("Kernel", "Parser", "Analysis")
    )
    return found


class RunningCounters:
    """Counters of a query's finished batches, kept with its checkpoint so that restarts go on from them.

    A batch is counted when its progress is there, which is after it has ended: what is reported in a batch
    is the state after the one before, as a report at any moment knows of what was finished by then.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.path = spark, f"{checkpoint}/counters"
        self.total, self.reported, self.last = dict.fromkeys(COUNTERS, 0), dict.fromkeys(COUNTERS, 0), -1
        schema = ", ".join(f"{kind}_{n} long" for kind in ("total", "reported") for n in COUNTERS)
        self.schema = f"batch long, last long, {schema}"
        for r in self._kept():
            self.last = r["last"]
            self.total, self.reported = ({n: r[f"{kind}_{n}"] for n in COUNTERS} for kind in ("total", "reported"))

    def _kept(self) -> list:
        """The newest state that was written, if there is one."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return []
        return self.spark.read.schema(self.schema).json(f"{self.path}/*").orderBy(F.desc("batch")).limit(1).collect()

    def advance(self, progress: list[dict]) -> None:
        """Add the batches not counted yet; where nothing was observed, rows that came in count as packets and events."""
        for p in sorted(progress, key=lambda p: p["batchId"]):
            if p["batchId"] > self.last:
                self.last = p["batchId"]
                if not p.get("observedMetrics"):
                    rows = p.get("numInputRows") or 0
                    seen = {"PacketsEnteredFilter": rows, "PacketsCaptured": rows, "ResponsesParsed": rows}
                    p = p | {"observedMetrics": {EVENTS: seen}}
                found = counters_of(p)
                self.total = {n: v + found[n] for n, v in self.total.items()}

    def report(self, batch: int) -> tuple[dict[str, int], dict[str, int]]:
        """All so far, and what came since the last report; written down under the batch's number."""
        change = {n: v - self.reported[n] for n, v in self.total.items()}
        self.reported = dict(self.total)
        row = {"batch": batch, "last": self.last}
        row |= {f"total_{n}": v for n, v in self.total.items()} | {f"reported_{n}": v for n, v in self.reported.items()}
        names = [f.split()[0] for f in self.schema.split(", ")]
        frame = self.spark.createDataFrame([tuple(row[n] for n in names)], self.schema)
        frame.coalesce(1).write.mode("overwrite").json(f"{self.path}/batch={batch}")
        return dict(self.total), change


class StatsListener(StreamingQueryListener):
    """Calls ``handler(cumulative, incremental)`` after every batch."""

    def __init__(self, handler: Callable[[dict[str, int], dict[str, int]], None]):
        self.handler = handler
        self.cumulative = dict.fromkeys(COUNTERS, 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        incremental = counters_of(json.loads(event.progress.json))
        self.cumulative = {n: v + incremental[n] for n, v in self.cumulative.items()}
        self.handler(dict(self.cumulative), incremental)

    def onQueryTerminated(self, event) -> None:
        pass
