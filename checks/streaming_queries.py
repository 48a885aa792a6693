"""Registered queries of the streaming operators: file streams over the tables, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import report_queries as r
from checks import tables as t
from checks import traffic as w
from keytide.operators.events import as_events
from keytide.operators.report import HotKeys
from keytide.plans.cut import shared_folder
from keytide.streaming import reports as SR
from keytide.streaming.decode import cache_events, stream_events

QUERIES, SQL = {}, {}
#: Rows of a landing file on average, where there are enough for one.
FILE_ROWS = 200_000


def check(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def run_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def land(parts: list[DataFrame], folder: str, *by: str) -> int:
    """Write the parts one after the other, each as the same number of files, which is returned.

    A stream that takes so many files at a trigger takes a part at a trigger. Rows go to files by ``by``.
    """
    files = max(1, min(part.count() for part in parts) // FILE_ROWS)
    for part in parts:
        part.repartition(files, *by).write.mode("append").parquet(folder)
    return files


def streamed_user_events(spark, sf):
    schema = t.read(spark, sf, "events").schema
    return user_events_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def user_events_of(rows):
    return as_events(
        rows,
        F.concat(F.lit("user:"), F.col("user_id").cast("string")),
        F.get_json_object("props", "$.k"),
        ts=F.col("ts").cast("timestamp"),
    )


@check(
    "t1_stream_interval_report",
    f"""SELECT window_start, key, max_size, sum_size, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY sum_size DESC, key) AS rank
          FROM ({r.interval_sql("1 day", r.MAX_SUM)}))
        WHERE rank <= 20 AND window_end <= (SELECT max(ts) FROM events)""",
)
def stream_interval_report(spark, sf):
    """Daily top keys of the event stream; a day is reported once the stream has passed its end."""
    folder = run_folder(spark)
    SR.start_interval_reports(
        streamed_user_events(spark, sf), HotKeys(top=20), "1 day", f"{folder}/state",
        lambda report, batch: report.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"),
        availableNow=True,
    ).awaitTermination()
    found = t.flat(spark.read.parquet(f"{folder}/out").drop("batch", "window_end"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@check(
    "t2_t7_running_report",
    f"""WITH p AS ({r.percentile_sql(t.USER_EVENTS, {"p50_size": 50.0, "p90_size": 90.0})})
        SELECT key, CAST(sum(size) AS BIGINT) AS sum_size, any_value(p50_size) AS p50_size,
               any_value(p90_size) AS p90_size
        FROM ({t.USER_EVENTS}) JOIN p USING (key) GROUP BY key""",
)
def running_report(spark, sf):
    """Report over the whole stream so far, as handed out at the last trigger."""
    folder = run_folder(spark)
    SR.start_running_reports(
        streamed_user_events(spark, sf), HotKeys("key,sum(size),p50(size),p90(size)"),
        f"{folder}/state", lambda report, batch: report.write.mode("overwrite").parquet(f"{folder}/out"),
        availableNow=True,
    ).awaitTermination()
    return t.flat(spark.read.parquet(f"{folder}/out"))


@check(
    "t7_running_top",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size FROM ({t.USER_EVENTS})
        GROUP BY key ORDER BY sum_size DESC, key LIMIT 25""",
)
def running_top(spark, sf):
    """The top after the last of four triggers, each of which hands over only the keys of its rows."""
    folder = run_folder(spark)
    events = t.read(spark, sf, "events")
    parts = [events.filter(F.pmod(F.xxhash64("user_id", "ts"), F.lit(4)) == i) for i in range(4)]
    files = land(parts, f"{folder}/in", "event_id")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    SR.start_running_reports(
        user_events_of(stream), HotKeys(top=25), f"{folder}/state",
        lambda report, batch: report.write.mode("overwrite").parquet(f"{folder}/out"),
        availableNow=True,
    ).awaitTermination()
    return t.flat(spark.read.parquet(f"{folder}/out"))


@check("t4_stream_decode", f"SELECT key, type, size FROM ({w.REDIS_EVENTS}) UNION ALL {w.MCTEXT_EVENTS}")
def stream_decode(spark, sf):
    """Both protocols as a stream of packets, decoded with state per connection."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folder = run_folder(spark)
    messages = w.redis_messages(spark, sf).unionByName(w.mctext_messages(spark, sf))
    packets = w.packets_of(messages).withColumns({"fin": F.lit(False), "rst": F.lit(False)})
    packets.write.parquet(f"{folder}/packets")
    stream = spark.readStream.schema(packets.schema).parquet(f"{folder}/packets")
    events = cache_events(stream_events(stream, idle_seconds=10**6))
    SR.start_events(
        events, lambda found, batch: found.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"),
        f"{folder}/state", availableNow=True,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key", "type", "size")
