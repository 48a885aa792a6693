"""Registered queries of the report layer and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from keytide.functions import text as X
from keytide.functions.spec import Aggregate, State, register_aggregate
from keytide.operators import intervals as I
from keytide.operators import json_report as J
from keytide.operators import report as R
from keytide.operators import stats as S
from keytide.operators.events import filter_keys, hits_and_misses

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


# ---- grouping and aggregates ------------------------------------------------------------------


@check(
    "a2_hot_keys_by_source",
    """SELECT source AS key, max(n_chars) AS max_size, CAST(sum(n_chars) AS BIGINT) AS sum_size
       FROM documents GROUP BY source ORDER BY sum_size DESC, key LIMIT 20""",
)
def hot_keys_by_source(spark, sf):
    return t.flat(R.hot_keys(t.document_events(spark, sf), "key,max(size),sum(size)", top=20))


@check(
    "a1_a11_spec_order",
    f"""SELECT key, CAST(sum(size) AS BIGINT) AS sum_size, min(size) AS min_size,
              CAST(sum(size) // count(*) AS BIGINT) AS avg_size, max(size) AS max_size
        FROM ({t.PAGE_EVENTS}) GROUP BY key""",
)
def spec_order(spark, sf):
    return t.flat(R.report(t.page_events(spark, sf), " key , sum(size),min(size) ,avg(size),max(size)"))


@check(
    "a2_composite_key",
    f"""SELECT CAST(size AS VARCHAR) AS size, key, max(size) AS max_size,
               CAST(sum(size) AS BIGINT) AS sum_size
        FROM ({t.USER_EVENTS}) e GROUP BY e.key, e.size""",
)
def composite_key(spark, sf):
    return t.flat(R.report(t.user_events(spark, sf), "size,key,max(size),sum(size)"))


@check("a3_distinct_keys", f"SELECT DISTINCT key, CAST(size AS VARCHAR) AS size FROM ({t.USER_EVENTS})")
def distinct_keys(spark, sf):
    return R.report(t.user_events(spark, sf), "key,size")


@check(
    "a4_global_aggregates",
    """SELECT max(n_chars) AS max_size, min(n_chars) AS min_size,
              CAST(sum(n_chars) AS BIGINT) AS sum_size,
              CAST(sum(n_chars) // count(*) AS BIGINT) AS avg_size FROM documents""",
)
def global_aggregates(spark, sf):
    return t.flat(R.report(t.document_events(spark, sf), "max(size),min(size),sum(size),avg(size)"))


@check(
    "a4_global_empty",
    """SELECT max(n_chars) AS max_size, CAST(sum(n_chars) AS BIGINT) AS sum_size
       FROM documents WHERE source = 'no such source' HAVING count(*) > 0""",
)
def global_empty(spark, sf):
    none = t.document_events(spark, sf).filter(F.col("key") == "no such source")
    return t.flat(R.report(none, "max(size),sum(size)"))


@check(
    "a8_truncated_average",
    """SELECT CAST(l_partkey AS VARCHAR) AS key,
              CAST(trunc(sum(v)::DOUBLE / count(*)) AS BIGINT) AS avg_size
       FROM (SELECT l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) - 3000000 AS v
             FROM lineitem) GROUP BY l_partkey""",
)
def truncated_average(spark, sf):
    events = t.price_events(spark, sf).withColumn("size", F.col("size") - 3000000)
    return t.flat(R.report(events, "key,avg(size)"))


@check(
    "a14_misses_counted",
    f"""SELECT key, min(CASE WHEN type = 'hit' THEN size ELSE 0 END) AS min_size,
               CAST(sum(CASE WHEN type = 'hit' THEN size ELSE 0 END) // count(*) AS BIGINT) AS avg_size
        FROM ({t.USER_EVENTS}) GROUP BY key""",
)
def misses_counted(spark, sf):
    events = t.user_events(spark, sf).withColumn(
        "size", F.when(F.col("type") == "miss", 0).otherwise(F.col("size"))
    )
    return t.flat(R.report(events, "key,min(size),avg(size)"))


@check(
    "a14_hits_only",
    f"""SELECT key, min(size) AS min_size, CAST(sum(size) AS BIGINT) AS sum_size
        FROM ({t.USER_EVENTS}) WHERE type = 'hit' GROUP BY key""",
)
def hits_only(spark, sf):
    events = hits_and_misses(t.user_events(spark, sf), include_misses=False)
    return t.flat(R.report(events, "key,min(size),sum(size)"))


@check(
    "e1_registered_aggregate",
    """SELECT source AS key, count(*) AS rows_size, max(n_chars) - min(n_chars) AS spread_size
       FROM documents GROUP BY source""",
)
def registered_aggregate(spark, sf):
    register_aggregate("rows", Aggregate((State(F.count, F.sum),)))
    register_aggregate(
        "spread",
        Aggregate((State(F.max, F.max), State(F.min, F.min)), lambda high, low: high - low),
    )
    return t.flat(R.report(t.document_events(spark, sf), "key,rows(size),spread(size)"))


# ---- percentiles ------------------------------------------------------------------------------


def percentile_sql(events: str, quantiles: dict[str, float], group: str = "key") -> str:
    """Same bucket, rank and overflow rule, one filtered minimum for each quantile."""
    names = ", ".join(
        f"""CASE WHEN min(b) FILTER (reached >= greatest(1, floor(CAST({q!r} AS DOUBLE) / 100.0
              * CAST(total AS DOUBLE) + 0.5))) >= 67108864 THEN 9223372036854775807
            ELSE min(b) FILTER (reached >= greatest(1, floor(CAST({q!r} AS DOUBLE) / 100.0
              * CAST(total AS DOUBLE) + 0.5))) END AS {n}"""
        for n, q in quantiles.items()
    )
    key = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    return f"""
    WITH v AS (SELECT {key}least(size, 67108864) AS v FROM ({events})),
         s AS (SELECT {key}v, greatest(length(bin(v)) - 11, 0) AS s FROM v),
         c AS (SELECT {key}((v >> s) << s) + (CAST(1 AS BIGINT) << s) - 1 AS b, count(*) AS n
               FROM s GROUP BY ALL),
         r AS (SELECT {key}b, sum(n) OVER ({part} ORDER BY b) AS reached,
                      sum(n) OVER ({part}) AS total FROM c)
    SELECT {key}{names} FROM r {"GROUP BY " + group if group else ""}"""


DOCUMENT_EVENTS = "SELECT source AS key, n_chars AS size FROM documents"


@check(
    "a9_percentiles_by_source",
    percentile_sql(
        DOCUMENT_EVENTS, {"p50_size": 50.0, "p90_size": 90.0, "p995_size": 99.5, "p9999_size": 99.99}
    ),
)
def percentiles_by_source(spark, sf):
    spec = "key,p50(size),p90(size),p995(size),p9999(size)"
    return t.flat(R.report(t.document_events(spark, sf), spec))


@check(
    "a9_percentiles_many_keys",
    percentile_sql(
        """SELECT CAST(l_partkey AS VARCHAR) AS key,
                  CAST(round(l_extendedprice * 100) AS BIGINT) AS size FROM lineitem""",
        {"p50_size": 50.0, "p75_size": 75.0, "p99_size": 99.0},
    ),
)
def percentiles_many_keys(spark, sf):
    return t.flat(R.report(t.price_events(spark, sf), "key,p50(size),p75(size),p99(size)"))


@check(
    "a9_percentile_overflow",
    percentile_sql(
        """SELECT l_returnflag AS key, CAST(round(l_extendedprice * 1000) AS BIGINT) AS size
           FROM lineitem""",
        {"p10_size": 10.0, "p50_size": 50.0, "p95_size": 95.0},
    ),
)
def percentile_overflow(spark, sf):
    events = t.price_events(spark, sf, 1000, "l_returnflag")
    return t.flat(R.report(events, "key,p10(size),p50(size),p95(size)"))


@check(
    "a10_percentile_descriptors",
    percentile_sql(
        "SELECT n_chars AS size FROM documents",
        {"p05_size": 5.0, "p100_size": 10.0, "p005_size": 0.5, "p995_size": 99.5},
        group="",
    ),
)
def percentile_descriptors(spark, sf):
    spec = "p05(size),p100(size),p005(size),p995(size)"
    return t.flat(R.report(t.document_events(spark, sf), spec))


@check(
    "a11_aggregates_and_percentiles",
    f"""WITH p AS ({percentile_sql(t.PAGE_EVENTS, {"p50_size": 50.0, "p95_size": 95.0})}),
             a AS (SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size,
                          CAST(sum(size) // count(*) AS BIGINT) AS avg_size
                   FROM ({t.PAGE_EVENTS}) GROUP BY key)
        SELECT key, p50_size, max_size, p95_size, sum_size, avg_size FROM a JOIN p USING (key)""",
)
def aggregates_and_percentiles(spark, sf):
    spec = "key,p50(size),max(size),p95(size),sum(size),avg(size)"
    return t.flat(R.report(t.page_events(spark, sf), spec))


# ---- filters, order, top ----------------------------------------------------------------------

URL_SQL = "SELECT url AS key, octet_length(encode(html)) AS size FROM pages"


@check(
    "f2_key_pattern",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size FROM ({URL_SQL})
        WHERE regexp_matches(key, '^https?://[a-z.]+\\.(?:com|org)/(?P<lang>en|fr)/[0-9]+$')
        GROUP BY key""",
)
def key_pattern(spark, sf):
    pattern = r"^https?://[a-z.]+\.(?:com|org)/(?P<lang>en|fr)/[[:digit:]]+$"
    return t.flat(R.report(filter_keys(t.url_events(spark, sf), pattern)))


@check(
    "f4_replaced_filter",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size FROM ({URL_SQL})
        WHERE key LIKE '%page=%' GROUP BY key""",
)
def replaced_filter(spark, sf):
    first = R.HotKeys(filter="^https://")
    return t.flat(first.with_filter("page=").run(t.url_events(spark, sf)))


PRICES = """SELECT CAST(l_partkey AS VARCHAR) AS key,
                   CAST(round(l_extendedprice * 100) AS BIGINT) AS size FROM lineitem"""


@check(
    "f5_threshold",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size FROM ({PRICES})
        GROUP BY key HAVING sum(size) >= 100000000""",
)
def threshold(spark, sf):
    return t.flat(R.hot_keys(t.price_events(spark, sf), threshold=100000000))


@check(
    "f5_o3_threshold_on_other_value",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size FROM ({PRICES})
        GROUP BY key HAVING max(size) >= 9000000 ORDER BY max_size DESC, key LIMIT 50""",
)
def threshold_on_other_value(spark, sf):
    events = t.price_events(spark, sf)
    return t.flat(R.hot_keys(events, threshold=9000000, rank_by="max(size)", top=50))


@check(
    "o1_sort_by_columns",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size,
               row_number() OVER (ORDER BY max(size), sum(size) DESC, key) AS position
        FROM ({t.USER_EVENTS}) GROUP BY key QUALIFY position <= 200""",
)
def sort_by_columns(spark, sf):
    """Position 1 ascending, then position 2 descending; the order shows in ``position``."""
    spec = R.report_spec("key,max(size),sum(size)")
    order = R.sort_columns(spec, 1, -2)
    full = R.report(t.user_events(spark, sf), spec).withColumn("one", F.lit(1))
    ranked = R.top_per(full, ["one"], order, 200, ["key"]).drop("one")
    return t.flat(ranked.withColumnRenamed("rank", "position"))


@check(
    "o1_whole_sort",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size,
               row_number() OVER (ORDER BY max(size), sum(size) DESC, key) AS position
        FROM ({PRICES}) GROUP BY key""",
)
def whole_sort(spark, sf):
    """Every key of the report with its place, ranked in ranges."""
    spec = R.report_spec("key,max(size),sum(size)")
    full = R.report(t.price_events(spark, sf), spec)
    return t.flat(R.top_per(full, [], R.sort_columns(spec, 1, -2), None, ["key"]).withColumnRenamed("rank", "position"))


@check(
    "o2_o3_top_parts",
    f"""SELECT key, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size FROM ({PRICES})
        GROUP BY key ORDER BY sum_size DESC, key LIMIT 100""",
)
def top_parts(spark, sf):
    return t.flat(R.hot_keys(t.price_events(spark, sf), top=100))


@check(
    "o1_w4_uncut_intervals",
    f"""SELECT window_start, key, max_size, sum_size,
               row_number() OVER (PARTITION BY window_start ORDER BY sum_size DESC, key) AS rank
        FROM (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, key,
                     max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size
              FROM ({t.USER_EVENTS}) GROUP BY ALL)""",
)
def uncut_intervals(spark, sf):
    """All keys of every day with their ranks."""
    found = t.flat(I.ranked_intervals(I.interval_report(t.user_events(spark, sf), every="1 day")))
    return found.drop("window_end").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---- intervals --------------------------------------------------------------------------------


def interval_sql(width: str, aggregates: str, events: str = t.USER_EVENTS) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS window_start,
                      time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01')
                        + INTERVAL '{width}' AS window_end, key, {aggregates}
               FROM ({events}) GROUP BY ALL"""


MAX_SUM = "max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size"


@check("w1_daily_report", interval_sql("1 day", MAX_SUM))
def daily_report(spark, sf):
    return t.flat(I.interval_report(t.user_events(spark, sf), every="1 day"))


@check("w1_hourly_report", interval_sql("1 hour", MAX_SUM + ", min(size) AS min_size"))
def hourly_report(spark, sf):
    spec = "key,max(size),sum(size),min(size)"
    return t.flat(I.interval_report(t.user_events(spark, sf), spec, every="1 hour"))


@check(
    "w1_daily_percentiles",
    percentile_sql(
        f"""SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, size FROM ({t.USER_EVENTS})""",
        {"p50_size": 50.0, "p95_size": 95.0},
        "window_start",
    ),
)
def daily_percentiles(spark, sf):
    report = I.interval_report(t.user_events(spark, sf), "p50(size),p95(size)", "1 day")
    return t.flat(report.drop("window_end"))


@check(
    "w4_daily_top",
    f"""SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY sum_size DESC, key) AS rank
        FROM ({interval_sql("1 day", MAX_SUM)}) WHERE sum_size >= 60 QUALIFY rank <= 10""",
)
def daily_top(spark, sf):
    daily = I.interval_report(t.user_events(spark, sf), every="1 day")
    return t.flat(I.ranked_intervals(daily, top=10, threshold=60))


CUMULATIVE = f"""
    WITH e AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, key, size FROM ({t.USER_EVENTS})),
         ticks AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL '1 day')) AS day FROM e),
         p AS (SELECT day, key, max(size) AS m, sum(size) AS s, count(*) AS n FROM e GROUP BY ALL)
    SELECT ticks.day AS window_start, ticks.day + INTERVAL '1 day' AS window_end, key,
           max(m) AS max_size, CAST(sum(s) AS BIGINT) AS sum_size,
           CAST(sum(s) // sum(n) AS BIGINT) AS avg_size
    FROM ticks JOIN p ON p.day <= ticks.day GROUP BY ALL"""


@check("w2_cumulative", CUMULATIVE)
def cumulative(spark, sf):
    spec = "key,max(size),sum(size),avg(size)"
    return t.flat(I.cumulative_report(t.user_events(spark, sf), spec, "1 day"))


@check(
    "w2_cumulative_percentiles",
    f"""WITH e AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, key, size FROM ({t.USER_EVENTS})),
         ticks AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL '1 day')) AS day FROM e),
         r AS (SELECT ticks.day AS day, key, size,
                      row_number() OVER (PARTITION BY ticks.day, key ORDER BY size) AS reached,
                      count(*) OVER (PARTITION BY ticks.day, key) AS total
               FROM ticks JOIN e ON e.day <= ticks.day)
    SELECT day AS window_start, key, max(size) AS max_size,
           min(size) FILTER (reached >= greatest(1, floor(0.5::DOUBLE * total + 0.5))) AS p50_size,
           min(size) FILTER (reached >= greatest(1, floor(0.9::DOUBLE * total + 0.5))) AS p90_size
    FROM r GROUP BY ALL""",
)
def cumulative_percentiles(spark, sf):
    spec = "key,max(size),p50(size),p90(size)"
    running = I.cumulative_report(t.user_events(spark, sf), spec, "1 day")
    return t.flat(running.drop("window_end"))


@check(
    "w2_keyless_percentiles",
    f"""WITH e AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, size FROM ({t.USER_EVENTS})),
         ticks AS (SELECT DISTINCT hour FROM e),
         grid AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL '1 hour')) AS tick FROM e),
         r AS (SELECT ticks.hour AS hour, size, row_number() OVER (PARTITION BY ticks.hour ORDER BY size) AS reached,
                      count(*) OVER (PARTITION BY ticks.hour) AS total
               FROM ticks JOIN e ON e.hour <= ticks.hour),
         p AS (SELECT hour, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS sum_size,
                      min(size) FILTER (reached >= greatest(1, floor(0.5::DOUBLE * total + 0.5))) AS p50_size,
                      min(size) FILTER (reached >= greatest(1, floor(0.99::DOUBLE * total + 0.5))) AS p99_size
               FROM r GROUP BY hour)
    SELECT tick AS window_start, max_size, sum_size, p50_size, p99_size FROM grid ASOF JOIN p ON tick >= hour""",
)
def keyless_percentiles(spark, sf):
    """One running report of all events, hour by hour: hundreds of slices, no key."""
    spec = "max(size),sum(size),p50(size),p99(size)"
    running = I.cumulative_report(t.user_events(spark, sf), spec, "1 hour")
    return t.flat(running.drop("window_end"))


# ---- statistics -------------------------------------------------------------------------------

STATS_SQL = """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
           time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
           count(*) AS PacketsEnteredFilter,
           count(*) FILTER (event_type <> 'view') AS PacketsPassedFilter,
           count(*) FILTER (event_type <> 'view') AS PacketsCaptured,
           CAST(0 AS BIGINT) AS PacketsDroppedKernel,
           count(*) FILTER (event_type = 'error') AS PacketsDroppedParser,
           CAST(0 AS BIGINT) AS PacketsDroppedAnalysis,
           count(*) FILTER (event_type = 'error') AS PacketsDroppedTotal,
           count(*) FILTER (event_type = 'click') AS ResponsesParsed
    FROM events GROUP BY ALL"""


def hourly_stats(spark, sf):
    """The event table read as packets: views fail the filter, errors the parser; clicks reply."""
    rows = t.read(spark, sf, "events")
    kind = F.col("event_type")
    return S.run_stats(
        rows, rows.filter(kind == "click"), "1 hour", passed=kind != "view", truncated=kind == "error"
    )


check("t6_run_statistics", STATS_SQL)(hourly_stats)


@check(
    "t6_cumulative_statistics",
    f"SELECT window_start, {', '.join(f'CAST(sum({c}) OVER (ORDER BY window_start) AS BIGINT) AS {c}' for c in S.COUNTERS)} FROM ({STATS_SQL})",
)
def cumulative_statistics(spark, sf):
    return S.cumulative(hourly_stats(spark, sf)).drop("window_end")


@check(
    "w3_incremental_statistics",
    f"""SELECT window_start, PacketsCaptured - lag(PacketsCaptured, 1, 0) OVER w AS PacketsCaptured,
               ResponsesParsed - lag(ResponsesParsed, 1, 0) OVER w AS ResponsesParsed
        FROM ({STATS_SQL}) WINDOW w AS (ORDER BY window_start)""",
)
def incremental_statistics(spark, sf):
    names = ["PacketsCaptured", "ResponsesParsed"]
    return S.incremental(hourly_stats(spark, sf).select("window_start", *names), counters=names)


@check(
    "x12_drop_label",
    f"""SELECT window_start,
          CASE WHEN PacketsPassedFilter = 0 THEN 0.0::DOUBLE
               ELSE PacketsDroppedTotal::DOUBLE / PacketsPassedFilter END AS drop_rate,
          printf('Dropped: %d+%d+%d=%d (%5.2f%%)', PacketsDroppedKernel, PacketsDroppedParser,
                 PacketsDroppedAnalysis, PacketsDroppedTotal,
                 CASE WHEN PacketsPassedFilter = 0 THEN 0.0::DOUBLE
                 ELSE PacketsDroppedTotal::DOUBLE / PacketsPassedFilter END * 100) AS drop_label
        FROM ({STATS_SQL})""",
)
def drop_label(spark, sf):
    return S.with_drop_label(hourly_stats(spark, sf)).select("window_start", "drop_rate", "drop_label")


# ---- totals, JSON, merging --------------------------------------------------------------------


@check(
    "a13_totals",
    f"""WITH f AS (SELECT key, CAST(sum(size) AS BIGINT) AS s FROM ({PRICES}) GROUP BY key),
             c AS (SELECT * FROM f ORDER BY s DESC, key LIMIT 100)
        SELECT (SELECT count(*) FROM f) AS total_keys, (SELECT CAST(sum(s) AS BIGINT) FROM f) AS total_bytes,
               (SELECT count(*) FROM c) AS reported_keys,
               (SELECT CAST(sum(s) AS BIGINT) FROM c) AS reported_bytes,
               100.0::DOUBLE * (SELECT sum(s)::DOUBLE FROM c) / (SELECT sum(s)::DOUBLE FROM f)
                 AS reported_percentage""",
)
def report_totals(spark, sf):
    hot = R.HotKeys(top=100)
    events = t.price_events(spark, sf)
    return R.totals(hot.full(events), hot.run(events), "sum(size)")


@check(
    "a13_daily_totals",
    f"""WITH f AS ({interval_sql("1 day", MAX_SUM)}),
             c AS (SELECT * FROM f WHERE sum_size >= 150
                   QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY sum_size DESC, key) <= 5)
        SELECT f.window_start, f.total_keys, f.total_bytes, coalesce(c.n, 0) AS reported_keys,
               coalesce(c.b, 0) AS reported_bytes,
               CASE WHEN coalesce(c.b, 0) > 0 THEN 100.0::DOUBLE * c.b::DOUBLE / f.total_bytes::DOUBLE
                    ELSE 0.0::DOUBLE END AS reported_percentage
        FROM (SELECT window_start, count(*) AS total_keys, CAST(sum(sum_size) AS BIGINT) AS total_bytes
              FROM f GROUP BY ALL) f
        LEFT JOIN (SELECT window_start, count(*) AS n, CAST(sum(sum_size) AS BIGINT) AS b
                   FROM c GROUP BY ALL) c USING (window_start)""",
)
def daily_totals(spark, sf):
    daily = I.interval_report(t.user_events(spark, sf), every="1 day")
    shown = I.ranked_intervals(daily, top=5, threshold=150)
    return R.totals(daily, shown, "sum(size)", ["window_start"])


JSON_SQL = f"""
    WITH f AS ({interval_sql("1 day", MAX_SUM)}),
         r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY sum_size DESC, key) AS rank
               FROM f QUALIFY rank <= 3)
    SELECT strftime(f.window_end, '%Y-%m-%dT%H:%M:%SZ') AS stamp, f.total_keys, r.reported_keys,
           r.rows_json
    FROM (SELECT window_start, window_end, count(*) AS total_keys FROM f GROUP BY ALL) f
    JOIN (SELECT window_start, count(*) AS reported_keys,
                 '[' || string_agg('{{"key":"' || key || '","max(size)":' || max_size
                   || ',"sum(size)":' || sum_size || '}}', ',' ORDER BY rank) || ']' AS rows_json
          FROM r GROUP BY ALL) r USING (window_start)"""


@check("x14_json_rows", JSON_SQL)
def json_rows(spark, sf):
    daily = I.interval_report(t.user_events(spark, sf), every="1 day")
    reports = J.json_reports(daily, by=I.WINDOW, top=3)
    return reports.select(
        F.col("Timestamp").alias("stamp"),
        F.col("TotalKeys").alias("total_keys"),
        F.col("ReportedKeys").alias("reported_keys"),
        F.to_json("Rows").alias("rows_json"),
    )


@check(
    "u1_merge_reports",
    f"""SELECT CAST(l_partkey AS VARCHAR) AS key, max(v) AS max_size, min(v) AS min_size,
               CAST(sum(v) AS BIGINT) AS sum_size
        FROM (SELECT l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)
        GROUP BY l_partkey""",
)
def merge_reports(spark, sf):
    spec = "key,max(size),min(size),sum(size)"
    lineitem = t.read(spark, sf, "lineitem")
    parts = [
        R.report(
            t.as_events(
                lineitem.filter(F.col("l_returnflag") == flag),
                "l_partkey",
                F.round(F.col("l_extendedprice") * 100),
            ),
            spec,
        )
        for flag in ("A", "N", "R")
    ]
    return t.flat(R.merge_reports(*parts, spec=spec))


@check(
    "u1_merge_partials",
    f"""WITH p AS ({percentile_sql(DOCUMENT_EVENTS, {"p50_size": 50.0})})
        SELECT source AS key, CAST(sum(n_chars) // count(*) AS BIGINT) AS avg_size,
               any_value(p50_size) AS p50_size
        FROM documents JOIN p ON p.key = source GROUP BY source""",
)
def merge_partials(spark, sf):
    spec = "key,avg(size),p50(size)"
    documents = t.read(spark, sf, "documents")
    parts = [
        R.partial_report(t.as_events(documents.filter(where), "source", "n_chars"), spec)
        for where in (F.col("lang") == "en", F.coalesce(F.col("lang") != "en", F.lit(True)))
    ]
    return t.flat(R.finish_report(R.merge_partials(*parts, spec=spec), spec))


# ---- scalar functions -------------------------------------------------------------------------


@check(
    "d8_d9_flat_key",
    f"""SELECT key || chr(0) || CAST(size AS VARCHAR) || chr(0) AS flat_key,
               CAST(size AS VARCHAR) AS size_text, count(*) AS n
        FROM ({t.USER_EVENTS}) GROUP BY ALL""",
)
def flat_key(spark, sf):
    events = t.user_events(spark, sf)
    return events.groupBy(
        X.flat_key(F.col("key"), F.col("size")).alias("flat_key"),
        F.col("size").cast("string").alias("size_text"),
    ).agg(F.count(F.lit(1)).alias("n"))


@check(
    "x10_x11_stamp_and_share",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
              CASE WHEN o_custkey - 100 > 0 AND o_orderkey > 0
                   THEN 100.0::DOUBLE * (o_custkey - 100)::DOUBLE / o_orderkey::DOUBLE
                   ELSE 0.0::DOUBLE END AS share
       FROM orders""",
)
def stamp_and_share(spark, sf):
    return t.read(spark, sf, "orders").select(
        "o_orderkey",
        X.rfc3339(F.col("o_orderdate").cast("timestamp")).alias("stamp"),
        X.percentage(F.col("o_custkey") - 100, F.col("o_orderkey")).alias("share"),
    )
