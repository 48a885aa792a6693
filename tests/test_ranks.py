"""Ranks of uncut reports: many tasks for one group, the same numbers as a window gives."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from keytide.operators import json_report as J
from keytide.plans.ranks import ranked


def test_ranks_like_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randint(0, 50), f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, k string")
    order = [F.col("v").desc(), F.col("k")]
    for by in (["g"], []):
        window = Window.partitionBy(*by).orderBy(*order)
        expected = df.withColumn("rank", F.row_number().over(window).cast("long"))
        assert sorted(ranked(df, by, order).collect(), key=repr) == sorted(expected.collect(), key=repr)
    assert ranked(df.limit(0), ["g"], order).count() == 0


def test_a_million_keys_of_one_interval_are_ranked_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.range(1_000_000).select(F.lit(0).alias("day"), F.pmod(F.xxhash64("id"), F.lit(999)).alias("v"), "id")
        found = ranked(df, ["day"], [F.col("v").desc(), F.col("id")])
        per_task = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 4 and max(r["count"] for r in per_task) < 400_000
        summary = found.agg(F.min("rank"), F.max("rank"), F.sum("rank"), F.countDistinct("rank")).first()
        assert tuple(summary) == (1, 10**6, 10**6 * (10**6 + 1) // 2, 10**6)
        step = Window.partitionBy(F.floor(F.col("rank") / 1000)).orderBy("rank")
        wrong = found.withColumn("next", F.lead("v").over(step)).filter("next > v")
        assert wrong.count() == 0
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # Rows are numbered by range; only counts of ranges meet by interval.
        assert len(windows) == 2 and sum("__range" in w and "row_number" in w for w in windows) == 1
        assert sum("sum(__rows" in w for w in windows) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_uncut_json_report_in_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "PART_ROWS", 100)
    full = spark.range(1050).select(F.col("id").cast("string").alias("key"), F.pmod(F.col("id") * 7919, F.lit(500)).alias("sum(size)"))
    found = J.json_reports(full, "key,sum(size)", stamp=F.lit(0).cast("timestamp")).orderBy("Part").collect()
    assert [r["Part"] for r in found] == list(range(11)) and {len(r["Rows"]) for r in found} == {100, 50}
    rows = [(r["sum(size)"], r["key"]) for part in found for r in part["Rows"]]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1])) and len(rows) == 1050
