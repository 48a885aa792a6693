"""Inputs of registered queries: their order, their files and the parts they land in."""

from pyspark.sql import functions as F

from checks import capture_queries, message_queries, streaming_queries
from checks.packet_queries import order_frames


def test_line_items_at_one_place_of_an_order(spark, tmp_path):
    rows = [(1, 7, 3, part, float(part), flag) for part, flag in zip(range(60), "NARNNA" * 10)]
    rows += [(1, 7, 3, 5, 5.0, "N"), (1, 7, 3, 5, 5.0, "N"), (2, 7, 3, 5, 5.0, "N")]
    names = "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = message_queries.line_events(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((str(s), f"part:{p}", int(q)) for s, _, _, p, q, f in rows if f == "N")


def test_capture_files_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(capture_queries, "FILE_FRAMES", 50, raising=False)
    orders = spark.range(1000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.lit("2020-01-01").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    frames = order_frames(spark, str(tmp_path))
    folder = capture_queries.written(spark, frames)
    found = capture_queries.read_captures(spark, f"{folder}/pcapng")
    assert found.select("file").distinct().count() == 20
    assert sorted(bytes(r[0]) for r in found.select("data").collect()) == sorted(bytes(r[0]) for r in frames.select("data").collect())


def test_parts_land_in_as_many_files_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming_queries, "FILE_ROWS", 100)
    parts = [spark.range(0, 350), spark.range(350, 1500), spark.range(1500, 1900)]
    files = streaming_queries.land(parts, f"{tmp_path}/in", "id")
    assert files == 3
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    seen = []
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state")
    query.foreachBatch(lambda rows, _: seen.append(sorted(r["id"] for r in rows.collect()))).start().awaitTermination()
    assert seen == [list(range(0, 350)), list(range(350, 1500)), list(range(1500, 1900))]
