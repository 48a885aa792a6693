"""Driver tables as event inputs, and small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.events import as_events


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame) -> DataFrame:
    """Report columns under plain names: ``max(size)`` becomes ``max_size``."""
    return df.toDF(*[c.replace("(", "_").rstrip(")") for c in df.columns])


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(read(spark, sf_dir, "documents"), "source", "n_chars")


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return as_events(pages, F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.octet_length("html"))


def url_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(read(spark, sf_dir, "pages"), "url", F.octet_length("html"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per row of the event table, keyed by user, sized by the number in ``props``."""
    return as_events(
        read(spark, sf_dir, "events"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")),
        F.get_json_object("props", "$.k"),
        ts="ts",
        type=F.when(F.col("event_type") == "error", "miss").otherwise("hit"),
    )


def price_events(spark: SparkSession, sf_dir: str, scale: int = 100, key: str = "l_partkey") -> DataFrame:
    lineitem = read(spark, sf_dir, "lineitem")
    return as_events(lineitem, key, F.round(F.col("l_extendedprice") * scale))


USER_EVENTS = """
    SELECT 'user:' || user_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, ts,
           CASE WHEN event_type = 'error' THEN 'miss' ELSE 'hit' END AS type
    FROM events
"""
PAGE_EVENTS = """
    SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS key, octet_length(encode(html)) AS size
    FROM pages
"""


def address(number: str):
    """Dotted address in 10.0.0.0/8 to 255.0.0.0/8 from a 32-bit number."""
    n = F.col(number)
    parts = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)
