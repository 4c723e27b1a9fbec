"""The test tables seen as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.time import bucket_start

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FIRST, LAST = "2024-01-01 00:00:00", "2024-01-30 23:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each event type: ``symbol, ts, seq, value``."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), "value")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sparse series of five columns for each user."""
    cells = [F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in EVENT_TYPES]
    return table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), *cells)


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in EVENT_TYPES], "symbol string")


def daily_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each event type and day that has events."""
    rows = events(spark, sf_dir).withColumn("day", bucket_start(F.col("ts")))
    found = rows.groupBy("symbol", "day").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_rows"))
    return found.select("symbol", F.concat_ws("-", "symbol", F.date_format("day", "yyyyMMdd")).alias("segment_id"), "start", "end", "n_rows")


CATALOG_SQL = """
    SELECT event_type AS symbol, event_type || '-' || strftime(date_trunc('day', ts), '%Y%m%d') AS segment_id,
           min(ts) AS start, max(ts) AS "end", count(*) AS n_rows
    FROM events GROUP BY event_type, date_trunc('day', ts)"""


def ranges(spark: SparkSession) -> DataFrame:
    """``symbol, low, high``: three ranges for each event type."""
    rows = [(t, d, low, high) for t in EVENT_TYPES for d, (low, high) in enumerate(RANGES)]
    df = spark.createDataFrame(rows, "symbol string, range_id int, low string, high string")
    return df.select("symbol", F.col("range_id").cast("long").alias("range_id"), F.col("low").cast("timestamp_ntz").alias("low"), F.col("high").cast("timestamp_ntz").alias("high"))


RANGES = [("2024-01-03 06:00:00", "2024-01-05 18:00:00"), ("2024-01-10 00:00:00", "2024-01-10 00:00:01"), ("2024-01-28 12:00:00", "2024-02-03 00:00:00")]
RANGES_SQL = "SELECT symbol, range_id, low, high FROM (VALUES {}) t(symbol, range_id, low, high)".format(
    ", ".join(f"('{t}', {d}::BIGINT, TIMESTAMP '{low}', TIMESTAMP '{high}')" for t in EVENT_TYPES for d, (low, high) in enumerate(RANGES))
)
