"""Queries that write a store to the shared folder and read it back, each beside its SQL.

Every store holds all rows of ``events``: a symbol for each event type, one
column ``value``. The second commit writes every tenth event again, one higher.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.types import VALUE_COLUMNS, typed_field
from tickweave.operators.model import TALL
from tickweave.plans.fixtures import EVENT_TYPES, table
from tickweave.plans.queries import query
from tickweave.sources.provider import fetch
from tickweave.sources.shared import new_folder
from tickweave.sources.store import Store

FIRST_SQL = "SELECT event_type AS symbol, ts, event_id AS seq, value, 1 AS c FROM events WHERE value IS NOT NULL"
SECOND_SQL = "SELECT event_type AS symbol, ts, event_id AS seq, value + 1 AS value, 2 AS c FROM events WHERE value IS NOT NULL AND event_id % 10 = 0"
MERGED_SQL = f"SELECT symbol, ts, arg_max(value, (c, seq)) AS value FROM ({FIRST_SQL} UNION ALL {SECOND_SQL}) GROUP BY symbol, ts"


def tall_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("value IS NOT NULL")
    named = rows.select(F.col("event_type").alias("symbol"), F.lit("value").alias("column"), "ts", F.col("event_id").cast("long").alias("seq"), F.col("value").alias("v_double"))
    return named.select(*TALL[:4], *[typed_field(named, v, v[2:]) for v in VALUE_COLUMNS])


def two_commits(spark: SparkSession, d: str) -> Store:
    store = Store(spark, new_folder(spark, "store"))
    rows = tall_events(spark, d)
    store.append(rows)
    store.append(rows.where("seq % 10 = 0").withColumn("v_double", F.col("v_double") + 1))
    return store


def shown(tall: DataFrame) -> DataFrame:
    return tall.select("symbol", "ts", F.col("v_double").alias("value"))


@query(MERGED_SQL)
def store_merged_read(spark, d):
    return shown(two_commits(spark, d).scan(EVENT_TYPES))


@query(f"""SELECT CAST(v AS BIGINT) AS version, symbol, min(ts) AS start, max(ts) AS "end", count(*) AS n_rows, CAST(c AS BIGINT) AS commit
    FROM ({FIRST_SQL} UNION ALL {SECOND_SQL}) JOIN (VALUES (1), (2)) t(v) ON c <= v GROUP BY v, symbol, c""")
def store_versions(spark, d):
    store = two_commits(spark, d)
    found = [store.catalog(v).withColumn("version", F.lit(v).cast("long")) for v in (1, 2)]
    return found[0].unionByName(found[1]).select("version", "symbol", "start", "end", "n_rows", "commit")


@query(f"SELECT * FROM ({MERGED_SQL}) WHERE symbol = 'view' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'")
def store_range_read(spark, d):
    return shown(two_commits(spark, d).scan("view", "2024-01-03", "2024-01-09", ["value"]))


@query(f"SELECT * FROM ({MERGED_SQL}) WHERE NOT (symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20')")
def store_delete(spark, d):
    store = two_commits(spark, d)
    store.delete("click", "2024-01-08", "2024-01-20")
    return shown(store.scan(EVENT_TYPES))


@query(MERGED_SQL)
def store_snapshot(spark, d):
    store = two_commits(spark, d)
    before = shown(store.scan(EVENT_TYPES))
    store.delete("view", "2024-01-01", "2024-12-31")
    return before


@query(f"""SELECT symbol, count(*) AS n_rows, CAST(3 AS BIGINT) AS commit FROM ({MERGED_SQL}) WHERE symbol = 'click' GROUP BY symbol
    UNION ALL SELECT symbol, count(*), CAST(c AS BIGINT) FROM ({FIRST_SQL} UNION ALL {SECOND_SQL}) WHERE symbol <> 'click' GROUP BY symbol, c""")
def store_compact(spark, d):
    store = two_commits(spark, d)
    store.compact("click")
    return store.catalog().select("symbol", "n_rows", "commit")


@query("""SELECT TIMESTAMP '2024-01-02' + to_seconds(s) AS ts, "column", v_long, v_double FROM (VALUES
    (0, 'bid', NULL, 1.5), (1, 'bid', NULL, 3.5), (1, 'size', CAST(7 AS BIGINT), NULL)) t(s, "column", v_long, v_double)""")
def store_recorder(spark, d):
    first, second = datetime(2024, 1, 2), datetime(2024, 1, 2, 0, 0, 1)
    store = Store(spark, new_folder(spark, "store"))
    with store.recorder("S") as r:
        r.add_row(first).record("bid", 9.5).record("lost", 1)
        r.revert()
        r.add_row(first).record("bid", 1.5)
        r.add_row(second).record("bid", 2.5).record("size", 7).record("bid", 3.5)
        r.commit()
        r.add_row(second).record("bid", 8.5)
    return store.scan("S").select("ts", "column", "v_long", "v_double")


@query("""SELECT event_type AS symbol, ts, arg_max(value, event_id) AS value FROM events
    WHERE value IS NOT NULL AND event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-12' GROUP BY event_type, ts""")
def store_read_through(spark, d):
    store = Store(spark, new_folder(spark, "store"))
    rows = tall_events(spark, d).where("symbol = 'click'")
    store.append(rows.where(F.col("ts").between("2024-01-05", "2024-01-07")))

    def provider(symbol, low, high):
        found = rows.where(F.col("ts").between(F.lit(str(low)).cast("timestamp_ntz"), F.lit(str(high)).cast("timestamp_ntz")))
        return found.groupBy(F.col("ts").alias("timestamp")).agg(F.max_by("v_double", "seq").alias("value"))

    return shown(fetch(store, "click", "value", datetime(2024, 1, 3), datetime(2024, 1, 12), provider))
