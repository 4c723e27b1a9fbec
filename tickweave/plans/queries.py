"""The library's queries over the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import time, types, varint
from tickweave.operators import align, blocks, carry, deltas, merge, model, segments
from tickweave.plans.fixtures import CATALOG_SQL, EVENT_TYPES, FIRST, LAST, RANGES_SQL, daily_catalog, events, ranges, symbols, table, user_events
from tickweave.sources.store import order_violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def at(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


E = "(SELECT event_type AS symbol, ts, event_id AS seq, value FROM events)"
EW = "(SELECT user_id, ts, event_id AS seq, {} FROM events)".format(", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {t}" for t in EVENT_TYPES))


# scans


@query(f"SELECT * FROM {E} WHERE symbol IN ('click', 'view') AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'")
def range_scan(spark, d):
    return model.time_range(events(spark, d).where(F.col("symbol").isin("click", "view")), at("2024-01-10"), at("2024-01-12 12:00:00"))


@query(f"SELECT * FROM {E} WHERE symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def default_end_scan(spark, d):
    return model.time_range(events(spark, d).where("symbol = 'click'"), at("2024-01-05"))


@query("SELECT user_id AS symbol, event_type AS \"column\", ts, event_id AS seq, value AS v_double FROM events WHERE event_type IN ('click', 'purchase')")
def project_columns(spark, d):
    tall = table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("event_type").alias("column"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("v_double"))
    return model.project(tall, ["click", "purchase"], EVENT_TYPES)


@query(f"SELECT symbol, arg_max(ts, (ts, seq)) AS ts, arg_max(value, (ts, seq)) AS value FROM {E} GROUP BY symbol")
def latest_value(spark, d):
    return align.latest(events(spark, d), ["symbol"], ["ts", "value"], ["ts", "seq"])


# alignment

GRID = f"(SELECT s.symbol, g.ts FROM (SELECT unnest({EVENT_TYPES}) AS symbol) s, (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 HOUR)) AS ts) g)"


@query(f"SELECT g.symbol, g.ts, e.value FROM {GRID} g ASOF LEFT JOIN {E} e ON g.symbol = e.symbol AND g.ts >= e.ts")
def asof_grid_hourly(spark, d):
    probes = align.grid(spark, symbols(spark), FIRST, LAST, "1 hour")
    return align.asof(events(spark, d), probes, ["symbol"], "ts", ["value"], ["seq"])


PROBES = f"""(SELECT o_orderkey, {EVENT_TYPES}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS symbol,
    TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INTEGER)) + to_seconds(CAST((o_custkey * 7919) % 86400 AS BIGINT)) AS ts FROM orders)"""


def _order_probes(spark, d) -> DataFrame:
    seconds = (F.col("o_orderkey") % 30) * 86400 + (F.col("o_custkey") * 7919) % 86400
    names = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return table(spark, d, "orders").select(
        "o_orderkey", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("symbol"), F.timestamp_add("SECOND", seconds, at("2024-01-01")).alias("ts")
    )


@query(f"SELECT p.o_orderkey, p.symbol, p.ts, e.value FROM {PROBES} p ASOF LEFT JOIN {E} e ON p.symbol = e.symbol AND p.ts >= e.ts")
def asof_probe_orders(spark, d):
    return align.asof(events(spark, d), _order_probes(spark, d), ["symbol"], "ts", ["value"], ["seq"])


@query(f"SELECT p.o_orderkey, p.symbol, p.ts, e.value FROM {PROBES} p ASOF LEFT JOIN {E} e ON p.symbol = e.symbol AND p.ts <= e.ts")
def asof_forward_orders(spark, d):
    return align.asof_forward(events(spark, d), _order_probes(spark, d), ["symbol"], "ts", ["value"], ["seq"])


@query(f"SELECT p.o_orderkey, p.symbol, p.ts, CASE WHEN p.ts - e.ts <= INTERVAL 10 MINUTE THEN e.value END AS value FROM {PROBES} p ASOF LEFT JOIN {E} e ON p.symbol = e.symbol AND p.ts >= e.ts")
def asof_tolerance(spark, d):
    out = align.asof(events(spark, d), _order_probes(spark, d), ["symbol"], "ts", ["value"], ["seq"], stamps=True)
    fresh = time.micros(F.col("ts")) - time.micros(F.col("value__ts")) <= 600 * 1_000_000
    return out.select("o_orderkey", "symbol", "ts", F.when(fresh, F.col("value")).alias("value"))


LAST_OF = "last_value({} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS {}"


@query("SELECT user_id, ts, seq, {} FROM {}".format(", ".join(LAST_OF.format(t, t) for t in EVENT_TYPES), EW))
def dense_snapshot(spark, d):
    return align.locf(user_events(spark, d), ["user_id"], "ts", EVENT_TYPES, ["seq"])


STAMPED = ", ".join(LAST_OF.format(f"CASE WHEN {t} IS NOT NULL THEN ts END", f"{t}__ts") for t in EVENT_TYPES)


@query(f"SELECT user_id, ts, seq, {STAMPED} FROM {EW}")
def field_timestamps(spark, d):
    return align.locf(user_events(spark, d), ["user_id"], "ts", EVENT_TYPES, ["seq"], stamps=True).drop(*EVENT_TYPES)


DAILY = "(SELECT u.user_id, g.ts FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS ts) g)"


def _daily(spark, d) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return align.grid(spark, users, "2024-01-01 00:00:00", "2024-01-30 00:00:00", "1 day")


@query(f"""SELECT p.user_id, p.ts, e.ts AS cursor_ts FROM {DAILY} p
    ASOF LEFT JOIN (SELECT user_id, ts FROM events) e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def cursor_timestamp(spark, d):
    out = align.asof(user_events(spark, d), _daily(spark, d), ["user_id"], "ts", EVENT_TYPES, ["seq"], stamps=True, unit="quarter")
    return out.select("user_id", "ts", align.cursor_time([f"{t}__ts" for t in EVENT_TYPES]).alias("cursor_ts"))


@query(f"""SELECT p.user_id, p.ts, e.value IS NULL AS double_is_nan, CAST(coalesce(e.event_id % 1000, 0) AS INTEGER) AS v_int,
    coalesce(e.event_id, 0) AS v_long, coalesce(e.event_type, '') AS v_string
    FROM {DAILY} p ASOF LEFT JOIN events e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def typed_defaults(spark, d):
    ticks = table(spark, d, "events").select(
        "user_id", "ts", F.col("event_id").alias("seq"), F.col("value").alias("v_double"), (F.col("event_id") % 1000).cast("int").alias("v_int"),
        F.col("event_id").alias("v_long"), F.col("event_type").alias("v_string"),
    )
    kinds = {"v_double": "double", "v_int": "int", "v_long": "long", "v_string": "string"}
    out = align.asof(ticks, _daily(spark, d), ["user_id"], "ts", list(kinds), ["seq"], unit="quarter")
    out = out.withColumns({c: types.with_default(F.col(c), k) for c, k in kinds.items()})
    return out.select("user_id", "ts", F.isnan("v_double").alias("double_is_nan"), "v_int", "v_long", "v_string")


@query(f"SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS next_ts FROM (SELECT DISTINCT symbol, ts FROM {E})")
def next_tick(spark, d):
    return align.next_tick(events(spark, d), ["symbol"], "ts")


# merge and delete


@query("SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_max(o_orderkey, o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL")
def same_tick_collapse(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return merge.collapse(rows, ["symbol", "ts"], ["seq"])


@query("""SELECT l_returnflag AS symbol, l_shipdate AS ts, arg_max(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey,
    arg_max(l_linenumber, (l_orderkey, l_linenumber)) AS l_linenumber, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS value FROM lineitem GROUP BY ALL""")
def same_tick_collapse_lineitem(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    return merge.collapse(rows, ["symbol", "ts"], ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderpriority AS symbol, 'o_totalprice' AS "column", o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS value FROM orders
    UNION ALL SELECT o_orderpriority, 'o_custkey', o_orderdate, o_orderkey, CAST(o_custkey AS DOUBLE) FROM orders""")
def insert_melt(spark, d):
    tall = model.melt(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", ["o_totalprice", "o_custkey"], "o_orderkey")
    return tall.select("symbol", "column", "ts", "seq", F.coalesce("v_double", F.col("v_long").cast("double")).alias("value"))


@query("SELECT user_id, ts, {} FROM events GROUP BY user_id, ts".format(", ".join(f"arg_max(value, event_id) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES)))
def pivot_wide(spark, d):
    tall = table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("event_type").alias("column"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("v_double"))
    return model.pivot(tall, dict.fromkeys(EVENT_TYPES, "double")).withColumnRenamed("symbol", "user_id")


@query("""SELECT user_id AS symbol, event_type AS "column", min(ts) AS start, max(ts) AS "end", count(*) AS n_rows FROM events GROUP BY ALL""")
def commit_bounds(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("event_type").alias("column"), "ts")
    return merge.bounds(rows, ["symbol", "column"])


@query("""SELECT symbol, ts, arg_max(seq, (b, seq)) AS seq, arg_max(value, (b, seq)) AS value FROM (
    SELECT event_type AS symbol, ts, event_id AS seq, value, 0 AS b FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT event_type, ts, event_id, value * 2, 1 FROM events WHERE event_id % 2 = 0) GROUP BY symbol, ts""")
def merge_lww(spark, d):
    rows = events(spark, d)
    update = rows.where("seq % 2 = 0").withColumn("value", F.col("value") * 2)
    return merge.merge([rows.where("seq % 3 <> 0"), update], ["symbol", "ts"], ["seq"])


@query(f"SELECT * FROM {E} WHERE NOT ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20 06:00:00'")
def delete_range(spark, d):
    return merge.delete_range(events(spark, d), at("2024-01-08"), at("2024-01-20 06:00:00"))


@query("""SELECT user_id AS symbol, event_type AS "column", ts, event_id AS seq, value AS v_double FROM events
    WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20' AND event_type IN ('view', 'error'))""")
def delete_range_columns(spark, d):
    tall = table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("event_type").alias("column"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("v_double"))
    return merge.delete_range(tall, at("2024-01-08"), at("2024-01-20"), ["view", "error"])


@query("""SELECT o_orderpriority AS symbol, o_orderkey, o_orderdate AS ts, prev_ts FROM (
    SELECT *, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS prev_ts FROM orders) WHERE prev_ts > o_orderdate""")
def order_violation(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), "o_orderkey", F.col("o_orderdate").alias("ts"))
    return order_violations(rows, ["symbol"], "o_orderkey", "ts")


@query("""SELECT a.t AS written, b.t AS stored, a.t = b.t AS fungible, CAST(b.n AS BIGINT) AS entry_bytes
    FROM (VALUES ('float', 12), ('double', 16), ('int', 12), ('long', 16), ('string', 256)) a(t, n), (VALUES ('float', 12), ('double', 16), ('int', 12), ('long', 16), ('string', 256)) b(t, n)""")
def type_check(spark, d):
    return types.type_matrix(spark)


@query("SELECT event_id, coalesce(value = nullif(value, 0), false) OR (value IS NULL AND nullif(value, 0) IS NULL) AS same FROM events")
def entry_equality(spark, d):
    return table(spark, d, "events").select("event_id", types.entries_equal(F.col("value"), F.nullif(F.col("value"), F.lit(0.0))).alias("same"))


# segments


@query(f"""SELECT r.symbol, r.range_id, c.segment_id, c.start, c."end" FROM ({CATALOG_SQL}) c JOIN ({RANGES_SQL}) r ON c.symbol = r.symbol
    WHERE c.start BETWEEN r.low AND r.high OR (c.start < r.low AND c."end" >= r.low)""")
def segment_overlap(spark, d):
    return segments.search_many(daily_catalog(spark, d), ranges(spark), ["symbol"]).select("symbol", "range_id", "segment_id", "start", "end")


@query(f"""SELECT r.symbol, r.low, r.high, least(min(c.start), r.low) AS start, greatest(max(c."end"), r.high) AS "end", count(*) AS n_segments
    FROM ({CATALOG_SQL}) c JOIN ({RANGES_SQL}) r ON c.symbol = r.symbol
    WHERE c.start BETWEEN r.low AND r.high OR (c.start < r.low AND c."end" >= r.low) GROUP BY r.symbol, r.low, r.high""")
def merged_range(spark, d):
    return segments.merged_ranges(segments.search_many(daily_catalog(spark, d), ranges(spark), ["symbol"]), ["symbol"])


@query(f"SELECT * FROM ({CATALOG_SQL}) WHERE start = (SELECT min(ts) FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-09')")
def segment_point(spark, d):
    first = events(spark, d).where((F.col("symbol") == "click") & (F.col("ts") >= at("2024-01-09"))).agg(F.min("ts").alias("at"))
    return daily_catalog(spark, d).join(F.broadcast(first), F.col("start") == F.col("at"), "left_semi")


def _carry(spark, d, mode):
    low, high = at("2024-01-10 12:00:00"), at("2024-01-11 12:00:00")
    ticks = segments.carry_in(daily_catalog(spark, d), events(spark, d), ["symbol"], low, high, mode)
    probes = align.grid(spark, symbols(spark), "2024-01-10 12:00:00", "2024-01-11 12:00:00", "10 minutes")
    return align.asof(ticks, probes, ["symbol"], "ts", ["value"], ["seq"])


def _carry_sql(where: str) -> str:
    return f"""WITH c AS ({CATALOG_SQL}), k AS (SELECT symbol, min(start) AS first FROM c WHERE start < TIMESTAMP '2024-01-10 12:00:00' AND "end" >= TIMESTAMP '2024-01-10 12:00:00' GROUP BY symbol),
        t AS (SELECT e.* FROM {E} e LEFT JOIN k ON e.symbol = k.symbol WHERE e.ts <= TIMESTAMP '2024-01-11 12:00:00' AND ({where})),
        g AS (SELECT s.symbol, g.ts FROM (SELECT unnest({EVENT_TYPES}) AS symbol) s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-10 12:00:00', TIMESTAMP '2024-01-11 12:00:00', INTERVAL 10 MINUTE)) AS ts) g)
        SELECT g.symbol, g.ts, t.value FROM g ASOF LEFT JOIN t ON g.symbol = t.symbol AND g.ts >= t.ts"""


@query(_carry_sql("e.ts >= TIMESTAMP '2024-01-10 12:00:00'"))
def carry_in_none(spark, d):
    return _carry(spark, d, "none")


@query(_carry_sql("e.ts >= TIMESTAMP '2024-01-10 12:00:00' OR e.ts >= k.first"))
def carry_in_segment(spark, d):
    return _carry(spark, d, "segment")


@query(_carry_sql("true"))
def carry_in_unbounded(spark, d):
    return _carry(spark, d, "unbounded")


@query("""WITH c AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events),
    o AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM c)
    SELECT user_id, coalesce(prev + INTERVAL 1 DAY, TIMESTAMP '2024-01-01') AS gap_start, CAST(day - INTERVAL 1 DAY AS TIMESTAMP) AS gap_end FROM o
    WHERE coalesce(prev + INTERVAL 1 DAY, TIMESTAMP '2024-01-01') <= day - INTERVAL 1 DAY
    UNION ALL SELECT user_id, max(day) + INTERVAL 1 DAY, TIMESTAMP '2024-01-30' FROM c GROUP BY user_id HAVING max(day) + INTERVAL 1 DAY <= TIMESTAMP '2024-01-30'""")
def gap_detection(spark, d):
    days = table(spark, d, "events").select("user_id", time.bucket_start(F.col("ts")).alias("start")).distinct().withColumn("end", F.col("start"))
    return segments.gaps(days, ["user_id"], at("2024-01-01"), at("2024-01-30"), "1 day")


@query(f"""SELECT segment_id, symbol, n_rows FROM ({CATALOG_SQL}) WHERE n_rows % 2 = 0
    UNION ALL SELECT segment_id, symbol, -n_rows FROM ({CATALOG_SQL}) WHERE n_rows % 2 <> 0""")
def catalog_union(spark, d):
    catalog = daily_catalog(spark, d).select("segment_id", "symbol", "n_rows")
    return segments.union_new(catalog.where("n_rows % 2 = 0"), catalog.withColumn("n_rows", -F.col("n_rows")), ["segment_id"])


@query(f"SELECT symbol, count(*) AS revision FROM ({CATALOG_SQL}) GROUP BY symbol")
def revision_count(spark, d):
    return segments.revisions(daily_catalog(spark, d), ["symbol"])


# blocks and deltas

BLOCKS = f"""(SELECT symbol, block, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(value, (ts, seq)) AS first_value, arg_max(value, (ts, seq)) AS last_value
    FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 512 AS block FROM {E}) GROUP BY symbol, block)"""


def _blocks(spark, d) -> DataFrame:
    return blocks.block_infos(events(spark, d), ["symbol"], ["ts", "seq"], "value")


@query(f"SELECT * FROM {BLOCKS}")
def block_infos(spark, d):
    return _blocks(spark, d)


@query(f"SELECT symbol, block, n, n * 16 AS payload_bytes, 42::BIGINT AS shell_bytes, n * 16 + 42 AS total_bytes, 1 - (n * 16) / (n * 24)::DOUBLE AS payload_saving, 1 - (n * 16 + 42) / (n * 24)::DOUBLE AS total_saving FROM {BLOCKS}")
def block_sizes(spark, d):
    raw = _blocks(spark, d).withColumn("raw", F.col("n") * 24)
    return blocks.block_sizes(raw, raw="raw").drop("raw", "first_ts", "last_ts", "first_value", "last_value")


@query(f"SELECT symbol, block // 2 AS sample, min(first_ts) AS start, max(last_ts) AS \"end\", min(block) * 8234 AS \"offset\", count(*) AS n_blocks FROM {BLOCKS} GROUP BY symbol, block // 2")
def block_samples(spark, d):
    return blocks.block_samples(_blocks(spark, d), ["symbol"], 16000)


@query(f"""SELECT symbol, coalesce(arg_max(o, start) FILTER (start <= TIMESTAMP '2024-01-15'), 0) AS "offset" FROM (
    SELECT symbol, block // 2 AS sample, min(first_ts) AS start, min(block) * 8234 AS o FROM {BLOCKS} GROUP BY symbol, block // 2) GROUP BY symbol""")
def block_seek(spark, d):
    return blocks.seek(blocks.block_samples(_blocks(spark, d), ["symbol"], 16000), ["symbol"], at("2024-01-15"))


TICKS = "(epoch_us(ts) * 10 + 621355968000000000)"
CENTS = f"(SELECT event_type AS symbol, ts, event_id AS seq, {TICKS} AS ticks, CAST(floor(value * 100) AS BIGINT) AS cents FROM events)"


def _cents(spark, d) -> DataFrame:
    return events(spark, d).select("symbol", "ts", "seq", time.to_ticks(F.col("ts")).alias("ticks"), F.floor(F.col("value") * 100).cast("long").alias("cents"))


@query(f"SELECT * FROM (SELECT *, ticks - lag(ticks) OVER w AS delta_ticks, cents - lag(cents) OVER w AS delta_cents FROM {CENTS} WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) WHERE delta_ticks IS NOT NULL")
def delta_values(spark, d):
    return deltas.deltas(_cents(spark, d), ["symbol"], ["ts", "seq"], ["ticks", "cents"]).where("delta_ticks IS NOT NULL")


STEPS = f"""(SELECT *, ticks - lag(ticks) OVER w AS dt, cents - lag(cents) OVER w AS dv FROM
    (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 512 AS block FROM {CENTS}) WINDOW w AS (PARTITION BY symbol, block ORDER BY ts, seq))"""


@query(f"SELECT symbol, block, count(*) AS n, min(dt) AS min_delta_ticks, max(dv) FILTER (dv < 0) AS max_negative_delta, min(dv) FILTER (dv >= 0) AS min_positive_delta FROM {STEPS} GROUP BY symbol, block")
def min_delta_stats(spark, d):
    return deltas.min_delta_stats(_cents(spark, d), ["symbol"], ["ts", "seq"], "ticks", "cents", 512)


@query(f"SELECT symbol, block, count(*) AS n, min(cents) AS base, max(cents) - min(cents) AS spread FROM {STEPS} GROUP BY symbol, block")
def frame_of_reference(spark, d):
    return deltas.frame_of_reference(_cents(spark, d), ["symbol"], ["ts", "seq"], "cents", 512)


@query(f"""WITH m AS (SELECT symbol, block, min(dt) AS least, min(dv) FILTER (dv >= 0) AS up, max(dv) FILTER (dv < 0) AS down FROM {STEPS} GROUP BY symbol, block),
    s AS (SELECT s.*, least, up, down, dt - least AS t, CASE WHEN dv < 0 THEN down - dv ELSE dv - up END AS v FROM {STEPS} s JOIN m ON s.symbol = m.symbol AND s.block = m.block)
    SELECT symbol, block, count(*) AS n, CAST(sum(CASE WHEN dt IS NULL THEN ({varint.size_sql('ticks', 64, True)}) + ({varint.size_sql('cents', 64, True)})
        ELSE ({varint.size_sql('t', 64, True)}) + ({varint.size_sql('v', 64, True, True)}) END)
        + any_value({varint.size_sql('coalesce(least, 0)', 64, True)}) + any_value({varint.size_sql('coalesce(up, 0)', 64, True)}) + any_value({varint.size_sql('coalesce(down, 0)', 64, True)}) AS BIGINT) AS encoded_bytes
    FROM s GROUP BY symbol, block""")
def min_delta_bytes(spark, d):
    return deltas.encoded_bytes(_cents(spark, d), ["symbol"], ["ts", "seq"], "ticks", "cents", 512)


@query(f"SELECT symbol, ts, seq, cents, cents AS restored FROM {CENTS}")
def delta_roundtrip(spark, d):
    coded = deltas.deltas(_cents(spark, d), ["symbol"], ["ts", "seq"], ["cents"])
    back = deltas.restore(coded, ["symbol"], ["ts", "seq"], "cents", "delta_cents", "restored")
    return back.select("symbol", "ts", "seq", "cents", "restored")


STEPPED = f"(SELECT seq, ticks - lag(ticks) OVER (PARTITION BY symbol ORDER BY ts, seq) AS dt, cents, (seq * 7919 % 4294967296) AS u, CAST(cents * 7919 % 2147483647 AS BIGINT) AS i FROM {CENTS})"


def _stepped(spark, d) -> DataFrame:
    rows = deltas.deltas(_cents(spark, d), ["symbol"], ["ts", "seq"], ["ticks"])
    return rows.select("seq", F.col("delta_ticks").alias("dt"), "cents", (F.col("seq") * 7919 % 4294967296).alias("u"), (F.col("cents") * 7919 % 2147483647).alias("i"))


@query(f"SELECT seq, dt, {varint.size_sql('dt', 64, True)} AS bytes, {varint.size_sql('dt', 64, True, True)} AS flagged_bytes FROM {STEPPED} WHERE dt IS NOT NULL")
def varint_size_i64(spark, d):
    return _stepped(spark, d).where("dt IS NOT NULL").select("seq", "dt", varint.size_signed(F.col("dt"), 64).alias("bytes"), varint.size_signed(F.col("dt"), 64, True).alias("flagged_bytes"))


@query(f"SELECT seq, i, {varint.size_sql('i', 32, True)} AS bytes, {varint.size_sql('i', 32, True, True)} AS flagged_bytes FROM {STEPPED}")
def varint_size_i32(spark, d):
    return _stepped(spark, d).select("seq", "i", varint.size_signed(F.col("i"), 32).alias("bytes"), varint.size_signed(F.col("i"), 32, True).alias("flagged_bytes"))


@query(f"SELECT seq, dt, {varint.size_sql('dt', 64, False)} AS bytes FROM {STEPPED} WHERE dt IS NOT NULL")
def varint_size_u64(spark, d):
    return _stepped(spark, d).where("dt IS NOT NULL").select("seq", "dt", varint.size_unsigned(F.col("dt"), 64).alias("bytes"))


@query(f"SELECT seq, u, {varint.size_sql('u', 32, False)} AS bytes FROM {STEPPED}")
def varint_size_u32(spark, d):
    return _stepped(spark, d).select("seq", "u", varint.size_unsigned(F.col("u"), 32).alias("bytes"))


@query(f"SELECT {varint.size_sql('dt', 64, True)} AS bytes, count(*) AS n FROM {STEPPED} WHERE dt IS NOT NULL GROUP BY 1")
def varint_histogram(spark, d):
    return varint_size_i64(spark, d).groupBy("bytes").agg(F.count("*").alias("n"))


# scalar functions


@query(f"SELECT event_id, ts, {TICKS} AS ticks, ts AS restored FROM events")
def ticks_conversion(spark, d):
    ticks = time.to_ticks(F.col("ts"))
    return table(spark, d, "events").select("event_id", "ts", ticks.alias("ticks"), time.from_ticks(ticks).alias("restored"))


@query("SELECT event_id, least(ts, TIMESTAMP '2024-01-15') AS earlier, greatest(ts, TIMESTAMP '2024-01-15') AS later FROM events")
def time_min_max(spark, d):
    return table(spark, d, "events").select("event_id", F.least("ts", at("2024-01-15")).alias("earlier"), F.greatest("ts", at("2024-01-15")).alias("later"))


@query("""SELECT event_id, TIMESTAMP '2024-01-01' + least(ts - TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-20' - ts) AS shorter,
    TIMESTAMP '2024-01-01' + greatest(ts - TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-20' - ts) AS longer FROM events""")
def span_min_max(spark, d):
    spans = [F.col("ts") - at("2024-01-01"), at("2024-01-20") - F.col("ts")]
    return table(spark, d, "events").select("event_id", (at("2024-01-01") + F.least(*spans)).alias("shorter"), (at("2024-01-01") + F.greatest(*spans)).alias("longer"))


@query("SELECT TIMESTAMP '0001-01-01' AS least, TIMESTAMP '9999-12-31 23:59:59.999999' AS most")
def time_sentinels(spark, d):
    return spark.range(1).select(time.instant(time.MIN_TIME).alias("least"), time.instant(time.MAX_TIME).alias("most"))


@query("""SELECT event_id, value, CAST(NULL AS FLOAT) AS user_id, CAST(NULL AS DOUBLE) AS absent FROM events""")
def typed_access(spark, d):
    rows = table(spark, d, "events")
    fields = [types.typed_field(rows, name, kind) for name, kind in (("value", "double"), ("user_id", "float"), ("absent", "double"))]
    return rows.select("event_id", *fields)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END - date_trunc('day', ts) + TIMESTAMP '2024-05-06' AS parsed FROM events""")
def parse_times_of_day(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "HH:mm:00.000"))
    return table(spark, d, "events").select("event_id", time.parse_time(text, F.lit("2024-05-06").cast("date")).alias("parsed"))


@query("""SELECT event_id, concat_ws('/', CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'hot' WHEN ts >= TIMESTAMP '2024-01-10' THEN 'warm' ELSE 'cold' END,
    strftime(ts, '%Y'), CAST(user_id AS VARCHAR), event_type, concat_ws('_', CAST(user_id AS VARCHAR), event_type, strftime(ts, '%Y-%m-%d_%H-%M-%S'))) AS path FROM events""")
def path_layout(spark, d):
    path = time.segment_path(F.col("ts"), F.col("user_id").cast("string"), F.col("event_type"), [("2024-01-10", "warm"), ("2024-01-20", "hot")], "cold")
    return table(spark, d, "events").select("event_id", path.alias("path"))


@query("SELECT doc_id, substr(text, 1, 246) AS text FROM documents")
def string_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", types.truncated(F.col("text")).alias("text"))


@query("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS day")
def calendar_days(spark, d):
    return time.days_between(spark, "2024-01-01", "2024-03-01").select(F.col("day").cast("timestamp_ntz").alias("day"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN date_trunc('day', ts)
    WHEN event_id % 3 = 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS parsed FROM events""")
def parse_timestamps(spark, d):
    forms = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd"]
    text = F.lit("max")
    for n, form in enumerate(forms):
        text = F.when(F.col("event_id") % 3 == n, F.date_format("ts", form)).otherwise(text)
    return table(spark, d, "events").select("event_id", time.parse_time(text).alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(event_id - 1)) END AS power FROM events")
def next_power_of_two(spark, d):
    return table(spark, d, "events").select("event_id", time.next_power_of_two(F.col("event_id")).alias("power"))


# extensions


@query(f"""SELECT symbol, date_trunc('hour', ts) AS hour, count(*) AS n, arg_min(value, (ts, seq)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, seq)) AS close
    FROM {E} GROUP BY symbol, date_trunc('hour', ts)""")
def resample_ohlc(spark, d):
    rank = F.struct("ts", "seq")
    return events(spark, d).groupBy("symbol", time.bucket_start(F.col("ts"), "hour").alias("hour")).agg(
        F.count("*").alias("n"), F.min_by("value", rank).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", rank).alias("close")
    )


@query(f"SELECT symbol, ts, seq, value, lag(value) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev_value FROM {E}")
def previous_value(spark, d):
    return carry.with_previous(events(spark, d), ["symbol"], ["ts", "seq"], ["value"])
