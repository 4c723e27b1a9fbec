"""Golden cards of the aligned reads."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickweave.operators import align

DAY = datetime(2024, 1, 2, 8)
#: Seconds after 08:00:00 -> value, for each column.
QUOTES = {
    "bid": {0: 12.2, 1: 12.3, 2: 12.4, 3: 12.5, 4: 12.6},
    "bsize": {0: 1e6, 2: 2e6},
    "ask": {0: 13.2, 2: 13.3, 4: 13.4},
    "asize": {0: 2e6, 4: 1e6},
}
SNAPSHOTS = [
    (-2, None, (None, None, None, None)),
    (-1, None, (None, None, None, None)),
    (0, 0, (12.2, 1e6, 13.2, 2e6)),
    (0.5, 0, (12.2, 1e6, 13.2, 2e6)),
    (0.7, 0, (12.2, 1e6, 13.2, 2e6)),
    (1.2, 1, (12.3, 1e6, 13.2, 2e6)),
    (3.9, 3, (12.5, 2e6, 13.3, 2e6)),
    (4, 4, (12.6, 2e6, 13.4, 1e6)),
    (5, 4, (12.6, 2e6, 13.4, 1e6)),
    (6, 4, (12.6, 2e6, 13.4, 1e6)),
]


def second(s):
    return DAY + timedelta(seconds=s)


def quotes(spark):
    rows = [("ABC", second(s), 0, *[QUOTES[c].get(s) for c in QUOTES]) for s in range(5)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, bid double, bsize double, ask double, asize double")


@pytest.mark.parametrize("unit", ["day", "minute", None])
def test_k_way_alignment(spark, unit):
    probes = spark.createDataFrame([("ABC", second(s)) for s, _, _ in SNAPSHOTS], "symbol string, ts timestamp_ntz")
    out = align.asof(quotes(spark), probes, ["symbol"], "ts", list(QUOTES), ["seq"], stamps=True, unit=unit)
    out = out.withColumn("at", align.cursor_time([f"{c}__ts" for c in QUOTES])).orderBy("ts").collect()
    for row, (_, at, values) in zip(out, SNAPSHOTS, strict=True):
        assert tuple(row[c] for c in QUOTES) == values
        assert row["at"] == (None if at is None else second(at))


def test_next_tick(spark):
    out = {r["ts"]: r["next_ts"] for r in align.next_tick(quotes(spark), ["symbol"], "ts").collect()}
    assert out == {second(s): second(s + 1) if s < 4 else None for s in range(5)}


def test_single_column_and_late_first_tick(spark):
    values = dict(zip((0, 4, 5, 6, 7), (12.2, 15.2, 16.2, 13.2, 14.2)))
    for shift in (0, 1):
        ticks = spark.createDataFrame([("s", second(max(s, shift)), 0, v) for s, v in values.items()], "symbol string, ts timestamp_ntz, seq long, v double")
        probes = spark.createDataFrame([("s", second(s)) for s in range(10)], "symbol string, ts timestamp_ntz")
        got = [r["v"] for r in align.asof(ticks, probes, ["symbol"], "ts", ["v"], ["seq"]).orderBy("ts").collect()]
        assert got == [None if shift else 12.2, 12.2, 12.2, 12.2, 15.2, 16.2, 13.2, 14.2, 14.2, 14.2]


def test_nan_is_an_observation_and_same_tick_takes_the_last(spark):
    rows = [("s", second(0), 0, 1.0), ("s", second(1), 1, float("nan")), ("s", second(2), 2, None), ("s", second(3), 3, 12.5), ("s", second(3), 4, 13.5)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, v double")
    probes = spark.createDataFrame([("s", second(2)), ("s", second(3))], "symbol string, ts timestamp_ntz")
    got = [r["v"] for r in align.asof(ticks, probes, ["symbol"], "ts", ["v"], ["seq"]).orderBy("ts").collect()]
    assert got[0] != got[0] and got[1] == 13.5


def test_carrying_twice_changes_nothing(spark):
    rows = spark.range(2000).select(
        (F.col("id") % 3).alias("symbol"), F.timestamp_add("MINUTE", F.col("id") * 17 % 20000, F.lit(DAY).cast("timestamp_ntz")).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 5 == 0, F.col("id").cast("double")).alias("v"),
    )
    once = align.locf(rows, ["symbol"], "ts", ["v"], ["seq"])
    assert once.exceptAll(align.locf(once, ["symbol"], "ts", ["v"], ["seq"])).isEmpty()
    assert once.exceptAll(align.locf(rows, ["symbol"], "ts", ["v"], ["seq"], unit=None)).isEmpty()


def test_forward(spark):
    probes = spark.createDataFrame([("ABC", second(s)) for s in (-1, 0, 0.5, 4, 5)], "symbol string, ts timestamp_ntz")
    got = [r["bid"] for r in align.asof_forward(quotes(spark), probes, ["symbol"], "ts", ["bid"], ["seq"]).orderBy("ts").collect()]
    assert got == [12.2, 12.2, 12.3, 12.6, None]
