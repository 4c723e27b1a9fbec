import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickweave.functions import time, types, varint
from tickweave.operators import blocks, carry, deltas, merge


@pytest.mark.parametrize("width,signed,flag", [(64, True, False), (64, True, True), (64, False, False), (32, True, False), (32, True, True), (32, False, False)])
def test_varint_sizes_at_powers_of_two(spark, width, signed, flag):
    tag = {64: 3, 32: 2}[width] + (1 + flag if signed else 0)
    lengths = list(range(1, 8)) if width == 64 else [1, 2, 3]
    top = 9 if width == 64 else 5
    values = {s * ((1 << i) + d) for i in range(1, width - 1) for d in (-2, -1, 0, 1, 2) for s in ((1, -1) if signed else (1,))} - {-1, -2} | {0}
    values = [v for v in values if signed or v >= 0]
    size = varint.size_signed(F.col("v"), width, flag) if signed else varint.size_unsigned(F.col("v"), width)
    for row in spark.createDataFrame([(v,) for v in values], "v long").select("v", size.alias("n")).collect():
        assert row["n"] == next((n for n in lengths if abs(row["v"]).bit_length() <= 8 * n - tag), top), row


def test_least_values_take_the_longest(spark):
    row = spark.sql("SELECT -9223372036854775807L - 1 AS a, CAST(-2147483648 AS INT) AS b").select(varint.size_signed(F.col("a"), 64), varint.size_signed(F.col("b").cast("long"), 32)).first()
    assert tuple(row) == (9, 5)


def test_ticks(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5, 678901),), (datetime(1, 1, 1),), (datetime(9000, 12, 31, 23, 59, 59, 999999),), (datetime(2024, 3, 31, 2, 30),)], "ts timestamp_ntz")
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            back = df.select("ts", time.to_ticks(F.col("ts")).alias("t"), time.bucket(F.col("ts")).alias("d")).select("*", time.from_ticks(F.col("t")).alias("b")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r["t"] for r in back][:2] == [638397614456789010, 0]
        assert all(r["t"] == (r["ts"] - datetime(1, 1, 1)) // timedelta(microseconds=1) * 10 for r in back)
        assert all(r["b"] == r["ts"] and r["d"] == (r["ts"] - datetime(1970, 1, 1)).days for r in back)


def test_parse_time(spark):
    texts = {
        "2024-01-02 03:04:05.678": datetime(2024, 1, 2, 3, 4, 5, 678000), "2024-01-02 03:04": datetime(2024, 1, 2, 3, 4), "02/01/2024": datetime(2024, 1, 2),
        "02/01/2024 03:04:05": datetime(2024, 1, 2, 3, 4, 5), "min": datetime(1, 1, 1), "": datetime(1, 1, 1), "what": datetime(1, 1, 1), "MAX": datetime(9999, 12, 31, 23, 59, 59, 999999),
    }
    got = {r["s"]: r["t"] for r in spark.createDataFrame([(t,) for t in texts], "s string").select("s", time.parse_time(F.col("s")).alias("t")).collect()}
    assert got == texts


def test_parse_time_of_day(spark):
    texts = {"03:04:05.678": datetime(2024, 5, 6, 3, 4, 5, 678000), "03:04:05": datetime(2024, 5, 6, 3, 4, 5), "23:59": datetime(2024, 5, 6, 23, 59), "24:61": datetime(1, 1, 1)}
    parsed = time.parse_time(F.col("s"), F.lit("2024-05-06").cast("date"))
    got = {r["s"]: r["t"] for r in spark.createDataFrame([(t,) for t in texts], "s string").select("s", parsed.alias("t")).collect()}
    assert got == texts


def test_next_power_of_two(spark):
    values = [-3, 0, 1, 2, 3, 4, 5, 1023, 1024, 1025, (1 << 40) + 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(time.next_power_of_two(F.col("v"))).collect()]
    assert got == [1, 1, 1, 2, 4, 4, 8, 1024, 1024, 2048, 1 << 41]


def test_types():
    assert types.fungible("int", "int") and not types.fungible("int", "long")
    with pytest.raises(TypeError):
        types.field_type("boolean")
    assert [blocks.capacity(t) for t in ("int", "double", "string")] == [682, 512, 32]
    assert [blocks.shell_bytes(t) for t in ("int", "double", "string")] == [34, 42, 522]


def test_string_entry(spark):
    df = spark.createDataFrame([("A" * 256,), ("é",)], "s string")
    assert [r[0] for r in df.select(types.truncated(F.col("s"))).collect()] == ["A" * 246, "é"]


def random_rows(spark, n=3000, seed=1):
    draw = random.Random(seed)
    rows = [(draw.randrange(3), datetime(2024, 1, 1 + draw.randrange(20), draw.randrange(24), draw.randrange(60)), i, draw.randrange(-(10**6), 10**6)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, ts timestamp_ntz, seq long, v long")


def test_bucketed_windows_equal_plain_ones(spark):
    rows, df = random_rows(spark)
    expected_prev, expected_at, last, count = {}, {}, {}, {}
    for k, ts, seq, v in sorted(rows, key=lambda r: r[1:3]):
        expected_prev[seq], expected_at[seq] = last.get(k), count.get(k, 0)
        last[k], count[k] = v, count.get(k, 0) + 1
    assert {r["seq"]: r["prev_v"] for r in carry.with_previous(df, ["k"], ["ts", "seq"], ["v"]).collect()} == expected_prev
    assert {r["seq"]: r["position"] for r in carry.with_position(df, ["k"], ["ts", "seq"]).collect()} == expected_at


def test_deltas_restore(spark):
    rows, df = random_rows(spark, seed=2)
    back = deltas.restore(deltas.deltas(df, ["k"], ["ts", "seq"], ["v"]), ["k"], ["ts", "seq"], "v", "delta_v", "r")
    assert back.count() == len(rows) and back.where("v <> r").isEmpty()


def test_merge_laws(spark):
    _, a = random_rows(spark, 500, 3)
    _, b = random_rows(spark, 500, 4)
    _, c = random_rows(spark, 500, 5)
    def m(*parts):
        return merge.merge(list(parts), ["k", "ts"], ["seq"])
    one = m(a)
    assert m(a, a.limit(0)).exceptAll(one).isEmpty()
    assert m(one, one).exceptAll(one).isEmpty()
    assert m(m(a, b), c).exceptAll(m(a, m(b, c))).isEmpty()
    assert m(a, b, c).exceptAll(m(m(a, b), c)).isEmpty()
