"""Store, recorder and provider, with the decisions where intent and habit differ."""

import math
from datetime import datetime, timedelta

import pytest

from tickweave.operators.model import TALL_SCHEMA
from tickweave.sources.provider import fetch, missing
from tickweave.sources.store import Conflict, Store

DAY = datetime(2024, 1, 2, 8)


def second(s):
    return DAY + timedelta(seconds=s)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def values(store, symbol="S", column="v", **range_):
    return [(r["ts"], r["v_double"]) for r in store.scan(symbol, columns=[column], **range_).orderBy("ts").collect()]


def test_recorder_golden(spark, store):
    with store.recorder("MySymbol") as r:
        r.add_row(second(0)).record("i", 1, "int").record("d", 1.2).record("l", 2)
        r.add_row(second(1)).record("f", 1.4, "float").record("l", 23)
        r.add_row(second(2)).record("i", 12, "int")
        r.add_row(second(3)).record("d", 12.4).record("i", 13, "int")
        r.add_row(second(4))
        r.add_row(second(5)).record("d", 12.3).record("i", 13, "int")
        r.add_row(second(6)).record("d", 12.5).record("d", 13.5)
        r.commit()
    probes = spark.createDataFrame([(second(s),) for s in (-1, 4, 6)], "ts timestamp_ntz")
    before, middle, last = store.read_at("MySymbol", probes, defaults=True).orderBy("ts").collect()
    assert math.isnan(before["d"]) and before["i"] == 0 and before["l"] == 0
    assert (middle["i"], middle["i__ts"]) == (13, second(3))
    assert (last["d"], last["d__ts"], last["i"], last["i__ts"], last["l"], last["l__ts"]) == (13.5, second(6), 13, second(5), 23, second(1))
    assert abs(last["f"] - 1.4) < 1e-6
    ends = {r["column"]: (r["start"], r["end"]) for r in store.catalog().collect()}
    assert ends == {"i": (second(0), second(5)), "d": (second(0), second(6)), "l": (second(0), second(1)), "f": (second(1), second(1))}


def test_recorder_rules(store):
    r = store.recorder("S")
    with pytest.raises(ValueError):
        r.record("v", 1.0)
    r.add_row(second(1)).record("v", 1.0)
    r.add_row(second(1))
    with pytest.raises(ValueError):
        r.add_row(second(0))
    with pytest.raises(TypeError):
        r.record("v", 1)
    with pytest.raises(ValueError):
        r.record("", 1.0)
    r.revert()
    r.commit()
    assert store.version() == 0


def test_insert_checks_before_it_writes(store):
    for bad, error in (
        ({"v": [1.0]}, ValueError),
        ({"timestamp": [1.5], "v": [1.0]}, TypeError),
        ({"timestamp": [DAY], "v": [1.0, 2.0]}, ValueError),
        ({"timestamp": [second(1), second(0)], "v": [1.0, 2.0]}, ValueError),
    ):
        with pytest.raises(error):
            store.insert("S", bad)
    assert store.version() == 0
    store.insert("S", {"timestamp": [second(1), second(0)], "v": [1.0, 2.0]}, sort=True)
    with pytest.raises(TypeError):
        store.insert("S", {"timestamp": [second(9)], "v": [1]})
    assert values(store) == [(second(0), 2.0), (second(1), 1.0)]


def test_merge_keeps_both_tails_and_the_later_write(store):
    store.insert("S", {"timestamp": [second(s) for s in (10, 20, 30, 40)], "v": [1.0, 2.0, 3.0, 4.0]})
    store.insert("S", {"timestamp": [second(s) for s in (15, 20, 25)], "v": [-1.0, -2.0, -3.0]})
    merged = [(second(s), v) for s, v in ((10, 1.0), (15, -1.0), (20, -2.0), (25, -3.0), (30, 3.0), (40, 4.0))]
    assert values(store) == merged
    store.compact("S")
    assert values(store) == merged
    assert store.catalog().count() == 1


def test_delete_range_is_inclusive_and_by_column(store):
    times = [second(s) for s in range(6)]
    store.insert("S", {"timestamp": times, "v": [float(s) for s in range(6)], "w": [float(s) for s in range(6)]})
    store.delete("S", second(2), second(4), ["v"])
    assert [t for t, _ in values(store)] == [second(0), second(1), second(5)]
    assert len(values(store, column="w")) == 6
    assert values(store, start=second(2), end=second(4)) == []
    store.delete("S", second(0), second(9))
    assert values(store) == [] and store.catalog().isEmpty()


def test_ranges_and_segment_visibility(spark, store):
    for begin in (0, 1200):
        store.insert("S", {"timestamp": [second(begin), second(begin + 600)], "v": [float(begin), float(begin + 600)]})
    probes = spark.createDataFrame([(second(s),) for s in (900, 1200, 1500)], "ts timestamp_ntz")
    for mode, expect in (("segment", [None, 1200.0, 1200.0]), ("none", [None, 1200.0, 1200.0]), ("unbounded", [600.0, 1200.0, 1200.0])):
        got = [r["v"] for r in store.read_at("S", probes, second(900), second(1500), carry_in=mode).orderBy("ts").collect()]
        assert got == expect, mode
    inside = [r["v"] for r in store.read_at("S", probes.limit(1), second(300), second(900)).collect()]
    assert inside[0] == 600.0
    assert values(store, start=second(600), end=second(600)) == [(second(600), 600.0)]
    assert len(values(store, start=second(0), day=True)) == 4
    with pytest.raises(KeyError):
        store.scan("S", columns=["nope"])


def test_a_slower_writer_notices(store):
    store.insert("S", {"timestamp": [DAY], "v": [1.0]})
    catalog = store.catalog()
    with pytest.raises(Conflict):
        store._publish(catalog, 0)


def test_strings(store):
    store.insert("S", {"timestamp": [DAY, second(1)], "v": ["a" * 300, None]})
    assert [r["v_string"] for r in store.scan("S").collect()] == ["a" * 300]


def test_gap_fill_asks_for_missing_ranges_only(spark, store):
    def month(m):
        return datetime(2018, m, 1)

    def end(m):
        return month(m + 1) - timedelta(microseconds=1)

    for m in (3, 4, 5, 1):
        store.insert("S", {"timestamp": [month(m), end(m)], "v": [float(m), float(m)]})
    assert missing(store, "S", "v", datetime(2018, 3, 15), datetime(2018, 5, 15)) == []
    asked = []

    def provider(symbol, low, high):
        asked.append((low, high))
        return spark.createDataFrame([(low, 2.0), (high, 2.0)], "timestamp timestamp_ntz, v double")

    rows = fetch(store, "S", "v", datetime(2018, 1, 15), datetime(2018, 3, 15), provider)
    assert asked == [(month(2), end(2))]
    assert rows.count() == 4
    fetch(store, "S", "v", datetime(2018, 1, 15), datetime(2018, 3, 15), provider)
    assert len(asked) == 1


def test_delete_leaves_the_segments_other_series(spark, store):
    """A segment stays in use for its other symbols and columns; what was deleted must not come back with them."""
    rows = [(symbol, column, second(s), s, None, float(s), None, None, None) for symbol in "AB" for column in ("v", "w") for s in range(4)]
    store.append(spark.createDataFrame(rows, TALL_SCHEMA))
    store.delete("A", second(1), second(2), ["v"])
    got = {(r["symbol"], r["column"], r["ts"]) for r in store.scan(["A", "B"]).collect()}
    gone = {("A", "v", second(1)), ("A", "v", second(2))}
    assert got == {(r[0], r[1], r[2]) for r in rows} - gone
    assert {(r["symbol"], r["column"], r["ts"]) for r in store.scan("A").collect()} == {x for x in got if x[0] == "A"}
