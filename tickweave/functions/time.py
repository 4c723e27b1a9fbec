"""Ticks, calendar helpers and path stamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 100 ns ticks from 0001-01-01 to 1970-01-01.
EPOCH_TICKS = 621355968000000000
#: Timestamp formats that are read, fixed values, tried in this order.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "dd/MM/yyyy HH:mm:ss.SSS",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
)
#: Formats of a time without its day, fixed values.
TIME_FORMATS = ("HH:mm:ss.SSS", "HH:mm:ss", "HH:mm")
MIN_TIME, MAX_TIME = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


def instant(value: datetime | str) -> Column:
    """A literal without time zone; through text, as a datetime literal would take the session's zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, from its fields, so the session's zone takes no part."""
    ts = ts.cast("timestamp_ntz")
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return days * UNITS["day"] + F.hour(ts).cast("long") * UNITS["hour"] + F.minute(ts).cast("long") * UNITS["minute"] + second


def whole_division(value: Column, by: int) -> Column:
    """Quotient rounded down, in whole numbers."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


#: Microseconds of the units that series are cut into.
UNITS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000, "quarter": 91 * 86_400_000_000}


def bucket(ts: Column, unit: str = "day") -> Column:
    """Number of the unit since 1970 that holds ``ts``; no time zone takes part."""
    return whole_division(micros(ts), UNITS[unit])


def bucket_start(ts: Column, unit: str = "day") -> Column:
    """First instant of the unit that holds ``ts``."""
    return F.timestamp_add("MICROSECOND", bucket(ts, unit) * UNITS[unit], instant("1970-01-01"))


def to_ticks(ts: Column) -> Column:
    return micros(ts) * 10 + F.lit(EPOCH_TICKS)


def from_ticks(ticks: Column) -> Column:
    """Timestamp of ticks; the 100 ns below a microsecond are cut."""
    us = whole_division(ticks - F.lit(EPOCH_TICKS), 10)
    return F.timestamp_add("MICROSECOND", us, instant("1970-01-01"))


def parse_time(text: Column, day: Column | None = None) -> Column:
    """A timestamp from any of the known formats, 'min' or 'max'; empty and null text is 'min', unreadable text too.

    A time alone is one of ``day``, today if none is given.
    """
    dated = F.concat_ws(" ", F.date_format(F.current_date() if day is None else day, "yyyy-MM-dd"), text)
    formats = [*[(text, f) for f in TIMESTAMP_FORMATS], *[(dated, f"yyyy-MM-dd {f}") for f in TIME_FORMATS]]
    known = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for t, f in formats]
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (MIN_TIME, MAX_TIME))
    word = F.lower(F.coalesce(text, F.lit("")))
    return F.when(word == "max", high).when(word.isin("", "min"), low).otherwise(F.coalesce(*known, low))


def days_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """``day`` for every day from ``first`` to ``last``, both included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")


def segment_path(ts: Column, symbol: Column, column: Column, roots: list[tuple[str, str]], default: str) -> Column:
    """Path of a segment: the root of the last (date, root) that is not after ``ts``, year, symbol, column and stamp."""
    root = F.lit(default)
    for date, path in sorted(roots):
        root = F.when(ts >= F.lit(date).cast("timestamp_ntz"), F.lit(path)).otherwise(root)
    name = F.concat_ws("_", symbol, column, stamp(ts))
    return F.concat_ws("/", root, F.date_format(ts, "yyyy"), symbol, column, name)


def next_power_of_two(value: Column) -> Column:
    """Smallest power of two that is not below ``value``; 1 for anything up to 1."""
    digits = F.length(F.bin((F.greatest(value.cast("long"), F.lit(2)) - 1).cast("long")))
    return F.when(value <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), digits))
