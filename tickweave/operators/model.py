"""The tall table (symbol, column, ts, seq, one value column a type) and its wide views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.types import FIELD_TYPES, VALUE_COLUMNS, field_type

KEYS = ["symbol", "column", "ts", "seq"]
TALL = ["symbol", "column", "ts", "seq", *VALUE_COLUMNS]
TALL_SCHEMA = "symbol string, column string, ts timestamp_ntz, seq long, v_float float, v_double double, v_int int, v_long long, v_string string"


def melt(wide: DataFrame, symbol: str, ts: str, columns: list[str], seq: Column | str | None = None) -> DataFrame:
    """Wide rows to tall ones, one pass and no shuffle. A null cell is no observation; NaN is one."""
    cells = []
    for name in columns:
        kind = field_type(wide.schema[name].dataType)
        values = [F.col(f"`{name}`").cast(t.spark).alias(t.column) if t is kind else F.lit(None).cast(t.spark).alias(t.column) for t in FIELD_TYPES.values()]
        cells.append(F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(name).alias("column"), *values)))
    order = F.lit(0).cast("long") if seq is None else F.col(seq) if isinstance(seq, str) else seq
    rows = wide.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp_ntz").alias("ts"), order.cast("long").alias("seq"), F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    return rows.select("symbol", "cell.column", "ts", "seq", *[f"cell.{v}" for v in VALUE_COLUMNS])


def pivot(tall: DataFrame, types: dict[str, str]) -> DataFrame:
    """Tall rows to one row for each (symbol, ts): the last value in seq order of each named column.

    The columns are named, so no job has to find them; one shuffle on
    (symbol, ts) with partial aggregation.
    """
    latest = [
        F.max_by(F.col(field_type(kind).column), F.when((F.col("column") == name) & F.col(field_type(kind).column).isNotNull(), F.col("seq"))).alias(name) for name, kind in types.items()
    ]
    return tall.where(F.col("column").isin(*types)).groupBy("symbol", "ts").agg(*latest)


def project(tall: DataFrame, columns: list[str] | None, known: list[str] | None = None) -> DataFrame:
    """Rows of the named columns; None means all, an unknown name is an error where ``known`` is given."""
    if columns is None:
        return tall
    if known is not None and (missing := sorted(set(columns) - set(known))):
        raise KeyError(f"unknown columns: {', '.join(missing)}")
    return tall.where(F.col("column").isin(*columns))


def time_range(df: DataFrame, start: Column, end: Column | None = None, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; without an end, one day from the start."""
    stop = start + F.expr("interval 1 day") if end is None else end
    return df.where(F.col(ts).between(start, stop))
