"""Read-through source: ranges that a store lacks are fetched from a provider and kept."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.time import instant
from tickweave.operators import segments

Provider = Callable[[str, datetime, datetime], "DataFrame | None"]


def missing(store, symbol: str, column: str, start: datetime, end: datetime, resolution: str = "1 microsecond") -> list[tuple[datetime, datetime]]:
    """Sub-ranges of [start, end] that no segment of the column covers; segments of one column and range are few."""
    low, high = instant(start), instant(end)
    known = store.catalog().where((F.col("symbol") == symbol) & (F.col("column") == column))
    if known.isEmpty():
        return [(start, end)]
    found = segments.gaps(known.select("symbol", "column", "start", "end"), ["symbol", "column"], low, high, resolution)
    return [(r["gap_start"], r["gap_end"]) for r in found.orderBy("gap_start").collect()]


def fetch(store, symbol: str, column: str, start: datetime, end: datetime, provider: Provider, resolution: str = "1 microsecond") -> DataFrame:
    """Rows of [start, end], after the provider has been asked for each missing sub-range.

    The provider returns wide rows (``timestamp`` and the column) or None.
    """
    for low, high in missing(store, symbol, column, start, end, resolution):
        rows = provider(symbol, low, high)
        if rows is not None:
            store.insert(symbol, rows)
    return store.scan(symbol, start, end, [column])
