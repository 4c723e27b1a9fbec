"""Last-write-wins merge, same-tick collapse and range delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each ``keys``: the last in ``order``. Aggregated before the shuffle, so many writes of one tick cost one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("__top")
    return rows.groupBy(*keys).agg(top).select(*[F.col(c) if c in keys else F.col("__top")[c].alias(c) for c in rows.columns])


def merge(batches: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All rows of batches written one after another; where keys meet, the later batch wins, in it the last in ``order``."""
    marked = [b.withColumn("__batch", F.lit(n)) for n, b in enumerate(batches)]
    return collapse(reduce(DataFrame.unionByName, marked), keys, ["__batch", *order]).drop("__batch")


def delete_range(rows: DataFrame, start: Column, end: Column, columns: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Rows outside [start, end], or inside it but of other columns."""
    inside = F.col(ts).between(start, end)
    if columns is not None:
        inside &= F.col("column").isin(*columns)
    return rows.where(~F.coalesce(inside, F.lit(False)))


def bounds(rows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``start, end, n_rows`` of each key: what a commit enters into the catalog."""
    return rows.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_rows"))
