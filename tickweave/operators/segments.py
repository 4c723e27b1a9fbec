"""The segment catalog: overlap search, merged ranges, gaps and revisions.

A catalog row is one immutable piece of a series: ``symbol, column, segment_id,
start, end, n_rows`` (and ``path`` in a store).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.time import bucket


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Starts inside [low, high], or starts before and reaches ``low``."""
    return start.between(low, high) | ((start < low) & (end >= low))


def search(catalog: DataFrame, low: Column, high: Column) -> DataFrame:
    """Segments that overlap one range."""
    return catalog.where(overlaps(F.col("start"), F.col("end"), low, high))


def search_many(catalog: DataFrame, ranges: DataFrame, keys: list[str], unit: str = "day") -> DataFrame:
    """Segments joined to every range (``low, high``) of their key that they overlap.

    Both sides are dealt to the time buckets they touch and meet on (key,
    bucket), an equality; a pair counts in the first bucket that both touch, so
    it comes once.
    """

    def touched(first: str, last: str) -> Column:
        return F.explode(F.sequence(bucket(F.col(first), unit), bucket(F.col(last), unit)))

    left = catalog.withColumn("__at", touched("start", "end"))
    right = ranges.where("low <= high").withColumn("__at", touched("low", "high"))
    met = left.join(right, [*keys, "__at"]).where(overlaps(F.col("start"), F.col("end"), F.col("low"), F.col("high")))
    first = F.greatest(bucket(F.col("start"), unit), bucket(F.col("low"), unit))
    return met.where(F.col("__at") == first).drop("__at")


def merged_ranges(found: DataFrame, keys: list[str]) -> DataFrame:
    """Range that replaces the overlapped segments: least start to largest end, the range's own bounds included."""
    return found.groupBy(*keys, "low", "high").agg(
        F.least(F.min("start"), F.col("low")).alias("start"), F.greatest(F.max("end"), F.col("high")).alias("end"), F.count("*").alias("n_segments")
    )


def point(catalog: DataFrame, start: Column) -> DataFrame:
    """Segments that start at an instant."""
    return catalog.where(F.col("start") == start)


def union_new(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Known rows and those new ones whose key is not known yet."""
    return known.unionByName(new.join(known.select(*keys), keys, "left_anti"))


def gaps(covered: DataFrame, keys: list[str], low: Column, high: Column, resolution: str) -> DataFrame:
    """``gap_start, gap_end`` of what [low, high] leaves uncovered, for every key that has a row in ``covered``.

    ``covered`` has ``start, end`` (included); ``resolution`` is the distance of
    neighbouring instants, as an interval. Segments are few for each key.
    """
    step = F.expr(f"interval {resolution}")
    order = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    clipped = covered.where((F.col("end") >= low) & (F.col("start") <= high))
    begin = F.coalesce(F.max("end").over(order) + step, low)
    between = clipped.select(*keys, begin.alias("gap_start"), (F.col("start") - step).alias("gap_end"))
    ends = clipped.groupBy(*keys).agg(F.max("end").alias("__end"))
    tail = ends.select(*keys, (F.col("__end") + step).alias("gap_start"), high.alias("gap_end"))
    empty = covered.select(*keys).distinct().join(ends, keys, "left_anti").select(*keys, low.alias("gap_start"), high.alias("gap_end"))
    return between.unionByName(tail).unionByName(empty).where("gap_start <= gap_end")


def revisions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog changes of each key so far."""
    return events.groupBy(*keys).agg(F.count("*").alias("revision"))


def carry_in(catalog: DataFrame, ticks: DataFrame, keys: list[str], low: Column, high: Column, mode: str) -> DataFrame:
    """Ticks that a read of [low, high] may carry forward.

    ``none``: only those inside. ``unbounded``: all up to ``high``. ``segment``:
    those inside, and earlier ones of the segments that straddle ``low``.
    """
    if mode == "unbounded":
        return ticks.where(F.col("ts") <= high)
    inside = ticks.where(F.col("ts").between(low, high))
    if mode == "none":
        return inside
    if mode != "segment":
        raise ValueError(f"unknown carry-in {mode}")
    straddling = catalog.where((F.col("start") < low) & (F.col("end") >= low)).groupBy(*keys).agg(F.min("start").alias("__from"))
    early = ticks.where(F.col("ts") < low).join(straddling, keys).where(F.col("ts") >= F.col("__from")).drop("__from")
    return inside.unionByName(early.select(*inside.columns))
