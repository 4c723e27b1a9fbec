"""Differences between neighbouring ticks, their block minima and encoded sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.time import bucket
from tickweave.functions.varint import size_signed
from tickweave.operators.carry import with_position, with_previous


def deltas(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds ``delta_<value>`` to the previous row of the key, null on the first; whole numbers as long."""
    before = with_previous(rows, keys, order, values)
    return before.select(*rows.columns, *[(F.col(v) - F.col(f"prev_{v}")).alias(f"delta_{v}") for v in values])


def min_delta_stats(rows: DataFrame, keys: list[str], order: list[str], ticks: str, value: str, per_block: int) -> DataFrame:
    """Header of every block: least tick step, largest negative and least non-negative value step inside the block."""
    placed = with_position(rows, keys, order).withColumn("block", F.floor(F.col("position") / per_block).cast("long"))
    inside = W.partitionBy(*keys, "block").orderBy(*order)
    step = placed.withColumn("__dt", F.col(ticks) - F.lag(ticks).over(inside)).withColumn("__dv", F.col(value) - F.lag(value).over(inside))
    return step.groupBy(*keys, "block").agg(
        F.count("*").alias("n"), F.min("__dt").alias("min_delta_ticks"),
        F.max(F.when(F.col("__dv") < 0, F.col("__dv"))).alias("max_negative_delta"), F.min(F.when(F.col("__dv") >= 0, F.col("__dv"))).alias("min_positive_delta"),
    )


def encoded_bytes(rows: DataFrame, keys: list[str], order: list[str], ticks: str, value: str, per_block: int) -> DataFrame:
    """``block, n, encoded_bytes``: what min-delta encoding would take, header and entries, 64-bit ticks and values."""
    placed = with_position(rows, keys, order).withColumn("block", F.floor(F.col("position") / per_block).cast("long"))
    block, inside = W.partitionBy(*keys, "block"), W.partitionBy(*keys, "block").orderBy(*order)
    step = placed.withColumn("__dt", F.col(ticks) - F.lag(ticks).over(inside)).withColumn("__dv", F.col(value) - F.lag(value).over(inside))
    least = F.min("__dt").over(block)
    up = F.min(F.when(F.col("__dv") >= 0, F.col("__dv"))).over(block)
    down = F.max(F.when(F.col("__dv") < 0, F.col("__dv"))).over(block)
    step = step.withColumns({"__t": F.col("__dt") - least, "__v": F.when(F.col("__dv") < 0, down - F.col("__dv")).otherwise(F.col("__dv") - up)})
    entry = F.coalesce(size_signed(F.col("__t"), 64) + size_signed(F.col("__v"), 64, flag=True), F.lit(0))
    first = F.when(F.col("__dt").isNull(), size_signed(F.col(ticks), 64) + size_signed(F.col(value), 64)).otherwise(0)
    step = step.withColumns({"__entry": entry + first, "__least": least, "__up": up, "__down": down})
    head = size_signed(F.coalesce(F.first("__least"), F.lit(0)), 64) + size_signed(F.coalesce(F.first("__up"), F.lit(0)), 64) + size_signed(F.coalesce(F.first("__down"), F.lit(0)), 64)
    return step.groupBy(*keys, "block").agg(F.count("*").alias("n"), (F.sum("__entry") + head).alias("encoded_bytes"))


def frame_of_reference(rows: DataFrame, keys: list[str], order: list[str], value: str, per_block: int) -> DataFrame:
    """``block, n, base, spread``: each block's least value and how far the largest is above it."""
    placed = with_position(rows, keys, order).withColumn("block", F.floor(F.col("position") / per_block).cast("long"))
    return placed.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.min(value).alias("base"), (F.max(value) - F.min(value)).alias("spread"))


def restore(rows: DataFrame, keys: list[str], order: list[str], first: str, delta: str, name: str, unit: str = "day") -> DataFrame:
    """Adds the value that deltas add up to from the key's first value: decode of ``deltas``, cut into time buckets."""
    cut = rows.withColumn("__bucket", bucket(F.col(order[0]), unit)).withColumn("__step", F.coalesce(F.col(delta), F.col(first)))
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("__sum", F.sum("__step").over(inside))
    sums = cut.groupBy(*keys, "__bucket").agg(F.sum("__step").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return local.join(start, [*keys, "__bucket"]).select(*rows.columns, (F.col("__start") + F.col("__sum")).alias(name))
