"""Windows over long series, cut into time buckets.

A window over a whole symbol runs in one task however many rows it has. Here
rows are grouped by (keys, bucket); what a bucket needs from earlier ones is a
single row for each bucket, found on a table of one row a bucket and joined
back. The largest task holds one bucket of one symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.time import bucket as bucket_of

BUCKET = "__bucket"


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], unit: str = "day", prefix: str = "prev_", bucket: Column | None = None) -> DataFrame:
    """Adds ``prev_<value>``: the value on the preceding row of ``keys`` in ``order``.

    The first column of ``order`` is a timestamp, or ``bucket`` says how it is cut and does not fall where it rises.
    """
    cut = df.withColumn(BUCKET, bucket_of(F.col(order[0]), unit) if bucket is None else bucket)
    inside = W.partitionBy(*keys, BUCKET).orderBy(*order)
    own = F.struct(*[F.col(v).alias(v) for v in values])
    local = cut.withColumn("__before", F.lag(own).over(inside))
    last = cut.groupBy(*keys, BUCKET).agg(F.max_by(own, F.struct(*order)).alias("__last"))
    carried = last.select(*keys, BUCKET, F.lag("__last").over(W.partitionBy(*keys).orderBy(BUCKET)).alias("__carry"))
    joined = local.join(carried, [*keys, BUCKET], "left")
    before = F.coalesce("__before", "__carry")
    return joined.select(*df.columns, *[before[v].alias(f"{prefix}{v}") for v in values])


def with_position(df: DataFrame, keys: list[str], order: list[str], unit: str = "day", name: str = "position") -> DataFrame:
    """Adds the 0-based position of each row of ``keys`` in ``order`` (its first column is a timestamp)."""
    cut = df.withColumn(BUCKET, bucket_of(F.col(order[0]), unit))
    local = cut.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, BUCKET).orderBy(*order)).cast("long"))
    counts = cut.groupBy(*keys, BUCKET).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    joined = local.join(offsets, [*keys, BUCKET])
    return joined.select(*df.columns, (F.col("__offset") + F.col("__rn") - 1).alias(name))
