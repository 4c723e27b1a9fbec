"""Last observation carried forward: as-of alignment of sparse columns on one clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.time import micros
from tickweave.operators.carry import BUCKET, bucket_of


def _carried(rows: DataFrame, keys: list[str], order: list[str], values: list[str], unit: str | None) -> DataFrame:
    """``rows`` with every value replaced by the last non-null one up to the row, in ``order``."""
    if unit is None:
        window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({v: F.last(v, True).over(window) for v in values})
    # one exchange serves both the windows and the last rows of the buckets
    cut = rows.withColumn(BUCKET, bucket_of(F.col(order[0]), unit)).repartition(*keys, BUCKET)
    window = W.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({v: F.last(v, True).over(window) for v in values})
    rank = F.struct(*order)
    last = cut.groupBy(*keys, BUCKET).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), rank)).alias(v) for v in values])
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*keys, BUCKET, *[F.last(v, True).over(before).alias(f"__carry_{v}") for v in values])
    joined = local.join(carry, [*keys, BUCKET], "left")
    return joined.select(*[F.coalesce(c, f"__carry_{c}").alias(c) if c in values else F.col(c) for c in rows.columns])


def locf(rows: DataFrame, keys: list[str], ts: str, values: list[str], ties: list[str], stamps: bool = False, unit: str | None = "day") -> DataFrame:
    """Every row with each value's last observation up to it; ``stamps`` adds ``<value>__ts``, when that was.

    ``ties`` order rows of one timestamp, later ones win. With ``unit`` the work
    is cut into time buckets (two passes, no task holds a whole symbol); None
    uses one window a key.
    """
    if stamps:
        rows = rows.withColumns({f"{v}__ts": F.when(F.col(v).isNotNull(), F.col(ts)) for v in values})
        values = [*values, *[f"{v}__ts" for v in values]]
    return _carried(rows, keys, [ts, *ties], values, unit)


def asof(ticks: DataFrame, probes: DataFrame, keys: list[str], ts: str, values: list[str], ties: list[str], stamps: bool = False, unit: str | None = "day") -> DataFrame:
    """``probes`` with each value's last observation at or before the probe's time, null if there is none.

    One union of ticks and probes, sorted so that a probe comes after the ticks
    of its own instant: no join on a range, nothing grows beyond the input.
    """
    data = ticks.select(*keys, ts, *[F.struct(F.lit(False).alias("probe"), *[F.col(t).cast("long").alias(t) for t in ties]).alias("__order")], *values, F.lit(None).cast(_struct(probes)).alias("__own"))
    asked = probes.select(
        *keys, ts,
        F.struct(F.lit(True).alias("probe"), *[F.lit(None).cast("long").alias(t) for t in ties]).alias("__order"),
        *[F.lit(None).cast(ticks.schema[v].dataType).alias(v) for v in values],
        F.struct(*[F.col(c) for c in probes.columns]).alias("__own"),
    )
    both = data.unionByName(asked)
    if stamps:
        both = both.withColumns({f"{v}__ts": F.when(F.col(v).isNotNull(), F.col(ts)) for v in values})
        values = [*values, *[f"{v}__ts" for v in values]]
    done = _carried(both, keys, [ts, "__order"], values, unit).where("__own IS NOT NULL")
    return done.select(*[F.col("__own")[c].alias(c) for c in probes.columns], *values)


def _struct(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema) + ">"


def grid(spark, symbols: DataFrame, first: str, last: str, step: str, ts: str = "ts") -> DataFrame:
    """Every step from ``first`` to ``last`` (included) for every symbol; the steps are broadcast, their number is fixed by the arguments."""
    steps = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval {step})")).alias(ts))
    return symbols.crossJoin(F.broadcast(steps))


def next_tick(rows: DataFrame, keys: list[str], ts: str, name: str = "next_ts") -> DataFrame:
    """Distinct ticks of each key with the tick after, null at the end; cut into days like the rest."""
    ticks = rows.select(*keys, ts).distinct().withColumn(BUCKET, bucket_of(F.col(ts)))
    local = ticks.withColumn("__next", F.lead(ts).over(W.partitionBy(*keys, BUCKET).orderBy(ts)))
    firsts = ticks.groupBy(*keys, BUCKET).agg(F.min(ts).alias("__first"))
    after = firsts.select(*keys, BUCKET, F.lead("__first").over(W.partitionBy(*keys).orderBy(BUCKET)).alias("__carry"))
    return local.join(after, [*keys, BUCKET]).select(*keys, ts, F.coalesce("__next", "__carry").alias(name))


def cursor_time(stamps: list[str]) -> Column:
    """Latest update among fields, null before any."""
    return F.greatest(*[F.col(s) for s in stamps]) if len(stamps) > 1 else F.col(stamps[0])


def asof_forward(ticks: DataFrame, probes: DataFrame, keys: list[str], ts: str, values: list[str], ties: list[str]) -> DataFrame:
    """Extension: each value's first observation at or after the probe's time."""
    back, epoch = "__back", F.lit("1970-01-01").cast("timestamp_ntz")

    def flip(df: DataFrame) -> DataFrame:
        return df.withColumn(back, F.timestamp_add("MICROSECOND", -micros(F.col(ts)), epoch))

    turned = flip(ticks).withColumns({t: -F.col(t).cast("long") for t in ties})
    return asof(turned, flip(probes), keys, back, values, ties).drop(back)


def latest(rows: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Last row of each key in ``order``: an aggregation with partial sums, no sort."""
    top = F.max_by(F.struct(*values), F.struct(*order)).alias("__top")
    return rows.groupBy(*keys).agg(top).select(*keys, *[F.col("__top")[v].alias(v) for v in values])
