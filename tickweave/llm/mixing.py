"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document's expected copies are the
source's rate times the document's own weight, three at most. The whole part is
certain; for the rest every document draws an order key, its random odds over
its inclusion odds, and the source takes documents in that order up to the
words still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.llm.common import hex_fraction, stage, word_count

#: No document and no source is repeated more often than this.
CAP = 3.0
#: Texts of fewer words are fragments and have half the inclusion rate of others.
FRAGMENT_WORDS = 50
FRAGMENT_RATE = 0.5
SEED = "mix-1"
#: Cells of the order key in which sizes are summed before any row is ranked.
CELLS = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` of ``source, source_size``: one row a source.

    Sources in code-point order, null last, weigh 1, 2, 3 and again. A target
    is the weight times a common level, or CAP times the source's size where
    that is less; the level makes the targets add up to all words. Sources
    reach their cap in the order of cap over weight, so the level is the first
    that leaves the next source below its cap.
    """
    ranked = sizes.withColumn("weight", 1 + (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    capped = ranked.withColumn("room", CAP * F.col("source_size") / F.col("weight"))
    order = W.orderBy("room", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = capped.select(
        "*",
        F.row_number().over(order).alias("at"),
        (
            (F.sum("source_size").over(W.partitionBy()) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    first = F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.col("at"))).over(W.partitionBy())
    return level.select("source", "source_size", F.coalesce(F.least(CAP * F.col("source_size"), F.col("weight") * first), CAP * F.col("source_size")).alias("target"))


def own_rate(size: Column) -> Column:
    return F.when(size < FRAGMENT_WORDS, F.lit(FRAGMENT_RATE)).otherwise(F.lit(1.0))


def source_rates(docs: DataFrame) -> DataFrame:
    """``source, source_size, target, rate``: with it expected words equal the target.

    Full documents reach the cap first; the rate beyond that is what fragments
    need to make up the rest.
    """
    sums = docs.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.when(F.col("size") < FRAGMENT_WORDS, F.col("size")).otherwise(0)).alias("fragments"),
    )
    sums = stage(sums, "source-sizes")
    full = F.col("source_size") - F.col("fragments")
    plain = F.try_divide(F.col("target"), full + FRAGMENT_RATE * F.col("fragments"))
    rest = F.try_divide(F.col("target") - CAP * full, FRAGMENT_RATE * F.col("fragments"))
    targets = source_targets(sums.select("source", "source_size"))
    both = targets.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "s.fragments")
    rate = F.coalesce(F.when(plain <= CAP, plain).otherwise(rest), F.lit(CAP))
    return both.select("source", "source_size", "target", rate.alias("rate"))


def with_odds(docs: DataFrame) -> DataFrame:
    """Adds ``copies`` (certain ones) and ``z``: the order key mapped to [0, 1), null where nothing is left to draw."""
    expected = F.least(F.lit(CAP), F.col("rate") * own_rate(F.col("size")))
    whole = F.floor(expected + 1e-9)
    left = F.greatest(F.lit(0.0), expected - whole)
    u = hex_fraction(F.col("doc_id"), SEED)
    z = u * (1 - F.col("left")) / (u * (1 - F.col("left")) + (1 - u) * F.col("left"))
    drawn = docs.withColumn("copies", whole.cast("long")).withColumn("left", left)
    return drawn.withColumn("z", F.when((F.col("left") > 1e-9) & (F.col("size") > 0), z)).drop("left")


def cut_points(odds: DataFrame) -> DataFrame:
    """``source, z_cut, id_cut``: the last document, in order, that the source takes once more.

    Sizes are summed in CELLS cells of the key for each source; only rows of
    the one cell in which a source's running total passes what it still needs
    are ranked one by one. The total ends as near to the need as whole
    documents allow.
    """
    need = odds.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("need"))
    cells = odds.where(F.col("z").isNotNull()).groupBy("source", F.floor(F.col("z") * CELLS).alias("cell")).agg(F.sum("size").alias("words"))
    running = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("end", F.sum("words").over(running)).withColumn("begin", F.col("end") - F.col("words"))
    last = stage(
        cells.alias("c")
        .join(need.alias("n"), F.col("c.source").eqNullSafe(F.col("n.source")))
        .where("c.begin < n.need")
        .groupBy("c.source")
        .agg(F.max("c.cell").alias("cell"), F.max_by("c.begin", "c.cell").alias("begin"), F.first("n.need").alias("need")),
        "mix-cells",
    )
    at = F.col("o.source").eqNullSafe(F.col("l.source")) & (F.floor(F.col("o.z") * CELLS) == F.col("l.cell"))
    rows = odds.where(F.col("z").isNotNull()).alias("o").join(last.alias("l"), at).select("o.source", "o.z", order_id(F.col("o.doc_id")).alias("id"), "o.size", "l.begin", "l.need")
    rows = rows.groupBy("source", "z", "id", "begin", "need").agg(F.sum("size").alias("size"))
    total = F.sum("size").over(W.partitionBy("source").orderBy("z", "id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("middle", F.col("begin") + total - F.col("size") / 2)
    inside = rows.where("middle < need").groupBy("source").agg(F.max(F.struct("z", "id")).alias("top"))
    # a cell whose first document is already past the middle takes all earlier cells and none of its own
    return last.alias("l").join(inside.alias("i"), F.col("l.source").eqNullSafe(F.col("i.source")), "left").select(
        "l.source",
        F.coalesce(F.col("i.top.z"), F.col("l.cell") / CELLS).alias("z_cut"),
        F.coalesce(F.col("i.top.id"), F.lit(-(2**63)).cast("long")).alias("id_cut"),
    )


def order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` -> ``doc_id, source, size, source_size, target, copies, taken``; reads ``docs`` four times.

    Every input row gives one row. Null sources form one source. Rows with an
    equal ``doc_id`` draw the same number: repeated rows are taken together.
    Empty documents take nothing; an empty table gives an empty result.
    """
    rates = stage(source_rates(docs), "mix-rates")
    same = F.col("d.source").eqNullSafe(F.col("r.source"))
    odds = with_odds(docs.alias("d").join(rates.alias("r"), same).select("d.*", "r.source_size", "r.target", "r.rate"))
    cuts = stage(cut_points(odds.select("doc_id", "source", "size", "target", "copies", "z")), "mix-cuts")
    decided = odds.alias("o").join(cuts.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")), "left")
    extra = F.coalesce((F.col("z") < F.col("z_cut")) | ((F.col("z") == F.col("z_cut")) & (order_id(F.col("doc_id")) <= F.col("id_cut"))), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("copies") + extra.cast("long")).otherwise(0)
    kept = [F.col(f"o.{c}") for c in docs.columns]
    return decided.select(*kept, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the same columns.

    Texts are never shuffled: the decision on a row needs only its source's
    rate and cut, two small tables. Other columns, whatever their names, pass
    through untouched.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), own)
    mixed = mix_sizes(narrow)
    repeated = mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sizes(stage(docs, "sizes")).drop("source")


def sql() -> str:
    return rf"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents),
        sums AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST(sum(CASE WHEN size < {FRAGMENT_WORDS} THEN size ELSE 0 END) AS BIGINT) AS fragments
            FROM sized GROUP BY source),
        ranked AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sums),
        roomy AS (SELECT *, {CAP}::DOUBLE * source_size / weight AS room FROM ranked),
        levels AS (
            SELECT *, row_number() OVER o AS turn,
                   ((sum(source_size) OVER ())::DOUBLE - {CAP}::DOUBLE * coalesce(sum(source_size) OVER p, 0)::DOUBLE)
                   / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level
            FROM roomy
            WINDOW o AS (ORDER BY room, source NULLS LAST),
                   p AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        chosen AS (SELECT arg_min(level, turn) AS level FROM levels WHERE level <= room),
        targets AS (
            SELECT source, source_size, fragments,
                   coalesce(least({CAP}::DOUBLE * source_size, weight * chosen.level), {CAP}::DOUBLE * source_size) AS target
            FROM levels, chosen),
        rates AS (
            SELECT *, coalesce(
                CASE WHEN target / nullif(source_size - fragments + {FRAGMENT_RATE}::DOUBLE * fragments, 0) <= {CAP}
                     THEN target / nullif(source_size - fragments + {FRAGMENT_RATE}::DOUBLE * fragments, 0)
                     ELSE (target - {CAP}::DOUBLE * (source_size - fragments)) / nullif({FRAGMENT_RATE}::DOUBLE * fragments, 0) END,
                {CAP}) AS rate
            FROM targets),
        expected AS (
            SELECT doc_id, s.source, size, source_size, target,
                   least({CAP}::DOUBLE, rate * CASE WHEN size < {FRAGMENT_WORDS} THEN {FRAGMENT_RATE}::DOUBLE ELSE 1.0::DOUBLE END) AS e,
                   (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE)
                   / {float(1 << 52)}::DOUBLE AS u
            FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
        split AS (SELECT *, floor(e + 1e-9::DOUBLE) AS whole, greatest(0.0::DOUBLE, e - floor(e + 1e-9::DOUBLE)) AS rest FROM expected),
        keyed AS (
            SELECT *, CASE WHEN rest > 1e-9 AND size > 0 THEN u * (1 - rest) / (u * (1 - rest) + (1 - u) * rest) END AS z FROM split),
        running AS (
            SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS need,
                   sum(CASE WHEN z IS NULL THEN 0 ELSE size END) OVER (
                       PARTITION BY source ORDER BY z NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
            FROM keyed),
        taken AS (
            SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN z IS NOT NULL AND total - size / 2.0::DOUBLE < need THEN 1 ELSE 0 END END AS n
            FROM running)
        SELECT doc_id, size, source_size, target, CAST(n AS BIGINT) AS copies, CAST(n * size AS BIGINT) AS taken FROM taken
    """
