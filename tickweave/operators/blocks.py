"""Blocks of a series: fixed numbers of entries with first and last, sizes and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.types import field_type
from tickweave.operators.carry import with_position

BLOCK_BYTES = 8192
#: Bytes of a block's header besides its first and last entry, and of its checksum.
HEADER_BYTES, CHECK_BYTES = 9, 1


def capacity(kind: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Entries in a full block."""
    return block_bytes // field_type(kind).entry_bytes


def shell_bytes(kind: str) -> int:
    """Bytes of a block besides its entries."""
    return HEADER_BYTES + 2 * field_type(kind).entry_bytes + CHECK_BYTES


def block_infos(rows: DataFrame, keys: list[str], order: list[str], value: str, kind: str = "double") -> DataFrame:
    """``block, n, first_ts, last_ts, first_value, last_value`` of every block of each key."""
    placed = with_position(rows, keys, order).withColumn("block", F.floor(F.col("position") / capacity(kind)).cast("long"))
    rank = F.struct(*order)
    return placed.groupBy(*keys, "block").agg(
        F.count("*").alias("n"), F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts"),
        F.min_by(value, rank).alias("first_value"), F.max_by(value, rank).alias("last_value"),
    )


def block_sizes(infos: DataFrame, kind: str = "double", raw: str | None = None) -> DataFrame:
    """Adds ``payload_bytes, shell_bytes, total_bytes`` and the saved shares against ``raw`` bytes (n entries if None)."""
    entry, shell = field_type(kind).entry_bytes, shell_bytes(kind)
    raw_bytes = F.col("n") * entry if raw is None else F.col(raw)
    return infos.select(
        "*",
        (F.col("n") * entry).alias("payload_bytes"), F.lit(shell).cast("long").alias("shell_bytes"), (F.col("n") * entry + shell).alias("total_bytes"),
        (1 - (F.col("n") * entry) / raw_bytes).alias("payload_saving"), (1 - (F.col("n") * entry + shell) / raw_bytes).alias("total_saving"),
    )


def block_samples(infos: DataFrame, keys: list[str], threshold: int, kind: str = "double") -> DataFrame:
    """``sample, start, end, offset``: the first and last tick of each run of blocks of at least ``threshold`` bytes.

    All blocks but a series' last are full, so a run has a fixed number of
    blocks and integer division numbers the runs; the last run ends with the
    series.
    """
    full = capacity(kind) * field_type(kind).entry_bytes + shell_bytes(kind)
    run = -(-threshold // full)
    numbered = infos.withColumn("sample", F.floor(F.col("block") / run).cast("long"))
    return numbered.groupBy(*keys, "sample").agg(
        F.min("first_ts").alias("start"), F.max("last_ts").alias("end"), (F.min("block") * full).alias("offset"), F.count("*").alias("n_blocks")
    )


def seek(samples: DataFrame, keys: list[str], at) -> DataFrame:
    """Byte offset at which a read from ``at`` begins: that of the last sample that starts no later, else 0."""
    return samples.groupBy(*keys).agg(F.coalesce(F.max_by("offset", F.when(F.col("start") <= at, F.col("start"))), F.lit(0)).alias("offset"))
