"""Shard placement through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The
shards take turns; at its turn a shard claims the first slot of its permutation
that is still free. The table is a function of the shard names alone, holds
``size`` entries whatever the data, and moves few keys when a shard comes or
goes. Placement is one digest and one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def table_size(n_shards: int, per_shard: int = 101) -> int:
    """The smallest prime of at least ``per_shard`` slots a shard."""
    size = max(3, n_shards * per_shard)
    while not is_prime(size):
        size += 1
    return size


def preference(shard: str, size: int) -> tuple[int, int]:
    """First slot and stride of a shard's permutation of the slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:16], 16) % size, int(digest[16:], 16) % (size - 1) + 1


def fill_table(shards: list[str], size: int) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime and hold every shard")
    prefer = [preference(name, size) for name in shards]
    turn_at = [0] * len(shards)
    owner = [-1] * size
    free = size
    while True:
        for shard, (first, stride) in enumerate(prefer):
            if not free:
                return owner
            slot = (first + turn_at[shard] * stride) % size
            while owner[slot] >= 0:
                turn_at[shard] += 1
                slot = (first + turn_at[shard] * stride) % size
            owner[slot] = shard
            turn_at[shard] += 1
            free -= 1


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 32 bits of its digest modulo the table size; a null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(size)


def place(df: DataFrame, key: str, shards: list[str], size: int | None = None) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string) of every row.

    Rows stay where they are: no shuffle, one broadcast of ``size`` rows. Equal
    keys, repeated rows included, land on one shard; a null key is placed as
    the empty string; an empty table gives an empty result. Input columns
    named ``slot`` or ``shard`` are replaced.
    """
    size = size or table_size(len(shards))
    owner = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*[F.lit(name) for name in shards])
    lookup = (
        df.sparkSession.range(1)
        .select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "owner"))
        .select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))
    )
    kept = df.drop("slot", "shard")
    return kept.withColumn("slot", slot_of(kept[key], size)).join(F.broadcast(lookup), "slot").select(*kept.columns, "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1, salt: str | None = None) -> None:
    """Write placed rows as one folder a shard, a hot shard as several files."""
    spread = F.pmod(F.xxhash64(F.col(salt) if salt else F.monotonically_increasing_id()), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)


#: Parameters of the registered query.
SHARDS = [f"shard-{i:02d}" for i in range(64)]


def query(spark, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return place(docs, "doc_id", SHARDS)


def sql() -> str:
    size = table_size(len(SHARDS))
    owner = ",".join(SHARDS[i] for i in fill_table(SHARDS, size))
    return f"""
        WITH claimed AS (SELECT string_split('{owner}', ',') AS names),
             keyed AS (
                 SELECT doc_id, source,
                        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {size} AS slot
                 FROM documents)
        SELECT doc_id, source, CAST(slot AS BIGINT) AS slot, names[CAST(slot + 1 AS INTEGER)] AS shard
        FROM keyed, claimed
    """
