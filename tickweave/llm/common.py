"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract: space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session that names none (tests) gets a temporary one: on a
    cluster nobody else could read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickweave-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at files that outlive any executor, computes an expensive
    input once, and gives Catalyst the table's true size, so that it decides
    about a broadcast by size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Batches = Iterator[pd.DataFrame]


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` for mapInPandas, whose worker afterwards gives back what it has freed.

    Workers are kept for the next tasks, busy or not, and would else hold the
    most that any of their tasks needed.
    """

    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            # not every C library has it
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_fraction(key: Column, seed: str) -> Column:
    """A repeatable number in (0, 1) from a key: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    whole = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (whole.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


#: Stands for a null id where pandas would turn a column with nulls into floats.
NO_ID = -(2**63)


def hide_null(doc_id: Column) -> Column:
    """An id as long, NO_ID for null."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID).cast("long"))


def show_null(doc_id: Column) -> Column:
    return F.nullif(doc_id, F.lit(NO_ID).cast("long"))
