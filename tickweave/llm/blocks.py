"""Work on groups of rows inside mapInPandas tasks, and on groups too large for one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal_blocks(members: DataFrame, sizes: DataFrame, group: list[str], spread: str, block: int) -> DataFrame:
    """``members`` dealt to blocks: adds ``bi``, ``bj`` (block pair) and ``part`` (the row's own block).

    A group of at most ``block`` rows is one block. A larger one is cut into c
    parts by a hash of ``spread`` and every pair of parts is a block of work, so
    each row is sent c times, no task holds more than about two parts, and
    every pair of the group's rows meets: in (i, i) if both are of part i, else
    in (i, j). ``sizes`` has ``group`` and ``n``.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("part"), F.col(spread)), F.col("parts")).cast("int")
    dealt = members.join(sizes.withColumn("parts", parts).drop("n"), group).withColumn("part", own)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*members.columns, "part", F.least("part", "with").alias("bi"), F.greatest("part", "with").alias("bj"))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches, sorted by ``keys``, cut so that every key's rows are in one frame, with the first row of each key.

    Holds one batch and the unfinished key of the one before.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        if held and (batch[keys].iloc[-1] == held[0][keys].iloc[-1]).all():
            held.append(batch)
            continue
        frame = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
        values = frame[keys].to_numpy()
        begins = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        if len(begins) > 1:
            yield frame.iloc[: begins[-1]], begins[:-1]
        held = [frame.iloc[begins[-1] :]]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, np.array([0])


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, whole, from batches sorted by ``keys``."""
    for frame, begins in whole_groups(batches, keys):
        for begin, end in zip(begins, [*begins[1:], len(frame)]):
            yield frame.iloc[begin:end]


def pairs_inside(begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows i < j that lie in one group, for groups that begin at ``begins`` in ``n`` rows."""
    ends = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    left, right = [], []
    for step in range(1, int(np.diff(np.append(begins, n)).max(initial=0))):
        i = np.flatnonzero(np.arange(n) + step < ends)
        left.append(i)
        right.append(i + step)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def local_labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches in a symmetric link matrix."""
    labels = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(labels, np.where(linked, labels[None, :], top).min(axis=1))
        if (new == labels).all():
            return labels
        labels = new


def link_rows(linked: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    """``id, links, root`` of rows with a link: linked weight, and a link each that joins the block's components."""
    some = linked.any(axis=1)
    linked, ids, weights = linked[np.ix_(some, some)], ids[some], weights[some]
    if not len(ids):
        return pd.DataFrame({"id": ids, "links": weights, "root": ids})
    return pd.DataFrame({"id": ids, "links": linked @ weights, "root": local_labels(linked, ids)})
