"""Near-duplicate embeddings through rotated binary codes.

Vectors are scaled to length 1 and rotated at random. A rotated vector's signs
are its code; stored with it is the inner product of vector and code, with
which code products become unbiased estimates of inner products. The error of
an estimate is bounded with confidence CONFIDENCE standard deviations, and only
pairs whose upper bound reaches the threshold are computed exactly, in double
precision.

Pairs are looked for where vectors meet: in each of TABLES tables a vector's
bucket is its largest coordinate, with sign, under each of two further
rotations. Vectors that are equal are one vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.blocks import deal_blocks, link_rows, pairs_inside, whole_groups
from tickweave.llm.common import lean, stage, table
from tickweave.llm.components import components

THRESHOLD = 0.95
#: A pair at the threshold meets in a table with probability 0.357 in 64 dimensions: in one of 16 with 0.9991.
TABLES = 16
CONFIDENCE = 6.0
#: Vectors in one part of a bucket.
BLOCK = 512
#: Blocks of so many vectors or fewer are worked on together.
SMALL = 32


@lru_cache(maxsize=8)
def rotations(dimension: int) -> np.ndarray:
    """One rotation for the codes and two for each table, from a fixed seed."""
    draw = np.random.Generator(np.random.PCG64(1000 + dimension))
    return np.stack([np.linalg.qr(draw.normal(size=(dimension, dimension)))[0] for _ in range(1 + 2 * TABLES)])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated vectors, (n, d) of +-1/sqrt(d), and each vector's inner product with its own."""
    rotated = units @ rotations(units.shape[1])[0]
    signs = np.where(rotated > 0, 1.0, -1.0) / np.sqrt(units.shape[1])
    return signs, (rotated * signs).sum(axis=1)


def buckets(units: np.ndarray) -> np.ndarray:
    """Bucket of every vector in every table, (n, TABLES)."""
    n, d = units.shape
    out = np.zeros((n, TABLES), dtype=np.int64)
    for k in range(2 * TABLES):
        rotated = units @ rotations(d)[1 + k]
        top = np.abs(rotated).argmax(axis=1)
        side = 2 * top + (rotated[np.arange(n), top] > 0)
        out[:, k // 2] = out[:, k // 2] * (2 * d) + side
    return out


def estimates(signs: np.ndarray, own: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of coded rows with exact ones, and the slack a true link can fall short by.

    For a coded vector with inner product f with its code, the estimate is
    <code, other> / f, and its error at a true product c has the deviation
    sqrt(1 - c^2) sqrt(1 - f^2) / f / sqrt(d - 1); links have c >= THRESHOLD.
    """
    guess = (signs @ rotated.T) / own[:, None]
    deviation = np.sqrt((1 - THRESHOLD**2) * np.maximum(1 - own**2, 0)) / own / np.sqrt(max(signs.shape[1] - 1, 1))
    return guess, CONFIDENCE * deviation[:, None]


def exact(vectors: np.ndarray, units: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs reach the threshold, in double precision; scaled vectors where a square over- or underflows."""
    linked = np.zeros(len(i), dtype=bool)
    for begin in range(0, len(i), 1 << 16):
        part = slice(begin, begin + (1 << 16))
        a, b = vectors[i[part]], vectors[j[part]]
        with np.errstate(all="ignore"):
            norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            cosine = (a * b).sum(axis=1) / norm
        scaled = (units[i[part]] * units[j[part]]).sum(axis=1)
        linked[part] = np.where(np.isfinite(cosine) & (norm > 1e-200), cosine, scaled) >= THRESHOLD
    return linked


def stored_codes(rows: pd.DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and correction factors as ``codes`` made them, from the bits that are stored with each vector."""
    packed = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
    signs = np.unpackbits(packed, axis=1, count=dimension) * 2.0 - 1.0
    return signs / np.sqrt(dimension), rows["factor"].to_numpy()


def find_links(vectors: np.ndarray, cross: np.ndarray, signs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Symmetric matrix of pairs inside ``cross`` at the threshold: estimated first, then computed where the bound allows."""
    units = unit(vectors)
    guess, slack = estimates(signs, own, units @ rotations(units.shape[1])[0])
    i, j = np.nonzero(np.triu(cross & (guess + slack >= THRESHOLD), 1))
    sure = exact(vectors, units, i, j)
    linked = np.zeros(cross.shape, dtype=bool)
    linked[i[sure], j[sure]] = linked[j[sure], i[sure]] = True
    return linked


def find_pairs(vectors: np.ndarray, i: np.ndarray, j: np.ndarray, signs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The same for a list of pairs."""
    units = unit(vectors)
    rotated = units @ rotations(units.shape[1])[0]
    guess = np.concatenate([(signs[i[k : k + 65536]] * rotated[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.empty(0)]) / own[i]
    deviation = np.sqrt((1 - THRESHOLD**2) * np.maximum(1 - own[i] ** 2, 0)) / own[i] / np.sqrt(max(vectors.shape[1] - 1, 1))
    maybe = guess + CONFIDENCE * deviation >= THRESHOLD
    linked = np.zeros(len(i), dtype=bool)
    linked[maybe] = exact(vectors, units, i[maybe], j[maybe])
    return linked


def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dimension, part in batch.groupby(batch["vector"].map(len)):
            units = unit(np.stack(part["vector"].to_numpy()).astype(np.float64))
            signs, own = codes(units)
            bits = [row.tobytes() for row in np.packbits(signs > 0, axis=1)]
            yield part[["rep", "copies", "vector"]].assign(dimension=dimension, code=bits, factor=own, buckets=list(buckets(units)))


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of every block: small ones all at once as a list of pairs, larger ones as a matrix each."""
    for frame, begins in whole_groups(batches, ["dimension", "turn", "bucket", "bi", "bj"]):
        sizes = np.diff(np.append(begins, len(frame)))
        few = (sizes > 1) & (sizes <= SMALL)
        inside = np.repeat(few, sizes)
        for dimension, part in frame[inside].groupby("dimension", sort=False):
            yield small_blocks(part)
        for begin, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL]):
            yield large_block(frame.iloc[begin : begin + size])


def small_blocks(part: pd.DataFrame) -> pd.DataFrame:
    values = part[["turn", "bucket", "bi", "bj"]].to_numpy()
    begins = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
    i, j = pairs_inside(begins, len(part))
    met, turn, own = np.stack(part["buckets"].to_numpy()), part["turn"].to_numpy(), part["part"].to_numpy()
    fresh = (part["bi"].to_numpy() == part["bj"].to_numpy())[i] | (own[i] != own[j])
    for earlier in range(TABLES):
        fresh &= (turn[i] <= earlier) | (met[i, earlier] != met[j, earlier])
    i, j = i[fresh], j[fresh]
    vectors = np.stack(part["vector"].to_numpy()).astype(np.float64)
    linked = find_pairs(vectors, i, j, *stored_codes(part, vectors.shape[1]))
    i, j = i[linked], j[linked]
    ids, weights = part["rep"].to_numpy(), part["copies"].to_numpy()
    root = np.minimum(ids[i], ids[j])
    return pd.DataFrame({"id": np.r_[ids[i], ids[j]], "links": np.r_[weights[j], weights[i]], "root": np.r_[root, root]})


def large_block(block: pd.DataFrame) -> pd.DataFrame:
    turn, part = int(block["turn"].iat[0]), block["part"].to_numpy()
    cross = ~np.eye(len(block), dtype=bool) if block["bi"].iat[0] == block["bj"].iat[0] else part[:, None] != part[None, :]
    # a pair that has met in an earlier table was dealt with there
    met = np.stack(block["buckets"].to_numpy())
    for earlier in range(turn):
        cross &= met[:, earlier][:, None] != met[:, earlier][None, :]
    vectors = np.stack(block["vector"].to_numpy()).astype(np.float64)
    return link_rows(find_links(vectors, cross, *stored_codes(block, vectors.shape[1])), block["rep"].to_numpy(), block["copies"].to_numpy())


def usable(vector) -> F.Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_dedup(embeddings: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings`` (``vec_id, embedding``).

    ``n_links`` counts the other rows at a cosine of THRESHOLD or more,
    ``component_id`` is the smallest vec_id reached by links, ``kept`` whether
    it is the row's own. Null, zero and non-finite vectors link with nothing;
    vectors of different lengths do not either. Rows without vec_id link with
    nothing and have a null component (kept). Repeated rows count; rows that
    share a vec_id with unlike vectors each have the links of their own.
    Other columns, labels among them, are not read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fine = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    hashed = rows.where(fine).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    distinct = hashed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # a number for each vector, fixed by writing it, as ids may repeat with unlike vectors
    distinct = stage(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    placed = distinct.select("rep", "copies", "vector").mapInPandas(lean(assign), "rep long, copies long, vector array<double>, dimension int, code binary, factor double, buckets array<long>")
    placed = stage(placed.withColumn("vector", F.col("vector").cast(embeddings.schema["embedding"].dataType)), "buckets")
    group = ["dimension", "turn", "bucket"]
    spots = placed.select("rep", "dimension", F.posexplode("buckets").alias("turn", "bucket"))
    sizes = stage(spots.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    dealt = stage(deal_blocks(spots, sizes, group, "rep", BLOCK), "blocks")
    work = dealt.join(placed.select("rep", "copies", "vector", "code", "factor", "buckets"), "rep")
    keys = [*group, "bi", "bj"]
    found = stage(work.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lean(verify), "id long, links long, root long"), "verified")

    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    per_vector = stage(distinct.drop("vector").join(links, "rep", "left").join(roots, "rep", "left"), "vector-links")
    names = per_vector.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("least").alias("first"))
    per_vector = per_vector.join(names, "component_id", "left")
    own = hashed.select("vec_id", "k1", "k2").join(per_vector, ["k1", "k2"])
    linked = own.select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("first", "least").alias("component_id"),
    )
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
