"""N-gram Jaccard self-join of documents through MinHash bands.

Texts become sets of five-word shingles. Equal sets form a class, joined once.
``ROWS`` and ``BANDS`` give a pair at the threshold a chance of TARGET_RECALL
to share a band. Documents meet on band hashes. Where they meet, the share of
equal MinHash values tells pairs that may reach the threshold from those that
do not come near it; a document is first held against the least of its bucket,
and only buckets with documents unlike the least are compared further, block by
block. What such pairs connect is a candidate group, and inside it all pairs
are verified on their full sets. Texts that are half alike, as templates are,
share bands but are no candidates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.blocks import deal_blocks, groups, link_rows
from tickweave.llm.common import lean, stage, table
from tickweave.llm.components import components

WORDS = 5
#: Similarity of a link, as a fraction: 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
TARGET_RECALL = 0.999
ROWS = 8
#: Documents in one part of a candidate group.
BLOCK = 128
COLUMNS = 8192


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes with which a pair of ``similarity`` shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(NUMERATOR / DENOMINATOR, ROWS, TARGET_RECALL)

_random = np.random.Generator(np.random.PCG64(20240101))
MULTIPLY = _random.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
FLIP = _random.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
WORD_FACTORS = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROW_FACTORS = _random.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_TERMS = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the five-word shingles of a whole text.

    Words part at space, tab and line ends. A text of one to four words has
    one shingle, all its words; one without words, or null, has none.
    """
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(WORDS, len(words))
    total = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        total += hashed[k : len(words) - span + 1 + k] * WORD_FACTORS[k]
    return np.unique(mix64(total))


#: Equal values of two signatures from which a pair is a candidate: six deviations below what the threshold lets expect.
LEAST_EQUAL = math.floor(ROWS * BANDS * NUMERATOR / DENOMINATOR - 6 * math.sqrt(ROWS * BANDS * NUMERATOR * (DENOMINATOR - NUMERATOR)) / DENOMINATOR)
#: Documents in one part of a bucket that is compared.
MEETING = 512


def minima(sets: np.ndarray) -> np.ndarray:
    """MinHash signature of a non-empty set."""
    short = (sets >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MULTIPLY), np.iinfo(np.uint32).max, dtype=np.uint32)
    for begin in range(0, len(short), 2048):
        part = (short[None, begin : begin + 2048] ^ FLIP[:, None]) * MULTIPLY[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_hashes(sets: np.ndarray) -> np.ndarray:
    """Hash of every band of a non-empty set's signature."""
    return bands_of(minima(sets))


def bands_of(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((rows * ROW_FACTORS).sum(axis=1, dtype=np.uint64) + BAND_TERMS).view(np.int64)


def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, version, text in zip(batch["doc_id"], batch["version"], batch["text"]):
            own = shingles(text)
            key = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()
            signature = minima(own) if len(own) else None
            bands, low = (None, None) if signature is None else (bands_of(signature), signature.astype(np.uint8).tobytes())
            out.append((doc_id, version, key, len(own), bands, low))
        yield pd.DataFrame(out, columns=["doc_id", "version", "key", "n_shingles", "bands", "low"])


def low_bytes(values: pd.Series) -> np.ndarray:
    """The low bytes of signatures, one a row; unlike values agree in one of 256, so no equal one is missed."""
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, len(MULTIPLY))


def near_least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether each document is a candidate pair with the least of its bucket."""
    for batch in batches:
        equal = (low_bytes(batch["low"]) == low_bytes(batch["least_low"])).sum(axis=1)
        yield batch[["rep", "least"]].assign(near=equal >= LEAST_EQUAL)


def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that join what candidate pairs connect in each block; pairs that are both near their bucket's least are joined by it."""
    for block in groups(batches, ["band", "bi", "bj"]):
        low, loose, part = low_bytes(block["low"]), block["loose"].to_numpy(), block["part"].to_numpy()
        linked = np.zeros((len(block), len(block)), dtype=bool)
        for i in range(len(block) - 1):
            linked[i, i + 1 :] = (low[i + 1 :] == low[i]).sum(axis=1) >= LEAST_EQUAL
        linked = (linked | linked.T) & (loose[:, None] | loose[None, :])
        if block["bi"].iat[0] != block["bj"].iat[0]:
            linked &= part[:, None] != part[None, :]
        links = link_rows(linked, block["rep"].to_numpy(), np.ones(len(block), dtype=np.int64))
        yield links[["id", "root"]].rename(columns={"id": "a", "root": "b"})


def candidate_links(classes: DataFrame) -> DataFrame:
    """``a, b``: links that connect all classes which share a band and agree in LEAST_EQUAL values, directly or through others."""
    banded = classes.select("rep", F.explode("bands").alias("band"))
    meeting = banded.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stage(banded.join(meeting, "band"), "met")
    low = classes.select("rep", "low")
    pairs = met.where("rep <> least").select("rep", "least").distinct()
    pairs = pairs.join(low, "rep").join(low.select(F.col("rep").alias("least"), F.col("low").alias("least_low")), "least")
    near = stage(pairs.select("rep", "least", "low", "least_low").mapInPandas(lean(near_least), "rep long, least long, near boolean"), "near-least")

    placed = met.join(near, ["rep", "least"], "left").select("band", "rep", (~F.coalesce("near", F.lit(True))).alias("loose"))
    sizes = stage(placed.groupBy("band").agg(F.count("*").alias("n"), F.max("loose").alias("loose")).where("loose AND n > 2").drop("loose"), "open-sizes")
    dealt = stage(deal_blocks(placed, sizes, ["band"], "rep", MEETING), "meetings")
    keys = ["band", "bi", "bj"]
    work = dealt.join(low, "rep").select(*keys, "part", "rep", "loose", "low").repartition(*keys).sortWithinPartitions(*keys)
    others = work.mapInPandas(lean(meet), "a long, b long").where("a <> b")
    return near.where("near").select(F.col("rep").alias("a"), F.col("least").alias("b")).unionByName(others)


def jaccard_links(left: list[np.ndarray], cross: np.ndarray) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly; only where ``cross`` is true."""
    sizes = np.array([len(x) for x in left], dtype=np.int64)
    values, column = np.unique(np.concatenate(left), return_inverse=True)
    row = np.repeat(np.arange(len(left)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(left)), dtype=np.int64)
    for begin in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
        held = np.zeros((len(left), COLUMNS), dtype=np.float32)
        held[row[lo:hi], column[lo:hi] - begin] = 1
        common += (held @ held.T).astype(np.int64)
    # common / (a + b - common) >= NUMERATOR / DENOMINATOR
    return cross & ((NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (sizes[:, None] + sizes[None, :]))


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block in groups(batches, ["cid", "bi", "bj"]):
        ids, weights, part = block["rep"].to_numpy(), block["copies"].to_numpy(), block["part"].to_numpy()
        if block["bi"].iat[0] == block["bj"].iat[0]:
            cross = ~np.eye(len(ids), dtype=bool)
        else:
            cross = part[:, None] != part[None, :]
        if cross.any():
            yield link_rows(jaccard_links([shingles(t) for t in block["text"]], cross), ids, weights)


def linked_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, version, class_id, n_links, component_id, first`` of every row with a doc_id.

    ``version`` is a hash of the text, so rows that share an id with unlike
    texts stay apart; ``first`` is the least (doc_id, version) of the group.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    signed = stage(ids.mapInPandas(lean(sign), "doc_id long, version long, key string, n_shingles long, bands array<long>, low binary"), "signatures")
    some = signed.where("n_shingles > 0")
    member = F.struct("doc_id", "version")
    classes = some.groupBy("key").agg(F.min(member).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    # a number for each class, fixed by writing it
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    grouped = stage(components(candidate_links(classes)).select(F.col("id").alias("rep"), F.col("component_id").alias("cid")), "candidates")

    members = grouped.join(classes.select("rep", "copies", "least.*"), "rep")
    sizes = grouped.groupBy("cid").agg(F.count("*").alias("n"))
    dealt = stage(deal_blocks(members, sizes, ["cid"], "rep", BLOCK), "blocks")
    shown = members.select("doc_id", "version")
    texts = ids.join(shown, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    work = dealt.join(texts, ["doc_id", "version"]).select("cid", "bi", "bj", "part", "rep", "copies", "text")
    work = work.repartition("cid", "bi", "bj").sortWithinPartitions("cid", "bi", "bj")
    found = stage(work.mapInPandas(lean(verify), "id long, links long, root long"), "verified")

    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    per_class = stage(classes.drop("bands", "low").join(links, "rep", "left").join(roots, "rep", "left"), "class-links")
    firsts = per_class.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("least").alias("first"))
    per_class = per_class.join(firsts, "component_id", "left").select("key", "copies", "links", "least", F.coalesce("first", "least").alias("first"))

    own = signed.drop("bands", "low").join(per_class, "key", "left")
    return own.select(
        "doc_id", "version",
        F.coalesce("least.doc_id", "doc_id").alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        F.coalesce("first", member).alias("first"),
    )


def ngram_join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    ``class_id`` is the smallest doc_id with the same shingle set, ``n_links``
    the number of other documents at a Jaccard similarity of 0.8 or more,
    ``component_id`` the smallest doc_id reached by links, ``kept`` whether it
    is the document itself. Texts without words link with nothing, and so do
    rows without doc_id (null class and component, kept). Rows repeated in the
    table count as documents; of rows that share a doc_id with unlike texts
    each has the links of its own text, and if they are of one group, one of
    them is kept. Other columns are not read.
    """
    linked = linked_rows(docs).select("doc_id", "class_id", "n_links", "component_id", (F.struct("doc_id", "version") == F.col("first")).alias("kept"))
    none = F.lit(None).cast("long")
    unnamed = docs.where(F.col("doc_id").isNull()).select(none.alias("doc_id"), none.alias("class_id"), F.lit(0).cast("long").alias("n_links"), none.alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(unnamed)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; same columns.

    Rows without doc_id stay, and so does one row of each text without words.
    Rows that share a doc_id with unlike texts are documents of their own.
    """
    kept = stage(linked_rows(docs).where(F.struct("doc_id", "version") == F.col("first")).select("doc_id", "version").distinct(), "kept")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    named = docs.where(F.col("doc_id").isNotNull()).select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"))
    named = named.join(kept, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    return named.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """Links and group of every document."""
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
