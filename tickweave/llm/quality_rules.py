"""Quality rules: counts over whole texts and a likelihood ratio of hashed n-grams.

Words and word pairs are hashed. Two multinomials are counted over the hashes:
one of trusted documents (label quality 1), one of the whole raw corpus. A
document's score is the mean log ratio of its n-grams, so length does not
count; a document passes at ``THRESHOLD`` or above. The same corpus and labels
always give the same verdicts.

PRIOR and THRESHOLD are absolute, so n-grams must not share a count, whatever
the size of the corpus. The HOT most frequent n-grams, about half of all
occurrences, are counted in a table that every task holds, and weighed where
the text is. All others are dealt by their hash to parts of about ``PART``
n-grams with 2^32 hashes each; a part counts its n-grams and returns the counts
to their documents. Which n-grams are hot is guessed from a few texts and
changes no count and no score, only what is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.blocks import groups
from tickweave.llm.common import hide_null, lean, show_null, stage, table
from tickweave.llm.ngram_join import mix64

#: N-grams that every task holds, and rows in which they are looked for.
HOT, HOT_ROWS = 1 << 18, 5000
#: Hot n-grams whose counts travel together.
CHUNK = 1 << 14
#: N-grams that one part counts at a time.
PART = 1_000_000
#: Parts at least, so that small corpora are counted by many tasks as well.
PARTS = 32
#: N-grams that a task gathers before it deals them.
HELD = 1_000_000
#: Labelled rows (16 bytes each) that are broadcast to the texts; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Occurrences that each n-gram is given on both sides, so that a few sightings of a rare one say little.
PRIOR = 5.0
#: A mean log ratio below this is nearer to the raw corpus than to the trusted text.
THRESHOLD = -0.1

#: Texts whose n-grams a task holds at a time.
SLICE = 500

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
BASE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def split_words(text: str) -> list[bytes]:
    """Words as UTF-8: bytes.split() parts at exactly the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split()


def ngram_keys(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word, then of every pair of neighbours."""
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    two = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.concatenate([one, two])


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    inside = bytearray(len(words))
    for at, window in enumerate(windows):
        before = first.setdefault(window, at)
        if before != at:
            inside[at : at + 3] = b"\1\1\1"
            inside[before : before + 3] = b"\1\1\1"
    return sum(inside)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        repeated_lines(text),
        repeated_words(words),
    )


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (by row_hash), ``trusted`` and ``text`` of every document; all rows labelled good are trusted."""
    named = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = stage(named.withColumn("trusted", F.lit(True)), "trusted")
    if good.count() <= MOST_BROADCAST:
        good = F.broadcast(good)
    rows = docs.select(hide_null(F.col("doc_id")).alias("doc_id"), row_hash().alias("row"), "text").join(good, "doc_id", "left")
    return rows.select("row", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """SLICE rows at a time with the hashes of their texts' n-grams."""
    for batch in batches:
        for begin in range(0, len(batch), SLICE):
            part = batch.iloc[begin : begin + SLICE]
            yield part, [ngram_keys(split_words(text or "")) for text in part["text"]]


def hot_keys(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the HOT most frequent n-grams of about HOT_ROWS rows, which a hash of the row chooses."""
    share = HOT_ROWS / max(rows.count(), 1)
    some = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "row"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, found in slices(batches):
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"key": keys.view(np.int64), "n": n})

    sums = some.mapInPandas(lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = sums.where("n > 1").orderBy(F.desc("n"), "key").limit(HOT).select("key")
    return np.sort(top.toArrow().column("key").to_numpy().view(np.uint64))


def among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


class Counts(NamedTuple):
    """Hot n-grams with their raw and trusted counts, and the counts of all n-grams, hot or not."""

    keys: np.ndarray
    raw: np.ndarray
    good: np.ndarray
    total_raw: float
    total_good: float

    def adds(self, own: np.ndarray, raw: np.ndarray, good: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """What n-grams add to the sum of log (trusted count / count that the raw corpus lets expect) of their document.

        ``own`` of the ``raw`` sightings are the document's; they are taken out
        first, else a text would speak against itself by being in the corpus.
        """
        with np.errstate(divide="ignore", invalid="ignore"):
            expected = (raw - own) * (self.total_good / (self.total_raw - length))
            return np.where(self.total_raw > length, own * (np.log(good + PRIOR) - np.log(expected + PRIOR)), 0.0)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed in the narrowest type that holds them, whose letter stands first."""
    kind = np.min_scalar_type(numbers.max(initial=0))
    return kind.char.encode() + zlib.compress(numbers.astype(kind).tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), data[:1].decode()).astype(np.int64)


def count_hot(rows: DataFrame) -> Counts:
    """Counts over all rows: a task sends the counts of the hot n-grams, and only their sums come to the driver."""
    hot = hot_keys(rows)
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        # all n-grams in the last column
        total = np.zeros((2, len(known) + 1), dtype=np.int64)
        for part, found in slices(batches):
            keys = np.concatenate(found)
            trusted = np.repeat(part["trusted"].to_numpy(), [len(f) for f in found])
            hit, at = among(keys, known)
            for side, here in enumerate((hit, hit & trusted)):
                total[side, :-1] += np.bincount(at[here], minlength=len(known))
            total[:, -1] += len(keys), trusted.sum()
        for begin in range(0, total.shape[1], CHUNK):
            raw, good = total[:, begin : begin + CHUNK]
            yield pd.DataFrame({"begin": [begin], "raw": [pack(raw)], "good": [pack(good)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for begin, raw, good in zip(batch["begin"], batch["raw"], batch["good"]):
                sums[begin] = sums.get(begin, 0) + np.stack([unpack(raw), unpack(good)])
        for begin, (raw, good) in sums.items():
            yield pd.DataFrame({"begin": [begin], "raw": [pack(raw)], "good": [pack(good)]})

    form = "begin long, raw binary, good binary"
    sums = rows.mapInPandas(lean(count), form).repartition("begin").mapInPandas(lean(add), form).toPandas().sort_values("begin")
    none = np.zeros(len(hot) + 1, dtype=np.int64)
    raw, good = (np.concatenate([unpack(x) for x in sums[c]]).astype(float) if len(sums) else none for c in ("raw", "good"))
    return Counts(hot, raw[:-1], good[:-1], float(raw[-1]), float(good[-1]))


DEALT = "part long, batch long, n_docs long, n_trusted long, keys binary, doc binary, own binary, row binary, length binary, sums binary"
COUNTED = "batch long, doc binary, own binary, others binary, good binary, row binary, length binary, sums binary"


def deal(parts: int, shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Weighs the hot n-grams of a batch of documents and cuts the others, each once a document with its count, by their hash into ``parts``.

    One more record holds the documents' row hashes and what their hot n-grams
    add up to. Trusted documents come first, so their number tells which they are.
    """

    def cut(texts: list[tuple], batch: int) -> pd.DataFrame:
        texts.sort(key=lambda x: not x[1])
        sizes = [len(keys) for _, _, keys, *_ in texts]
        doc, length = np.repeat(np.arange(len(texts)), sizes), np.array([x[4] for x in texts], dtype=np.int64)
        keys, own = np.concatenate([x[2] for x in texts]), np.concatenate([x[3] for x in texts])
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        known = (batch, len(texts), sum(x[1] for x in texts))
        sums = np.array([x[5] for x in texts], dtype="<f8").tobytes()
        out = [(batch % parts, *known, None, None, None, np.array([x[0] for x in texts], dtype="<i8").tobytes(), pack(length), sums)]
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            # the hash within its part, spread over 32 bits
            low = (keys[at] & np.uint64(0xFFFFFFFF)).astype("<u4")
            out.append((int(p), *known, low.tobytes(), pack(np.diff(doc[at], prepend=0)), pack(own[at]), None, None, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DEALT.split(", ")])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        texts, held, n = [], 0, 0
        first = TaskContext.get().partitionId() << 32
        for frame in batches:
            for row, trusted, text in zip(frame["row"], frame["trusted"], frame["text"]):
                found = ngram_keys(split_words(text or ""))
                if len(found):
                    keys, own = np.unique(found, return_counts=True)
                    hit, at = among(keys, counts.keys)
                    at = at[hit]
                    known = counts.adds(own[hit], counts.raw[at], counts.good[at], len(found)).sum()
                    texts.append((row, bool(trusted), keys[~hit], own[~hit], len(found), known))
                    held += len(texts[-1][2])
                if held >= HELD:
                    yield cut(texts, first + n)
                    texts, held, n = [], 0, n + 1
        if texts:
            yield cut(texts, first + n)

    return apply


def count_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts the n-grams of each part and sends every document the counts of its own: sightings in other documents, and trusted ones.

    An n-gram that stands in no other document and in no trusted one adds nothing and stays.
    """
    for frame in groups(batches, ["part"]):
        names = frame[frame["row"].notna()]
        if len(names):
            yield names.reindex(columns=[c.split()[0] for c in COUNTED.split(", ")])
        pieces = frame[frame["row"].isna()]
        if len(pieces):
            keys = np.concatenate([np.frombuffer(x, "<u4") for x in pieces["keys"]])
            docs = [np.cumsum(unpack(x)) for x in pieces["doc"]]
            own = np.concatenate([unpack(x) for x in pieces["own"]])
            trusted = np.concatenate([doc < n for doc, n in zip(docs, pieces["n_trusted"])])
            _, at = np.unique(keys, return_inverse=True)
            others = np.bincount(at, own)[at].astype(np.int64) - own
            good = np.bincount(at, own * trusted)[at].astype(np.int64)
            begin = 0
            for batch, doc in zip(pieces["batch"], docs):
                here = slice(begin, begin + len(doc))
                begin += len(doc)
                told = (others[here] > 0) | (good[here] > 0)
                back = [pack(np.diff(doc[told], prepend=0)), *(pack(x[here][told]) for x in (own, others, good))]
                yield pd.DataFrame([(batch, *back, None, None, None)], columns=[c.split()[0] for c in COUNTED.split(", ")])


def add_up(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Score of every row hash of a batch from its hot n-grams' sums and the counts of the others."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(batches, ["batch"]):
            named = frame[frame["row"].notna()].iloc[0]
            length, total = unpack(named["length"]), np.frombuffer(named["sums"], "<f8").copy()
            for piece in frame[frame["row"].isna()].itertuples():
                doc, own, others, good = np.cumsum(unpack(piece.doc)), *(unpack(x) for x in (piece.own, piece.others, piece.good))
                total += np.bincount(doc, shared.value.adds(own, own + others, good, length[doc]), minlength=len(total))
            yield pd.DataFrame({"row": np.frombuffer(named["row"], "<i8"), "score": total / length})

    return apply


def row_hash() -> Column:
    """Stands for an id with its text, so that rows that share an id keep their own verdict."""
    return F.xxhash64("doc_id", "text")


def text_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (by row_hash) and ``score``, once each; texts without words may be absent and score 0, as all do without trusted text."""
    rows = with_trust(docs, labels)
    counts = count_hot(rows)
    if not counts.total_good:
        return docs.sparkSession.createDataFrame([], "row long, score double")
    parts = max(PARTS, math.ceil((counts.total_raw - counts.raw.sum()) / PART))
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    dealt = rows.mapInPandas(lean(deal(parts, shared)), DEALT).repartition("part").sortWithinPartitions("part")
    counted = dealt.mapInPandas(lean(count_part), COUNTED).repartition("batch").sortWithinPartitions("batch")
    return stage(counted.mapInPandas(lean(add_up(shared)), "row long, score double").groupBy("row").agg(F.min("score").alias("score")), "scores")


def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [base_counts(text or "", split_words(text or "")) for text in batch["text"]]
        yield pd.concat([batch[["doc_id", "row"]].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in BASE_COLUMNS.split(", ")])], axis=1)


def judged_rows(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, row``, the base counts, ``base_failed``, ``score`` and ``kept``; NO_ID for a null id."""
    own = docs.select(hide_null(F.col("doc_id")).alias("doc_id"), row_hash().alias("row"), "text")
    based = own.mapInPandas(lean(judge), f"doc_id long, row long, {BASE_COLUMNS}").join(text_scores(docs, labels), "row", "left")
    judged = based.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` (double) and ``kept`` of every row of ``docs`` (``doc_id, text``).

    A null or empty text has no words and fails; repeated rows are judged each
    time; a null doc_id stays null; an empty table gives an empty result. Texts
    of any length are read whole, other columns not at all.
    """
    judged = judged_rows(docs, labels, threshold)
    return judged.select(show_null(F.col("doc_id")).alias("doc_id"), *[c.split()[0] for c in BASE_COLUMNS.split(", ")], "base_failed", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns as they are."""
    kept = stage(judged_rows(docs, labels, threshold).where("kept").select("row").distinct(), "kept")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_hash().alias("row"))
    return named.join(kept, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Verdict on every document."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
