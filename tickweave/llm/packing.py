"""Packing documents into fixed-length sequences along a Hilbert curve.

Documents are tokenized whole, their hashed token counts projected to a few
dimensions, and the Hilbert key of that point range-sorts them, so neighbours
in a sequence are alike. The sorted documents form one stream of ids that is
cut every ``LENGTH`` ids: only the last sequence has padding.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.llm.common import hide_null, lean, show_null, stage, table

LENGTH = 4096
END_ID = 2
DIMENSIONS, BITS = 4, 10
BUCKETS = 1024
#: Bytes of words and their ids that a Python worker remembers, and what a remembered word costs besides.
REMEMBERED, ENTRY = 64 << 20, 170
#: Words that are encoded at once: encodings take far more room than their ids.
AT_ONCE = 1000

_random = np.random.Generator(np.random.PCG64(7))
PROJECTION = _random.choice(np.array([-1.0, 1.0]), size=(BUCKETS, DIMENSIONS))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known(dict):
    """Ids by word: the remembered words, and ``fresh`` ones that are looked up here for one call only."""

    fresh: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        return self.fresh[word]


class WordTokenizer:
    """Ids of whole texts by way of their words.

    For tokenizers that drop white space and never join two words: a text's
    ids are those of its words in order, and each distinct word is encoded
    once. Words part only where the tokenizer always parts: at ASCII white
    space, and between a letter and a mark of MARKS. If it lower-cases, so do
    we first, which makes more words equal; texts that may name a special
    token are left as they are.
    """

    MARKS = re.compile(rb"[.,;:!?*%$#&](?<=[A-Za-z].)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        first = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if not (first.get("behavior") == "Removed" and first.get("invert")):
            raise ValueError("the tokenizer must drop white space")
        self.lower = any(x["type"] == "Lowercase" for x in (made["normalizer"] or {}).get("normalizers", []))
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.type = f"<u{array(self.code).itemsize}"
        special = [(t["content"], t["id"]) for t in made.get("added_tokens", []) if t["special"] and t["content"].startswith("<|")]
        self.between = special[-1] if special else None
        self.known, self.held = Known(), 0
        self.met = bytearray(1 << 22)

    def words(self, text: str | None) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if self.lower and b"<|" not in raw:
            raw = raw.lower()
        return self.MARKS.sub(rb" \g<0>", raw).split()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of every word; of all words at once, with a special token between, where none holds one itself."""
        if not self.between or any("<|" in word for word in words):
            return [array(self.code, code.ids).tobytes() for code in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        name, stop = self.between
        ids = np.array(self.tokenizer.encode_batch_fast([name.join(words)], add_special_tokens=False)[0].ids, dtype=self.type)
        ends = [*np.flatnonzero(ids == stop).tolist(), len(ids)]
        raw, size = ids.tobytes(), ids.itemsize
        return [raw[begin * size : end * size] for begin, end in zip([0, *(end + 1 for end in ends)], ends)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.words(text) for text in texts]
        new = list(set().union(*split).difference(self.known))
        fresh = {}
        for begin in range(0, len(new), AT_ONCE):
            part = new[begin : begin + AT_ONCE]
            fresh.update(zip(part, self.encode_words([word.decode("utf-8", "replace") for word in part])))
        if self.held < REMEMBERED:
            for word, ids in fresh.items():
                # a word is remembered when it is met again, as most never are
                place = hash(word) & 0x3FFFFF
                if self.met[place]:
                    self.known[word] = ids
                    self.held += len(word) + len(ids) + ENTRY
                self.met[place] = 1
        self.known.fresh = fresh
        end, known = array(self.code, [END_ID]).tobytes(), self.known.__getitem__
        coded = [np.frombuffer(b"".join(map(known, words)) + end, dtype=self.type) for words in split]
        self.known.fresh = {}
        return coded


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer a Python worker, which remembers REMEMBERED bytes at most from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, d) with coordinates below 2 ** bits."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(len(axes)):
            high = (axes[axis] & bit) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[axis]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0]) ^ swap
            if axis:
                axes[axis] = axes[axis] ^ swap
    for axis in range(1, len(axes)):
        axes[axis] = axes[axis] ^ axes[axis - 1]
    flip = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> level) & 1)
    return key


def curve_point(ids: np.ndarray) -> np.ndarray:
    """Cell of a document: hashed token counts, scaled to length 1, projected, on a grid over [-4, 4)."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS)
    place = (counts / np.sqrt((counts.astype(np.float64) ** 2).sum())) @ PROJECTION
    return np.clip(((place + 4) / 8 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """``row, doc_id, key, doc_tokens, ids``; ``row`` tells rows with an equal doc_id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        tokenizer = tokenizer_at(path)
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.iloc[begin : begin + 1000]
                coded = tokenizer.encode(part["text"].tolist())
                keys = hilbert_keys(np.array([curve_point(ids) for ids in coded]), BITS)
                yield pd.DataFrame(
                    {"row": np.arange(row, row + len(part)), "doc_id": part["doc_id"], "key": keys, "doc_tokens": [len(ids) for ids in coded], "ids": [ids.tobytes() for ids in coded]}
                )
                row += len(part)

    return docs.select(hide_null(F.col("doc_id")).alias("doc_id"), "text").mapInPandas(lean(run), "row long, doc_id long, key long, doc_tokens long, ids binary")


def positions(rows: DataFrame) -> DataFrame:
    """``row, begin``: place of each row's first id in the stream of all rows sorted by key.

    Only keys and lengths are sorted. Equal keys are spread over range
    partitions by a hash, so a group of copies is no hot partition. Sums of
    whole partitions, one row each, give every partition its start.
    """
    tie = F.xxhash64("row")

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + batch["doc_tokens"].cumsum()
            yield pd.DataFrame({"row": batch["row"], "part": part, "begin": ends - batch["doc_tokens"], "doc_tokens": batch["doc_tokens"]})
            total = int(ends.iloc[-1]) if len(ends) else total

    ranged = rows.select("row", "key", "doc_tokens", tie.alias("tie")).repartitionByRange("key", "tie", "row").sortWithinPartitions("key", "tie", "row")
    local = stage(ranged.mapInPandas(lean(running), "row long, part int, begin long, doc_tokens long"), "positions")
    sums = local.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("start"))
    return local.join(F.broadcast(starts), local["part"] == starts["p"]).select("row", (F.col("begin") + F.col("start")).alias("begin"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: the pieces of all rows of ``docs``.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers. A
    null text counts as empty: one piece with the end id alone. Repeated rows
    are packed each time; rows without doc_id are packed with a null doc_id.
    An empty table gives no piece. Other columns are not read.
    """
    rows = stage(tokenize(docs, tokenizer_path or default_tokenizer()), "tokens")
    placed = rows.join(positions(rows), "row").select("doc_id", "doc_tokens", "ids", "begin")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out = []
            for doc_id, n, raw, begin in zip(batch["doc_id"], batch["doc_tokens"], batch["ids"], batch["begin"]):
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}")
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, length)
                    take = min(length - offset, n - at)
                    out.append((doc_id, at, take, ids[at : at + take].astype("<u4").tobytes(), n, sequence, offset))
                    at += take
            yield pd.DataFrame(out, columns=names)

    pieces = placed.mapInPandas(lean(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("doc_id", show_null(F.col("doc_id")))


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, length``: whole sequences, ``LENGTH`` ids each at most, as binary."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def query(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents, their ids as a checksum."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
