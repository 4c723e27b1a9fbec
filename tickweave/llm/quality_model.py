"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Every passage is encoded by
fixed hashed features: the shapes and the words in it, and a few measures.
Labels belong to documents only, so the model learns which passages matter: a
gated attention net weighs the passages, and a linear layer scores their
weighted mean.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import hide_null, show_null, stage, table
from tickweave.llm.training import Adam, held_out, sigmoid, training_labels

FOLDS, FOLD = 4, 2
#: Labelled rows of each class that the model is fitted on, with all their passages.
TRAIN_ROWS = 3000
PASSAGE = 128
SHAPES, WORDS, MEASURES = 64, 32, 8
WIDTH = SHAPES + WORDS + MEASURES
HIDDEN, EPOCHS, RATE, RIDGE = 12, 250, 0.02, 1e-4

LETTERS = bytes(
    ord("a") if chr(b).islower() or b >= 0x80 else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b for b in range(256)
)
RUN = re.compile(rb"([a-zA-Z0])\1+")


def encode(text: str | None) -> np.ndarray:
    """Features of every passage, (passages, WIDTH); a text without words is one passage of zeros.

    The shape of a word keeps its punctuation and collapses runs of lower-case
    letters, capitals and digits. Passages are counted by histograms over all
    words at once.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return np.zeros((1, WIDTH), dtype=np.float32)
    n = len(words)
    shapes = RUN.sub(rb"\1", raw.translate(LETTERS)).split()
    passage = np.arange(n) // PASSAGE
    count = int(passage[-1]) + 1
    size = np.bincount(passage, minlength=count).astype(np.float64)
    shape = np.fromiter(map(zlib.crc32, shapes), dtype=np.int64, count=n) % SHAPES
    code = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=n)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    shape_share = np.bincount(passage * SHAPES + shape, minlength=count * SHAPES).reshape(count, SHAPES) / size[:, None]
    sign = np.where(code & 1024, 1.0, -1.0)
    word_share = np.bincount(passage * WORDS + code % WORDS, sign, minlength=count * WORDS).reshape(count, WORDS) / size[:, None]
    # words whose pair with the next word has come before in the text, and new words
    pair = code[:-1] * 4294967296 + code[1:] if n > 1 else np.empty(0, dtype=np.int64)
    _, first = np.unique(pair, return_index=True)
    repeat = np.ones(n)
    repeat[first] = 0
    repeat[-1] = 0
    _, first = np.unique(code, return_index=True)
    fresh = np.zeros(n)
    fresh[first] = 1

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, minlength=count) / size

    measures = np.stack(
        [
            mean(repeat),
            mean(fresh),
            mean(lengths) / 10,
            mean(lengths > 20),
            np.full(count, raw.count(b"\n") / n),
            size / PASSAGE,
            np.full(count, np.log1p(n) / 10),
            np.full(count, float(n < 50)),
        ],
        axis=1,
    )
    return np.concatenate([4 * shape_share, 2 * word_share, measures], axis=1).astype(np.float32)


class AttentionModel:
    """Gated attention over passages and a linear score of their weighted mean."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 3):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.params = [draw.normal(0, 0.1, (width, hidden)), draw.normal(0, 0.1, (width, hidden)), draw.normal(0, 0.1, hidden), np.zeros(width), np.zeros(1)]

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        """``begin``: first passage of every bag."""
        v, u, w, c, b = self.params
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        h, g = np.tanh(x @ v), sigmoid(x @ u)
        energy = (h * g) @ w
        energy = np.exp(energy - np.maximum.reduceat(energy, begin)[bag])
        attention = energy / np.add.reduceat(energy, begin)[bag]
        pooled = np.add.reduceat(attention[:, None] * x, begin, axis=0)
        return bag, h, g, attention, pooled, pooled @ c + b[0]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> AttentionModel:
        x = np.concatenate(bags).astype(np.float64)
        begin = np.concatenate([[0], np.cumsum([len(bag) for bag in bags])[:-1]])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        x = (x - self.mean) / self.scale
        weight = weight / weight.sum()
        optimizer = Adam(self.params, RATE)
        for _ in range(EPOCHS):
            v, u, w, c, b = self.params
            bag, h, g, attention, pooled, logit = self.forward(x, begin)
            error = (sigmoid(logit) - y) * weight
            through = x @ c
            # d logit / d energy of a passage: its attention times how far its own score is from the bag's
            energy = error[bag] * attention * (through - (pooled @ c)[bag])
            gate = energy[:, None] * w
            grads = [x.T @ (gate * g * (1 - h * h)), x.T @ (gate * h * g * (1 - g)), (h * g).T @ energy, pooled.T @ error, np.array([error.sum()])]
            optimizer.step([grad + RIDGE * param for grad, param in zip(grads, self.params)])
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate(bags).astype(np.float64) - self.mean) / self.scale
        begin = np.concatenate([[0], np.cumsum([len(bag) for bag in bags])[:-1]])
        return sigmoid(self.forward(x, begin)[-1])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text``).

    Every passage of a whole text is encoded and weighed. Held-out rows' labels
    are not used. Empty and null texts are scored as a passage without words;
    without labels of both classes every score is their share of good rows, or
    0 if there are none. Repeated rows each get their score; other columns are
    not read.
    """
    doc_id = show_null(F.col("doc_id"))
    fold = held_out(doc_id, FOLDS, FOLD).alias("held_out")
    own = docs.select(hide_null(F.col("doc_id")).alias("doc_id"), "text")
    chosen = stage(training_labels(labels, "quality", FOLDS, FOLD, TRAIN_ROWS), "quality-labels")
    rate = labels.where(~held_out(F.col("doc_id"), FOLDS, FOLD)).agg(F.avg(F.col("quality").cast("double"))).first()[0]

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [encode(text) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "bag": [bag.tobytes() for bag in bags]})

    # at most 2 TRAIN_ROWS rows; of rows that share an id one is fitted, always the same
    known = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    fit = stage(known.mapInPandas(sample, "doc_id long, y int, bag binary"), "quality-sample").orderBy("doc_id").toPandas()
    y = fit["y"].to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return own.select(doc_id.alias("doc_id"), fold, F.lit(float(rate or 0.0)).alias("score"), F.lit(int((rate or 0.0) >= 0.7)).alias("predicted"))
    bags = [np.frombuffer(bag, dtype=np.float32).reshape(-1, WIDTH) for bag in fit["bag"]]
    # the sample's classes weigh what they do among all labels
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    model = own.sparkSession.sparkContext.broadcast(AttentionModel().fit(bags, y, weight))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.iloc[begin : begin + 256]
                scores = model.value.score([encode(text) for text in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": scores})

    scored = own.mapInPandas(score, "doc_id long, score double")
    return scored.select(doc_id.alias("doc_id"), fold, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
