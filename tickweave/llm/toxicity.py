"""Toxicity by weak supervision.

Terms that mark labelled toxic text become lexicon voters, and patterns over
them more voters. A generative label model is fitted on the votes of all
documents: every voter's firing rates in the classes, and for voters that
repeat each other the rates given the vote of the one they hang on. A linear
classifier is trained on the model's posterior labels and scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import hide_null, show_null, stage, table
from tickweave.llm.training import fit_logistic, held_out, sigmoid, training_labels

FOLDS, FOLD = 3, 1
#: Labelled rows of each class that terms are mined from and the classifier is fitted on.
TRAIN_ROWS = 6000
#: A term tells something from so many toxic texts, log odds and likelihood ratio statistic on (2.71: one chance in ten).
MIN_SEEN, MIN_ODDS, TELLING_G = 3, 0.5, 2.71
#: Terms that vote on their own, best first; votes and PATTERNS share a 64-bit number. The others count through the patterns.
TERM_VOTERS = 56
PREFIXES = (5, 6, 7, 8)
#: Likelihood ratio statistic and log odds from which a term belongs to the lexicon.
STRONG_G, STRONG_ODDS = 30.0, 1.5
#: Labelled sightings that the label model's starting rates are worth.
PRIOR_ROWS = 500.0
ROUNDS = 5
#: No rate is nearer to 0 or 1.
LEAST = 1e-4

WORD = re.compile(r"[^\W\d_]{3,}")
PATTERNS = 7


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms_in(words: Column) -> Column:
    """Distinct terms of a text's words: whole words and, with ~, the beginnings of longer ones."""
    return F.array_distinct(F.concat(words, *[F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("~"))) for k in PREFIXES]))


def least_hash(words: list[str]) -> int:
    """MinHash of a text's word triples: near copies mostly share it, others hardly ever."""
    triples = map(" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [" ".join(words)]
    return min(map(xxhash.xxh3_64_intdigest, triples)) - (1 << 63)


def mine_terms(sample: DataFrame) -> pd.DataFrame:
    """``term, n1, n0, g, odds`` of all telling terms, best first; ``sample`` has ``doc_id, text, y``.

    Of near copies in the sample one speaks, that with the smallest id, so a
    much-copied text does not make its words a lexicon. The sample is bounded,
    and so are its terms.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words_of(text) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "copy": [least_hash(w) for w in found], "words": [sorted(set(w)) for w in found]})

    speaker = F.min_by("words", F.struct("doc_id", F.xxhash64("words")))
    single = sample.select("doc_id", "text", "y").mapInPandas(cut, "doc_id long, y int, copy long, words array<string>").groupBy("y", "copy").agg(speaker.alias("words"))
    single = stage(single, "toxic-sample")
    sizes = {r["y"]: r["count"] for r in single.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return pd.DataFrame(columns=["term", "n1", "n0", "g", "odds"])
    terms = single.select("y", F.explode(terms_in(F.col("words"))).alias("term")).groupBy("term").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    both = F.col("n1") + F.col("n0")
    g = 2 * (F.col("n1") * F.log(F.col("n1") * (n1 + n0) / (both * n1)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") * (n1 + n0) / (both * n0))).otherwise(0.0))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    told = terms.where(F.col("n1") >= MIN_SEEN).withColumn("g", g).withColumn("odds", odds).where((F.col("odds") > MIN_ODDS) & (F.col("g") >= TELLING_G))
    return told.orderBy(F.desc("g"), "term").toPandas()


def pick_voters(terms: pd.DataFrame) -> list[int]:
    """The best terms, each stem once."""
    chosen: list[int] = []
    stems: list[str] = []
    for at, (term, g, odds) in enumerate(zip(terms["term"], terms["g"], terms["odds"])):
        stem = term.rstrip("~")
        if g >= STRONG_G and odds >= STRONG_ODDS and not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            chosen.append(at)
            stems.append(stem)
            if len(chosen) == TERM_VOTERS:
                break
    return chosen


class Featurizer:
    """Term hits, votes and a few measures of a text."""

    def __init__(self, terms: pd.DataFrame):
        self.index = {term: at for at, term in enumerate(terms["term"])}
        self.strong = {t for t, g, o in zip(terms["term"], terms["g"], terms["odds"]) if g >= STRONG_G and o >= STRONG_ODDS}
        self.voter = {at: bit for bit, at in enumerate(pick_voters(terms))}
        self.n_votes = len(self.voter) + PATTERNS

    def __call__(self, text: str | None) -> tuple[int, list[int], list[float]]:
        words = words_of(text)
        counted = Counter(words)
        hits, strong, strong_words = [], 0, set()
        for word, n in counted.items():
            found = [word, *(word[:k] + "~" for k in PREFIXES if len(word) > k)]
            hits += [self.index[t] for t in found if t in self.index]
            if any(t in self.strong for t in found):
                strong += n
                strong_words.add(word)
        share = strong / len(words) if words else 0.0
        upper = sum(map(str.isupper, text)) / len(text) if text else 0.0
        marks = text.count("!") / len(words) if words else 0.0
        patterns = (strong >= 1, strong >= 2, strong >= 4, len(strong_words) >= 2, share > 0.005, share > 0.02, upper > 0.5 and marks > 0.1)
        votes = 0
        for at in set(hits):
            if at in self.voter:
                votes |= 1 << self.voter[at]
        for k, fired in enumerate(patterns):
            votes |= bool(fired) << (len(self.voter) + k)
        return votes, sorted(set(hits)), [float(strong >= 1), min(np.log1p(strong), 4.0), min(np.log1p(len(strong_words)), 4.0), min(50 * share, 2.0)]


def bits(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(n, dtype=np.int64)) & 1).astype(np.float64)


class LabelModel:
    """How lexicon and pattern voters fire on clean and on toxic text.

    A voter's accuracy is its firing rate in each class. Voters repeat each
    other, so every voter but one depends on a second one: the tree over all
    voters that holds the most mutual information inside the classes, with the
    voter's rate in each class for either vote of the one it depends on.
    ``pairs`` (2, n, n) are the rates at which two voters fire together.
    """

    def __init__(self, pairs: np.ndarray, prior: float):
        n = pairs.shape[1]
        self.prior = prior
        rate = np.stack([np.diag(p) for p in pairs]).clip(LEAST, 1 - LEAST)
        one, other = rate[:, :, None], rate[:, None, :]
        # (2, n, n) each: both fire, the first alone, the second alone, neither
        both = np.clip(pairs, np.maximum(0, one + other - 1) + LEAST**2, np.minimum(one, other) - LEAST**2)
        cells = [(both, one * other), (one - both, one * (1 - other)), (other - both, (1 - one) * other), (1 - one - other + both, (1 - one) * (1 - other))]
        shared = sum(np.maximum(p, LEAST**2) * np.log(np.maximum(p, LEAST**2) / q) for p, q in cells)
        self.parent = widest_tree((1 - prior) * shared[0] + prior * shared[1])
        at, up = np.arange(n), self.parent
        joint, above = both[:, at, up], rate[:, up]
        root = at == up
        # (2 classes, vote of the parent, n)
        self.rates = np.stack([np.where(root, rate, (rate - joint) / (1 - above)), np.where(root, rate, joint / above)], axis=1).clip(LEAST, 1 - LEAST)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """P(toxic) of votes (rows, n) of 0 and 1."""
        above = fired[:, self.parent] > 0
        logit = np.full(len(fired), np.log(self.prior / (1 - self.prior)))
        for y, side in ((1, 1), (0, -1)):
            rate = np.where(above, self.rates[y, 1], self.rates[y, 0])
            logit += side * np.log(np.where(fired > 0, rate, 1 - rate)).sum(axis=1)
        return sigmoid(logit)


def widest_tree(shared: np.ndarray) -> np.ndarray:
    """Parent of every node in the spanning tree of the largest sum of ``shared``; the root, node 0, is its own."""
    n = len(shared)
    parent, best = np.zeros(n, dtype=np.int64), np.array(shared[0], dtype=float)
    left = np.arange(n) > 0
    while left.any():
        at = int(np.where(left, best, -np.inf).argmax())
        left[at] = False
        closer = left & (shared[at] > best)
        parent[closer], best[closer] = at, shared[at][closer]
    return parent


def pair_sums(fired: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(n + 1, n): weighted sightings of two voters firing together, and the weight of all rows."""
    return np.vstack([(fired * weight[:, None]).T @ fired, np.full(fired.shape[1], weight.sum())])


def fit_label_model(patterns: DataFrame, sample_votes: np.ndarray, sample_y: np.ndarray, n: int, prior: float) -> LabelModel:
    """EM over the vote patterns of all documents.

    ``patterns`` has ``votes, n``. Every round is one Spark job that returns
    sums of at most 2 n (n + 1) numbers a task. The first rates are those on
    the labelled sample and stay in as PRIOR_ROWS sightings.
    """
    seen = bits(sample_votes, n)
    start = np.stack([(pair_sums(seen[sample_y == y], np.ones((sample_y == y).sum()))[:n] + 0.5 * np.eye(n)) / ((sample_y == y).sum() + 1) for y in (0, 1)])
    model = LabelModel(start, prior)
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, n + 1, n))
            for batch in batches:
                fired, count = bits(batch["votes"].to_numpy(), n), batch["n"].to_numpy()
                p = model.posterior(fired)
                total += np.stack([pair_sums(fired, (1 - p) * count), pair_sums(fired, p * count)])
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        sums = patterns.mapInPandas(expect, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros(2 * (n + 1) * n)
        total[sums["at"]] = sums["v"]
        total = total.reshape(2, n + 1, n)
        rows = total[:, n, 0]
        if rows.min() <= 0:
            break
        share = float(np.clip(rows[1] / rows.sum(), model.prior / 2, min(2 * model.prior, 0.5)))
        model = LabelModel((total[:, :n] + PRIOR_ROWS * start) / (rows + PRIOR_ROWS)[:, None, None], share)
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text``).

    Held-out rows' labels are not used. Empty and null texts get the score of a
    text without any term; without labels of both classes every score is 0.
    Repeated rows each get their score; other columns are not read.
    """
    doc_id = show_null(F.col("doc_id"))
    fold = held_out(doc_id, FOLDS, FOLD).alias("held_out")
    own = docs.select(hide_null(F.col("doc_id")).alias("doc_id"), "text")
    chosen = stage(training_labels(labels, "toxic", FOLDS, FOLD, TRAIN_ROWS), "toxic-labels")
    known = F.broadcast(chosen)  # at most 2 TRAIN_ROWS rows
    terms = mine_terms(own.join(known, "doc_id"))
    if terms.empty:
        return own.select(doc_id.alias("doc_id"), fold, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    make = own.sparkSession.sparkContext.broadcast(Featurizer(terms))
    n = make.value.n_votes

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [make.value(text) for text in batch["text"]]
            out = pd.DataFrame(got, columns=["votes", "hits", "measures"])
            yield out.assign(doc_id=batch["doc_id"])

    features = stage(own.mapInPandas(featurize, "doc_id long, votes long, hits array<int>, measures array<double>"), "toxic-features")
    rate = labels.where(~held_out(F.col("doc_id"), FOLDS, FOLD)).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.1
    # of rows that share an id one is fitted, always the same
    one = F.min(F.struct("hits", "votes", "measures")).alias("one")
    fit = features.join(known, "doc_id").groupBy("doc_id", "y").agg(one).select("doc_id", "y", "one.*").orderBy("doc_id").toPandas()
    patterns = stage(features.groupBy("votes").agg(F.count("*").alias("n")), "vote-patterns")
    votes, y = fit["votes"].to_numpy(), fit["y"].to_numpy()
    soft = fit_label_model(patterns, votes, y, n, float(np.clip(rate, 0.001, 0.5))).posterior(bits(votes, n))
    lengths = fit["hits"].map(len).to_numpy()
    row = np.repeat(np.arange(len(fit)), lengths)
    column = np.concatenate([*fit["hits"], np.empty(0)]).astype(np.int64)
    # the sample has more toxic rows than the corpus: each class weighs what it does there
    share = np.where(y == 1, rate / max((y == 1).mean(), 1e-9), (1 - rate) / max((y == 0).mean(), 1e-9))
    sparse, dense, bias = fit_logistic(row, column, np.array(fit["measures"].tolist()), len(terms), soft, share, 1e-5)
    model = own.sparkSession.sparkContext.broadcast((sparse, dense, bias))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sparse, dense, bias = model.value
        for batch in batches:
            logit = [sparse[np.asarray(h, dtype=np.int64)].sum() + np.dot(m, dense) + bias for h, m in zip(batch["hits"], batch["measures"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": sigmoid(np.array(logit, dtype=float))})

    scored = features.select("doc_id", "hits", "measures").mapInPandas(score, "doc_id long, score double")
    return scored.select(doc_id.alias("doc_id"), fold, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
