"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Everything is learned here: the lexicon from words that mark toxic rows, the trees from features of rows with a
label, the calibration from folds that the trees didn't see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, thinned, written

FOLDS, HELD_OUT = 5, 0
#: The most rows with a label that the fit takes, or a few more: those with small hashes of their ids.
SAMPLE = 20_000
#: A lexicon has at most so many words, each in so many toxic rows of the sample at least.
LEXICON, LEAST = 200, 4
WORD = re.compile(r"[^\W\d_]+")
CHUNK = re.compile(r"\S+")
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú tus su".split())
#: Words away from a second-person one that still count as near.
NEAR = 6
PUNCT = re.compile(r"[^\w\s]")
SHOUT = re.compile(r"[!?]")
RUN = re.compile(r"(.)\1{2,}", re.S)
MIXED = re.compile(r"[^\W\d_][\d@$!*#%&|+]+[^\W\d_]")
LEET = str.maketrans("013457@$!|", "oieastasil")
FEATURES = (
    "log_words", "lexicon_share", "lexicon_hits", "lexicon_kinds", "lexicon_weight", "near_second", "second_share", "first_hit",
    "capitals", "all_caps", "punctuation", "shouts", "runs", "mixed", "hidden_hits", "word_length",
)


def fold(doc_id: Column, n: int = FOLDS) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Dense features of one whole text; an empty one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    words = WORD.findall(text)
    lower = [w.lower() for w in words]
    hits = [i for i, w in enumerate(lower) if w in lexicon]
    you = [i for i, w in enumerate(lower) if w in SECOND]
    n, chars = max(len(words), 1), len(text)
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        near = int(sum(min(abs(h - you[j]) for j in (max(k - 1, 0), min(k, len(you) - 1))) <= NEAR for h, k in zip(hits, at, strict=True)))
    mixed = MIXED.findall(text)
    hidden = sum(w.lower().translate(LEET).strip("*#%&+.,") in lexicon for w in CHUNK.findall(text) if MIXED.search(w)) if mixed else 0
    return [
        np.log1p(len(words)), len(hits) / n, float(len(hits)), float(len({lower[i] for i in hits})), sum(lexicon[lower[i]] for i in hits) / n, near / n, len(you) / n,
        (hits[0] + 1) / n if hits else 2.0, sum(map(str.isupper, text)) / chars, sum(len(w) > 2 and w.isupper() for w in words) / n, len(PUNCT.findall(text)) / chars,
        len(SHOUT.findall(text)) / n, len(RUN.findall(text)) / n, len(mixed) / n, float(hidden), sum(map(len, words)) / n,
    ]


class Trees:
    """Boosted regression trees on the logistic loss, over quantile bins of each feature."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = n_trees, depth, rate, bins, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, p = self._binned(x), min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        raw = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            q = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, y - q, q * (1 - q))
            self.trees.append(tree)
            raw += self._leaves(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Heap order: feature (-1: leaf), bin (at most: left), value."""
        n = 2 ** (self.depth + 1)
        feature, cut, value, node = np.full(n, -1), np.zeros(n, int), np.zeros(n), np.ones(len(g), int)
        for at in range(1, n):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = self.rate * gs / (hs + 1)
            if at >= n // 2:
                continue
            best, where = 1e-6, None
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], self.bins + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], self.bins + 1))[:-1]
                gain = np.where((hl >= self.least) & (hs - hl >= self.least), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                if gain.max() > best:
                    best, where = gain.max(), (j, int(gain.argmax()))
            if where:
                feature[at], cut[at] = where
                node[rows] = 2 * at + (b[rows, where[0]] > where[1])
        return feature, cut, value

    def _leaves(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.ones(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + (b[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._leaves(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots of a rising step function, read with linear steps between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([t, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            t1, n1, _, hi = blocks.pop()
            t0, n0, lo, _ = blocks.pop()
            blocks.append([(t0 * n0 + t1 * n1) / (n0 + n1), n0 + n1, lo, hi])
    # A block of n rows is drawn towards one half by one row, so that few rows never give certainty.
    x = np.array([v for b in blocks for v in b[2:]])
    p = np.array([(b[0] * b[1] + 0.5) / (b[1] + 1) for b in blocks for _ in range(2)])
    return x, np.maximum.accumulate(p)


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, batch: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in batch], float).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic: rows of the training folds with a label, about ``size`` at most; a null label is none."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = thinned(written(y.where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "toxic")), size)
    return texts(docs).join(F.broadcast(y), "doc_id")  # about ``size`` rows


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words by the log odds of their share of toxic and other rows; at most ``LEXICON`` reach the driver."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")
    counts = rows.select(word, "toxic").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") >= LEAST)
    total = rows.agg(F.sum("toxic").alias("nt"), F.sum(1 - F.col("toxic")).alias("nc"))
    odds = F.log((F.col("t") + 0.5) / (F.col("nt") + 1)) - F.log((F.col("c") + 0.5) / (F.col("nc") + 1))
    strong = counts.crossJoin(F.broadcast(total)).select("word", "t", odds.alias("odds")).where("odds > 2")  # total: one row
    best = strong.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "word").limit(LEXICON)
    return {r["word"]: float(r["odds"]) for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """The model from at most ``size`` rows; with labels of one kind or none it gives that kind's share."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, size).where("toxic IN (0, 1)").repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism)).persist()
    lexicon = learn_lexicon(rows)
    inner = F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "toxic": b.toxic, "k": b.k, "x": [features(t, lexicon) for t in b.text]})

    got = rows.withColumn("k", inner).mapInPandas(featured, "doc_id long, toxic int, k int, x array<double>").toPandas()  # ``size`` rows of dense numbers
    rows.unpersist()
    got = got.sort_values("doc_id", kind="stable")
    y = got.toxic.to_numpy(float)
    if len(y) < 20 or y.min() == y.max():
        p = float((y.sum() + 0.5 * (len(y) == 0)) / max(len(y), 1))
        trees = Trees()
        trees.edges, trees.trees, trees.base = [np.zeros(0)] * len(FEATURES), [], 0.0
        return Model(lexicon, trees, (np.array([0.0]), np.array([p])))
    x, k = np.array(got.x.tolist()), got.k.to_numpy()
    unseen = np.zeros(len(y))
    for i in range(3):
        if (k == i).any() and (k != i).any():
            unseen[k == i] = Trees().fit(x[k != i], y[k != i]).raw(x[k == i])
    return Model(lexicon, Trees().fit(x, y), isotonic(unseen, y))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text counts as empty; an empty one gets the score of zero features. A null doc_id has held_out null.
    Equal texts get equal scores. No rows give no rows; other columns of ``docs`` are not looked at.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "score": model.score(b.text.tolist())})

    small_batches(docs.sparkSession)
    got = texts(docs).mapInPandas(scored, "doc_id long, score double")
    return got.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, in one pass over the rows."""
    model = fit(docs, labels)
    score = F.pandas_udf(lambda t: pd.Series(model.score(t.fillna("").tolist())), "double")
    return docs.where(score(F.col("text")) < 0.5)
