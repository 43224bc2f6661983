"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A word stands between two blanks, and no context reaches over a blank: so the cost of a text is the sum of its
words' costs, and each distinct word of a batch is looked up once. The lowest cross-entropy for a character wins; how
sure that is comes from a calibration on rows that the models didn't see.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, thinned_each
from .toxicity import fold, isotonic

FOLDS, HELD_OUT = 4, 2
ORDER, DISCOUNT = 5, 0.75
#: The most rows of each language that the fit takes, or a few more: those with small hashes of their ids; and at most so many languages.
SAMPLE, LANGUAGES = 2_000, 200
#: One row in so many of the sample calibrates instead of being counted.
CALIBRATE = 5
#: Words that a Python worker remembers the costs of.
MOST = 200_000
#: Letters whose costs are computed at once.
LETTERS = 200_000
#: A prediction is rejected where its calibrated chance to be right is less.
SURE = 0.8
WORD = re.compile(r"[^\W\d_]+")
NONE = "und"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words(text: str | None) -> list[str]:
    """The runs of letters, in lower case."""
    return WORD.findall((text or "").lower())


def _hashed(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place from n - 1 on."""
    h = np.full(len(points) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ points[k : len(points) - n + 1 + k]) * _ODD[k]
        h ^= h >> np.uint64(29)
    return h


class Grams:
    """All n-grams of orders 1 to ORDER of a list of words, place by place: a row of hashes per predicted character."""

    def __init__(self, batch: list[str]):
        size = np.array([len(w) for w in batch], np.int64)
        joined = "".join(f"{' ' * (ORDER - 1)}{w} " for w in batch)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        starts = np.cumsum(size + ORDER) - (size + ORDER)
        self.word = np.repeat(np.arange(len(batch)), size + 1)
        # Predicted: the characters of each word and the blank behind it.
        inner = np.arange(len(self.word)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
        self.at = np.repeat(starts, size + 1) + ORDER - 1 + inner
        self.n, self.size = len(batch), size + 1
        self.hash = {n: _hashed(points, n)[self.at - n + 1] for n in range(1, ORDER + 1)}
        # The context of the n-gram that ends at a place ends one before it.
        self.context = {n: _hashed(points, n)[self.at - n] for n in range(1, ORDER)}


class KneserNey:
    """Sorted arrays of hashes, and beside them what each n-gram and each context adds, for one language."""

    def __init__(self, counts: Counter, alphabet: int):
        batch = list(counts)
        grams, times = Grams(batch), np.array([counts[w] for w in batch], float)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backoff: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.floor = 1.0 / max(alphabet, 1)
        for n in range(ORDER, 0, -1):
            h = grams.hash[n]
            if n == ORDER:
                keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(inverse, times[grams.word], len(keys))
            else:
                # Lower orders count the distinct characters that come before.
                longer = np.unique(np.stack([grams.hash[n + 1], h]), axis=1)
                keys, c = np.unique(longer[1], return_counts=True)
                c = c.astype(float)
                first = self._first(keys, h)
            context = grams.context[n - 1][first] if n > 1 else np.zeros(len(keys), np.uint64)
            ctx, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, c, len(ctx))
            kinds = np.bincount(which, minlength=len(ctx))
            self.grams[n] = keys, (c - DISCOUNT) / total[which]
            self.backoff[n] = ctx, DISCOUNT * kinds / total

    @staticmethod
    def _first(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h, kind="stable")
        return order[np.searchsorted(h[order], keys)]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full(len(h), missing)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], missing)

    def costs(self, grams: Grams) -> np.ndarray:
        """-log P of each word of the batch, its end included."""
        p = np.full(len(grams.word), self.floor)
        for n in range(1, ORDER + 1):
            weight = self._find(self.backoff[n], grams.context[n - 1] if n > 1 else np.zeros(len(p), np.uint64), 1.0)
            p = self._find(self.grams[n], grams.hash[n], 0.0) + weight * p
        return np.bincount(grams.word, -np.log(p), grams.n)


class Model:
    """The models of all languages, and the calibration of the margin between the best two."""

    def __init__(self, models: dict[str, KneserNey], knots: tuple[np.ndarray, np.ndarray]):
        self.names, self.knots = sorted(models), knots
        self.known: dict[str, np.ndarray] = {}
        # One sorted array of the hashes of all languages, a column for each: a look-up serves them all.
        each = [models[x] for x in self.names]
        self.floor = np.array([m.floor for m in each])
        self.grams = {n: self._joined([m.grams[n] for m in each], 0.0) for n in range(1, ORDER + 1)} if each else {}
        self.backoff = {n: self._joined([m.backoff[n] for m in each], 1.0) for n in range(1, ORDER + 1)} if each else {}

    @staticmethod
    def _joined(tables: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        """The last row is for what no language has."""
        keys = np.unique(np.concatenate([k for k, _ in tables]))
        values = np.full((len(keys) + 1, len(tables)), missing)
        for j, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        keys, values = table
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return values[np.where(keys[at] == h, at, len(keys))]

    def costs(self, grams: Grams) -> np.ndarray:
        """-log P of each word, its end included, for each language: a row per word."""
        p = np.broadcast_to(self.floor, (len(grams.word), len(self.names)))
        for n in range(1, ORDER + 1):
            weight = self._found(self.backoff[n], grams.context[n - 1] if n > 1 else np.zeros(len(p), np.uint64))
            p = self._found(self.grams[n], grams.hash[n]) + weight * p
        starts = np.cumsum(grams.size) - grams.size
        return np.add.reduceat(-np.log(p), starts, axis=0)

    def learn(self, batch: set[str]) -> None:
        if len(self.known) > MOST:
            self.known.clear()
        new = list(batch.difference(self.known)) if self.names else []
        # Scripts without blanks have words as long as a text, so batches go by letters; only a longer word is one alone.
        ends = np.cumsum([len(w) for w in new])
        at = 0
        while at < len(new):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, side="right")))
            grams = Grams(new[at:stop])
            self.known.update(zip(new[at:stop], np.column_stack([self.costs(grams), grams.size]), strict=True))
            at = stop

    def entropies(self, batch: list[str | None]) -> np.ndarray:
        """Cross-entropy per character of each text for each language, NaN without letters."""
        counts = [Counter(words(t)) for t in batch]
        self.learn(set().union(*counts))
        out = np.full((len(batch), len(self.names)), np.nan)
        for k, c in enumerate(counts):
            if c and self.names:
                rows = np.array([self.known[w] for w in c], float)
                total = np.array(list(c.values()), float) @ rows
                out[k] = total[:-1] / total[-1]
        return out

    def predict(self, batch: list[str | None]) -> tuple[list[str], np.ndarray]:
        e = self.entropies(batch)
        if not self.names:
            return [NONE] * len(batch), np.zeros(len(batch))
        none = np.isnan(e).any(1)
        e[none] = 0
        best = e.argmin(1)
        score = np.interp(margin(e), *self.knots)
        return [NONE if x else self.names[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, np.clip(score, 0, 1))


def margin(e: np.ndarray) -> np.ndarray:
    """How much worse the second language is, by character; far more than any text's where there is but one."""
    return np.partition(e, 1, 1)[:, 1] - e.min(1) if e.shape[1] > 1 else np.full(len(e), 10.0)


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, text, lang, part: the rows to learn from, about ``size`` of each of at most LANGUAGES languages."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    return thinned_each(rows, size, "lang", LANGUAGES).withColumn("part", F.pmod(F.shiftright(F.xxhash64("doc_id"), 40), F.lit(CALIBRATE)).cast("int"))


def fit(docs: DataFrame, size: int = SAMPLE) -> Model:
    """Models from at most ``size`` rows of each language; word counts are summed by Spark."""
    small_batches(docs.sparkSession)
    rows = sample(docs, size).repartition(docs.sparkSession.sparkContext.defaultParallelism).persist()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = {x: Counter() for x in b.lang.unique()}
            for x, t in zip(b.lang, b.text, strict=True):
                sums[x].update(words(t))
            yield pd.DataFrame([(x, w, n) for x, c in sums.items() for w, n in c.items()], columns=["lang", "word", "n"])

    counts = rows.where("part > 0").mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by: dict[str, Counter] = {}
    for r in counts.toLocalIterator():  # the words of a bounded sample, a partition at a time
        by.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    alphabet = len({c for x in by.values() for w in x for c in w}) + 1
    model = Model({x: KneserNey(c, alphabet) for x, c in by.items()}, (np.array([0.0]), np.array([1.0])))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = model.entropies(b.text.tolist())
            ok = ~np.isnan(e).any(1)
            right = np.array(model.names)[np.nan_to_num(e).argmin(1)] == b.lang.to_numpy() if model.names else np.zeros(len(b), bool)
            yield pd.DataFrame({"m": margin(np.nan_to_num(e))[ok], "right": right[ok].astype(float)})

    if model.names:
        seen = rows.where("part = 0").mapInPandas(judged, "m double, right double").toPandas().sort_values(["m", "right"], kind="stable")
        if len(seen):
            model.knots = isotonic(seen.m.to_numpy(), seen.right.to_numpy())
    rows.unpersist()
    return model


def predict_language(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    A null text and one without a letter are ``und`` with score 0. Of equal entropies the language that sorts first
    wins. score is the calibrated chance that the prediction is right; under ``sure`` the prediction is rejected, and ``und`` is always.
    Very long texts count whole; equal texts get equal rows, and other columns aren't looked at. A null doc_id has held_out null. Without a label to learn from all rows are ``und``. No rows give no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # arrays of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = sent.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    small_batches(spark)
    got = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", (F.col("score") < sure).alias("rejected"))
