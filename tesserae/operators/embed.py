"""Embedders: hashed n-grams, and latent semantic analysis by distributed factorisation; a content-keyed cache."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment
from ..functions import text as X


#: Texts that are encoded at once.
ROWS = 512


def _place(feature: str, dim: int) -> tuple[int, float]:
    value = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "big")
    return value % dim, (-1.0, 1.0)[value >> 63]


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=-1, keepdims=True)
    return (m / np.where(length == 0, 1, length)).astype(np.float32)


def hashed(texts: list[str], dim: int = 512, grams: bool = True) -> np.ndarray:
    """A row per text: signed counts, as 1 + ln, of words and CJK bigrams, and of character trigrams."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, t in enumerate(texts):
        words = [w for w in segment.raw_tokens(t, True) if len(w) > 1]
        for feature, n in Counter([*words, *(f"#{g}" for g in segment.char_ngrams(t) * grams)]).items():
            at, sign = _place(feature, dim)
            out[row, at] += sign * (1 + math.log(n))
    return _unit(out)


def hashed_tokens(text: str, dim: int = 512, grams: bool = True) -> np.ndarray:
    """A row per token of two characters or more: its own place, and half of each of its trigrams."""
    words = [w for w in segment.tokens(text, True) if len(w) > 1]
    out = np.zeros((len(words), dim), np.float32)
    for row, w in enumerate(words):
        at, sign = _place(w, dim)
        out[row, at] = sign
        for g in segment.char_ngrams(w) * grams:
            at, sign = _place(f"#{g}", dim)
            out[row, at] += sign / 2
    return _unit(out)


def embed(rows: DataFrame, dim: int = 512, key: str = "chunk_id", encoder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(key, vector) of (key, text); ``encoder`` is any function from texts to a matrix."""
    encode = encoder or (lambda texts: hashed(texts, dim))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                some = b.iloc[at : at + ROWS]
                yield pd.DataFrame({key: some[key], "vector": list(encode(some.text.fillna("").tolist()))})

    return rows.select(key, "text").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")


def embed_tokens(rows: DataFrame, dim: int = 512, key: str = "chunk_id", grams: bool = True) -> DataFrame:
    """(key, pos, vector): a row per token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(k, p, v) for k, t in zip(b[key], b.text.fillna(""), strict=True) for p, v in enumerate(hashed_tokens(t, dim, grams))]
            yield pd.DataFrame(made, columns=[key, "pos", "vector"])

    return rows.select(key, "text").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, pos int, vector array<float>")


class LSA:
    """TF-IDF and its largest singular vectors, by power iteration over term and document factors kept as tables.

    A pass multiplies by the matrix and its transpose: two aggregations of sparse products of width k. Only k by k
    matrices reach the driver, and the projection has a row per term, so neither grows with the documents. The factors
    are ``oversample`` columns wider than what is kept.
    """

    def __init__(self, dim: int = 64, max_share: float = 0.9, passes: int = 3, seed: int = 7, oversample: int = 10):
        self.dim, self.max_share, self.passes, self.seed, self.oversample = min(dim, 256), max_share, passes, seed, oversample
        self.projection: DataFrame | None = None

    @staticmethod
    def _terms(rows: DataFrame) -> DataFrame:
        stop = F.array(*map(F.lit, sorted(X.STOPWORDS)))
        words = F.filter(X.tokens("text", True), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))
        return rows.select("chunk_id", F.explode(words).alias("term")).groupBy("chunk_id", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))

    @staticmethod
    def _orthonormal(table: DataFrame, key: str, most: int | None = None) -> DataFrame:
        """Columns made orthonormal by the eigenvectors of their k by k products; the ``most`` of the largest values, largest first."""
        k = len(table.first()["f"])
        gram = np.zeros((k, k))

        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, k))
            for b in batches:
                if len(b):
                    m = np.stack(b.f.tolist())
                    total += m.T @ m
            yield pd.DataFrame({"g": [total.ravel()]})

        # toLocalIterator() would run the tasks one after another.
        for r in table.select("f").mapInPandas(products, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            gram[divmod(r["i"], k)] = r["x"]
        values, vectors = np.linalg.eigh(gram)
        good = values > max(values.max(), 1e-12) * 1e-10
        turn = (vectors[:, good] / np.sqrt(values[good]))[:, ::-1][:, :most]

        def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({key: b[key], "f": list(np.stack(b.f.tolist()) @ turn) if len(b) else []})

        return table.mapInPandas(turned, f"{key} string, f array<double>")

    @staticmethod
    def _times(cells: DataFrame, factor: DataFrame, by: str, to: str) -> DataFrame:
        """Sum over ``by`` of weight times the factor's row, for each ``to``."""
        k = len(factor.first()["f"])
        # A column for each place, so that a task sums what it has of a key before the shuffle, without a row for each place.
        sums = cells.join(factor, by).groupBy(to).agg(*[F.sum(F.col("f")[i] * F.col("weight")).alias(f"x{i}") for i in range(k)])
        return sums.select(to, F.array(*[f"x{i}" for i in range(k)]).alias("f"))

    def fit(self, chunks: DataFrame) -> LSA:
        rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
        n, cells = rows.count(), self._terms(rows)
        df = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        some = df.where(F.col("df") <= self.max_share * n)
        df = some if some.limit(1).count() else df
        self.idf = df.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf")).checkpoint()
        cells = cells.join(self.idf, "term").select("chunk_id", "term", (F.col("tf") * F.col("idf")).alias("weight")).checkpoint()
        start = F.array(*[(F.xxhash64(F.col("term"), F.lit(self.seed + i)) / F.lit(2.0**63)) for i in range(self.dim + self.oversample)])
        terms = self._orthonormal(self.idf.select("term", start.alias("f")), "term").checkpoint()
        for _ in range(self.passes):
            docs = self._times(cells, terms, "term", "chunk_id").checkpoint()
            terms = self._orthonormal(self._times(cells, docs, "chunk_id", "term").checkpoint(), "term").checkpoint()
        # The projection is the term side times the singular values: the transpose times the unit documents.
        docs = self._orthonormal(self._times(cells, terms, "term", "chunk_id").checkpoint(), "chunk_id", self.dim).checkpoint()
        self.projection = self._times(cells, docs, "chunk_id", "term").checkpoint()
        return self

    def embed(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, vector); texts without a known term have no row."""
        if self.projection is None:
            raise RuntimeError("fit before embed")
        from ..functions import vectors as V

        cells = self._terms(chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")).join(self.idf, "term")
        made = self._times(cells.select("chunk_id", "term", (F.col("tf") * F.col("idf")).alias("weight")), self.projection, "term", "chunk_id")
        return made.select("chunk_id", V.l2_normalize("f").alias("vector"))


def cache_key(name: str, dim: int):
    """What an embedding is kept under: the embedder, its width and the text."""
    return F.concat_ws("|", F.lit(name), F.lit(str(dim)), F.sha2("text", 256))


def embed_cached(rows: DataFrame, cache: DataFrame, name: str = "hashed", dim: int = 512, encoder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, vector) of all rows, and the rows (key, vector) to add to the cache; only misses are embedded."""
    keyed = rows.select("chunk_id", "text", cache_key(name, dim).alias("key"))
    missing = keyed.join(cache, "key", "left_anti").dropDuplicates(["key"]).select(F.col("key"), "text")
    new = embed(missing, dim, "key", encoder)
    return keyed.join(cache.select("key", "vector").unionByName(new), "key").select("chunk_id", "vector"), new
