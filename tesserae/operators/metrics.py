"""Ranking and answer metrics over many queries at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

_INNER = re.compile(r"(?<=[ \n])[a-zA-Z]+(?=[ \n])")
_WORD = re.compile(r"[a-zA-Z]+")


def holders(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents (doc_id, text) that contain the text of (query_id, text); a null is in none.

    Texts are read once. A passage is looked for where its longest inner word stands, as such a word is whole in a
    document that holds the passage; one without an inner word is looked for everywhere. All passages go to the executors.
    """
    whole, always, by = [], [], {}
    for r in passages.where("text IS NOT NULL").select("query_id", "text").collect():
        words = _INNER.findall(r["text"])
        always.append(len(whole)) if not words else by.setdefault(max(words, key=len), []).append(len(whole))
        whole.append((r["query_id"], r["text"]))
    sent = documents.sparkSession.sparkContext.broadcast((pa.array([q for q, _ in whole]), [t for _, t in whole], always, by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, always, by = sent.value
        words = by.keys()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                found = [(p, d) for d, t in enumerate(some.column("text").to_pylist()) if t is not None for p in always + [p for w in words & set(_WORD.findall(t)) for p in by[w]] if texts[p] in t]
                p, d = np.array(found, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([names.take(pa.array(p)), some.column("doc_id").take(pa.array(d))], ["query_id", "doc_id"])

    kinds = [t.dataType.simpleString() for t in (passages.schema["query_id"], documents.schema["doc_id"])]
    if not whole:
        return documents.sparkSession.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}")
    return documents.select("doc_id", "text").mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}")


def retrieval(ranked: DataFrame, gold: DataFrame, k: int = 5, mode: str = "retrieved_gold") -> DataFrame:
    """One row per judged query: recall, precision, hit, mrr, ndcg of (query_id, doc_id, chunk_id, rank) at ``k``.

    gold: (query_id, doc_id). retrieved_gold takes as gold the retrieved chunks of gold documents and leaves out queries
    without one; true counts gold documents, found or not. mrr looks at the whole list.
    """
    good = ranked.join(gold.select("query_id", "doc_id").distinct().withColumn("g", F.lit(1)), ["query_id", "doc_id"], "left")
    top = F.col("rank") <= k
    hit = F.col("g").isNotNull()
    by = good.groupBy("query_id").agg(
        F.count_if(hit).alias("found"), F.count_if(hit & top).alias("in_k"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit & top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    if mode == "true":
        wanted = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("wanted"))
        by = wanted.join(by, "query_id", "left").fillna(0, ["found", "in_k"]).fillna(0.0, ["dcg"])
    else:
        by = by.where("found > 0").withColumn("wanted", F.col("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return by.select(
        "query_id", (F.col("in_k") / F.col("wanted")).alias("recall"), (F.col("in_k") / k).alias("precision"), (F.col("in_k") > 0).cast("double").alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"),
    )


def mean(rows: DataFrame) -> DataFrame:
    """One row: the metrics' means, rounded to 4 places, and the number of queries."""
    names = [c for c, t in rows.dtypes if t == "double"]
    return rows.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in names])


def generation(answers: DataFrame, dim: int = 512) -> DataFrame:
    """One row: faithfulness, answer relevancy (cosine of question and answer), citation coverage, answerable rate."""
    from ..functions import vectors as V
    from .embed import embed

    answers = stored(answers)  # read three times
    q = embed(answers.select("query_id", F.col("query").alias("text")), dim, "query_id").withColumnRenamed("vector", "qv")
    a = embed(answers.select("query_id", "text"), dim, "query_id").withColumnRenamed("vector", "av")
    rows = answers.join(q, "query_id").join(a, "query_id").withColumn("relevancy", F.round(V.dot("qv", "av"), 4))
    means = [("faithfulness", F.col("groundedness")), ("answer_relevancy", F.col("relevancy")), ("citation_coverage", F.col("citation_coverage")), ("answerable_rate", F.col("answerable").cast("double"))]
    return rows.agg(*[F.round(F.avg(c), 4).alias(n) for n, c in means])
