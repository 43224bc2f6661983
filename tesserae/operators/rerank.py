"""Rerankers over units (query_id, query, chunk_id, text, window_text, heading_path, score, rerank_score)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .retrieve import best_text, final_score

Reranker = Callable[[DataFrame], DataFrame]


def renumber(units: DataFrame) -> DataFrame:
    """New ranks by final score, ties by chunk."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(final_score(), 6)), "chunk_id")
    return units.withColumn("rank", F.row_number().over(order))


def proximity(wanted: Column | str, have: Column | str) -> Column:
    """0.7 times the share of wanted tokens that are there, plus 0.3 times their kinds by the width from first to last."""
    w = F.col(wanted) if isinstance(wanted, str) else wanted
    h = F.col(have) if isinstance(have, str) else have
    at = F.filter(F.transform(h, lambda t, i: F.when(F.array_contains(w, t), i)), lambda i: i.isNotNull())
    kinds = F.size(F.array_intersect(w, h))
    width = F.element_at(at, -1) - F.element_at(at, 1) + 1
    return F.when(F.size(at) > 0, 0.7 * kinds / F.size(F.array_distinct(w)) + 0.3 * kinds / width).otherwise(F.lit(0.0))


def heuristic(units: DataFrame, title_weight: float = 0.35, proximity_weight: float = 0.45) -> DataFrame:
    """Coverage, title hits, tight terms, and less for texts that are very short or long."""
    rows = units.withColumn("_b", best_text()).withColumn("_q", X.content_tokens("query"))
    rows = rows.withColumn("_d", X.tokens("_b")).withColumn("_t", X.tokens(F.array_join("heading_path", " ")))
    total = final_score() + X.overlap("_q", "_d") + title_weight * X.overlap("_q", "_t") + proximity_weight * proximity("_q", "_d")
    length = F.when(F.length("_b").between(60, 2500), F.lit(1.0)).otherwise(F.lit(0.85))
    return renumber(rows.withColumn("rerank_score", total * length).drop("_b", "_q", "_d", "_t"))


def late(query_tokens: DataFrame, chunk_tokens: DataFrame, weight: float = 1.0) -> Reranker:
    """Adds ``weight`` times the late-interaction score where there is one, and shows it as a channel."""
    from .index import maxsim

    def run(units: DataFrame) -> DataFrame:
        scores = maxsim(query_tokens, chunk_tokens, units.select("query_id", "chunk_id")).withColumnRenamed("score", "_late")
        rows = units.join(scores, ["query_id", "chunk_id"], "left")
        shown = F.when(F.col("_late").isNotNull(), F.map_concat("channels", F.create_map(F.lit("late"), F.col("_late")))).otherwise(F.col("channels"))
        return renumber(rows.withColumn("rerank_score", F.when(F.col("_late").isNotNull(), final_score() + weight * F.col("_late")).otherwise(F.col("rerank_score"))).withColumn("channels", shown).drop("_late"))

    return run


def listwise(complete: Callable[[str], str], first: int = 12, chars: int = 700) -> Reranker:
    """A chat model orders the first units of each query; a failure leaves the order, and the tail stays behind."""
    import pandas as pd

    from ..sources.chat import numbers

    def run(units: DataFrame) -> DataFrame:
        rows = units.withColumn("_b", F.substring(best_text(), 1, chars)).withColumn("_f", final_score())

        def order(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("rank")
            head = g.head(first)
            listing = "\n".join(f"{i}: {t}" for i, t in enumerate(head._b, 1))
            try:
                said = numbers(complete(f"Rank these passages for the question, best first, as numbers.\nQuestion: {head['query'].iloc[0]}\n{listing}"))
            except Exception:
                return g.assign(rerank_score=g.rerank_score.astype(float))
            place = list(dict.fromkeys(i - 1 for i in said if 1 <= i <= len(head)))
            place += [i for i in range(len(head)) if i not in place]
            score = g._f.astype(float).to_numpy().copy()
            for p, i in enumerate(place):
                score[i] += (len(head) - p) / len(head)
            return g.assign(rerank_score=score)

        done = rows.groupBy("query_id").applyInPandas(order, rows.schema)
        return renumber(done.drop("_b", "_f"))

    return run


def build(name: str, tokens: tuple[DataFrame, DataFrame] | None = None, complete: Callable[[str], str] | None = None) -> Reranker | None:
    """Rerankers by name, several joined by commas; late without token tables is none, llm without a model heuristic."""
    chain: list[Reranker] = []
    for part in (p.strip().lower() for p in (name or "none").split(",")):
        if part in ("none", "off", ""):
            continue
        if part == "heuristic" or part == "llm" and complete is None:
            chain.append(heuristic)
        elif part == "late":
            chain += [late(*tokens)] if tokens else []
        elif part == "llm":
            chain.append(listwise(complete))
        else:
            raise ValueError(f"unknown reranker: {part}")
    if not chain:
        return None

    def run(units: DataFrame) -> DataFrame:
        for step in chain:
            units = step(units)
        return units

    return run
