"""Query variants: the query itself, its key words, and what a chat model makes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PROMPTS = {
    "hyde": "Write 120 to 200 words of a factual passage that answers the question.",
    "multi-query": "Give {n} search queries for different sides of the question, as a JSON array of strings.",
    "step-back": "Give one broader question whose answer is the background of this one, and nothing else.",
    "decompose": "Cut the question into at most {n} simple ones, as a JSON array of strings.",
}


def keyword(queries: DataFrame) -> DataFrame:
    """(query_id, variant, text): each query, and its content tokens where it has any."""
    words = F.array_join(X.content_tokens("text"), " ")
    both = F.when(words != "", F.array("text", words)).otherwise(F.array("text"))
    return queries.select("query_id", F.posexplode(both).alias("variant", "text"))


def variants(queries: DataFrame, name: str = "none", complete: Callable[[str], str] | None = None, n: int = 3) -> DataFrame:
    """(query_id, variant, text); a named transform without a chat model falls back to key words, a failed one to the query."""
    name = {"multi": "multi-query"}.get((name or "none").lower(), (name or "none").lower())
    if name in ("none", "off", ""):
        return queries.select("query_id", F.lit(0).alias("variant"), "text")
    if complete is None:
        return keyword(queries)
    if name not in PROMPTS:
        raise ValueError(f"unknown transform: {name}")
    from ..sources.chat import parse_json

    def made(text: str) -> list[str]:
        try:
            said = complete(f"{PROMPTS[name].format(n=n)}\n\nQuestion: {text}")
        except Exception:
            return []
        if name in ("multi-query", "decompose"):
            found = parse_json(said)
            return [x.strip() for x in found if isinstance(x, str) and x.strip()][:n] if isinstance(found, list) else []
        said = said.strip() if name == "hyde" else said.strip().split("\n")[0]
        return [said] * bool(said)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(q, i, v) for q, t in zip(b.query_id, b.text, strict=True) for i, v in enumerate([t, *made(t)])], columns=["query_id", "variant", "text"])

    return queries.select("query_id", "text").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, variant int, text string")
