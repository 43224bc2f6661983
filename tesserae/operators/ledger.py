"""What answers cost, and hard stops."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("llm_calls", "prompt_tokens", "completion_tokens", "rounds", "candidates_retrieved", "graded_candidates", "reranked_candidates", "delivered_units", "dropped_units", "web_fetches")


def totals(usage: DataFrame, key: str = "query_id") -> DataFrame:
    """Counters of rounds summed; rounds is the last one. total_tokens is of prompts and completions."""
    sums = [F.coalesce(F.max(c) if c == "rounds" else F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    return usage.groupBy(key).agg(*sums).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def exceeded(max_llm_calls: int = 0, max_tokens: int = 0, max_graded_candidates: int = 24) -> Column:
    """The first limit reached, as text, or ''; 0 is no limit."""
    out = F.when(F.lit(False), F.lit(""))
    for name, column, most in (("llm_calls", "llm_calls", max_llm_calls), ("tokens", "total_tokens", max_tokens), ("graded_candidates", "graded_candidates", max_graded_candidates)):
        if most:
            out = out.when(F.col(column) >= most, F.lit(f"{name}>={most}"))
    return out.otherwise("")


@dataclass
class Counted:
    """A chat model that counts: what it reports itself, else the tokens of what goes in and comes out."""

    inner: Callable[..., str]
    usage: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def __call__(self, prompt: str, system: str = "", **more) -> str:
        from ..functions.segment import count_tokens

        text = self.inner(prompt, system=system, **more)
        said = getattr(self.inner, "last_usage", None) or {}
        self.usage["llm_calls"] += 1
        self.usage["prompt_tokens"] += said.get("prompt_tokens") or count_tokens(prompt) + count_tokens(system)
        self.usage["completion_tokens"] += said.get("completion_tokens") or count_tokens(text)
        return text
