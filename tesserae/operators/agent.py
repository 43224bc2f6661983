"""The corrective loop, for a batch of questions: retrieve, grade, check the evidence, rewrite or stop, answer.

A round works on the questions that are still open and is written down by checkpoint(), so plans stay small. There
are ``max_rounds`` rounds at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import answer as A
from . import evidence as E
from .retrieve import best_text, final_score


@dataclass
class Loop:
    enabled: bool = True
    max_rounds: int = 3
    max_graded_candidates: int = 6
    weak_coverage_threshold: float = 0.35
    groundedness_threshold: float = 0.3
    evidence: bool = True
    evidence_drives_loop: bool = True
    evidence_gate: bool = False
    evidence_threshold: float = 0.5
    evidence_stop_on_no_entity: bool = True
    stop_when_no_lexical_hit: bool = True
    #: The old test looked at the fused contribution of bm25 and stopped at this; a raw hit counts otherwise.
    legacy_lexical_min: float | None = None
    adaptive: bool = True
    max_llm_calls: int = 0
    max_total_tokens: int = 0


LABELS = ("relevant", "ambiguous", "irrelevant")
_GRADING = (
    "Say of each numbered passage if it helps to answer the question, as a JSON array of objects with index (its number), "
    'label ("relevant", "ambiguous" or "irrelevant") and score (0 to 1).'
)


def grade(units: DataFrame) -> DataFrame:
    """Units with grade_score, the share of the query's distinct content tokens that the text has, and a label."""
    share = X.coverage(X.content_tokens("query"), X.tokens(best_text()))
    label = F.when(F.col("grade_score") >= 0.5, "relevant").when(F.col("grade_score") >= 0.2, "ambiguous").otherwise("irrelevant")
    return units.withColumn("grade_score", share).withColumn("label", label)


def graded_by(complete: Callable[..., str], chars: int = 600) -> Callable[[DataFrame], DataFrame]:
    """A grader that asks a chat model once for all units of a query; where it fails or leaves a unit out, ``grade`` counts.

    A query has as many units as the loop grades at most, so a group is small.
    """
    import pandas as pd

    from ..sources.chat import parse_json

    def ask(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank", kind="stable").reset_index(drop=True)
        passages = "\n".join(f"{i}. {t}" for i, t in enumerate(g._b, 1))
        try:
            said = parse_json(complete(f"{_GRADING}\nQuestion: {g['query'].iloc[0]}\n{passages}", system="Answer with JSON alone.", temperature=0.0, max_tokens=400))
        except (OSError, ValueError, KeyError):  # the endpoint is away or says something else
            said = None
        for verdict in said if isinstance(said, list) else []:
            try:
                at, label = int(verdict["index"]) - 1, str(verdict["label"]).lower()
            except (TypeError, ValueError, KeyError):
                continue
            if 0 <= at < len(g) and label in LABELS:
                try:
                    score = float(verdict.get("score", 0.0))
                except (TypeError, ValueError):
                    score = 0.0
                g.loc[at, ["label", "grade_score"]] = [label, score]
        return g

    def run(units: DataFrame) -> DataFrame:
        rows = grade(units).withColumn("_b", F.translate(F.substring(best_text(), 1, chars), "\n", " "))
        return rows.groupBy("query_id").applyInPandas(ask, rows.schema).drop("_b")

    return run


def dedupe(units: DataFrame) -> DataFrame:
    """Of a query's units with one chunk the best; of equals the one that comes first when written out."""
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc(final_score()), F.to_json(F.struct(*units.columns)))
    return units.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cut(units: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(final_score(), 6)), "chunk_id")
    return units.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def coverage_ratio(units: DataFrame) -> DataFrame:
    """(query_id, coverage): what all units of a query cover of its content tokens."""
    have = units.groupBy("query_id", "query").agg(F.array_distinct(F.flatten(F.collect_list(X.tokens(best_text())))).alias("_h"))
    return have.select("query_id", X.coverage(X.content_tokens("query"), F.col("_h")).alias("coverage"))


def strong_terms(units: DataFrame, most: int = 8) -> DataFrame:
    words = F.filter(X.tokens(best_text()), lambda t: F.length(t) > 2)
    return units.where(final_score() > 0).groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))), 1, most).alias("strong"))


def rewritten(query: Column, gap: Column, strong: Column) -> Column:
    none = F.array().cast("array<string>")
    g, s = F.coalesce(gap, none), F.coalesce(strong, none)
    words = F.when(F.size(g) > 0, F.slice(g, 1, 6)).when(F.size(s) > 0, F.slice(s, 1, 6)).otherwise(F.array(query))
    return F.trim(F.concat_ws(" ", query, F.array_join(words, " ")))


def run(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], cfg: Loop | None = None, answers: Callable[[DataFrame], DataFrame] = A.answer, grader: Callable[[DataFrame], DataFrame] = grade) -> DataFrame:
    """One row per query of (query_id, text): the answer columns, round, stop, evidence, and what the loop cost.

    ``retrieve`` gives units of (query_id, text). A question ends when its answer is grounded, when a budget or stop
    says so, or after the last round; then its best answer counts, and one without any is not answerable. The query of
    a row is the text as last rewritten.
    """
    cfg = cfg or Loop()
    open_ = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query")).withColumn("retrieved_so_far", F.lit(0).cast("long")).withColumn("graded_so_far", F.lit(0).cast("long")).checkpoint()
    done: list[DataFrame] = []
    tries: list[DataFrame] = []
    for k in range(1, cfg.max_rounds + 1):
        asked = open_.select("query_id", F.col("query").alias("text"))
        found = dedupe(retrieve(asked).withColumn("query_id", F.col("query_id").cast("string")).drop("query")).join(open_.select("query_id", "query"), "query_id").checkpoint()
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
        units = grader(cut(found, cfg.max_graded_candidates)).checkpoint()
        hits = F.count_if(F.coalesce(F.col("channels")["bm25"], F.lit(0.0)) > cfg.legacy_lexical_min) if cfg.legacy_lexical_min is not None else F.count_if(F.map_contains_key("channels", "bm25"))
        state = units.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "relevant").alias("relevant"), hits.alias("lexical"))
        spec = E.query_spec(asked)
        reports = E.report(spec, units, cfg.evidence_threshold, enabled=cfg.evidence)
        rows = open_.join(counts, "query_id", "left").join(state, "query_id", "left").join(coverage_ratio(units), "query_id", "left").join(reports, "query_id")
        rows = rows.fillna(0, ["found", "n", "relevant", "lexical"]).fillna(0.0, ["coverage"])
        rows = rows.withColumn("quality", 0.6 * F.col("relevant") / F.greatest("n", F.lit(1)) + 0.4 * F.col("coverage"))
        rows = rows.withColumn("retrieved_so_far", F.col("retrieved_so_far") + F.col("found")).withColumn("graded_so_far", F.col("graded_so_far") + F.col("n"))
        weak = F.col("quality") < cfg.weak_coverage_threshold
        gap = F.lit(cfg.evidence) & ~F.col("answerable")
        stop = F.when(F.lit(cfg.adaptive and not cfg.enabled and k == 1) & (F.col("coverage") < 0.15), "low_coverage")
        stop = stop.when(F.col("graded_so_far") >= 24, "budget")
        if cfg.stop_when_no_lexical_hit:
            stop = stop.when(F.col("lexical") == 0, "no_lexical_hit")
        if cfg.evidence_stop_on_no_entity and cfg.evidence:
            stop = stop.when((F.col("entity_coverage") == 0) & weak, "no_entity_coverage")
        again = F.lit(cfg.enabled and k < cfg.max_rounds) & (weak | (gap & F.lit(cfg.evidence_drives_loop)))
        gaps = E.gap_terms(reports, units) if cfg.evidence else reports.select("query_id", F.lit(None).cast("array<string>").alias("gap"))
        rows = rows.withColumn("stop", stop).withColumn("retry", F.col("stop").isNull() & again).join(gaps, "query_id", "left").join(strong_terms(units), "query_id", "left")
        rows = rows.withColumn("next_query", rewritten(F.col("query"), F.col("gap"), F.col("strong"))).withColumn("round", F.lit(k)).checkpoint()

        ready = rows.where("stop IS NULL AND NOT retry")
        given = answers(units.join(ready.select("query_id"), "query_id", "left_semi")).drop("query")
        keep = ["query_id", "query", "round", "stop", "support", "entity_coverage", "quality", "retrieved_so_far", "graded_so_far", "next_query", F.col("answerable").alias("evident")]
        got = ready.select(*keep).join(given, "query_id", "left").checkpoint()
        if cfg.evidence_gate:
            got = got.withColumn("answerable", F.col("answerable") & F.col("evident"))
        tries.append(got)
        left = got.where(F.coalesce("groundedness", F.lit(0.0)) < cfg.groundedness_threshold)
        done.append(rows.where("stop IS NOT NULL").select("query_id", "query", "round", "stop", "support", "entity_coverage", "quality", "retrieved_so_far", "graded_so_far"))
        if k == cfg.max_rounds:
            break
        more = rows.where("retry").select("query_id", F.col("next_query").alias("query"), "retrieved_so_far", "graded_so_far")
        open_ = more.unionByName(left.select("query_id", F.col("next_query").alias("query"), "retrieved_so_far", "graded_so_far")).checkpoint()
        if not open_.limit(1).count():
            break
    all_tries = tries[0]
    for t in tries[1:]:
        all_tries = all_tries.unionByName(t)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("groundedness", F.lit(0.0))), "round")
    kept = all_tries.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "next_query", "evident")
    stopped = done[0]
    for s in done[1:]:
        stopped = stopped.unionByName(s)
    bare = stopped.join(kept.select("query_id"), "query_id", "left_anti")
    out = kept.unionByName(bare, allowMissingColumns=True)
    return out.withColumn("answerable", F.coalesce("answerable", F.lit(False))).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("groundedness", F.coalesce("groundedness", F.lit(0.0)))
