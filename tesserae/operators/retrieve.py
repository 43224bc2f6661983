"""Hybrid retrieval: fusion of channels, filters, caps, expansion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILES = {"lexical": {"bm25": 1.2, "dense": 0.8, "late": 0.5}, "semantic": {"bm25": 0.5, "dense": 1.5, "late": 0.5}}
DEFAULT = {"bm25": 1.0, "dense": 1.0, "late": 0.5}


@dataclass
class Retrieval:
    candidate_k: int = 40
    top_k: int = 8
    channels: tuple[str, ...] = ("bm25", "dense")
    fusion: str = "rrf"
    rrf_k: int = 60
    weights: dict[str, float] | None = None
    profile: str | None = None
    window: int = 0
    expand_parents: bool = False
    max_per_document: int = 0
    filters: dict = field(default_factory=dict)
    prefilter: bool = False

    def weight(self, channel: str) -> float:
        """Own weights, if any are given, else the embedder's profile, else the defaults; a missing name counts 1."""
        return (self.weights or PROFILES.get(self.profile or "") or DEFAULT).get(channel, 1.0)


def _weights(cfg: Retrieval, hits: DataFrame) -> DataFrame:
    names = {*cfg.channels, *DEFAULT, *(cfg.weights or {})}
    table = F.create_map(*[x for n in sorted(names) for x in (F.lit(n), F.lit(float(cfg.weight(n))))])
    return hits.withColumn("w", F.coalesce(table[F.col("channel")], F.lit(1.0)))


def fuse(hits: DataFrame, cfg: Retrieval) -> DataFrame:
    """(query_id, chunk_id, score, channels): one score from hits (query_id, chunk_id, channel, score).

    rrf: w / (rrf_k + rank), and channels holds these. weighted: w times the score scaled to 0..1 within the channel's
    candidates, 0 where all are equal, and channels holds the scaled scores alone.
    """
    rows = _weights(cfg, hits)
    if cfg.fusion == "rrf":
        rank = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc(F.round("score", 6)), "chunk_id"))
        rows = rows.withColumn("shown", F.col("w") / (cfg.rrf_k + rank)).withColumn("part", F.col("shown"))
    elif cfg.fusion == "weighted":
        all_ = Window.partitionBy("query_id", "channel")
        lo, span = F.min("score").over(all_), F.max("score").over(all_) - F.min("score").over(all_)
        rows = rows.withColumn("shown", F.when(span > 0, (F.col("score") - lo) / span).otherwise(F.lit(0.0))).withColumn("part", F.col("w") * F.col("shown"))
    else:
        raise ValueError(f"unknown fusion: {cfg.fusion}")
    return rows.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.map_from_entries(F.collect_list(F.struct("channel", "shown"))).alias("channels"))


def passes(rows: DataFrame, filters: dict) -> DataFrame:
    """Rows with doc_id, heading_path and metadata that a filter lets through; an empty list is no filter."""
    if docs := list(filters.get("doc_ids") or []):
        rows = rows.where(F.col("doc_id").isin(docs))
    if docs := list(filters.get("exclude_doc_ids") or []):
        rows = rows.where(~F.col("doc_id").isin(docs))
    if part := filters.get("heading_contains"):
        rows = rows.where(F.contains(F.lower(F.array_join("heading_path", " ")), F.lit(part.lower())))
    for key, value in (filters.get("metadata") or {}).items():
        rows = rows.where(F.col("metadata")[key] == F.lit(str(value)))
    return rows


def top(rows: DataFrame, k: int, cap: int = 0) -> DataFrame:
    """The best ``k`` of each query with new ranks; with ``cap`` at most so many of a document."""
    order = [F.desc(F.round("score", 6)), F.col("chunk_id")]
    if cap:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def windows(chunks: DataFrame, radius: int) -> DataFrame:
    """(chunk_id, window_text): each chunk with its ``radius`` neighbours on both sides, of its document and kind."""
    kind = F.col("parent_id").isNull()
    near = Window.partitionBy("doc_id", kind).orderBy("ordinal", "chunk_id").rowsBetween(-radius, radius)
    return chunks.select("chunk_id", F.array_join(F.collect_list("text").over(near), "\n").alias("window_text"))


def expand(units: DataFrame, chunks: DataFrame, cfg: Retrieval) -> DataFrame:
    """``units`` with window_text: the parent's text, else the neighbours', else an empty one."""
    out = units
    if cfg.expand_parents:
        parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
        out = out.join(parents, "parent_id", "left")
    else:
        out = out.withColumn("parent_text", F.lit(None).cast("string"))
    if cfg.window:
        out = out.join(windows(chunks, cfg.window), "chunk_id", "left")
    else:
        out = out.withColumn("window_text", F.lit(None).cast("string"))
    return out.withColumn("window_text", F.coalesce("parent_text", "window_text", F.lit(""))).drop("parent_text")


def best_text():
    return F.when(F.col("window_text") != "", F.col("window_text")).otherwise(F.col("text"))


def final_score():
    return F.coalesce("rerank_score", "score")


def retrieve(hits: DataFrame, chunks: DataFrame, cfg: Retrieval) -> DataFrame:
    """Ranked units of channel hits: fused, then filtered, capped, cut to top_k and expanded.

    Filters come after the candidates are cut, as they would change the fused scores before; ``prefilter`` callers
    filter the chunks themselves.
    """
    rows = fuse(hits, cfg).join(chunks, "chunk_id")
    rows = top(passes(rows, cfg.filters), cfg.top_k, cfg.max_per_document)
    return expand(rows, chunks, cfg).withColumn("rerank_score", F.lit(None).cast("double"))
