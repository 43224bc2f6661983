"""Chunking of documents: structural, hierarchical and semantic, as one Arrow pass over the documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment

SCHEMA = "chunk_id string, doc_id string, text string, ordinal int, heading string, heading_path array<string>, start int, end int, parent_id string, metadata map<string,string>"


@dataclass(frozen=True)
class Chunking:
    strategy: str = "structural"
    max_tokens: int = 320
    min_tokens: int = 40
    overlap_tokens: int = 48
    parent_tokens: int = 700
    child_tokens: int = 140
    semantic_break_percentile: float = 0.22
    include_headings_in_text: bool = True
    #: Break behind the unit that is unlike the next one, instead of before it.
    break_after: bool = False


def percentile(values: list[float], share: float) -> float:
    """The value at the nearest place, halves to even; 0 of none."""
    return sorted(values)[min(max(round(share * (len(values) - 1)), 0), len(values) - 1)] if values else 0.0


def _semantic(parts: list[str], cfg: Chunking) -> list[str]:
    from .embed import hashed

    if len(parts) < 3:
        return segment.pack(parts, cfg.max_tokens, cfg.min_tokens, cfg.overlap_tokens)
    v = hashed(parts, 256)
    like = (v[:-1] * v[1:]).sum(1).tolist()
    low = percentile(like, cfg.semantic_break_percentile)
    groups: list[list[str]] = [[]]
    used = 0
    for i, part in enumerate(parts):
        price = max(1, segment.count_tokens(part))
        k = i - 1 if cfg.break_after else i
        cut = 0 <= k < len(like) and like[k] <= low and used >= cfg.min_tokens
        if groups[-1] and (cut or used + price > cfg.max_tokens):
            groups.append([])
            used = 0
        groups[-1].append(part)
        used += price
    return [" ".join(g) for g in groups]


def chunk_text(doc_id: str, text: str, title: str, cfg: Chunking) -> list[tuple]:
    """Rows (chunk_id, text, ordinal, heading, heading_path, start, end, parent_id); children come before parents."""
    rows: list[tuple] = []
    parents: list[tuple] = []
    for path, start, end, body in segment.sections(text):
        heading, head = (path[-1] if path else title), " > ".join(path)
        lead = lambda t, head=head: f"{head}\n{t}" if head else t
        parts = segment.units(body)
        if cfg.strategy == "hierarchical":
            for big in segment.pack(parts, cfg.parent_tokens, cfg.min_tokens, 0):
                parent = f"{doc_id}#p{len(parents)}"
                parents.append((parent, lead(big), len(parents), heading, path, 0, 0, None))
                for small in segment.pack(segment.units(big), cfg.child_tokens, 20, cfg.overlap_tokens):
                    rows.append((f"{doc_id}#c{len(rows)}", lead(small), len(rows), heading, path, 0, 0, parent))
            continue
        semantic = cfg.strategy == "semantic"
        pieces = _semantic(parts, cfg) if semantic else segment.pack(parts, cfg.max_tokens, cfg.min_tokens, cfg.overlap_tokens)
        for piece in pieces:
            rows.append((f"{doc_id}#{'m' if semantic else 's'}{len(rows)}", lead(piece) if cfg.include_headings_in_text else piece, len(rows), heading, path, start, end, None))
    return rows + parents


def chunk(documents: DataFrame, cfg: Chunking | None = None) -> DataFrame:
    """Chunks of documents (doc_id, text, title, metadata); other strategies than hierarchical and semantic are structural."""
    from .embed import ROWS

    cfg = cfg or Chunking()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b.iloc[at : at + ROWS] for b in batches for at in range(0, len(b), ROWS)):
            rows = [(c, d, t, o, h, list(p), s, e, q, m) for d, x, n, m in zip(b.doc_id, b.text, b.title, b.metadata, strict=True) for c, t, o, h, p, s, e, q in chunk_text(d, x or "", n or "", cfg)]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "text", "ordinal", "heading", "heading_path", "start", "end", "parent_id", "metadata"])

    given = {c: F.col(c) for c in documents.columns}
    title = given.get("title", F.lit(""))
    metadata = given.get("metadata", F.create_map().cast("map<string,string>"))
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), title.alias("title"), metadata.alias("metadata"))
    return docs.mapInPandas(run, SCHEMA)


def indexable(chunks: DataFrame) -> DataFrame:
    """Chunks to index: all but those that are the parent of another."""
    parents = chunks.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("_parent")).distinct()
    return chunks.join(parents, F.col("chunk_id") == F.col("_parent"), "left_anti")
