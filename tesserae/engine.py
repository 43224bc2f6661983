"""The engine: index documents, retrieve for many queries at once, answer, measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import agent, answer, chunk, embed, index, metrics, rerank, retrieve, stress, transform
from .session import with_checkpoints
from .sources import chat
from .sources.files import load_documents
from .sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, complete: Callable[[str], str] | None = None):
        with_checkpoints(spark)
        self.spark, self.cfg = spark, settings or Settings()
        self.store = Store(spark, self.cfg.store)
        self.complete = complete or chat.build(self.cfg.llm, self.cfg.llm_base_url, self.cfg.llm_model, self.cfg.llm_wire_api)

    # ---- indexing

    def index_paths(self, paths: list[str] | str) -> dict[str, int]:
        return self.index(load_documents(self.spark, paths))

    def index(self, documents: DataFrame) -> dict[str, int]:
        """Chunk and keep what is new or changed; embeddings follow when they are needed."""
        given = documents.count()
        new = self.store.changed(documents).checkpoint()
        n = new.count()
        if n:
            self.store.upsert(new, chunk.chunk(new, self.cfg.chunking).checkpoint())
        return {"documents": n, "skipped": given - n, **{f"stored_{k}": v for k, v in self.store.counts().items()}}

    augment = index

    # ---- retrieval

    def _vectors(self, chunks: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        if self.cfg.embedder == "lsa":
            lsa = embed.LSA(self.cfg.embed_dim).fit(chunks)
            asked = lambda q: lsa.embed(q.select(F.col("query_id").cast("string").alias("chunk_id"), "text")).withColumnRenamed("chunk_id", "query_id")
            return lsa.embed(chunks), asked
        dim = self.cfg.embed_dim
        return self.store.vectors(chunks, "hashed", dim), lambda q: embed.embed(q, dim, "query_id")

    def retrieve(self, queries: DataFrame, filters: dict | None = None, top_k: int | None = None) -> DataFrame:
        """Ranked units of (query_id, text): channels, fusion, filters, caps, expansion, reranking of what is left."""
        cfg = retrieve.Retrieval(**{**vars(self.cfg.retrieval), "filters": {**self.cfg.retrieval.filters, **(filters or {})}, **({"top_k": top_k} if top_k else {})})
        if cfg.weights is None and cfg.profile is None:
            cfg.profile = "lexical"
        every = self.store.load_chunks(False)
        chunks = self.store.load_chunks()
        if cfg.prefilter:
            chunks = retrieve.passes(chunks, cfg.filters)
        queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "text")
        hits = None
        for name in cfg.channels:
            if name == "bm25":
                rows = index.bm25_search(queries, chunks, cfg.candidate_k)
            elif name == "dense":
                vectors, ask = self._vectors(chunks)
                rows = index.dense_search(ask(queries), vectors, cfg.candidate_k)
            elif name == "late":
                if hits is None:
                    continue
                pairs = hits.select("query_id", "chunk_id").distinct()
                own = chunks.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
                rows = index.ranked(index.maxsim(embed.embed_tokens(queries, self.cfg.embed_dim, "query_id"), embed.embed_tokens(own, self.cfg.embed_dim), pairs), cfg.candidate_k)
            else:
                raise ValueError(f"unknown channel: {name}")
            rows = rows.select("query_id", "chunk_id", F.lit(name).alias("channel"), "score")
            hits = rows if hits is None else hits.unionByName(rows)
        if hits is None:
            hits = queries.select("query_id", F.lit("").alias("chunk_id"), F.lit("").alias("channel"), F.lit(0.0).alias("score")).limit(0)
        units = retrieve.retrieve(hits, every, cfg).join(queries.withColumnRenamed("text", "query"), "query_id")
        tokens = None
        if "late" in self.cfg.reranker:
            own = every.join(units.select("chunk_id").distinct(), "chunk_id", "left_semi")
            tokens = (embed.embed_tokens(queries, self.cfg.embed_dim, "query_id"), embed.embed_tokens(own, self.cfg.embed_dim))
        order = rerank.build(self.cfg.reranker, tokens, self.complete)
        return order(units) if order else units

    def explain(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, term, tf, part): what each term adds to a BM25 score."""
        return index.bm25_parts(queries, self.store.load_chunks())

    # ---- answers

    def _answers(self, units: DataFrame) -> DataFrame:
        g = self.cfg.generation
        return answer.answer(units, g.max_context_tokens, g.order, g.dedupe, complete=self.complete)

    def answer(self, queries: DataFrame, agentic: bool | None = None, filters: dict | None = None) -> DataFrame:
        """One row per query; without units it isn't answerable."""
        queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "text")
        if agentic if agentic is not None else self.cfg.agentic.enabled:

            def units(q: DataFrame) -> DataFrame:
                v = transform.variants(q, self.cfg.transform, self.complete)
                name = F.concat_ws("\u0001", "query_id", F.col("variant").cast("string"))
                found = self.retrieve(v.select(name.alias("query_id"), "text"), filters)
                return found.withColumn("query_id", F.substring_index("query_id", "\u0001", 1))

            return agent.run(queries, units, self.cfg.agentic, self._answers, agent.graded_by(self.complete) if self.complete else agent.grade)
        given = self._answers(self.retrieve(queries, filters))
        bare = queries.join(given.select("query_id"), "query_id", "left_anti").select("query_id", F.col("text").alias("query"), F.lit("").alias("text"), F.lit(False).alias("answerable"), F.lit(0.0).alias("groundedness"))
        return given.unionByName(bare, allowMissingColumns=True)

    # ---- measures

    def evaluate(self, cases: DataFrame, k: int = 5, mode: str = "retrieved_gold") -> DataFrame:
        units = self.retrieve(cases.select("query_id", F.col("question").alias("text")))
        gold = cases.select("query_id", F.explode("gold_doc_ids").alias("doc_id"))
        return metrics.mean(metrics.retrieval(units, gold, k, mode))

    def stress(self, documents: DataFrame, evaluate: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
        return stress.curve(documents, evaluate, **how)

    def doctor(self) -> dict[str, object]:
        return {"spark": self.spark.version, "store": self.store.counts(), "embedder": self.cfg.embedder, "chat": self.complete is not None, "reranker": self.cfg.reranker, "channels": list(self.cfg.retrieval.channels)}
