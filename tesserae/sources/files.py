"""Documents from files, judged questions from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("md", "markdown", "txt", "rst", "json", "csv", "html")


def load_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """doc_id (path), text, source, title, metadata of files; folders give files of known suffixes, at any depth.

    All are raw text, read by Spark, so any store will do. Blank files go; the title is the name without its suffix, and for
    Markdown the first ``# `` line.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for path in paths:
        named = path.rsplit("/", 1)[-1]
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        alone = "." in named and named.rsplit(".", 1)[-1].lower() in SUFFIXES
        rows = reader.load(path).select("path", "content")
        if not alone:
            rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
        out = rows if out is None else out.unionByName(rows)
    text = F.expr("make_valid_utf8(cast(content as string))")
    rows = out.select(F.regexp_replace("path", "^file:/+", "/").alias("doc_id"), text.alias("text")).dropDuplicates(["doc_id"]).where(F.trim(F.translate("text", "\r\n\t", "   ")) != "")
    name, suffix = F.regexp_extract("doc_id", r"([^/]*?)(?:\.[^./]*)?$", 1), F.lower(F.regexp_extract("doc_id", r"(\.[^./]+)$", 1))
    first = F.trim(F.regexp_extract("text", r"(?m)^# (.*)$", 1))
    title = F.when(suffix.isin(".md", ".markdown") & (first != ""), first).otherwise(name)
    return rows.select("doc_id", "text", F.col("doc_id").alias("source"), title.alias("title"), F.create_map(F.lit("source"), F.col("doc_id"), F.lit("suffix"), suffix).alias("metadata"))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """query_id, question, gold_chunk_ids, gold_doc_ids, gold_answer of JSON lines; missing fields are empty."""
    schema = "question string, gold_chunk_ids array<string>, gold_doc_ids array<string>, gold_answer string"
    none = F.array().cast("array<string>")
    rows = spark.read.schema(schema).json(path).where("question IS NOT NULL")
    return rows.select(F.sha2("question", 256).substr(1, 16).alias("query_id"), "question", F.coalesce("gold_chunk_ids", none).alias("gold_chunk_ids"), F.coalesce("gold_doc_ids", none).alias("gold_doc_ids"), F.coalesce("gold_answer", F.lit("")).alias("gold_answer"))
