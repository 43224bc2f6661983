"""A corpus from raw documents: toxic ones go, exact and near copies go, secrets are masked, the rest is packed.

In every stage a null text counts as an empty one, whole texts are judged however long, columns of any name pass through, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import exact, near, packing, secrets, toxicity
from tesserae.llm.common import remove, table, written


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic by a model of the labelled ones; equal texts share a verdict, rows without an id are judged too."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, once if its row repeats; one without an id only where none has one. Empty texts are equal."""
    return exact.keep_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; rows without an id, words or text stay, and rows of one doc_id go together."""
    return near.keep_near(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with what looks like a secret masked; n_chars follows. A null text stays null."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its place in a sequence; each of repeated rows has its own."""
    return packing.packed(docs)


STAGES = [("toxicity", toxic_stage), ("exact", exact_stage), ("near", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: The first stage is a model and the last a genetic search: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            remove(before)
    return docs
