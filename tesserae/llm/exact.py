"""Exact duplicates by progressive refinement: length, then the hash of a prefix, then the hash of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

PREFIX = 64


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, head (hash of the first characters), sha (SHA-256 of all)."""
    t = texts(docs)
    return t.select("doc_id", F.octet_length("text").alias("n_bytes"), F.xxhash64(F.substring("text", 1, PREFIX)).alias("head"), F.unhex(F.sha2("text", 256)).alias("sha"))


def exact_groups(digest: DataFrame) -> DataFrame:
    """The groups of two rows or more: n_bytes, head, sha, keep_id, group_size.

    Each step compares only what the step before left: rows of a length that occurs once never meet a prefix
    hash, rows of a prefix that occurs once never a full hash. All three are sums by key that are combined
    before the shuffle, so the size of a group doesn't matter. They are written down, so that a join behind them deals out
    both sides itself and Spark can split the part of a length or text that many rows share.
    """
    lengths = digest.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes")
    left = digest.join(written(lengths), "n_bytes", "left_semi")
    heads = left.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes", "head")
    left = left.join(written(heads), ["n_bytes", "head"], "left_semi")
    return left.groupBy("n_bytes", "head", "sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text is an empty one. Of equal texts the row with the largest
    doc_id stays. Whole rows that repeat share that doc_id: kept is true on each of them, and ``keep_exact``
    leaves one. A null doc_id loses to any other; a group of null ids alone has keep_id null and kept true. No
    rows give no rows.

    The text is read once; its digests are written down and the rest works on some 60 bytes a row.
    """
    digest = written(digests(docs))
    groups = written(exact_groups(digest))
    keys = ["n_bytes", "head", "sha"]
    return digest.join(groups, keys, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns; rows without an id go by text.

    Texts as in ``exact_duplicates``. Lengths and prefix hashes are counted first; the full hash is taken only of texts whose length
    and prefix occur twice, and only they are compared: all other rows stay as they are, and aren't hashed. Of rows that
    share the largest doc_id one stays. Columns of any name pass through. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("head"))
    shapes = own.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes", "head")
    shapes = written(shapes)
    alone = own.join(shapes, ["n_bytes", "head"], "left_anti").select("row.*")
    again = own.join(shapes, ["n_bytes", "head"], "left_semi").withColumn("sha", F.sha2(F.coalesce("row.text", F.lit("")), 256))
    # One number for each row and table, so that of rows with one doc_id one can be named.
    hashed = written(again.withColumn("place", F.monotonically_increasing_id()))
    stay = hashed.groupBy("n_bytes", "head", "sha").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "place")).alias("best")).select(F.col("best.place").alias("place"))
    kept = hashed.join(written(stay), "place", "left_semi").select("row.*")
    return alone.unionByName(kept)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
