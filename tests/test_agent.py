"""The loop's cost: what a round retrieves is computed once."""

from pyspark.sql import functions as F

from tesserae.operators import agent
from tesserae.session import with_checkpoints


def test_a_round_retrieves_once(spark, tmp_path):
    with_checkpoints(spark)

    def run(batches):
        for b in batches:
            with open(tmp_path / "read", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    def units(q):
        rows = q.select("query_id", F.col("text").alias("query"), F.lit("c1").alias("chunk_id"), F.lit("d1").alias("doc_id"), F.lit("alpha beta gamma delta are words here.").alias("text"), F.lit("").alias("window_text"))
        rows = rows.mapInArrow(run, rows.schema)
        return rows.withColumns({"heading": F.lit(""), "heading_path": F.array().cast("array<string>"), "metadata": F.create_map(F.lit("source"), F.lit("s")), "score": F.lit(1.0), "rank": F.lit(1), "rerank_score": F.lit(None).cast("double"), "channels": F.create_map(F.lit("bm25"), F.lit(1.0))})

    got = agent.run(spark.createDataFrame([("q1", "alpha beta gamma")], "query_id string, text string"), units).collect()
    assert len(got) == 1 and got[0]["retrieved_so_far"] == got[0]["round"] == 1
    assert (tmp_path / "read").read_text() == "x"  # twice before: for the count and for the units
