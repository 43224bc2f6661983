"""Gold of passages, and what is computed once."""

from tesserae.operators import metrics


def test_holders_of_passages_with_and_without_an_inner_word(spark):
    texts = ["one long sentence here", "x one long sentence herein", "one  long sentence here", "检索增强", "a 检索增强 b", "", None, "one\nlong\nsentence"]
    asked = ["one long sentence here", "检索", "one long", "", None, "long\nsentence", "absent words stand nowhere"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = metrics.holders(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), docs)
    want = {(q, d) for q, p in enumerate(asked) for d, t in enumerate(texts) if p is not None and t is not None and p in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert metrics.holders(spark.createDataFrame([(1, None)], "query_id long, text string"), docs).count() == 0


def test_generation_computes_the_answers_once(spark, tmp_path):
    def run(batches):
        for b in batches:
            with open(tmp_path / "read", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    rows = spark.createDataFrame([("q1", "alpha beta", "alpha", 1.0, 0.5, True), ("q2", "gamma", "delta", 0.0, 0.5, False)], "query_id string, query string, text string, groundedness double, citation_coverage double, answerable boolean")
    got = metrics.generation(rows.mapInArrow(run, rows.schema)).first()
    assert (got["faithfulness"], got["citation_coverage"], got["answerable_rate"]) == (0.5, 0.5, 0.5)
    assert (tmp_path / "read").read_text() == "xx"  # three times before
