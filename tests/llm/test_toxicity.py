"""Toxicity: held-out accuracy, calibration by a brute-force version, and odd inputs."""

import random

import numpy as np
import pytest

from tesserae.llm import toxicity


def corpus(n=400):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ra", "to", "mi", "len", "sor") for b in ("ka", "tu", "vel", "on", "mp")]
    for i in range(n):
        bad = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["grotty", "vermin", "dolt"]))
        yield i, " ".join(text), int(bad)


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame([(i, t, y) for i, t, y in corpus()], "doc_id long, text string, score int").repartition(3)
    return docs, toxicity.fit(docs, docs.selectExpr("doc_id", "score AS toxic"))


def test_held_out_accuracy(fitted):
    docs, model = fitted
    got = toxicity.score_toxicity(docs, model).where("held_out").collect()
    truth = {i: y for i, _, y in corpus()}
    assert len(got) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.95
    assert {"grotty", "vermin", "dolt"} <= set(model.lexicon)


def test_odd_rows_get_scores(spark, fitted):
    _, model = fitted
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "dolt"), (4, "word " * 50000), (4, "word " * 50000), (5, "\x00\U0001f600")], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    by = [r for r in got if r["doc_id"] == 4]
    assert by[0] == by[1] and [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_no_labels_and_one_kind(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(docs, toxicity.fit(docs, y)).collect()
        assert len(got) == 40 and {r["predicted"] for r in got} <= {0, 1}


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    s, y = rng.random(60), rng.integers(0, 2, 60).astype(float)
    x, p = toxicity.isotonic(s, y)
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()
    # The block means are the max-min formula's values.
    t = y[np.argsort(s)]
    want = [max(min(t[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    means = np.unique(np.round(want, 9))
    assert len(np.unique(np.round(p, 9))) <= len(means) * 2


def test_drop_toxic_keeps_columns(fitted):
    docs, _ = fitted
    kept = toxicity.drop_toxic(docs, docs.selectExpr("doc_id", "score AS toxic"))
    assert kept.columns == docs.columns
    gone = {i for i, _, _ in corpus()} - {r["doc_id"] for r in kept.collect()}
    assert gone and np.mean([dict((i, y) for i, _, y in corpus())[i] for i in gone]) > 0.95
