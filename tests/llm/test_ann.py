"""Nearest neighbours: recall against brute force, exact scores and ties, and odd vectors."""

import math

import numpy as np
import pytest

from tesserae.llm import ann


def brute(rows, top=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in (i for i in good if i % every == 0):
        near = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out[q] = near[:top]
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    points = centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    points *= rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    copies = [(5000 + i, rows[3][1]) for i in range(400)]  # a vector that many rows share
    odd = [(6000, None), (6020, []), (6040, [0.0] * 16), (6060, [None] * 16), (6080, [float("nan")] + [1.0] * 15), (6100, [float("inf")] * 16), (None, rows[0][1]), (6120, [1.0, 2.0]), (6121, [2.0, 1.0]), (7, rows[7][1])]
    rows += copies + odd
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in ann.nearest(vectors, shard=500).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return brute(rows), got, dict(rows)


def test_recall_against_brute_force(case):
    want, got, _ = case
    assert set(got) == {q for q, near in want.items() if near}
    found = [len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) / len(want[q]) for q in got]
    assert np.mean(found) >= 0.97


def test_scores_ranks_and_ties(case):
    want, got, vectors = case
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, len(want[q]) + 1))
        assert all(abs(s - np.dot(np.array(vectors[q], float), np.array(vectors[i], float))) < 1e-9 for _, i, s in near)
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near) and q not in [i for _, i, _ in near]
    assert [i for _, i, _ in got[5000]] == [i for _, i in want[5000]]  # copies, the smallest ids first


def test_few_and_no_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(rows).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.nearest(rows).count() == 2 and ann.nearest(rows.limit(0)).count() == 0 and ann.nearest(rows.where("vec_id = 0")).count() == 0


def test_one_vector_for_each_id(spark):
    rows = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 3.0]), (1, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>").repartition(4)
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(rows).orderBy("rank").collect()] == [(2, 4.0), (1, 3.0)]


def test_pruning_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)).astype(np.float32)
    norms = (x**2).sum(1)
    got = ann.prune(x, norms, np.array([0]), np.arange(40)[None], 1.2, 8)[0]
    left = sorted(range(1, 40), key=lambda i: np.linalg.norm(x[0] - x[i]))
    want = []
    while left and len(want) < 8:
        p = left.pop(0)
        want.append(p)
        left = [i for i in left if 1.2 * np.linalg.norm(x[p] - x[i]) > np.linalg.norm(x[0] - x[i])]
    assert [i for i in got if i >= 0] == want
