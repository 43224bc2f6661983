"""Exact duplicates against a brute-force version."""

import hashlib
from collections import defaultdict

from tesserae.llm import exact

ROWS = [
    (1, "a b"), (2, "a b"), (3, "a  b"), (4, None), (5, ""), (6, "x" * 100 + "1"), (7, "x" * 100 + "2"), (8, "x" * 100 + "1"),
    (9, "é" * 50000), (10, "é" * 50000), (11, "unique"), (12, "A b"), (13, "last"), (13, "last"),
]


def docs(spark):
    return spark.createDataFrame([(i, t, 1, "h") for i, t in ROWS], "doc_id long, text string, n_bytes int, head string")


def test_against_brute_force(spark):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted(map(tuple, exact.exact_duplicates(docs(spark)).collect())) == want


def test_one_row_of_each_group_stays(spark):
    kept = exact.keep_exact(docs(spark))
    assert kept.columns == ["doc_id", "text", "n_bytes", "head"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7, 8, 10, 11, 12, 13]


def test_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.exact_duplicates(rows).collect()}
    assert got == {(None, 1, False), (1, 1, True), (None, None, True)}
    assert exact.exact_duplicates(rows.limit(0)).count() == 0
    kept = exact.keep_exact(rows).collect()
    assert sorted(map(tuple, kept), key=str) == [(1, "a"), (None, "b")]
