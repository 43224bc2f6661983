"""Language ID: the models against a brute-force Kneser-Ney, held-out accuracy, and odd inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.llm import language


def brute(counts, alphabet):
    """log P of a word by the textbook's recursion over dicts."""
    n, d = language.ORDER, language.DISCOUNT
    top, before = Counter(), defaultdict(set)
    for w, c in counts.items():
        s = " " * (n - 1) + w + " "
        for i in range(n - 1, len(s)):
            top[s[i - n + 1 : i + 1]] += c
            for m in range(1, n):
                before[s[i - m + 1 : i + 1]].add(s[i - m : i + 1])
    table = {n: top} | {m: Counter({g: len(x) for g, x in before.items() if len(g) == m}) for m in range(1, n)}
    total, kinds = defaultdict(float), defaultdict(int)
    for m, grams in table.items():
        for g, c in grams.items():
            total[m, g[:-1]] += c
            kinds[m, g[:-1]] += 1

    def p(g, m):
        if m == 0:
            return 1 / alphabet
        g = g[-m:]
        lower = p(g, m - 1)
        if not total[m, g[:-1]]:
            return lower
        return max(table[m][g] - d, 0) / total[m, g[:-1]] + d * kinds[m, g[:-1]] / total[m, g[:-1]] * lower

    def cost(w):
        s = " " * (n - 1) + w + " "
        return -sum(math.log(p(s[i - n + 1 : i + 1], n)) for i in range(n - 1, len(s)))

    return cost


def test_against_brute_force():
    counts = Counter({"banana": 3, "band": 1, "ananas": 2, "a": 5, "é": 1})
    model, cost = language.KneserNey(counts, 9), brute(counts, 9)
    batch = ["banana", "bad", "zzz", "a", "é", "anand"]
    assert np.allclose(model.costs(language.Grams(batch)), [cost(w) for w in batch])
    both = language.Model({"x": model, "y": language.KneserNey(Counter({"bad": 2}), 9)}, (np.zeros(1), np.ones(1)))
    assert np.allclose(both.costs(language.Grams(batch))[:, 0], [cost(w) for w in batch])


def texts(n=400):
    rng = random.Random(2)
    parts = {"aa": ["ka", "ru", "mo", "ti"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["eux", "oi", "tre", "que"]}
    for i in range(n):
        x = rng.choice(list(parts))
        yield i, " ".join("".join(rng.choices(parts[x], k=rng.randint(1, 4))) for _ in range(rng.randint(2, 30))), x


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in texts()], "doc_id long, text string, lang string, score double").repartition(3)
    return docs, language.fit(docs)


def test_held_out_accuracy(fitted):
    docs, model = fitted
    got = language.predict_language(docs, model).where("held_out").collect()
    truth = {i: x for i, _, x in texts()}
    assert len(got) > 60 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.98


def test_odd_rows(spark, fitted):
    _, model = fitted
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "karu " * 50000), (None, "eux"), (6, "中文 \U0001f600"), (6, "中文 \U0001f600")]
    got = language.predict_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in got][:3] == ["und"] * 3 and [r["score"] for r in got][:3] == [0] * 3
    assert got[3]["lang_pred"] == "aa" and got[4]["held_out"] is None and got[5] == got[6]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(i, "ab cd", None) for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict_language(docs, language.fit(docs)).collect()} == {"und"}
    assert language.predict_language(docs.limit(0), language.fit(docs.limit(0))).count() == 0
