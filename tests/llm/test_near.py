"""Near duplicates against a brute-force version."""

import random
import re

import pytest

from tesserae.llm import near


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    while len(rows) < n:
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 40, 90, 150, 400]))]
        if rng.random() < 0.4:
            words[rng.randrange(len(words)) : 0] = passage
        for _ in range(rng.choice([1, 1, 2, 8])):
            words = list(words)  # a chain: each copy edits the one before
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((rng.randrange(10**6) * 1000 + len(rows), rng.choice([" ", "  ", "\n\t"]).join(words)))
    return rows + [(-5, None), (-4, ""), (-3, " \n"), (-2, "A b C"), (-1, "a B c"), (7, "É x"), (8, "é x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, n int, k1 int").repartition(3)
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == brute(rows)


def test_a_family_of_edits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "SHORT", 4)
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(5000)]
    rows = []
    for size in (150, 90):
        base = [rng.choice(vocab) for _ in range(size)]
        for i in range(70):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) * 7 + size, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == brute(rows)


def test_a_link_whose_sketches_share_few_values(spark):
    rng = random.Random(3)
    base = [f"u{rng.randrange(10**7)}" for _ in range(2004)]
    at = {int(near.shingles(" ".join(base[i : i + 5]))[0]): i for i in range(2000)}
    words = list(base)
    for edits, h in enumerate(sorted(at), 1):  # edits fall on the shingles of the sketch
        words[at[h] + 2] = f"x{edits}"
        a, b = (near.shingles(" ".join(w)) for w in (base, words))
        union = sorted(set(a.tolist()) | set(b.tolist()))
        shared = len(set(union[: near.K]) & set(a.tolist()) & set(b.tolist()))
        if shared < 40:
            break
    assert 34 <= shared < 40 and 100 * len(set(a.tolist()) & set(b.tolist())) >= 85 * len(union)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(words))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.near_duplicates(docs).where("kept").collect()) == [1]


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near.near_duplicates(docs).where("doc_id IS NOT NULL").collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert near.near_duplicates(docs.limit(0)).count() == 0
    assert near.keep_near(docs).columns == ["doc_id", "text"]
