"""Repeated passages against a brute-force version, and the suffix array against Python's sort."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import repeats

N = repeats.LENGTH


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + N] for _, b in raw for k in range(len(b) - N + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - N + 1):
            if seen[b[k : k + N]] > 1:
                gone[k : k + N] = b"\1" * N
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(30, 120)) for _ in range(6)]
    rows = [(None, text(60)), (-1, None), (-2, ""), (-3, "a" * 700), (-4, "b" * 199), (-5, "ab" * 150), (-6, "x" + "ab" * 100), (-7, "c" * 200), (-8, "c" * 200)]
    for i in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : rng.randint(2 * len(p) // 3, len(p))], text(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(100, rows[20][1]), (101, rows[20][1][:-1] + "q"), (102, rows[21][1]), (102, rows[21][1]), (103, text(40)), (103, text(40))]
    return rows


@pytest.mark.parametrize("crowd", [2048, 3, 1])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, cut int").repartition(3)
    got = repeats.remove_repeats(docs).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_many_texts_of_a_null_id_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(230)
    # A block of the passage alone in each text, at another place: 1,200 texts share 15 bits of a hash in some 22 pairs.
    rows = [(None, text(rng.randint(1, 150)) + passage + text(rng.randint(1, 150))) for _ in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(docs).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_very_long_text(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    filler = np.random.default_rng(2).integers(97, 123, 10_000_000).astype(np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, filler[:5_000_000] + passage + filler[5_000_000:]), (2, "x" + passage)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert [(x["lo"], x["hi"]) for x in got[1]["removed"]] == [(5_000_000, 5_001_000)] and got[1]["kept_sha256"] == hashlib.sha256(filler.encode()).hexdigest()
    assert [got[2][c] for c in ("n_bytes", "n_removed", "n_spans")] == [1001, 1000, 1]


def test_no_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_against_sort(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, [2, 3, 250][seed % 3], 400).astype(np.uint8)
    t[50:120] = t[200:270]
    got = repeats.suffix_array(t, 200)
    assert sorted(got.tolist()) == list(range(400))
    firsts = [bytes(t[i : i + 200]) for i in got]
    assert firsts == sorted(firsts)
    a, b = got[:-1], got[1:]
    want = [next((k for k in range(200) if bytes(t[i : i + k + 1]) != bytes(t[j : j + k + 1]) or max(i, j) + k >= 400), 200) for i, j in zip(a, b, strict=True)]
    assert all(x >= y for x, y in zip(repeats.common_prefix(t, a, b), want, strict=True))


def test_long_texts_are_cut_between_windows(monkeypatch):
    rng = random.Random(3)
    raw = bytes(rng.choice(b"abcd") for _ in range(5000))
    ends = np.array([1000, 1100, 5000])
    whole = {w for a, b, _, _ in repeats.blocks(raw, ends) for w in range(a, b + 1)}
    monkeypatch.setattr(repeats, "CHUNK", 300)
    cut = [w for a, b, _, _ in repeats.blocks(raw, ends) for w in range(a, b + 1)]
    assert len(cut) == len(set(cut)) and set(cut) == whole == {w for s, e in ((0, 1000), (1000, 1100), (1100, 5000)) for w in range(s, e - N + 1)}
