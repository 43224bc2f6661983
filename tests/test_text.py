"""Facts about text functions, for the Catalyst and the Python form alike."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.functions import segment, text

FACTS = [("检索增强", ["检索", "索增", "增强"]), ("猫", ["猫"]), ("BM25+ cross-encoder 2026", ["bm25", "cross-encoder", "2026"]), ("RAG", ["rag"]), ("café 3.14.1 a_b", ["caf", "3.14", "1", "a_b"]), ("", []), ("x检 y索引z", ["x", "检", "y", "索引", "z"])]


@pytest.fixture(scope="module")
def column(spark):
    def run(values, f, *a):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r["x"] for r in df.select("i", f("t", *a).alias("x")).orderBy("i").collect()]

    return run


def test_tokens(column):
    values, want = zip(*FACTS, strict=True)
    assert column(values, text.tokens) == list(want) == [list(segment.tokens(v)) for v in values]
    assert column(["检索"], text.tokens, True) == [["检", "索", "检索"]] == [list(segment.tokens("检索", True))]


def test_content_tokens_keep_duplicates(column):
    t = "the ranking of the ranking is a test"
    assert column([t], text.content_tokens) == [["ranking", "ranking", "test"]] == [list(segment.content_tokens(t))]


def test_counts_grams_and_overlap(spark, column):
    assert column(["检索 RAG", "a b 2.5"], text.count_tokens) == [3, 3] == [segment.count_tokens("检索 RAG"), segment.count_tokens("a b 2.5")]
    values = ["Ab c", "a", "", " x y\tz w"]
    assert column(values, text.char_ngrams) == [["abc"], ["a"], [], ["xyz", "yzw"]] == [segment.char_ngrams(v) for v in values]
    row = spark.sql("SELECT array('a','a','b') w, array('a','c') h").select(text.overlap("w", "h").alias("o"), text.coverage("w", "h").alias("c")).first()
    assert abs(row["o"] - 2 / 3) < 1e-12 and row["c"] == 0.5


def test_sentences():
    assert segment.sentences("第一句。第二句！Third one? yes")[:2] == ("第一句。", "第二句！")
    assert segment.sentences("one\n\ntwo") == ("one", "two")
    assert len(segment.sentences("see e.g. this one")) == 1
    assert segment.sentences("！？。") == ()
    assert segment.sentences("a b! c\n\nd") == ("a b! c", "d")  # a blank line doesn't cut inside


def test_sections_nest_and_units_keep_fences():
    doc = "intro\n# T\nx\n## A\ny\n## B ##\nz\n# U\nw"
    got = segment.sections(doc)
    assert [s[0] for s in got] == [("T",), ("T", "A"), ("T", "B"), ("U",)]
    assert got[0][3] == "x\n## A\ny\n## B ##\nz" and doc[got[1][1] : got[1][2]] == "## A\ny\n"
    fence = "`" * 3
    assert segment.units(f"a? b\n{fence}\ncode? here\n{fence}\nc") == ["a?", "b", f"{fence}\ncode? here\n{fence}", "c"]


def test_packing_overlap_and_merging():
    parts = [f"w{i} x y z" for i in range(6)]
    assert segment.pack(parts, 8, 0, 4) == [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
    assert segment.pack([*parts[:2], "tail"], 8, 3, 0) == [" ".join([*parts[:2], "tail"])]
    assert segment.pack([], 8, 3, 0) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab 检索!?.\n", max_size=30), max_size=8), st.integers(1, 20))
def test_packing_keeps_all_words(parts, most):
    parts = [p for p in parts if p.strip()]
    assert " ".join(segment.pack(parts, most, 0, 0)) == " ".join(parts)


def test_hard_split():
    long = " ".join(["word"] * 2000)
    assert [segment.count_tokens(p) for p in segment.hard_split(long)] == [900, 900, 200]


def test_grams_of_a_long_text_are_made_in_one_pass(column):
    import time

    values = ["𝒳a\n𝒴bc", "ab" * 400_000]
    began = time.time()
    got = column(values, text.char_ngrams)
    assert got[0] == ["𝒳a𝒴", "a𝒴b", "𝒴bc"] and len(got[1]) == 799_998 and set(got[1]) == {"aba", "bab"}
    assert time.time() - began < 30
