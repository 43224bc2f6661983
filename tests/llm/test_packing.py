"""Packing: ids against the tokenizer, places against a check of every sequence, count against simple best fit."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import packing

TEXTS = [
    (1, None), (2, ""), (3, "Hello, World! it's 2024"), (4, "ΟΔΟΣ ΣΑΣ café İx"), (5, "a\x1cb  c"), (6, "lorem ipsum " * 3000), (7, "x " * 2047),
    (8, "<|endoftext|> <|startoftext|>"), (9, "same"), (9, "same"), (9, "other text"), (None, "no id"), *[(100 + i, "word " * (37 * i % 900)) for i in range(150)],
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([(i, t, 3, 5) for i, t in TEXTS], "doc_id long, text string, piece int, length int").repartition(3)
    return packing.packed(docs).collect()


def test_ids_are_the_tokenizers(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = []
    for i, text in TEXTS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)


def test_sequences_are_gapless_and_few(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = [r["length"] for r in rows]
    simple = packing.best_fit([], list(range(len(lengths))), lengths, 2048)
    assert len(bins) <= len(simple) and len(bins) >= -(-sum(lengths) // 2048)


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert packing.packed(docs.limit(0)).count() == 0
    assert [tuple(r)[1:4] for r in packing.packed(docs).collect()] == [(0, 0, 2)]


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 900, 300).tolist()
    a = packing.best_fit([], list(range(300)), lengths, 2048)
    b = packing.best_fit([[i] for i in range(40)], list(range(40, 300)), lengths, 2048)
    for seed in range(5):
        child = packing.crossover(a, b, lengths, 2048, np.random.default_rng(seed))
        assert sorted(i for x in child for i in x) == list(range(300)) and all(sum(lengths[i] for i in x) <= 2048 for x in child)


@pytest.mark.parametrize("children", [packing.CHILDREN, 200])
def test_evolution_beats_best_fit_decreasing(children):
    # Nine bins hold all to the brim; longest first, best fit joins the wrong pairs and needs eleven.
    lengths = sorted([1044] * 6 + [552] * 6 + [532] * 6 + [472] * 12, reverse=True)
    simple = packing.best_fit([], list(range(len(lengths))), lengths, 2048)
    found = []
    for seed in range(8):
        best = packing.evolve(lengths, [simple], 2048, seed, children=children)
        assert sorted(i for b in best for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 2048 for b in best)
        found.append(len(best))
    assert len(simple) == 11 and max(found) <= 11 and min(found) < 11


def test_districts_pack_as_few_as_best_fit_of_all(spark):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.gamma(1.2, 300, 1500))], "doc_id long, text string")
    rows = packing.packed(docs, district=256).collect()
    lengths = [r["length"] for r in rows]
    simple = packing.best_fit([], list(range(len(lengths))), lengths, 2048)
    assert len({r["sequence_id"] for r in rows}) <= len(simple)


@pytest.mark.parametrize("text", ["straße naïve don't we'll 'twas o'clock 3rd x2y 12,345.67%", "a\u0301 e\u0308x \u0130stanbul ﬁn", "emoji😀😀 漢字かな 한국어 " * 3, "w" * 300 + "!" * 90 + " ,,, '' 's", "\x00\x07 \x85 \u2028 \xa0 \u3000 x"])
def test_words_by_steps_are_the_tokenizers(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = packing.Encoder(path).batch([text, "", text.upper(), text * 2])
    assert [g.tolist() for g in got] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in (text, "", text.upper(), text * 2)]


def test_every_character_is_the_tokenizers():
    """All code points, in a word, alone and before a sign: those that only newer Unicode tables know, too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encoder = packing.Encoder(path)
    for first in range(0, 0x110000, 1 << 16):
        chars = [chr(c) for c in range(first, first + (1 << 16)) if not 0xD800 <= c < 0xE000]
        batch = [f"a{c}B {c}, A{c}." for c in chars if first < 0x30000 or ord(c) % 64 == 0]
        want = [[*x.ids, 0] for x in t.encode_batch(batch, add_special_tokens=False)]
        assert [g.tolist() for g in encoder.batch(batch)] == want
