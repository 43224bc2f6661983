"""Byte-level BPE against the tiktoken library, and an exact round trip."""

import hashlib
import random

import public_tokenizers
import tiktoken

from tesserae.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def corpus():
    rng = random.Random(4)
    odd = [None, "", " ", "\n\n  \t x", "it's we'll", "\U0001f600‍éé 中文", "<|endoftext|>", "x" * 30000, "ab" * 200, "-" * 5000, "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(4000))]
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéè") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    return odd + [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(60)]


def test_against_tiktoken(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long").repartition(3)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = want.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), i
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encoded_gives_ids_and_bytes(spark):
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (3, None)], "doc_id long, text string")
    rows = bpe.encoded(docs).collect()
    assert [bytes(r["decoded"]) for r in rows] == [b"same text", b"same text", b""] and rows[0] == rows[1] and rows[2]["ids"] == []
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_heap_and_steps_agree():
    c = bpe.codec()
    words = ["unquestionablygibberish", "aaaaaaaaaaaaaaaaaaaa", "éèéèéèüüüßßß", "thththeheheing"]
    c.learn(set(words))
    assert [c.ids[w] for w in words] == [",".join(map(str, c._by_heap(w.encode()))) for w in words]
