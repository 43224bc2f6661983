"""The pipeline's stages one after the other, on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from tesserae.llm import near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "l", "st")]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, labels = [], []
    for i in range(300):
        words = text(rng.randint(60, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "dolt", "grotty"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    base = text(150)
    near = [*base[:70], "changed", *base[71:]]
    docs += [(1000, "exact copy of a text"), (1001, "exact copy of a text"), (1002, " ".join(base)), (1003, " ".join(near)), (1004, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (1005, "long " * 5000), (1006, None)]
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        left[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    gone = set(range(300)) - set(left["toxicity"])
    assert len(gone & set(range(0, 300, 4))) >= 73 and len(gone - set(range(0, 300, 4))) <= 1
    assert set(left["toxicity"]) - set(left["exact"]) == {1000}
    assert set(left["exact"]) - set(left["near"]) == {1003}
    assert set(left["secrets"]) == set(left["near"]) == set(left["packing"])
    assert left["secrets"][1004]["text"] == '[secret]" end' and left["secrets"][1006]["text"] is None


def test_run_gives_every_piece(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert sorted(r["piece"] for r in rows if r["doc_id"] == 1005) == [0, 1, 2]


def test_near_stage_links_from_eight_tenths_on(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
    apart = lambda places: " ".join("changed" if i in places else w for i, w in enumerate(base))
    # An edit within takes five shingles: 180 of 220 are common with four (0.82), 175 of 225 with five (0.78).
    rows = [(1, " ".join(base)), (2, apart({20, 60, 100, 140})), (10, " ".join(reversed(base))), (11, " ".join("other" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(reversed(base))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == [1, 10, 11]
    assert sorted(r["doc_id"] for r in near.near_duplicates(docs).where("kept").collect()) == [1, 2, 10, 11]


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.secret_stage])
def test_stages_with_odd_rows_and_clashing_names(spark, stage):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (1, words), (2, words), (None, words), (None, None), (3, None), (4, ""), (4, "")]
    names = ("_chosen", "_row", "row", "sha", "place", "found", "n_bytes", "component_id")
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    got = stage(spark, docs, "")
    left = got.collect()
    assert got.columns == docs.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in left)
    kept = sorted(((r["doc_id"], r["text"] or "") for r in left), key=str)
    if stage is corpus_pipeline.exact_stage:
        assert kept == sorted([(2, words), (4, "")], key=str)
    elif stage is corpus_pipeline.near_stage:
        assert kept == sorted(((i, t or "") for i, t in rows if (i, t) != (2, words)), key=str)
    else:
        assert kept == sorted(((i, t or "") for i, t in rows), key=str)
    assert stage(spark, docs.limit(0), "").count() == 0
