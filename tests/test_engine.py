"""The engine on a few documents: indexing, retrieval, answers, measures; and the driver's contract."""

import json
from dataclasses import replace

import pytest

from tesserae.config import Settings, load
from tesserae.engine import Engine
from tesserae.operators import agent, answer, chunk, retrieve
from tesserae.sources.files import load_cases, load_documents

PAGES = {
    "fusion.md": "# Fusion\n\nRank fusion adds reciprocal ranks of several channels; the constant is 60!\n\n## Weights\n\nWeights favour the lexical channel in small corpora!",
    "chunks.md": "# Chunks\n\nChunks follow headings and sentences; a parent holds several children!\n\n## Overlap\n\nNeighbouring chunks share their last sentences!",
    "blank.md": "  \n",
    "other.bin": "not text",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    for name, text in PAGES.items():
        (path / name).write_text(text)
    return path


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, Settings(store=str(tmp_path_factory.mktemp("store")), embed_dim=64, chunking=chunk.Chunking(strategy="hierarchical")))
    assert e.index_paths(str(folder))["documents"] == 2
    return e


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_files(spark, folder):
    rows = {r["title"]: r for r in load_documents(spark, str(folder)).collect()}
    assert set(rows) == {"Fusion", "Chunks"} and rows["Fusion"]["metadata"]["suffix"] == ".md"


def test_indexing_skips_what_is_there_and_replaces_what_changed(spark, engine, folder):
    again = engine.index_paths(str(folder))
    assert again["documents"] == 0 and again["skipped"] == 2
    new = load_documents(spark, str(folder)).where("title = 'Chunks'").selectExpr("doc_id", "concat(text, ' Zebras!') AS text", "source", "title", "metadata")
    assert engine.index(new)["documents"] == 1
    texts = [r["text"] for r in engine.store.load_chunks().collect()]
    assert any("Zebras" in t for t in texts) and engine.store.counts()["documents"] == 2


def test_retrieval_ranks_the_right_document_first(spark, engine):
    units = engine.retrieve(asked(spark, "reciprocal rank fusion constant", "parent children chunks", "")).collect()
    first = {u["query_id"]: u for u in units if u["rank"] == 1}
    assert first["q0"]["heading_path"][0] == "Fusion" and first["q1"]["heading_path"][0] == "Chunks" and "q2" not in first
    assert {"bm25", "dense"} <= set(first["q0"]["channels"])
    only = engine.retrieve(asked(spark, "fusion chunks"), {"heading_contains": "overlap"}).collect()
    assert only and all("Overlap" in u["heading_path"] for u in only)


def test_answers_are_cited_and_grounded(spark, engine):
    rows = {r["query_id"]: r for r in engine.answer(asked(spark, "what is the constant of rank fusion", "zzz qqq"), agentic=False).collect()}
    assert rows["q0"]["answerable"] and "[1]" in rows["q0"]["text"] and rows["q0"]["groundedness"] == 1.0
    assert rows["q0"]["delivered"] <= rows["q0"]["retrieved"] and rows["q0"]["citations"][0]["index"] == 1
    looped = {r["query_id"]: r for r in engine.answer(asked(spark, "what is the constant of rank fusion", "zzz qqq")).collect()}
    assert looped["q0"]["answerable"] and not looped["q1"]["answerable"] and looped["q1"]["stop"] == "no_lexical_hit"


def test_a_model_grades_and_what_it_leaves_out_is_graded_by_words(spark, engine):
    units = engine.retrieve(asked(spark, "reciprocal rank fusion constant", "parent children chunks"))
    plain = {(r["query_id"], r["rank"]): (r["label"], r["grade_score"]) for r in agent.grade(units).collect()}

    def model(prompt, system="", temperature=0.2, max_tokens=0):
        if "parent" in prompt.split("\n")[1]:
            raise OSError("away")
        return 'So: [{"index": 1, "label": "Irrelevant", "score": "0.1"}, {"index": 99, "label": "relevant"}, {"index": 2, "label": "fine"}, 7]'

    rows = agent.graded_by(model)(units).collect()
    got = {(r["query_id"], r["rank"]): (r["label"], r["grade_score"]) for r in rows}
    assert got == {**plain, ("q0", 1): ("irrelevant", 0.1)} and plain[("q0", 1)][0] == "relevant"
    assert {r["chunk_id"]: r["channels"] for r in rows} == {r["chunk_id"]: r["channels"] for r in units.collect()}
    for said in ("no", "{}", ""):
        rows = agent.graded_by(lambda *a, said=said, **k: said)(units).collect()
        assert {(r["query_id"], r["rank"]): (r["label"], r["grade_score"]) for r in rows} == plain


def test_context_keeps_the_budget():
    units = [{"chunk_id": f"c{i}", "best": " ".join(["word"] * 10 + [f"w{i}"]), "final": 1 - i / 10} for i in range(6)]
    chosen = answer.select_context(units, 35)
    assert [u["chunk_id"] for u in chosen] == ["c0", "c2", "c1"]
    assert [u["chunk_id"] for u in answer.select_context([*units, units[0]], 1000, "best")] == [f"c{i}" for i in range(6)]


def test_fusion_by_hand(spark):
    hits = spark.createDataFrame([("q", "a", "bm25", 3.0), ("q", "b", "bm25", 1.0), ("q", "b", "dense", 0.9)], "query_id string, chunk_id string, channel string, score double")
    rrf = {r["chunk_id"]: r["score"] for r in retrieve.fuse(hits, retrieve.Retrieval()).collect()}
    assert abs(rrf["a"] - 1 / 61) < 1e-12 and abs(rrf["b"] - (1 / 62 + 1 / 61)) < 1e-12
    weighted = {r["chunk_id"]: r["score"] for r in retrieve.fuse(hits, retrieve.Retrieval(fusion="weighted")).collect()}
    assert weighted == {"a": 1.0, "b": 0.0}  # a lone hit of a channel scores nothing


def test_rewriting_takes_the_gap(spark):
    row = spark.sql("SELECT 'q' q, array('x', 'y') g, array('s') s").select(agent.rewritten(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "qgs")).alias("r")).first()
    assert row["r"] == "q x y"


def test_evaluation(spark, engine, tmp_path):
    path = tmp_path / "cases.jsonl"
    ids = {r["title"]: r["doc_id"] for r in engine.store.read("documents").collect()}
    path.write_text("\n".join(json.dumps({"question": q, "gold_doc_ids": [ids[t]]}) for q, t in (("reciprocal rank fusion", "Fusion"), ("parent holds children", "Chunks"))))
    row = engine.evaluate(load_cases(spark, str(path))).first()
    assert row["queries"] == 2 and row["mrr"] == 1.0


def test_settings_extend_and_a_cycle_fails(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("extends: b.yaml\nretrieval: {top_k: 3}\n")
    (tmp_path / "b.yaml").write_text("agentic: false\nretrieval: {top_k: 5, rrf_k: 7}\n")
    cfg = Settings.from_file(tmp_path / "a.yaml")
    assert (cfg.retrieval.top_k, cfg.retrieval.rrf_k, cfg.agentic.enabled) == (3, 7, False)
    (tmp_path / "b.yaml").write_text("extends: a.yaml\n")
    with pytest.raises(ValueError):
        load(tmp_path / "a.yaml")
    assert replace(cfg, llm="none").llm == "none"


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
