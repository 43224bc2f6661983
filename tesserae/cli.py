"""Command line: index, search, query, eval, stress, doctor, webtest, demo."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tesserae")
    p.add_argument("--config")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index")
    x.add_argument("paths", nargs="+")
    x.add_argument("--strategy", choices=["structural", "hierarchical", "semantic"])
    for name in ("search", "query"):
        x = sub.add_parser(name)
        x.add_argument("text")
        x.add_argument("--k", type=int)
    for name in ("eval", "stress"):
        x = sub.add_parser(name)
        x.add_argument("cases")
        x.add_argument("--k", type=int, default=5)
        x.add_argument("--paths", nargs="*", default=[])
    sub.add_parser("doctor")
    x = sub.add_parser("webtest")
    x.add_argument("text")
    x = sub.add_parser("demo")
    x.add_argument("paths", nargs="+")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    from dataclasses import replace

    from .config import Settings
    from .engine import Engine
    from .sources.files import load_cases, load_documents

    a = parser().parse_args(args)
    cfg = Settings.from_file(a.config) if a.config else Settings()
    if a.store:
        cfg.store = a.store
    if getattr(a, "strategy", None):
        cfg.chunking = replace(cfg.chunking, strategy=a.strategy)
    if a.command == "webtest":
        from .sources.web import reachable, search

        print(json.dumps({"reachable": reachable(), "hits": search(a.text)}, ensure_ascii=False, indent=1))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tesserae").getOrCreate()
    engine = Engine(spark, cfg)
    ask = lambda text: spark.createDataFrame([("q", text)], "query_id string, text string")
    if a.command in ("index", "demo"):
        print(json.dumps(engine.index_paths(a.paths)))
    if a.command == "search":
        engine.retrieve(ask(a.text), top_k=a.k).orderBy("rank").select("rank", "chunk_id", "score", "heading", "text").show(truncate=80)
    elif a.command == "query":
        if a.k:
            cfg.retrieval.top_k = a.k
        row = engine.answer(ask(a.text)).first()
        print(row["text"] or "(no answer)")
    elif a.command == "eval":
        engine.evaluate(load_cases(spark, a.cases), a.k).show()
    elif a.command == "stress":
        cases = load_cases(spark, a.cases)
        documents = load_documents(spark, a.paths)
        places = iter(range(100))

        def measure(corpus):
            level = Engine(spark, replace(cfg, store=f"{cfg.store}-stress-{next(places)}"))
            level.index(corpus.withColumn("title", corpus["doc_id"]))
            return level.evaluate(cases, a.k)

        engine.stress(documents, measure).orderBy("level").show()
    elif a.command == "doctor":
        print(json.dumps(engine.doctor(), indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
