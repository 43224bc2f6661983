"""URL filters against a brute-force version of the rules and of the mined sets."""

import random
import re

import pytest

from tesserae.llm import urls

ODD = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://a.example.org/en/1?x", "http://a.example.org/en/2#f", "http://notexample.org/es/", "http://org/x",
    "http://x.com/fr/", "http://x.com/de/y/http://z.org/", "http://x.com?q=/fr/", "http://x.org", "ftp://Y.ORG#/es/", "http://İ.example.org/es/", "a" * 5000, "http://x.net/" + "p/" * 5000,
]


def split(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def corpus():
    rng = random.Random(1)
    good = [f"http://{rng.choice(['www', 'm'])}.site{rng.randrange(9)}.example.net/{rng.choice(['en', 'fr'])}/{rng.randrange(999)}" for _ in range(260)]
    bad = [f"http://{rng.choice(['www', 'm'])}.cheap-pills.example.net/{rng.choice(['en', 'fr'])}/{rng.randrange(999)}?utm_source=x" for _ in range(60)]
    return [*((u, 1) for u in good), *((u, 0) for u in bad), *((u, 1) for u in ODD)]


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus()
    pages = spark.createDataFrame([(i, u, "block") for i, (u, _) in enumerate(rows)], "page_id long, url string, verdict string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(rows) if i % 2 == 0], "doc_id long, quality int")
    mined = urls.mine(pages, labels)
    return rows, mined.collect(), {r["page_id"]: r for r in urls.judge(pages, labels, mined=mined).collect()}, pages, labels


def test_hosts_paths_and_rules(judged):
    rows, _, got, _, _ = judged
    assert len(got) == len(rows)
    for i, (u, _) in enumerate(rows):
        assert (got[i]["host"], got[i]["path"]) == split(u), u
        name, verdict = rule(*split(u))
        assert got[i]["rule"] == name and (not verdict or got[i]["verdict"] == verdict), u


def test_mined_sets_block_what_they_should(judged):
    rows, mined, got, _, _ = judged
    assert mined and all(r["confidence"] >= urls.CONFIDENCE and 1 <= len(r["items"]) <= urls.LONGEST and r["token"] in r["items"] for r in mined)
    for i, (u, q) in enumerate(rows[:320]):
        assert (got[i]["verdict"] == "block") == (q == 0), u


def test_confidence_and_support_against_brute_force(spark, judged):
    rows, mined, _, pages, labels = judged
    items = {r["page_id"]: set(r["items"]) for r in urls.parsed(pages).select("page_id", urls.tokens().alias("items")).collect()}
    seen = {i: rows[i][1] for i in range(0, len(rows), 2)}
    for r in mined[:50]:
        holds = [q for i, q in seen.items() if set(r["items"]) <= items[i]]
        assert r["support"] == holds.count(0) and abs(r["confidence"] - holds.count(0) / len(holds)) < 1e-12


def test_no_labels_no_rows_and_no_python(spark, judged):
    _, _, _, pages, labels = judged
    none = urls.judge(pages, labels.limit(0))
    assert {r["verdict"] for r in none.where("rule IS NULL").collect()} == {"allow"}
    assert urls.judge(pages.limit(0), labels).count() == 0
    assert not re.search("Python|Pandas|Arrow", urls.judge(pages, labels)._jdf.queryExecution().toString())
