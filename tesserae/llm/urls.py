"""URL filters: a list of rules for hosts and paths, and mined association rules for what no rule fits.

Native: built-in functions and Spark's FP-growth only. Sets of URL tokens that go with a low-quality label become
rules, pruned by support and confidence; an inverted index of their tokens finds those that a URL holds.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import thinned, written

#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The most labelled URLs that the fit takes, or a few more: those with small hashes of their ids.
SAMPLE = 50_000
#: A set of tokens stands in this share of the blocked sample URLs and in so many of them at least, and has so many tokens at most.
SUPPORT, LEAST, LONGEST = 0.005, 5, 3
#: Of the sample URLs that hold the set, this share is blocked.
CONFIDENCE = 0.6


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path; a null URL counts as empty, and without ``://`` host and path are empty.

    Host: behind the first ``://``, up to /, ?, # or the end, A-Z in lower case; path: from there up to ?, # or the end.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    p = p.withColumn("rest", F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')"))
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return p.select("page_id", "url", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def tokens() -> Column:
    """The distinct tokens of a URL: scheme, labels of the host and its ending, words of path and query, marks of their shape."""
    words = F.expr("""concat(
        array(concat('scheme=', lower(substring_index(url, '://', 1)))),
        transform(filter(slice(split(host, '[.]'), 1, greatest(size(split(host, '[.]')) - 2, 0)), x -> x <> ''), x -> concat('host=', x)),
        array(concat('end=', substring_index(host, '.', -2))),
        transform(filter(flatten(transform(filter(split(host, '[.]'), x -> contains(x, '-')), x -> split(x, '-'))), x -> x <> ''), x -> concat('part=', x)),
        transform(filter(split(lower(path), '[/._-]'), x -> x <> '' and not rlike(x, '[0-9]')), x -> concat('path=', x)),
        transform(regexp_extract_all(lower(url), '[?&]([a-z_]+)=', 1), x -> concat('query=', x)),
        if(rlike(path, '[0-9]'), array('path has digits'), array()),
        if(endswith(path, '/'), array('path ends with /'), array()))""")
    return F.array_distinct(words)


def mine(pages: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rules: token (the rarest, under which a rule is filed), items, confidence, support; written down.

    Sets are mined from the blocked URLs of the sample (quality 0), and their confidence is counted on all of it, by
    an inverted index: a URL meets the sets filed under its tokens.
    """
    y = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    y = thinned(written(y), size)
    first = parsed(pages).where("page_id IS NOT NULL").join(F.broadcast(y), F.col("page_id") == F.col("doc_id")).groupBy("page_id", "quality").agg(F.min_by(F.struct("url", "host", "path"), "url").alias("p"))
    sample = written(first.select("page_id", "quality", "p.*").select("page_id", "quality", tokens().alias("items")))
    bad = sample.where("quality = 0")
    rare = written(sample.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses")))
    # Tokens that stand in the same blocked URLs would make a set of every choice among them. A set needs no more than LONGEST:
    # the rarest of all sample URLs, with which confidence is highest.
    marks = [F.sum(F.pmod(F.xxhash64("page_id", F.lit(k)), F.lit(1 << 30))).alias(f"h{k}") for k in (1, 2)]
    where = bad.select("page_id", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") >= LEAST).join(rare, "token")
    order = F.row_number().over(Window.partitionBy("n", "h1", "h2").orderBy("uses", "token"))
    chosen = where.withColumn("r", order).where(F.col("r") <= LONGEST).select("token")
    reduced = bad.select("page_id", F.explode("items").alias("token")).join(chosen, "token").groupBy("page_id").agg(F.collect_list("token").alias("items"))
    n = bad.count()
    schema = "token string, items array<string>, confidence double, support bigint"
    if not n:
        return pages.sparkSession.createDataFrame([], schema)
    sets = FPGrowth(itemsCol="items", minSupport=max(SUPPORT, LEAST / n), minConfidence=CONFIDENCE).fit(reduced.select("items")).freqItemsets
    sets = sets.where((F.size("items") <= LONGEST) & (F.col("freq") >= LEAST)).select(F.array_sort("items").alias("items"), "freq")
    filed = sets.select("items", "freq", F.explode("items").alias("token")).join(rare, "token").groupBy("items", "freq").agg(F.min_by("token", F.struct("uses", "token")).alias("token"))
    filed = written(filed)
    posted = sample.select("items", F.explode("items").alias("token")).select("token", F.col("items").alias("url_items"))
    held = posted.join(filed, "token").where(F.size(F.array_except("items", "url_items")) == 0)
    scored = held.groupBy("items", "freq", "token").agg(F.count(F.lit(1)).alias("seen")).withColumn("confidence", F.col("freq") / F.col("seen"))
    kept = written(scored.where(F.col("confidence") >= CONFIDENCE).select("token", "items", "confidence", F.col("freq").alias("support")))
    # A URL that holds a set holds its parts: a set with a rule within it decides nothing.
    parts = F.expr("filter(array_union(transform(items, x -> array(x)), transform(items, x -> array_remove(items, x))), x -> size(x) < size(items) and size(x) > 0)")
    wider = kept.select("items", F.explode(parts).alias("part")).join(kept.select(F.col("items").alias("part")), "part").select("items").distinct()
    return written(kept.join(wider, "items", "left_anti").select("token", "items", "confidence", "support"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, mined: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, reason.

    A rule fits its host and all hosts under it, where the path starts with the rule's; the longest host and
    path together win, and of equals the one listed first. Else the mined rules judge: a URL that holds the tokens of
    any is blocked, and reason names the tokens of the most confident. Null and malformed URLs have an empty host and
    path, fit no rule and hold no mined set, and are allowed. Equal URLs get equal verdicts. No rows give no rows.
    """
    mined = mine(pages, labels) if mined is None else mined
    p = parsed(pages)
    fits = F.array(*[
        F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(s), F.struct(F.lit(-len(h + s)).alias("k"), F.lit(i).alias("i"), F.lit(h + s).alias("rule"), F.lit(v).alias("verdict")))
        for i, (v, h, s) in enumerate(rules)
    ])
    p = p.withColumn("best", F.array_min(F.filter(fits, lambda x: x.isNotNull())))
    # The rules of the index as one row, made a map from token to sets. A set stands in SUPPORT of the blocked URLs, so there
    # are at most 1 / SUPPORT times as many as a URL has choices of LONGEST tokens or fewer: a bound that knows no number of pages.
    index = mined.select("token", F.struct("confidence", "support", "items").alias("r")).groupBy("token").agg(F.collect_list("r").alias("rs"))
    index = index.agg(F.map_from_entries(F.collect_list(F.struct("token", "rs"))).alias("index"))
    held = F.filter(F.flatten(F.transform(F.filter("items", lambda x: F.map_contains_key("index", x)), lambda x: F.col("index")[x])), lambda r: F.size(F.array_except(r["items"], F.col("items"))) == 0)
    found = p.withColumn("items", F.when(F.col("host") != "", tokens()).otherwise(F.array().cast("array<string>"))).crossJoin(F.broadcast(index))  # one row
    found = found.withColumn("worst", F.array_max(held))
    blocked = F.col("worst").isNotNull()
    verdict = F.coalesce(F.col("best.verdict"), F.when(blocked, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("best").isNull() & blocked, F.array_join("worst.items", " + ")).alias("reason"))
