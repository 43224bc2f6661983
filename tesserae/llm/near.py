"""Near duplicates: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard.

Texts of equal shingle sets form a class, and classes are compared, not copies. Two classes with a similarity of
0.85, or whatever links, share most of their smallest hashes. Inverted lists of those values propose pairs. Each class enters only
the lists of its rarest values: so many that two classes which share ``least_shared`` of their values still meet. So the
lists of a passage that a third of all texts hold stay all but empty, without a cap on any of them. Each list first
links its members to the one of the commonest values, the likely original of a family of edits. What is then still in
different components is compared: pair by pair in short lists, and for long ones by new lists of full sets, whose
rarest 15 % (at 0.85) are exactly enough. There, counts of shingles by SHAPE ranges of their hashes tell pairs that differ too
much, without an error: two sets differ in as many shingles at least as their counts differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import selected, small_batches, texts, written

WORDS = 5
#: A link: 100 * intersection >= link * union. LINK is op4's; a stage without a contract of its own takes STAGE_LINK.
LINK, STAGE_LINK = 85, 80
#: Values of a sketch.
K = 64
#: Longer lists that hold several components go by full sets.
SHORT = 32
#: Ranges of hashes whose shingles are counted; a power of two.
SHAPE = 128
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def least_shared(link: int) -> int:
    """Sets of more than K shingles that link share so many of their K values at least, but for 1 pair in 10**9 of those at the threshold."""
    p, below = link / 100, 0.0
    for s in range(K + 1):
        below += comb(K, s) * p**s * (1 - p) ** (K - s)
        if below > 1e-9:
            return s
    return K


class _Hashes(dict):
    """Hashes of words; forgets all once it holds 200,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; bytes.split and bytes.lower know ASCII alone, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return _mixed((h * _ODD[:n]).sum(keepdims=True) + np.uint64(n)).view(np.int64)
    total = h[: n - WORDS + 1] * _ODD[0]
    for i in range(1, WORDS):
        total += h[i : n - WORDS + 1 + i] * _ODD[i]
    return np.unique(_mixed(total).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(values))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column("text")]
        keys = np.array([np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists([s[:K] for s in sets])], ["doc_id", "n", "k1", "k2", "sketch"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists([shingles(t.as_py()) for t in b.column("text")])], ["id", "shingles"])


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(65 - SHAPE.bit_length())
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column("text")]
        shapes = [np.bincount((s.view(np.uint64) >> shift).astype(np.int64), minlength=SHAPE) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(sets), _lists(shapes).cast(pa.list_(pa.int32()))], ["id", "shingles", "shape"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b), for each id that has one.

    Smallest labels spread along edges, and each round every label also jumps to its own label; each round is
    written down. Only a count reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "id")
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = written(lower.join(root, "component").select("id", F.least("component", "root").alias("component"), "was"))
        done = after.where("component < was").limit(1).count() == 0
        labels = after.select("id", "component")
        if done:
            return labels


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) that link: by the estimate, then on full sets.

    Values that both sketches and the union's have in common are common to the sketches, so one bound holds for lists and estimate.
    """
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.array_intersect("sa", "sb")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    shared = F.when(whole, F.size(common)).otherwise(F.size(F.array_intersect(common, union)))
    both = both.select("a", "b", "na", "nb", whole.alias("whole"), shared.alias("shared"))
    passed = written(both.where(F.when(F.col("whole"), 100 * F.col("shared") >= link * (F.col("na") + F.col("nb") - F.col("shared"))).otherwise(F.col("shared") >= least_shared(link))))
    open_ = passed.where("NOT whole").select("a", "b", "na", "nb")
    ids = open_.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    small_batches(docs.sparkSession, 500)
    full = selected(docs, written(ids)).mapInArrow(_full, "id long, shingles array<long>")
    sets = written(full.groupBy("id").agg(F.first("shingles").alias("shingles")))
    left, right = (sets.select(F.col("id").alias(s), F.col("shingles").alias(f"s{s}")) for s in "ab")
    inner = F.size(F.array_intersect("sa", "sb"))
    sure = open_.join(left, "a").join(right, "b").select("a", "b", "na", "nb", inner.alias("i")).where(100 * F.col("i") >= link * (F.col("na") + F.col("nb") - F.col("i")))
    return passed.where("whole").select("a", "b").unionByName(sure.select("a", "b"))


def _rare(values: DataFrame, listed: Column, needed: Column) -> DataFrame:
    """v, id, n, place, common: the lists that a class enters, so that two which share ``needed`` of ``listed`` values meet.

    Values that one class alone has come first and make no list; then the rest by how many classes have them.
    common is the mean of that number over the class's values.
    """
    # Written down, so that the join deals out both sides itself and a common value's part can be split.
    counts = written(values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    mine = Window.partitionBy("id")
    single = listed - F.count(F.lit(1)).over(mine)
    place = single + F.row_number().over(mine.orderBy("f", "v"))
    ranked = values.join(counts, "v").select("v", "id", "n", place.alias("place"), ((single + F.sum("f").over(mine)) / listed).alias("common"))
    return ranked.where(F.col("place") <= listed - needed + 1)


def _alike(x: str, y: str, link: int) -> Column:
    """Whether two sizes leave room for a link."""
    return 100 * F.least(x, y) >= link * F.greatest(x, y)


def _mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """v, id, n, place, c, size: the lists whose members are in several components."""
    placed = written(lists.join(labels, "id", "left").select("v", "id", "n", "place", F.coalesce("component", "id").alias("c")))
    mixed = placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("v", "size")
    return placed.join(mixed, "v")


def _pairs(lists: DataFrame, full: bool, link: int) -> DataFrame:
    """Pairs (a, b) of a list in different components whose sizes leave room for a link.

    In lists of full sets the places do so as well: where two sets meet first, what both have behind it is all that they
    can share. Pairs that link pass at the first list that they share. So do their shapes: sets that link differ in
    (100 - link) / (100 + link) of their sizes' sum at most.
    """
    left, right = (lists.select("v", *[F.col(x).alias(f"{s}{x}") for x in ("id", "n", "c", "place", *(["shape"] if full else []))]) for s in "ab")
    meet = (F.col("aid") < F.col("bid")) & (F.col("ac") != F.col("bc")) & _alike("an", "bn", link)
    if full:
        most = 1 + F.least(F.col("an") - F.col("aplace"), F.col("bn") - F.col("bplace"))
        meet &= 100 * most >= link * (F.col("an") + F.col("bn") - most)
        differ = F.aggregate(F.zip_with("ashape", "bshape", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        meet &= (100 + link) * differ <= (100 - link) * (F.col("an") + F.col("bn"))
    return left.join(right, "v").where(meet).select(F.col("aid").alias("a"), F.col("bid").alias("b"))


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Letters A-Z are lower-cased; words are runs without ASCII white space; a set holds the distinct shingles of five
    words, or the whole sequence where there are fewer. A null, empty or blank text has no set and links with
    nothing. Equal sets always link. component_id is the smallest doc_id reachable; kept: it is the row's own. A
    null doc_id links with nothing, and its component_id is null and kept true. Rows that repeat whole stay
    rows of one document. No rows give no rows. Sets link from a Jaccard similarity of ``link`` / 100 on.
    """
    small_batches(docs.sparkSession, 500)
    t = texts(docs)
    sketched = written(t.mapInArrow(_sketched, "doc_id long, n long, k1 long, k2 long, sketch array<long>"))
    real = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")))
    reps = sketched.select(F.col("doc_id").alias("id"), "n", "sketch").where("n > 0").join(classes.select("id"), "id", "left_semi")
    reps = written(reps.groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    # Of two linked sets the smaller has ``link`` % of the larger one's size at least, and so has their intersection. The
    # union has n * 100 / link shingles at most, of which 100 - link % can push shared ones out of a sketch.
    shared = F.ceil(F.col("n") * link / 100)
    some = F.greatest(F.lit(least_shared(link)), F.least(shared, F.floor(K - F.col("n") * (100 - link) / link)))
    needed = F.when(F.col("n") * 100 <= K * link, shared).otherwise(some)
    lists = written(_rare(reps.select("id", "n", F.explode("sketch").alias("v")), F.least("n", F.lit(K)), needed))

    heads = lists.groupBy("v").agg(F.max(F.struct("common", "id", "n")).alias("head")).select("v", F.col("head.id").alias("h"), F.col("head.n").alias("nh"))
    stars = lists.join(heads, "v").where((F.col("id") != F.col("h")) & _alike("n", "nh", link))
    stars = written(stars.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct())
    links = written(_verified(stars, reps, t, link))
    labels = components(links)

    mixed = _mixed_lists(lists, labels)
    short = _pairs(mixed.where(F.col("size") <= SHORT), full=False, link=link)
    crowded = written(mixed.where(F.col("size") > SHORT).select(F.col("id").alias("doc_id")).distinct())
    full = selected(t, crowded).mapInArrow(_shaped, "id long, shingles array<long>, shape array<int>")
    full = written(full.groupBy("id").agg(F.first("shingles").alias("shingles"), F.first("shape").alias("shape")))
    values = full.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("v"))
    long = _mixed_lists(written(_rare(values, F.col("n"), shared)), labels).join(full.select("id", "shape"), "id")
    long = _pairs(long, full=True, link=link)
    more = written(short.unionByName(long).distinct().join(stars, ["a", "b"], "left_anti"))
    found = written(_verified(more, reps, t, link))
    labels = components(links.unionByName(found)) if found.limit(1).count() else labels

    label = classes.join(labels, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    own = F.when(F.col("n") > 0, F.col("component"))
    result = sketched.select("doc_id", "n", "k1", "k2").join(label, ["k1", "k2"], "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_near(docs: DataFrame, link: int = STAGE_LINK) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near duplicates, with all their columns."""
    return selected(docs, written(near_duplicates(docs, link).where(~F.col("kept")).select("doc_id").distinct()), keep=False)


SQL = """
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t
), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, len(any_value(g))::BIGINT AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id
"""
