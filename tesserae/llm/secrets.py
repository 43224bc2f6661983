"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Native: built-in functions only. Positions come from the pieces between matches, as no built-in gives them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, thinned

#: The first letter is looked at before the words are.
ASSIGN = r"""(?i)(?=[past])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs of these classes end where the class ends, so a least length drops just the runs that are too short.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge: runs of identifier characters, in what the patterns above leave of a text. No place within a run is tried.
LEAST_RUN = 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
KINDS = ("assign", "access", "hex", "markov")
SPAN = "array<struct<s:int,k:int,e:int,v:int,b:int>>"

#: A run is random where its log-likelihood ratio is above the log of the odds against a secret, 10,000 to 1.
THRESHOLD = math.log(1e4)
#: Labelled samples: so many random strings, and the words of so many documents.
N_RANDOM, N_DOCS = 4096, 2000
DRAW = 20


#: Elements that a running sum or maximum goes through one by one, before whole groups of so many are summed up.
GROUP = 128


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is computed once, however often lambdas in the body run."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, merge: str) -> str:
    """SQL: of each value the result of ``merge`` (of a and x) over all before it, from 0 on.

    No array grows by one element at a time: groups are merged first, then what stands before a group, then within it.
    """
    over = lambda some, start: f"aggregate({some}, {start}, (a, x) -> {merge})"
    parts = f"transform(sequence(0, greatest(size(_u) - 1, 0) div {GROUP}), g -> slice(_u, g * {GROUP} + 1, {GROUP}))"
    each = f"flatten(zip_with(_g, _h, (g, h) -> transform(g, (y, i) -> {over('slice(g, 1, i)', 'h')})))"
    before = f"transform(_t, (y, i) -> {over('slice(_t, 1, i)', '0L')})"
    return _let("_u", values, _let("_g", parts, _let("_t", f"transform(_g, g -> {over('g', '0L')})", _let("_h", before, each))))


def _spans(kind: int, text: str, pattern: str, matches: str, values: str) -> str:
    """SQL: spans of one kind from its matches: s and e in code points (end exclusive), b the first byte, v the value's length.

    What a match is made of is ASCII, so it has as many bytes as characters. Both places run in one number, bytes in the upper half.
    """
    step = "(p, m) -> length(p) + length(m) + shiftleft(cast(octet_length(p) + length(m) AS bigint), 32)"
    gaps = f"slice(split({text}, '{pattern}', -1), 1, size({matches}))"
    at = _running(f"zip_with(_gaps, {matches}, {step})", "a + x")
    start = f"zip_with(_at, _gaps, (a, p) -> a + length(p) + shiftleft(cast(octet_length(p) AS bigint), 32))"
    size = f"zip_with({matches}, {values}, (m, v) -> named_struct('m', length(m), 'v', length(v)))"
    span = "named_struct('s', int(a & 4294967295), 'k', %d, 'e', int(a & 4294967295) + x.m, 'v', x.v, 'b', int(shiftright(a, 32)))" % kind
    return _let("_gaps", gaps, _let("_at", at, f"zip_with({start}, {size}, (a, x) -> {span})"))


def _found(docs: DataFrame, text: str, kinds: dict[int, tuple[str, int]]) -> DataFrame:
    """``docs`` with a column s<kind> of the spans of ``text`` for each (pattern, group of the value)."""
    for k, (pattern, _) in kinds.items():
        docs = docs.withColumn(f"_m{k}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for k, (pattern, group) in kinds.items():
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        values = f"regexp_extract_all({text}, '{quoted}', {group})" if group else f"_m{k}"
        spans = F.when(F.size(f"_m{k}") > 0, F.expr(_spans(k, text, quoted, f"_m{k}", values)))
        docs = docs.withColumn(f"s{k}", F.coalesce(spans, F.array().cast(SPAN)))
    return docs.drop(*[f"_m{k}" for k in kinds])


def _cuts(spans: str) -> str:
    """SQL: sorted spans as the pieces to cut out, b and n in bytes; those that overlap are one piece."""
    reach = _running("transform(_s, y -> bigint(y.e))", "greatest(a, x)")
    first = "filter(sequence(0, size(_s) - 1), i -> _s[i].s >= _e[i])"
    piece = "named_struct('b', _s[i].b, 'n', int(if(j + 1 < size(_f), _e[_f[j + 1]], array_max(transform(_s, y -> y.e))) - _s[i].s))"
    return _let("_s", spans, _let("_e", reach, _let("_f", first, f"transform(_f, (i, j) -> {piece})")))


def _without(text: str, spans: str, fill: str) -> str:
    """SQL: ``text`` with ``fill`` (of the piece x) for each piece that the spans cover. Bytes are cut, which takes no walk from the start."""
    end = "if(i = 0, 0, _c[i - 1].b + _c[i - 1].n)"
    parts = f"transform(_c, (x, i) -> concat(cast(substring(_b, {end} + 1, x.b - {end}) AS string), {fill}))"
    last = "cast(substring(_b, element_at(_c, -1).b + element_at(_c, -1).n + 1) AS string)"
    return _let("_b", f"cast({text} AS binary)", _let("_c", _cuts(spans), f"concat(array_join({parts}, ''), {last})"))


def labelled(docs: DataFrame, n_random: int = N_RANDOM, n_docs: int = N_DOCS) -> DataFrame:
    """The samples: s, random (1 or 0).

    Random strings are hex and Base64 digits of hashes of a counter, 40 characters long. Ordinary ones are the words
    of about ``n_docs`` documents (by the hashes of their ids), as they are and in pairs joined by
    ``_`` or ``-``, as programs and paths join them, less what the fixed patterns take and long words with digits, which may be secrets.
    """
    spark = docs.sparkSession
    numbers = spark.range(n_random)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    random = numbers.select(
        F.explode(F.array(F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), F.substring(F.base64(F.unhex(digest)), 1, 40), F.translate(F.substring(F.base64(F.unhex(digest)), 3, 40), "+/", "-_"))).alias("s"),
        F.lit(1).alias("random"),
    )
    sample = thinned(docs, n_docs)
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = F.expr("filter(regexp_extract_all(_plain, '[A-Za-z][A-Za-z0-9_-]+', 0), w -> length(w) < 20 or not rlike(w, '[0-9]'))")
    pairs = F.expr("transform(_w, (w, i) -> if(i % 4 = 0, concat(w, '_', coalesce(try_element_at(_w, i + 2), '')), if(i % 4 = 1, concat(w, '-', coalesce(try_element_at(_w, i + 2), '')), w)))")
    ordinary = sample.select(plain.alias("_plain")).select(words.alias("_w")).select(F.explode(pairs).alias("s")).select("s", F.lit(0).alias("random"))
    return random.unionByName(ordinary)


def log_ratios(samples: DataFrame) -> list[float]:
    """log P(b|a, random) - log P(b|a, ordinary) for each pair of characters a, b of the alphabet, row by row.

    Counts of pairs are summed by Spark; what reaches the driver is 2 * 67 * 67 sums at most.
    """
    pair = F.explode(F.expr("transform(sequence(1, length(s) - 1), i -> substring(s, i, 2))")).alias("pair")
    sums = samples.where("length(s) > 1").select("random", pair).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))
    place = {c: i for i, c in enumerate(ALPHABET)}
    n = [[[0] * SIZE for _ in range(SIZE)] for _ in range(2)]
    for r in sums.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        n[r["random"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["n"]

    def log_p(n: list[list[int]]) -> list[list[float]]:
        """A pair's share, drawn towards the share of its second character by ``DRAW`` counts."""
        single = [0.5 + sum(row[b] for row in n) for b in range(SIZE)]
        return [[math.log((row[b] + DRAW * single[b] / sum(single)) / (sum(row) + DRAW)) for b in range(SIZE)] for row in n]

    ordinary, random = map(log_p, n)
    return [random[a][b] - ordinary[a][b] for a in range(SIZE) for b in range(SIZE)]


def train(docs: DataFrame, n_random: int = N_RANDOM, n_docs: int = N_DOCS) -> list[float]:
    return log_ratios(labelled(docs, n_random, n_docs))


def find_secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, found (array of s, k, e, v, b sorted by start and kind).

    k is the place in KINDS. Matches of one kind are leftmost and don't overlap; those whose value is too short
    go: assign values of under 6 characters, access keys under 20, hex under 24. A markov span is a run of LEAST_RUN
    or more identifier characters, in what the other spans leave, whose likelihood ratio is over the threshold.
    A null or empty text has no spans; a null doc_id stays null, and rows that repeat give the same spans. Ties don't arise:
    starts of one kind differ. Time grows with a text's length and by the power 4/3 with its matches. No rows give no rows.
    """
    t = texts(docs)
    return _find(t, train(t) if model is None else model, threshold)


def _find(t: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``t`` (no null text) with the column found."""
    t = _found(t, "text", {0: (ASSIGN, 2), 1: (ACCESS, 0), 2: (HEX, 0)})
    t = t.withColumn("_base", F.array_sort(F.concat(F.filter("s0", lambda x: x["v"] >= 6), "s1", "s2")))
    t = t.withColumn("_plain", F.when(F.size("_base") > 0, F.expr(_without("text", "_base", "repeat(' ', x.n)"))).otherwise(F.col("text")))
    t = _found(t, "_plain", {3: (RUN, 0)})
    place = f"locate(_c[%s], '{ALPHABET}')"
    pairs = f"aggregate(sequence(0, size(_c) - 2), 0D, (a, i) -> a + _ratios[({place % 'i'} - 1) * {SIZE} + {place % 'i + 1'} - 1])"
    run = "cast(substring(_bytes, x.b + 1, x.e - x.s) AS string)"
    letters = f"filter(split({run}, ''), z -> z <> '')"
    judged = f"filter(s3, x -> {_let('_c', letters, pairs)} > {threshold})"
    extra = _let("_bytes", "cast(_plain AS binary)", _let("_ratios", f"from_json('{model}', 'array<double>')", judged))
    found = F.when(F.size("s3") > 0, F.array_sort(F.concat("_base", F.expr(extra)))).otherwise(F.col("_base"))
    return t.withColumn("found", found).drop("s0", "s1", "s2", "s3", "_base", "_plain")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    name = f"element_at(array({', '.join(map(repr, KINDS))}), x.k + 1)"
    joined = "array_join(transform(%s, x -> concat_ws(':', " + name + ", x.s, x.e)), ',')"
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(joined % "filter(found, x -> x.k < 3)"), 256).alias("base_sha256"),
        F.expr(joined % "found").alias("spans"), count(3).alias("n_markov"),
    )


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each span of its texts replaced by ``mask``; overlapping spans count as one.

    All rows and columns stay, whatever their names; n_chars, where there is such a column, follows the new text. A text without
    a secret, null and empty ones included, is left as it is. Rows that repeat stay, masked alike. No rows give no rows.
    """
    names = docs.columns
    row = docs.select(F.struct(*names).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    found = _find(row, train(texts(docs)))
    quoted = mask.replace("\\", "\\\\").replace("'", "\\'")
    done = found.withColumn("_clean", F.when(F.size("found") > 0, F.expr(_without("text", "found", f"'{quoted}'"))))
    fields = [F.col("_row")[c].alias(c) for c in names]
    fields[names.index("text")] = F.coalesce("_clean", F.col("_row")["text"]).alias("text")
    if "n_chars" in names:
        fields[names.index("n_chars")] = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"]).alias("n_chars")
    return done.select(*fields)
