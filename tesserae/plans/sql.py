"""DuckDB SQL for what the operators compute, put together from parts, as an independent check."""

from __future__ import annotations

from ..functions.html import BOILERPLATE
from ..functions.text import CJK, STOPWORDS
from ..operators import evidence as E

LATIN = r"[A-Za-z][A-Za-z0-9_\-]*|\p{Nd}+(?:\.\p{Nd}+)?"
STOP = "[" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + "]"


def normal(t: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({t}, '　', ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')"


def tokens(t: str, unigrams: bool = False) -> str:
    pairs = "list_transform(range(1, length(t)), lambda i: substr(t, i, 2))"
    run = f"list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), {pairs})" if unigrams else pairs
    return rf"flatten(list_transform(regexp_extract_all(lower({normal(t)}), '[{CJK}]+|{LATIN}'), lambda t: CASE WHEN regexp_matches(t, '^[{CJK}][{CJK}]') THEN {run} ELSE [t] END))"


def content(t: str) -> str:
    return f"list_filter({tokens(t)}, lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def count(t: str) -> str:
    return rf"(len(regexp_extract_all({t}, '{LATIN}')) + length({t}) - length(regexp_replace({t}, '[{CJK}]', '', 'g')))"


def overlap(wanted: str, have: str) -> str:
    return f"CASE WHEN len({wanted}) > 0 THEN len(list_filter({wanted}, lambda w: list_contains({have}, w)))::DOUBLE / len({wanted}) ELSE 0 END"


def coverage(wanted: str, have: str) -> str:
    return f"len(list_intersect(list_distinct({wanted}), {have}))::DOUBLE / greatest(len(list_distinct({wanted})), 1)"


def bm25(queries: str, chunks: str) -> str:
    """WITH items up to ``scores`` (query_id, chunk_id, score), of tables (query_id, text) and (chunk_id, text)."""
    return f"""
    q AS ({queries}), c AS ({chunks}),
    toks AS (SELECT chunk_id, {content('text')} AS w FROM c),
    post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM toks) GROUP BY ALL),
    dl AS (SELECT chunk_id, greatest(len(w), 1) AS dl FROM toks),
    st AS (SELECT count(*) AS n, coalesce(avg(dl), 1) AS avgdl FROM dl),
    idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5)::DOUBLE / (count(*) + 0.5)) AS idf FROM post, st GROUP BY term),
    qt AS (SELECT DISTINCT query_id, unnest({content('text')}) AS term FROM q),
    parts AS (SELECT query_id, chunk_id, term, tf, df, idf * 2.4::DOUBLE * tf / (tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) + idf AS part
              FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), st),
    scores AS (SELECT query_id, chunk_id, sum(part) AS score FROM parts GROUP BY ALL)"""


def ranked(table: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM {table} WHERE score > 0 QUALIFY rank <= {k}"


def any_of(t: str, cues: str) -> str:
    return "(" + " OR ".join(f"contains({t}, '{c}')" for c in cues.split("|")) + ")"


def answer_type(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({t})', cues)} THEN '{name}'" for name, cues in E.CUES) + " ELSE 'entity' END"


def slot(t: str, kind: str) -> str:
    """RE2 has no look-behind: what stands around a number is matched with it."""
    number = r"(^|[^A-Za-z0-9_\-])\p{Nd}+([.,]\p{Nd}+)*($|[^A-Za-z0-9_\-])"
    shapes = {"count": number, "date": E.DATE, "version": E.VERSION}
    marks = " ".join(f"WHEN {kind} = '{n}' THEN {any_of(f'lower({t})', w)}" for n, w in E.MARKERS.items())
    return "CASE " + " ".join(f"WHEN {kind} = '{n}' THEN regexp_matches({t}, '{p}')" for n, p in shapes.items()) + f" {marks} ELSE true END"


def distinct8(items: str) -> str:
    low = f"list_transform({items}, lambda z: lower(z))"
    return f"list_filter({items}, lambda x, i: list_position({low}, lower(x)) = i)[1:8]"


def entities(t: str) -> str:
    quoted = E.QUOTED.replace("'", "''")
    good = f"length(trim(x)) >= 3 AND NOT list_contains({STOP}, lower(trim(x)))"
    return f"list_concat(list_transform(list_filter(regexp_extract_all({t}, '{quoted}', 1), lambda x: {good}), lambda x: trim(x)), list_filter(regexp_extract_all({t}, '{E.CODE}'), lambda x: {good} AND regexp_matches(x, '[A-Z_.\\-]|\\p{{Nd}}')))"


def plain_text(raw: str) -> str:
    """HTML to text where the only entities are those of the pages."""
    t = rf"regexp_replace({raw}, '(?s)<script.*?</script>|<style.*?</style>|<[^>]+>', ' ', 'g')"
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{mark}')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: length(x) > 2 AND NOT regexp_matches(x, '(?i){BOILERPLATE}')), chr(10))"
