"""Text functions for mixed scripts, as Catalyst expressions.

Latin words and numbers are tokens; a run of CJK characters gives its bigrams, a single one itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"⺀-⻿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿ｦ-ﾟ"
LATIN = r"[A-Za-z][A-Za-z0-9_\-]*|\p{Nd}+(?:\.\p{Nd}+)?"

# Results depend on them.
ENGLISH_STOPWORDS = frozenset(
    """a an and are as at be but by for from has have he her his i if in is it its of on or
    that the their them they this to was were will with we you your not can could would should
    which what when who how all any some such than too very about into over under between
    do does did been being our us me my""".split()
)
CHINESE_STOPWORDS = frozenset(
    """的 了 和 是 在 我 有 也 就 不 人 都 一 与 及 或 但 而 于 其 这 那 他 她 它 们 个 上 下 中 里 为 以 被 能 会
    可以 什么 怎么 如何 哪些 哪个 以及 并且 因为 所以 但是 然而 因此 通过 进行""".split()
)
STOPWORDS = ENGLISH_STOPWORDS | CHINESE_STOPWORDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: Column | str) -> Column:
    """Wide spaces become spaces, all line ends LF, runs of blanks and tabs one space."""
    t = F.replace(_col(text), F.lit("　"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[ \t]+", " ")


def tokens(text: Column | str, unigrams: bool = False) -> Column:
    """Tokens of the lower-cased text; with ``unigrams`` a CJK run also gives its characters, before its bigrams."""
    # White space stands in no token, so it needn't be normalised.
    raw = F.regexp_extract_all(F.lower(_col(text)), F.lit(f"[{CJK}]+|{LATIN}"), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    several = lambda t: F.concat(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1))), pairs(t)) if unigrams else pairs(t)
    cut = F.flatten(F.transform(raw, lambda t: F.when(t.rlike(f"^[{CJK}]{{2}}"), several(t)).otherwise(F.array(t))))
    # Most texts have no such run, and looking at each token takes longer than finding them all.
    return F.when(_col(text).rlike(f"[{CJK}]{{2}}"), cut).otherwise(raw)


def content_tokens(text: Column | str) -> Column:
    """Tokens that are no stopwords and longer than a character; duplicates stay."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(sorted(STOPWORDS)))


def count_tokens(text: Column | str) -> Column:
    """Latin words and numbers, plus CJK characters, of the raw text."""
    t = _col(text)
    return (F.regexp_count(t, F.lit(LATIN)) + F.length(t) - F.length(F.regexp_replace(t, f"[{CJK}]", ""))).cast("int")


def char_ngrams(text: Column | str, n: int = 3) -> Column:
    """Character n-grams of the lower-cased text without white space; a shorter text is its own, an empty one none."""
    bare = F.regexp_replace(F.lower(normalize(text)), r"(?U)\s+", "")
    none = F.array().cast("array<string>")

    def grams(t: Column) -> Column:
        # Each match is one character and looks ahead, so a text is read once; substring() would count from its start each time.
        several = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
        return F.when(F.length(t) >= n, several).when(F.length(t) > 0, F.array(t)).otherwise(none)

    # An array of one element binds the text, which else each step would make anew.
    return F.flatten(F.transform(F.array(bare), grams))


def overlap(wanted: Column | str, have: Column | str) -> Column:
    """The share of ``wanted`` tokens, with duplicates, that ``have`` holds; 0 where none is wanted."""
    w, h = _col(wanted), _col(have)
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda t: F.array_contains(h, t))) / F.size(w)).otherwise(F.lit(0.0))


def coverage(wanted: Column | str, have: Column | str) -> Column:
    """The share of distinct ``wanted`` tokens that ``have`` holds; 0 where none is wanted."""
    w = F.array_distinct(_col(wanted))
    return F.size(F.array_intersect(w, _col(have))) / F.greatest(F.size(w), F.lit(1))


def fingerprint(text: Column | str) -> Column:
    """16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def context_header(path: Column | str) -> Column:
    return F.array_join(_col(path), " > ")


def text_key(text: Column | str) -> Column:
    """A key under which equal stripped texts meet."""
    return F.sha2(F.trim(_col(text)), 256)
