"""Text facts as column expressions. White space is that of Unicode; counts are of code points; a null text is empty."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"(?U)\s+"
_PUNCTUATION_FREE = r"(?U)[^\p{L}\p{N}_\s.,!?;:'\"\-]"


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def char_count(t: Column) -> Column:
    return F.char_length(t)


def words(t: Column) -> Column:
    return F.filter(F.split(t, _WS), lambda w: w != "")


def sentence_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, "[.!?]+"), lambda s: s.rlike(r"(?U)\S")))


def word_chars(t: Column) -> Column:
    return F.char_length(F.regexp_replace(t, _WS, ""))


def special_chars(t: Column) -> Column:
    return F.regexp_count(t, F.lit(_PUNCTUATION_FREE))


def trigram_repetition(w: Column, least: int = 15) -> Column:
    """1 - distinct / all word trigrams; null under `least` words. A trigram is its words joined by blanks, which no word
    has: strings are told apart by hashing, where arrays would be compared pair by pair."""
    last = F.size(w) - 3
    grams = F.transform(F.slice(w, 1, F.greatest(last + 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2)))
    return F.when(F.size(w) >= least, 1.0 - F.size(F.array_distinct(grams)) / (F.size(w) - 2))


def normal_form(t: Column) -> Column:
    """Runs of white space are one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(t, _WS, " "), "^ | $", "")


def typographic_artifacts(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"(?U)\s{2,}")) + F.regexp_count(t, F.lit(r"(?U)\s[.!?,]"))


def search_tokens(t: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and Hangul syllables; long ones with Hangul also give their 2-grams."""
    tokens = F.filter(F.split(F.lower(t), "[^0-9a-zA-Z가-힣]+"), lambda x: x != "")
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x) - 1), lambda i: F.substring(x, i, 2))
    grams = F.flatten(F.transform(tokens, lambda x: F.when((F.char_length(x) >= 3) & x.rlike("[가-힣]"), F.concat(F.array(x), pairs(x))).otherwise(F.array(x))))
    return F.when(t.rlike("[가-힣]"), grams).otherwise(tokens)  # most texts have no Hangul and need no second look


_TOKEN, _HANGUL = re.compile("[0-9a-zA-Z가-힣]+"), re.compile("[가-힣]")
_BLANKS = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def python_search_tokens(text: str | None) -> list[bytes]:
    """search_tokens() of one text, in UTF-8: a table of bytes instead of a pattern where there is no Hangul."""
    low = (text or "").lower()
    if low.isascii() or not _HANGUL.search(low):
        return low.encode("utf-8", "surrogatepass").translate(_BLANKS).split()
    out = []
    for x in _TOKEN.findall(low):
        out.append(x)
        if len(x) >= 3 and _HANGUL.search(x):
            out += [x[i : i + 2] for i in range(len(x) - 1)]
    return [x.encode() for x in out]


def length_bin(n: Column) -> Column:
    return F.when(n < 50, "0-50").when(n < 200, "50-200").when(n < 500, "200-500").when(n < 1000, "500-1000").otherwise("1000+")


LENGTH_BINS = ("0-50", "50-200", "200-500", "500-1000", "1000+")


def quality_band(score: Column) -> Column:
    return F.when(score < 0.5, "low").when(score < 0.8, "medium").otherwise("high")


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.when(new > 0, 100.0).otherwise(0.0)).otherwise((new - old) / F.nullif(old, F.lit(0.0)) * 100)


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def query_type(query_id: Column) -> Column:
    return F.when(query_id.cast("string").startswith("qc_"), "code").otherwise("attribute")


def with_prefix(t: Column, kind: str, family: str = "") -> Column:
    """Models of the e5 family want to know what a text is; others take it as it is."""
    prefix = {"document": "passage: ", "query": "query: "}[kind] if "e5" in family.lower() else ""
    return F.concat(F.lit(prefix), t)
