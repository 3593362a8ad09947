"""Scalar functions that Spark lacks, from those that it has; Arrow only where none will do."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Text = str | Column


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_if_null(x: Text) -> Column:
    return F.coalesce(col(x), F.lit(""))


def iso_day(x: Text) -> Column:
    """Date of the first ten characters (yyyy-MM-dd), or null."""
    return F.try_to_timestamp(F.substring(col(x), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def plain_number(x: Text) -> Column:
    """A number written with grouping commas; null if it is none."""
    return F.replace(col(x).cast("string"), F.lit(","), F.lit("")).try_cast("double")


def days_apart(a: Text, b: Text) -> Column:
    return F.abs(F.datediff(col(a), col(b))).cast("long")


def day_of_week(d: Text) -> Column:
    """Sunday 0 to Saturday 6."""
    return F.dayofweek(col(d)) - 1


def md5_long(x: Text) -> Column:
    """The first 32 bits of the md5 as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(col(x)), 1, 8), 16, 10).cast("long")


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


def nfkd(x: Text) -> Column:
    """Compatibility decomposition (there is no built-in)."""
    return _nfkd(col(x))


#: Letters, numbers, underscore and white space stay; combining marks go.
_NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"


def collapsed(x: Text) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def clean_text(x: Text, lowercase: bool = True, decompose: bool = True) -> Column:
    """Decomposed, lower-cased, without punctuation and marks, white space collapsed. Null becomes empty.

    decompose=False keeps to built-ins: the same result for texts without compatibility or accented letters.
    """
    text = blank_if_null(x)
    text = nfkd(text) if decompose else text
    return collapsed(F.regexp_replace(F.lower(text) if lowercase else text, _NOT_WORD, " "))


def ascii_text(x: Text) -> Column:
    """Lower-cased, with ASCII letters and digits alone, single spaces between."""
    kept = F.regexp_replace(F.lower(blank_if_null(x)), r"[^a-z0-9 \t\n\r\f\x0B]", " ")
    return F.trim(F.regexp_replace(kept, r"[ \t\n\r\f\x0B]+", " "))


#: Boilerplate of portals, as (portals, phrase that betrays it, patterns).
BOILERPLATE = [
    (
        ["P001", "P002", "P005"], "NATIONAL PROCUREMENT AGGREGATION SERVICE",
        [r"NATIONAL\s+PROCUREMENT\s+AGGREGATION\s+SERVICE.*?(?:TERMS\s+AND\s+CONDITIONS|APPLICABLE\s+LAW|DISCLAIMER)", r"NATIONAL\s+PROCUREMENT\s+AGGREGATION\s+SERVICE"],
    ),
    (
        ["P003", "P004", "P006"], "STATE PROCUREMENT CELL",
        [r"STATE\s+PROCUREMENT\s+CELL.*?(?:TERMS\s+AND\s+CONDITIONS|APPLICABLE\s+LAW|DISCLAIMER)", r"STATE\s+PROCUREMENT\s+CELL"],
    ),
]
#: Disclaimers, up to the end of their line.
DISCLAIMERS = [r"DISCLAIMER:.*?(?:REPRESENTATION|WARRANTY|ALL\s+RIGHTS\s+RESERVED).*", r"DISCLAIMER:.*"]


def strip_boilerplate(x: Text, portal: Text | None = None, table=BOILERPLATE) -> Column:
    """Without the preambles of the portal (or of any portal whose phrase occurs) and without disclaimers."""
    text = blank_if_null(x)
    out = text
    for portals, phrase, patterns in table:
        applies = F.upper(text).contains(phrase)
        if portal is not None:
            applies = applies | F.coalesce(col(portal).isin(portals), F.lit(False))
        stripped = out
        for p in patterns:
            stripped = F.regexp_replace(stripped, f"(?ius){p}", " ")
        out = F.when(applies, stripped).otherwise(out)
    for p in DISCLAIMERS:
        out = F.regexp_replace(out, f"(?iud){p}", " ")
    return collapsed(out)


def word_tokens(cleaned: Text) -> Column:
    """Distinct words of two letters or more of a cleaned text."""
    return F.array_distinct(F.filter(F.split(col(cleaned), " "), lambda w: F.length(w) >= 2))


def _grams(text: Column, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def char_ngrams(x: Text, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is its own only gram, an empty one has none."""
    return char_ngram_range(x, n, n)


def char_ngram_range(x: Text, low: int = 3, high: int = 5) -> Column:
    """Distinct runs of low to high characters; a text shorter than low is its own only gram."""
    text = col(x)
    grams = F.concat(*[_grams(text, n) for n in range(low, high + 1)])
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < low, F.array(text)).otherwise(F.array_distinct(grams))


#: Symbols of ascii_text() as 6 bits each: space, digits, letters; 0 is none.
_CODES = np.zeros(128, np.uint64)
_CODES[[ord(c) for c in " 0123456789abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 38)
_RUN = re.compile("[a-z0-9]+")


def count_ascii_grams(text: str | None, low: int, high: int) -> int:
    """How many distinct runs of low to high (10 at most) characters ascii_text() of a text has; one if it is shorter than low."""
    clean = " ".join(_RUN.findall((text or "").lower()))
    if len(clean) < low:
        return int(clean != "")
    codes = _CODES[np.frombuffer(clean.encode(), np.uint8)]
    found, packed = 0, np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, min(high, len(codes)) + 1):
        packed = (packed[:-1] << np.uint64(6)) | codes[n - 1 :]
        if n >= low:
            own = np.sort(packed.astype(np.uint32) if n <= 5 else packed)
            found += 1 + int((own[1:] != own[:-1]).sum())
    return found


def ascii_gram_count(x: Text, low: int = 3, high: int = 5) -> Column:
    """The size of char_ngram_range() of ascii_text(), without its array of texts."""
    if high > 10:
        raise ValueError("a run of more than 10 characters does not fit 64 bits")

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_ascii_grams(t, low, high))

    return of(col(x))


def jaccard(a: Text, b: Text) -> Column:
    """Of two arrays without repeats: both empty 1, one empty 0."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def weighted_similarity(body: Column, title: Column | None = None, body_weight: float = 0.7, title_weight: float = 0.3) -> Column:
    """body_weight * body + title_weight * title; the body alone where there is no title."""
    return body if title is None else F.lit(body_weight) * body + F.lit(title_weight) * title


def field_compatibility(value_a: Text, value_b: Text, closing_a: Text, closing_b: Text) -> dict[str, Column]:
    """value_match, value_diff and closing_delta_days of two notices; null where a value cannot be read."""
    a, b = plain_number(value_a), plain_number(value_b)
    return {"value_diff": F.abs(a - b), "value_match": F.abs(a - b) == 0, "closing_delta_days": days_apart(iso_day(closing_a), iso_day(closing_b))}


#: Fixed value: the name space of card identifiers.
CARD_NAMESPACE = "a7b3c2d1-4e5f-6a7b-8c9d-0e1f2a3b4c5d"


def card_id(key: Text, namespace: str = CARD_NAMESPACE) -> Column:
    """CARD- and the first 16 characters of the name-based UUID (version 5) of a key."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(col(key), "UTF-8")))
    return F.concat(F.lit("CARD-"), F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 1))


def s_curve(s: Text, bands: int, rows: int) -> Column:
    """Probability that a pair of similarity s meets in one of the bands."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(s)))
    return 1 - F.pow(1 - F.pow(clipped, F.lit(rows)), F.lit(bands))
