"""Column expressions for text, numbers, dates and paths. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG_MAX, _LONG_MIN = (1 << 63) - 1, -(1 << 63)


def normalize_text(c: Column) -> Column:
    """Lower case, without white space (of any script) at either end."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def tokens(c: Column) -> Column:
    """All runs of ASCII letters and digits of the lower-cased text, in order; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def _terms_pattern(terms: list[str]) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(terms) + ")(?![a-z0-9])"


def has_token(c: Column, terms: list[str]) -> Column:
    """Whether one of the terms is a token of the text; false for null. No array is made of the text.

    A term with other characters than small letters and digits is never a token.
    """
    terms = [t for t in terms if re.fullmatch("[a-z0-9]+", t)]
    if not terms:
        return F.lit(False)
    low = F.lower(c)
    near = F.lit(False)
    for t in terms:
        near = near | F.contains(low, F.lit(t))  # a plain search comes first
    return F.coalesce(near & low.rlike(_terms_pattern(terms)), F.lit(False))


def count_token(c: Column, term: str) -> Column:
    """How often a term is a token of the text; 0 for null."""
    if not re.fullmatch("[a-z0-9]+", term):
        return F.lit(0)
    return F.coalesce(F.regexp_count(F.lower(c), F.lit(_terms_pattern([term]))), F.lit(0))


def ngrams(word: Column, low: int, high: int) -> Column:
    """All substrings of ``low`` to ``high`` characters, repeated ones too; shorter words have none."""
    if low < 1 or low > high:
        raise ValueError("n-gram lengths must be 1 <= min <= max")

    def of(n: int) -> Column:
        # sequence() would count down past the guard
        return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def text_ngrams(text: str, low: int, high: int) -> list[str]:
    """The same for one word on the driver."""
    return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]


def query_words(text: str) -> list[str]:
    """The tokens of a query text, on the driver."""
    return re.findall("[a-z0-9]+", text.lower())


def number_text(c: Column) -> Column:
    """A number without an exponent or trailing zeros: 8.99e9 is "8990000000", 35.0 is "35"."""
    x = c.cast("double")
    endless = F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(F.isnan(x), "NaN")
    return endless.otherwise(F.call_function("format_number", x, F.lit("0." + "#" * 340)))


def whole(c: Column) -> Column:
    """A number cut toward zero; beyond the range of a long its ends, and 0 for NaN."""
    x = c.cast("double")
    top = 9.223372036854775807e18
    low = F.expr("-9223372036854775807L - 1L")
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= top, F.lit(_LONG_MAX)).when(x <= -top, low).otherwise(x.try_cast("long"))


def value_key(c: Column) -> Column:
    """Numbers in thousandths, as ``whole``; null for null."""
    return whole(c.cast("double") * 1000.0)


def scaled(bound: float) -> int:
    """A query's bound as a value key."""
    return max(_LONG_MIN, min(_LONG_MAX, int(bound) * 1000 if float(bound).is_integer() else int(bound * 1000.0)))


def normalize_date(c: Column) -> Column:
    """Y-M-D from Y-M-D or D-M-Y with - or /; parts stay as written, and other texts as they are."""
    p = F.split(F.replace(F.trim(c), F.lit("/"), F.lit("-")), "-")
    return F.when(F.size(p) != 3, c).when(F.length(F.get(p, 0)) == 4, F.array_join(p, "-")).otherwise(F.array_join(F.reverse(p), "-"))


def date_key(c: Column) -> Column:
    """y * 10000 + m * 100 + d of a normalized date; null if it hasn't three whole numbers."""
    p = F.split(c, "-")
    part = lambda i: F.get(p, i).try_cast("long")
    return F.when(F.size(p) == 3, part(0) * 10000 + part(1) * 100 + part(2))


def leaf(path: Column) -> Column:
    """A path's last segment."""
    return F.substring_index(path, ".", -1)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance with unit costs."""
    return F.levenshtein(a, b)
