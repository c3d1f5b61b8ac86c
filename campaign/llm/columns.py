"""Column helpers of the operators that use built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what parts words: ASCII characters other than digits and letters, after A-Z became a-z
BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other characters as they are; the quick way where all are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def plain_words(text: Column) -> Column:
    """Words of a text as an array: A-Z lower-cased, parted by BETWEEN_WORDS; none of a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def upto(first: Column, last: Column) -> Column:
    """first..last as an array, empty where last is less."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _doubled(first: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """At each element the join of n consecutive ones, from joins of half as many; the last n - 1 are not whole."""
    if n == 1:
        return first
    if n % 2:
        return let(_doubled(first, n - 1, join), lambda p: F.zip_with(p, F.slice(first, n, F.size(p)), join))
    return let(_doubled(first, n // 2, join), lambda p: F.zip_with(p, F.slice(p, n // 2 + 1, F.size(p)), join))


def _sliding(values: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    whole = lambda v: F.slice(_doubled(v, n, join), 1, F.greatest(F.size(v) - (n - 1), F.lit(0)))
    return let(values, whole)


def window_hashes(words: Column, n: int) -> Column:
    """Hashes of all n consecutive words."""
    return _sliding(F.transform(words, lambda w: F.xxhash64(w)), n, lambda a, b: F.xxhash64(a, b))


def sliding_least(values: Column, n: int) -> Column:
    """The least of all n consecutive values."""
    return _sliding(values, n, lambda a, b: F.least(a, b))
