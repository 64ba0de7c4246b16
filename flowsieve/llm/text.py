"""Column expressions on words, shared by the operators of this package. All run on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words. A to Z are lower-cased word by word after the split, which gives the same words.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often and deep ``body`` names it.

    A lambda over an array of one element: the optimizer cannot copy ``value`` into inner
    lambdas, where it would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(word: Column) -> Column:
    """A to Z in lower case, all other characters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text in order: maximal runs of a-z, 0-9 and non-ASCII characters; null has none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")
    return F.transform(parts, ascii_lower)


def text_key(text: Column) -> Column:
    """Key of a text's content; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
