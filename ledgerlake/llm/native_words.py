"""Words of a text as Catalyst expressions, for the operators that stay inside Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.llm.common import SEPARATOR_CLASS, SEPARATORS


def is_blank(text: Column) -> Column:
    return F.translate(text, SEPARATORS, "") == ""


def words(text: Column) -> Column:
    """Maximal runs of other characters than the six separators; an empty array where there are none."""
    trimmed = F.trim(text, F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_CLASS + "+"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, k: int) -> Column:
    """64-bit hashes of every k consecutive elements; an empty array where there are fewer."""
    n = F.size(hashes)
    return F.when(n < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k))))
