"""Deterministic random columns for generated tables: functions of a seed and row ids, so that retries agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The syllables that customers' last names are made of, by digit.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def draw(seed: str, *ids: Column) -> Column:
    """A hash of the row, nonnegative."""
    return F.xxhash64(F.lit(seed), *ids).bitwiseAND(F.lit((1 << 63) - 1))


def uniform(seed: str, low: int, high: int, *ids: Column) -> Column:
    """A whole number of low..high."""
    return (draw(seed, *ids) % (high - low + 1) + low).cast("long")


def non_uniform(seed: str, a: int, c: int, low: int, high: int, *ids: Column) -> Column:
    """The benchmark's skewed whole numbers of low..high: two uniform draws, or-ed."""
    both = uniform(f"{seed}/a", 0, a, *ids).bitwiseOR(uniform(f"{seed}/b", low, high, *ids))
    return (both + c) % (high - low + 1) + low


def last_name(number: Column) -> Column:
    part = lambda n: F.element_at(F.array(*map(F.lit, SYLLABLES)), (n % 10 + 1).cast("int"))
    return F.concat(part(F.floor(number / 100)), part(F.floor(number / 10)), part(number))


def text(seed: str, low: int, high: int, *ids: Column) -> Column:
    """Letters and digits, low..high of them."""
    n = uniform(f"{seed}/n", low, high, *ids)
    row = draw(seed, *ids)
    char = lambda i: F.substring(F.lit(ALPHANUMERIC), (F.xxhash64(row, i).bitwiseAND(F.lit((1 << 63) - 1)) % 62 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), char), "")


def char(value: Column, width: int) -> Column:
    """Fixed-width text, padded with spaces."""
    return F.rpad(value, width, " ")
