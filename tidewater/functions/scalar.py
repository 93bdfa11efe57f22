"""Scalar functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def increment(c: Column, by: int = 1) -> Column:
    return c + F.lit(by)


def decrement(c: Column, by: int = 1) -> Column:
    return c - F.lit(by)


def fixed_length(c: Column, n: int) -> Column:
    """Padded with spaces on the right, or cut, to n characters."""
    return F.rpad(c, n, " ")


def as_text(c: Column) -> Column:
    return c.cast("string")


def is_integer(c: Column) -> Column:
    """Whether text is an optional minus sign and decimal digits; null for null."""
    return c.rlike("^-?[0-9]+$")


def minute_floor(c: Column) -> Column:
    return F.date_trunc("minute", c)


def working_days(a: Column, b: Column) -> Column:
    """Monday to Friday days after the earlier of two dates up to the later; 0 for equal dates, and where one is null.

    Days are counted from a Monday, the one before 1970: five for each whole week and those of the week begun."""

    def until(c: Column) -> Column:
        n = F.unix_date(c) + 4
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.coalesce(until(F.greatest(a, b)) - until(F.least(a, b)), F.lit(0)).cast("int")


def millis(c: Column) -> Column:
    return F.unix_millis(c)


def micros_of_milli(c: Column) -> Column:
    """Microseconds past the last whole millisecond."""
    return F.unix_micros(c) % 1000


def key_partition(key: Column, items: int, partitions: int) -> Column:
    """Range partition of a whole-number key below `items`; the last one takes what is above."""
    return F.least(F.floor(key / F.lit(-(-items // partitions))), F.lit(partitions - 1)).cast("int")


def uniform(seed: int, *on: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the inputs as text, joined by colons, and the seed: the same
    for the same inputs, wherever it runs and in whatever engine."""
    text = F.concat_ws(":", *(c.cast("string") for c in on), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def flat(u: Column, low: int, high: int) -> Column:
    """Whole numbers in [low, high)."""
    return (F.floor(u * (high - low)) + low).cast("long")


def gaussian(u: Column, v: Column) -> Column:
    """Standard normal from two uniforms (Box-Muller)."""
    return F.sqrt(-2 * F.log(F.lit(1.0) - u)) * F.cos(2 * math.pi * v)


def binomial(us: list[Column], p: float) -> Column:
    """Successes among as many trials as there are uniforms."""
    return sum(((u < p).cast("int") for u in us), F.lit(0))


def by_share(u: Column, shares: dict) -> Column:
    """A value drawn by share: a histogram, or hot, warm and cold keys."""
    total, out, seen = sum(shares.values()), None, 0.0
    for value, share in shares.items():
        seen += share / total
        out = F.when(u < seen, F.lit(value)) if out is None else out.when(u < seen, F.lit(value))
    return out.otherwise(F.lit(list(shares)[-1]))


def zipf(u: Column, n: int, skew: float) -> Column:
    """Keys 0 to n - 1 with weight (k + 1) ** -skew, by the continuous inverse of the distribution function."""
    if skew == 0:
        return flat(u, 0, n)
    if skew == 1:
        x = F.exp(u * math.log(n + 1))
    else:
        a = 1 - skew
        x = F.pow(u * ((n + 1) ** a - 1) + 1, F.lit(1 / a))
    return F.least(F.floor(x) - 1, F.lit(n - 1)).cast("long")
