"""Numeric cleaning, comparison and window-bound arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_numeric(c: Column | str) -> Column:
    """Coerce to double; text, NaN and infinities become NULL. Sentinels such as -2 stay."""
    x = _c(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def is_finite(c: Column | str) -> Column:
    """True or false, never NULL."""
    x = _c(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clip_probability(c: Column | str, eps: float = 1e-6) -> Column:
    """A probability kept off zero and one; a missing or non-finite one is missing."""
    return F.when(is_finite(c), F.greatest(F.least(_c(c), F.lit(1.0 - eps)), F.lit(eps)))


def finite_or_fail(c: Column | str, what: str) -> Column:
    """The value, or an error that ends the job where it is missing or not finite."""
    wrong = F.raise_error(F.lit(f"{what} is missing or not finite"))
    return F.when(is_finite(c), _c(c)).otherwise(wrong)


def near(a: Column | str, b: Column | str, atol: float = 1e-9) -> Column:
    """|a - b| <= atol; a missing side compares false."""
    return F.coalesce(F.abs(_c(a) - _c(b)) <= F.lit(atol), F.lit(False))


def magnitude(*axes: Column | str) -> Column:
    """Euclidean length, NULL unless every axis is present (clean the axes first)."""
    return F.sqrt(reduce(lambda s, t: s + t, [_c(a) * _c(a) for a in axes]))


def change(final: Column | str, initial: Column | str) -> Column:
    return _c(final) - _c(initial)


def start_bounds(t: Column, window: float, rate: float) -> tuple[Column, Column]:
    """Sample bounds [a, b) counted from the first sample; halves round to even."""
    return (F.bround((t - window) * rate).cast("bigint"), F.bround(t * rate).cast("bigint"))


def end_bounds(
    t: Column, duration: Column, n: Column, window: float, rate: float
) -> tuple[Column, Column]:
    """Sample bounds [a, b) counted back from the last sample."""
    a = F.bround(n - (duration - (t - window)) * rate).cast("bigint")
    b = F.bround(n - (duration - t) * rate).cast("bigint")
    return a, b


def bounds_valid(a: Column, b: Column, n: Column) -> Column:
    return (a >= 0) & (b <= n) & (b > a)


def hash_int(*parts: Column | str) -> Column:
    """First 32 bits of md5 over the '|'-joined parts, as BIGINT (same value in any engine)."""
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
