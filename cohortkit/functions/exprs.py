"""Cleaning and feature expressions: ``Column -> Column``.

Built-in functions only, stateless, so every one stays inside whole-stage codegen
and works on a batch or a streaming DataFrame alike.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "==": operator.eq,
}


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def null_codes(c: Column, codes: Iterable[float]) -> Column:
    """Null where the value is one of the non-response codes."""
    return F.when(~c.isin(*codes), c)


def in_range(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.between(lo, hi), c)


def rescaled(
    c: Column, lo: float, hi: float, divisor: float = 1.0, zero_codes: Sequence[float] = ()
) -> Column:
    if zero_codes:
        c = F.when(c.isin(*zero_codes), 0.0).otherwise(c)
    if divisor != 1.0:
        c = c / divisor
    return in_range(c, lo, hi)


def reverse_scale(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.between(lo, hi), (lo + hi) - c)


def compare_flag(c: Column, op: str, cut: float) -> Column:
    """0/1 for ``c <op> cut``, null for null."""
    return COMPARE[op](c, cut).cast("int")


def between_flag(c: Column, lo: float, hi: float, closed: bool = False) -> Column:
    upper = c <= hi if closed else c < hi
    return ((c >= lo) & upper).cast("int")


def recode(c: Column, mapping: Mapping[Any, Any]) -> Column:
    """New value per listed code, null for the rest."""
    (code, value), *rest = mapping.items()
    chain = F.when(c == code, value)
    for code, value in rest:
        chain = chain.when(c == code, value)
    return chain


def overlay_codes(c: Column, mapping: Mapping[Any, Any]) -> Column:
    """New value per listed code, the old value for the rest."""
    return F.coalesce(recode(c, mapping), c)


def band(
    c: Column, cuts: Sequence[float], labels: Sequence[str], missing: str | None = None
) -> Column:
    """Half-open bands: below ``cuts[0]``, ``[cuts[0], cuts[1])``, ..., from ``cuts[-1]`` up."""
    if len(labels) != len(cuts) + 1 or list(cuts) != sorted(cuts):
        raise ValueError("bands need ascending cuts and one label more than cuts")
    chain = F.when(c < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        chain = chain.when(c < cut, label)
    chain = chain.when(c.isNotNull(), labels[-1])
    return chain if missing is None else chain.otherwise(missing)


def outcome_flag(c: Column, yes: Iterable[float]) -> Column:
    """1 for a yes-code, 0 for any other answer, null for null or NaN."""
    return F.when(~F.isnan(c), c.isin(*yes).cast("int"))


def add_up(parts: Sequence[Column]) -> Column:
    """Sum with null counted as 0."""
    return reduce(operator.add, (F.coalesce(p, F.lit(0)) for p in parts))


def count_observed(parts: Sequence[Column]) -> Column:
    return reduce(operator.add, (available(p) for p in parts))


def available(c: Column) -> Column:
    return c.isNotNull().cast("int")


def log_positive(c: Column, missing: float | None = None) -> Column:
    logged = F.when(c > 0, F.log1p(c)).when(c.isNotNull(), F.lit(0.0))
    return logged if missing is None else F.coalesce(logged, F.lit(float(missing)))


def offset(c: Column, base: float) -> Column:
    return (c - base).cast("double")


def stars(p: Column) -> Column:
    """Significance marks at .001, .01 and .05."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def per_cent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, null when there is nothing to divide by."""
    return F.try_divide(F.lit(100.0) * part, whole)


def hash_share(key: Column, seed: int, buckets: int = 100) -> Column:
    """A bucket in ``0..buckets-1`` from the key's text alone: same row, same bucket,
    whatever the partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
