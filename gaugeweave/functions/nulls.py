"""Null rules shared by all operators: NaN and infinities count as missing, division never raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: str | Column) -> Column:
    """NaN becomes null."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c: str | Column) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def log10(c: str | Column) -> Column:
    """Null for zero and below."""
    c = col(c)
    return F.when(c > 0, F.log10(c))


def root(c: str | Column, power: float = 2.0) -> Column:
    """Null below zero."""
    c = col(c)
    return F.when(c >= 0, F.sqrt(c) if power == 2.0 else F.pow(c, F.lit(1.0 / power)))


def all_present(*cs: str | Column) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cs])


def strict_greatest(*cs: str | Column) -> Column:
    """Null where any argument is."""
    return F.when(all_present(*cs), F.greatest(*map(col, cs)))


def poisoned(agg: Column, c: str | Column) -> Column:
    """An aggregate that is null where the group holds a null in ``c``."""
    return F.when(F.count(F.lit(1)) == F.count(col(c)), agg)
