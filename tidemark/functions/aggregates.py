"""Aggregates of a model without nulls: an empty input gives 0, not null.

All are built-ins with partial aggregation. ``count_distinct`` is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_star() -> Column:
    return F.count(F.lit(1))


def count(c: Column | str) -> Column:
    return F.count(_column(c))


def sum_(c: Column | str, zero: object = 0) -> Column:
    total = F.sum(_column(c))
    return F.coalesce(total, F.lit(zero).cast("double" if isinstance(zero, float) else "long"))


def avg(c: Column | str) -> Column:
    return F.coalesce(F.avg(_column(c)), F.lit(0.0))


def _zero(zero: object) -> Column:
    return F.lit(zero).cast("long") if isinstance(zero, int) else F.lit(zero)


def min_(c: Column | str, zero: object = 0) -> Column:
    return F.coalesce(F.min(_column(c)), _zero(zero))


def max_(c: Column | str, zero: object = 0) -> Column:
    return F.coalesce(F.max(_column(c)), _zero(zero))


def count_distinct(c: Column | str) -> Column:
    return F.count_distinct(_column(c))
