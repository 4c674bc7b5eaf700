"""Predicates and projections of queries; arguments that are not given leave a filter out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal(column: str, value) -> Column | None:
    return None if value is None or value == "" else F.col(column) == value


def one_of(column: str, values: Iterable | None, single=None, single_wins: bool = False) -> Column | None:
    """``column`` among ``values``; with both a list and a single value the one that wins counts."""
    values = list(values) if values is not None else None
    if single is not None and (single_wins or not values):
        return F.col(column) == single
    return F.col(column).isin(values) if values else None


def matches(column: str, pattern: str | None, ignore_case: bool = True) -> Column | None:
    """Unanchored regular expression."""
    return F.col(column).rlike(("(?i)" if ignore_case else "") + pattern) if pattern else None


def half_open(column: str, low=None, high=None) -> Column | None:
    """[low, high)."""
    parts = [F.col(column) >= low] * (low is not None) + [F.col(column) < high] * (high is not None)
    return reduce(Column.__and__, parts) if parts else None


def closed(column: str, low=None, high=None, default_low=0.0, default_high=1.0) -> Column | None:
    """[low, high]; nothing if neither is given."""
    if low is None and high is None:
        return None
    return F.col(column).between(default_low if low is None else low, default_high if high is None else high)


def stabs(value, start: str = "start", end: str = "end") -> Column:
    """Closed windows that hold a value."""
    return F.lit(value).between(F.col(start), F.col(end))


def contains(column: str, value) -> Column | None:
    return F.array_contains(column, value) if value is not None else None


def fewer_than(column: str, n: int, wanted: bool | None = True) -> Column | None:
    """Arrays of fewer than ``n`` elements, if wanted."""
    return F.coalesce(F.size(column), F.lit(0)) < n if wanted else None


def enabled(column: str = "disable", value: bool | None = False) -> Column | None:
    """Rows that are not disabled, unless the caller passes None."""
    return F.col(column) == value if value is not None else None


def not_prefixed(column: str, prefix: str) -> Column:
    """Array columns whose first element lacks a prefix; rows without one stay."""
    return ~F.coalesce(F.get(F.col(column), F.lit(0)).startswith(prefix), F.lit(False))


def where(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """All given predicates together, so that they reach the scan as one filter."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(Column.__and__, given)) if given else df


def page(df: DataFrame, order: list[Column], current: int = 1, size: int = 20) -> DataFrame:
    """The ``current``-th page (from 1) in a total order."""
    return df.orderBy(*order).offset((current - 1) * size).limit(size)


def first(df: DataFrame, *predicates: Column | None) -> DataFrame:
    return where(df, *predicates).limit(1)


def exists(df: DataFrame, *predicates: Column | None) -> bool:
    return not where(df, *predicates).isEmpty()
