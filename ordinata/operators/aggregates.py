"""Aggregates with a value for the empty list."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinata.rel import Rel, Row

Value = Callable[[Row], Column]


@dataclasses.dataclass(frozen=True)
class Agg:
    """How to fold an expression over a list, and what the empty list gives (None: null)."""

    fold: Callable[[Row], Column]
    empty: object = None

    def over(self, row: Row) -> Column:
        """For use in `agg`: with the value for no rows."""
        return self.filled(self.fold(row))

    def filled(self, value: Column) -> Column:
        return value if self.empty is None else F.coalesce(value, F.lit(self.empty))


def total(f: Value, kind: str = "bigint") -> Agg:
    """Sum, in the type `kind`; 0 for no rows."""
    return Agg(lambda r: F.sum(f(r)).cast(kind), 0)


def average(f: Value, kind: str | None = None) -> Agg:
    return Agg(lambda r: F.avg(f(r)).cast(kind) if kind else F.avg(f(r)))


def minimum(f: Value) -> Agg:
    return Agg(lambda r: F.min(f(r)))


def maximum(f: Value) -> Agg:
    return Agg(lambda r: F.max(f(r)))


def length() -> Agg:
    return Agg(lambda r: F.count(F.lit(1)), 0)


def count_distinct(f: Value) -> Agg:
    return Agg(lambda r: F.count_distinct(f(r)), 0)


def every(f: Value) -> Agg:
    """Whether all hold; true for no rows."""
    return Agg(lambda r: F.bool_and(f(r)), True)


def some(f: Value) -> Agg:
    """Whether any holds; false for no rows."""
    return Agg(lambda r: F.bool_or(f(r)), False)


def fold(xs: Rel, **aggs: Agg) -> DataFrame:
    """Fold a whole list: one row, also for the empty list."""
    return xs.df.agg(*[a.over(xs.row).alias(n) for n, a in aggs.items()])


def null(xs: Rel, name: str = "value") -> DataFrame:
    """Whether the list is empty: looks for one row."""
    return xs.df.limit(1).agg((F.count(F.lit(1)) == 0).alias(name))


def any_(xs: Rel, p: Value) -> DataFrame:
    return fold(xs, value=some(p))


def all_(xs: Rel, p: Value) -> DataFrame:
    return fold(xs, value=every(p))


def elem(x: Column, xs: Rel) -> DataFrame:
    """Whether x is among the values of a list with one field."""
    return fold(xs, value=some(lambda r: r.only() == x))


def not_elem(x: Column, xs: Rel) -> DataFrame:
    return elem(x, xs).select((~F.col("value")).alias("value"))
