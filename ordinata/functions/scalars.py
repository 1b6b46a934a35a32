"""Scalar functions with the list language's meaning where Spark's differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quot(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b)


def rem(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def minimum_of(a: Column, b: Column) -> Column:
    return F.least(a, b)


def maximum_of(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def cond(test: Column, then: Column, other: Column) -> Column:
    """`then` where the test holds, else `other`; both may be lists or tuples."""
    return F.when(test, then).otherwise(other)


def signum(a: Column, kind: str = "bigint") -> Column:
    """-1, 0 or 1 in the argument's type."""
    return F.signum(a).cast(kind)


def integer_to_double(a: Column) -> Column:
    return a.cast("double")


def integer_to_decimal(a: Column, scale: int = 2) -> Column:
    return a.cast(f"decimal(38,{scale})")


def average(a: Column, kind: str | None = None) -> Column:
    """The average; a decimal one cast back to its argument's type `kind`."""
    return F.avg(a).cast(kind) if kind else F.avg(a)


def like(a: Column, pattern: Column | str) -> Column:
    """SQL LIKE, with regard to case."""
    return F.like(a, F.lit(pattern) if isinstance(pattern, str) else pattern)


def not_like(a: Column, pattern: Column | str) -> Column:
    return ~like(a, pattern)


def re_match(a: Column, pattern: str) -> Column:
    """Whether a regular expression is found in the text."""
    return F.rlike(a, F.lit(pattern))


def sub_string(a: Column, start: int, length: int) -> Column:
    """`length` characters from `start`, counted from 1; a start under 1 is refused, since engines differ there."""
    if start < 1 or length < 0:
        raise ValueError("sub_string needs start >= 1 and length >= 0")
    return F.substring(a, start, length)


def add_days(n: Column, day: Column) -> Column:
    return F.date_add(day, n.cast("int"))


def sub_days(n: Column, day: Column) -> Column:
    return F.date_sub(day, n.cast("int"))


def diff_days(a: Column, b: Column) -> Column:
    """Days from b to a."""
    return F.date_diff(a, b).cast("bigint")


def to_gregorian(day: Column) -> Column:
    """(year, month, day) as a struct."""
    return F.struct(F.year(day).cast("bigint").alias("year"), F.month(day).cast("bigint").alias("month"), F.dayofmonth(day).cast("bigint").alias("day"))


def date_year(day: Column) -> Column:
    return F.year(day).cast("bigint")
