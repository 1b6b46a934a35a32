"""Maybe as a list of no or one element, Either as a pair of such lists; nested Maybes keep their levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def just(x: Column) -> Column:
    return F.array(x)


def from_nullable(x: Column) -> Column:
    """Null is nothing."""
    return F.filter(F.array(x), lambda v: v.isNotNull())


def to_nullable(m: Column) -> Column:
    return F.get(m, F.lit(0))


def list_to_maybe(xs: Column) -> Column:
    """The list itself: a Maybe is one; what is seen of it is the first element."""
    return xs


def maybe_to_list(m: Column) -> Column:
    return m


def is_nothing(m: Column) -> Column:
    return F.size(m) == 0


def is_just(m: Column) -> Column:
    return F.size(m) > 0


def from_just(m: Column) -> Column:
    return F.get(m, F.lit(0))


def from_maybe(default: Column, m: Column) -> Column:
    return F.when(is_nothing(m), default).otherwise(from_just(m))


def maybe(default: Column, f: Fn, m: Column) -> Column:
    return F.when(is_nothing(m), default).otherwise(f(from_just(m)))


def cat_maybes(ms: Column) -> Column:
    return F.flatten(ms)


def map_maybe(f: Fn, xs: Column) -> Column:
    return F.flatten(F.transform(xs, f))


def left(x: Column, right_kind: str) -> Column:
    return F.struct(F.array(x).alias("left"), nothing(right_kind).alias("right"))


def right(x: Column, left_kind: str) -> Column:
    return F.struct(nothing(left_kind).alias("left"), F.array(x).alias("right"))


def pair_to_either(lefts: Column, rights: Column) -> Column:
    return F.struct(lefts.alias("left"), rights.alias("right"))


def either_to_pair(e: Column) -> Column:
    return F.struct(e["left"].alias("_1"), e["right"].alias("_2"))


def is_left(e: Column) -> Column:
    return F.size(e["left"]) > 0


def is_right(e: Column) -> Column:
    return F.size(e["right"]) > 0


def either(f: Fn, g: Fn, e: Column) -> Column:
    return F.when(is_left(e), f(F.get(e["left"], F.lit(0)))).otherwise(g(F.get(e["right"], F.lit(0))))


def lefts(es: Column) -> Column:
    return F.flatten(F.transform(es, lambda e: e["left"]))


def rights(es: Column) -> Column:
    return F.flatten(F.transform(es, lambda e: e["right"]))


def partition_eithers(es: Column) -> Column:
    return F.struct(lefts(es).alias("_1"), rights(es).alias("_2"))
