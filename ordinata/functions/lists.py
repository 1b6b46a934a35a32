"""The list operators on inner lists: array columns, by higher-order functions, never by exploding.

Lists have no nulls inside.  Aggregates of the empty list: `total` 0, `length` 0,
`and_` true, `or_` false; `average`, `minimum` and `maximum` null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def nil(kind: str) -> Column:
    """The empty list of an element type."""
    return F.array().cast(f"array<{kind}>")


def singleton(x: Column) -> Column:
    return F.array(x)


def map_(f: Fn, xs: Column) -> Column:
    return F.transform(xs, f)


def filter_(p: Fn, xs: Column) -> Column:
    return F.filter(xs, p)


def concat(xss: Column) -> Column:
    return F.flatten(xss)


def concat_map(f: Fn, xs: Column) -> Column:
    return F.flatten(F.transform(xs, f))


def append(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


def cons(x: Column, xs: Column) -> Column:
    return F.array_prepend(xs, x)


def snoc(xs: Column, x: Column) -> Column:
    return F.array_append(xs, x)


def reverse(xs: Column) -> Column:
    return F.reverse(xs)


def nub(xs: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(xs)


def number(xs: Column) -> Column:
    """(x, position from 1)."""
    return F.transform(xs, lambda x, i: F.struct(x.alias("value"), (i + 1).cast("bigint").alias("pos")))


def sort_with(f: Fn, xs: Column) -> Column:
    """Stable, rising by key."""
    keyed = F.transform(xs, lambda x, i: F.struct(f(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def group_with_key(f: Fn, xs: Column) -> Column:
    """(key, members) by rising key; members keep their order.  For few different keys: each key scans the list."""
    keys = F.sort_array(F.array_distinct(F.transform(xs, f)))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(xs, lambda x: f(x) == k).alias("members")))


def group_with(f: Fn, xs: Column) -> Column:
    return F.transform(group_with_key(f, xs), lambda g: g["members"])


def zip_with(f: Callable[[Column, Column], Column], xs: Column, ys: Column) -> Column:
    """As long as the shorter list."""
    n = F.least(F.size(xs), F.size(ys))
    return F.zip_with(F.slice(xs, F.lit(1), n), F.slice(ys, F.lit(1), n), f)


def zip_(xs: Column, ys: Column) -> Column:
    return zip_with(lambda x, y: F.struct(x.alias("_1"), y.alias("_2")), xs, ys)


def zip3(xs: Column, ys: Column, zs: Column) -> Column:
    return zip_with(lambda p, z: F.struct(p["_1"].alias("_1"), p["_2"].alias("_2"), z.alias("_3")), zip_(xs, ys), zs)


def zip_with3(f: Callable[[Column, Column, Column], Column], xs: Column, ys: Column, zs: Column) -> Column:
    return F.transform(zip3(xs, ys, zs), lambda t: f(t["_1"], t["_2"], t["_3"]))


def unzip(ps: Column, fields: tuple[str, ...] = ("_1", "_2")) -> Column:
    """A tuple of lists from a list of tuples."""
    return F.struct(*[_component(ps, f).alias(f) for f in fields])


def _component(ps: Column, field: str) -> Column:
    return F.transform(ps, lambda p: p[field])


def unzip3(ts: Column) -> Column:
    return unzip(ts, ("_1", "_2", "_3"))


def take(n: Column | int, xs: Column) -> Column:
    """The first n; none for a negative count, all for too large a one."""
    return F.slice(xs, F.lit(1), F.greatest(_int(n), F.lit(0)))


def drop(n: Column | int, xs: Column) -> Column:
    return F.filter(xs, lambda x, i: i >= _int(n))


def split_at(n: Column | int, xs: Column) -> Column:
    return F.struct(take(n, xs).alias("_1"), drop(n, xs).alias("_2"))


def head(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def index(xs: Column, i: Column | int) -> Column:
    """The element at i, counted from 0; null outside the list."""
    return F.get(xs, _int(i))


def only(xs: Column) -> Column:
    """The element of a list of one."""
    return F.get(xs, F.lit(0))


def tail(xs: Column) -> Column:
    return F.filter(xs, lambda x, i: i > 0)


def init(xs: Column) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0)))


def _prefix(p: Fn, xs: Column) -> Column:
    """How many elements hold before the first that does not."""
    first = F.array_position(F.transform(xs, p), F.lit(False))
    return F.when(first == 0, F.size(xs)).otherwise((first - 1).cast("int"))


def take_while(p: Fn, xs: Column) -> Column:
    return F.slice(xs, F.lit(1), _prefix(p, xs))


def drop_while(p: Fn, xs: Column) -> Column:
    n = _prefix(p, xs)
    return F.filter(xs, lambda x, i: i >= n)


def span(p: Fn, xs: Column) -> Column:
    return F.struct(take_while(p, xs).alias("_1"), drop_while(p, xs).alias("_2"))


def break_(p: Fn, xs: Column) -> Column:
    return span(lambda x: ~p(x), xs)


def total(xs: Column, kind: str = "bigint") -> Column:
    return F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def average(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(F.size(xs), F.lit(1)))


def minimum(xs: Column) -> Column:
    return F.array_min(xs)


def maximum(xs: Column) -> Column:
    return F.array_max(xs)


def length(xs: Column) -> Column:
    return F.size(xs).cast("bigint")


def count_distinct(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)).cast("bigint")


def and_(xs: Column) -> Column:
    return F.forall(xs, lambda x: x)


def or_(xs: Column) -> Column:
    return F.exists(xs, lambda x: x)


def any_(p: Fn, xs: Column) -> Column:
    return F.exists(xs, p)


def all_(p: Fn, xs: Column) -> Column:
    return F.forall(xs, p)


def elem(x: Column, xs: Column) -> Column:
    return F.array_contains(xs, x)


def not_elem(x: Column, xs: Column) -> Column:
    return ~F.array_contains(xs, x)


def null(xs: Column) -> Column:
    return F.size(xs) == 0


def lookup(key: Column, pairs: Column) -> Column:
    """All values of a key, in order: the empty list for none."""
    return F.transform(F.filter(pairs, lambda p: p["_1"] == key), lambda p: p["_2"])


def join(on: Callable[[Column, Column], Column], xs: Column, ys: Column) -> Column:
    """Pairs of two inner lists that meet `on`, left-major."""
    return F.flatten(F.transform(xs, lambda x: F.transform(F.filter(ys, lambda y: on(x, y)), lambda y: F.struct(x.alias("_1"), y.alias("_2")))))


def semi_join(on: Callable[[Column, Column], Column], xs: Column, ys: Column) -> Column:
    return F.filter(xs, lambda x: F.exists(ys, lambda y: on(x, y)))


def anti_join(on: Callable[[Column, Column], Column], xs: Column, ys: Column) -> Column:
    return F.filter(xs, lambda x: ~F.exists(ys, lambda y: on(x, y)))


def nest_join(on: Callable[[Column, Column], Column], xs: Column, ys: Column) -> Column:
    """Each x with the list of its partners."""
    return F.transform(xs, lambda x: F.struct(x.alias("_1"), F.filter(ys, lambda y: on(x, y)).alias("_2")))


def product(xs: Column, ys: Column) -> Column:
    """All pairs of two inner lists, left-major."""
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("_1"), y.alias("_2")))))


def group_join(on: Callable[[Column, Column], Column], f: Fn, xs: Column, ys: Column) -> Column:
    """Each x with the fold f of the list of its partners."""
    return F.transform(nest_join(on, xs, ys), lambda p: F.struct(p["_1"].alias("_1"), f(p["_2"]).alias("_2")))


def group_aggr(key: Fn, f: Fn, xs: Column) -> Column:
    """(key, fold f of its members) by rising key."""
    return F.transform(group_with_key(key, xs), lambda g: F.struct(g["key"].alias("key"), f(g["members"]).alias("value")))


def _int(n: Column | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("int")
