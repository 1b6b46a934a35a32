"""Projection, filters, nesting one level up or down, and appending."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordinata.rel import ORDER, Rel, Row, RowFn, named


def map_(xs: Rel, f: RowFn) -> Rel:
    return xs.with_fields(named(f(xs.row)))


def filter_(xs: Rel, p: Callable[[Row], Column]) -> Rel:
    return Rel(xs.df.where(p(xs.row)), xs.fields, xs.dirs)


guard = filter_


def leading_guard(holds: Column, xs: Rel) -> Rel:
    """A guard before any generator: the whole list or nothing."""
    return Rel(xs.df.where(holds), xs.fields, xs.dirs)


def concat_map(xs: Rel, f: Callable[[Row], Column], keep: tuple[str, ...] = (), name: str = "value") -> Rel:
    """The elements of the arrays that f gives, in order, beside some fields of where they came from."""
    df = xs.df.select(*[F.col(f"`{k}`") for k in keep], *xs.order_columns, F.posexplode(f(xs.row)).alias(f"{ORDER}{len(xs.dirs)}", name))
    return Rel(df, [*keep, name], [*xs.dirs, True])


def concat(xss: Rel) -> Rel:
    """One list of the inner lists' elements."""
    return concat_map(xss, lambda r: r.only())


def nest(xs: Rel, name: str = "members", item: Callable[[Row], Column] | None = None):
    """The whole list as one array: a one-row DataFrame.  It must fit in a row."""
    r = xs.rising()
    value = item(r.row) if item else (r.row.only() if len(r.fields) == 1 else r.row.struct())
    gathered = F.sort_array(F.collect_list(F.struct(r.rank().alias("o"), value.alias("v"))))
    return r.df.agg(F.transform(gathered, lambda s: s["v"]).alias(name))


def append(xs: Rel, ys: Rel) -> Rel:
    """First xs, then ys; both have the same fields."""
    if set(xs.fields) != set(ys.fields):
        raise ValueError("append needs lists of the same fields")
    # one order column each, of a common type: sides are told apart first
    a, b = xs.rising(), ys.rising()
    rank = lambda side, r: [F.lit(side).alias(f"{ORDER}0"), *[(F.col(c) if side == own else F.lit(None).cast(t)).alias(f"{ORDER}{1 + i}") for i, (own, c, t) in enumerate(_sides(a, b))]]
    df = a.df.select(*xs.fields, *rank(0, a)).unionByName(b.df.select(*xs.fields, *rank(1, b)))
    return Rel(df, xs.fields, [True] * (1 + len(a.dirs) + len(b.dirs)))


def _sides(a: Rel, b: Rel) -> list[tuple[int, str, str]]:
    types = [dict(r.df.dtypes) for r in (a, b)]
    return [(s, c, types[s][c]) for s, r in enumerate((a, b)) for c in r.order_columns]


def cons(x: Mapping[str, Column], xs: Rel) -> Rel:
    return append(single(x, xs), xs)


def snoc(xs: Rel, x: Mapping[str, Column]) -> Rel:
    return append(xs, single(x, xs))


def single(x: Mapping[str, Column], like: Rel) -> Rel:
    """A list of one element, with the fields' types of another list."""
    types = dict(like.df.dtypes)
    df = like.df.sparkSession.range(1).select(*[x[f].cast(types[f]).alias(f) for f in like.fields], F.lit(1).cast("long").alias(f"{ORDER}0"))
    return Rel(df, like.fields, [True])


def nub(xs: Rel) -> Rel:
    """First occurrences in order: grouped by value, with the least rank."""
    r = xs.rising()
    df = r.df.groupBy(*[F.col(f"`{f}`") for f in r.fields]).agg(F.min(r.rank()).alias("__first"))
    return Rel(df.select(*[F.col(f"`{f}`") for f in r.fields], *[F.col(f"__first.{c}").alias(c) for c in r.order_columns]), r.fields, r.dirs)


def union(xs: Rel, ys: Rel) -> Rel:
    """Distinct elements of both, first occurrences in order."""
    return nub(append(xs, ys))


def renamed(xs: Rel, prefix: str) -> Rel:
    """The same list with `prefix` before its field names, as joins of a list with itself need."""
    return xs.with_fields({prefix + f: F.col(f"`{f}`") for f in xs.fields})


def unzip(xs: Rel) -> tuple[Rel, ...]:
    """A list for each field."""
    return tuple(xs.with_fields({f: F.col(f"`{f}`")}) for f in xs.fields)


def lookup(key: Column, pairs: Rel, of: Callable[[Row], Column], item: Callable[[Row], Column], name: str = "value") -> Rel:
    """The values that a list of pairs has under one key, in order."""
    return map_(filter_(pairs, lambda r: of(r) == key), lambda r: {name: item(r)})
