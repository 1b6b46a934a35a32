"""Order, positions, and what depends on them.

With `within`, names of fields, an operator works on each group of equal values
by itself (the per-segment form): a window partitioned by them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordinata.rel import ORDER, Rel, Row, RowFn, named


def sort_with(xs: Rel, f: Callable[[Row], Column | Sequence[Column]]) -> Rel:
    """Stable, rising by key; a tuple of keys orders lexicographically."""
    keys = f(xs.row)
    keys = list(keys) if isinstance(keys, (list, tuple)) else [keys]
    return xs.with_order(keys, [True] * len(keys))


def reverse(xs: Rel) -> Rel:
    return Rel(xs.df, xs.fields, [not up for up in xs.dirs])


def number(xs: Rel, name: str = "pos", within: Sequence[str] = ()) -> Rel:
    """`xs` with field `name`: dense positions from 1.

    Without `within`, the list is dealt by ranges of its order and each partition
    is numbered by itself, from where the partitions before it end; no task sees the
    whole list.  The dealt rows are kept on the executors' disks, since numbers and
    sizes must come from one partitioning; a lost one is made again with the same bounds.
    `release` gives the disks back when no list that was numbered is read any more.
    """
    if within:
        pos = F.row_number().over(Window.partitionBy(*within).orderBy(*xs.order())).cast("bigint")
        return Rel(xs.df.withColumn(name, pos), [*xs.fields, name], xs.dirs)
    # the id's high bits are the partition's number, its low 33 bits the row's place
    d = xs.df.repartitionByRange(*xs.order()).sortWithinPartitions(*xs.order()).withColumn("__id", F.monotonically_increasing_id())
    d = kept(d)
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit(2**33 - 1))
    sizes = d.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row a partition
    d = d.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + place + 1).cast("bigint"))
    return Rel(d.select(*[F.col(f"`{f}`") for f in xs.fields], name, *xs.order_columns), [*xs.fields, name], xs.dirs)


#: What `kept` keeps on disks, until `release`.
_dealt: list[DataFrame] = []


def kept(d: DataFrame) -> DataFrame:
    """Dealt rows, kept on the executors' disks until `release`."""
    _dealt.append(d.persist(StorageLevel.DISK_ONLY))
    return _dealt[-1]


def release() -> None:
    """Drop the rows that `number` (and what rests on it: drop, zip, windows over whole lists) and joins by `below` keep on the executors' disks."""
    while _dealt:
        _dealt.pop().unpersist()


def take(xs: Rel, n: int | Column, within: Sequence[str] = ()) -> Rel:
    """The first n, none for a negative n.  A literal n on the whole list keeps only n rows a task."""
    if isinstance(n, int) and not within:
        return Rel(xs.df.orderBy(*xs.order()).limit(max(n, 0)), xs.fields, xs.dirs)
    return _where(xs, lambda pos: pos <= n, within)


def drop(xs: Rel, n: int | Column, within: Sequence[str] = ()) -> Rel:
    return _where(xs, lambda pos: pos > n, within)


def _where(xs: Rel, p: Callable[[Column], Column], within: Sequence[str]) -> Rel:
    d = number(xs, "__pos", within)
    return Rel(d.df.where(p(F.col("__pos"))).drop("__pos"), xs.fields, xs.dirs)


def top_k(xs: Rel, k: int, f: Callable[[Row], Column | Sequence[Column]], within: Sequence[str] = ()) -> Rel:
    """The k elements of least key, by key."""
    return take(sort_with(xs, f), k, within)


def split_at(xs: Rel, n: int) -> tuple[Rel, Rel]:
    return take(xs, n), drop(xs, n)


def head(xs: Rel) -> Rel:
    return take(xs, 1)


def last(xs: Rel) -> Rel:
    return take(reverse(xs), 1)


def index(xs: Rel, i: int) -> Rel:
    """The element at i, counted from 0: a list of one, or of none."""
    first = take(xs, i + 1) if i >= 0 else take(xs, 0)
    enough = first.df.agg((F.count("*") == i + 1).alias("__enough"))  # one row
    last = take(reverse(first), 1).df.crossJoin(F.broadcast(enough)).where("__enough").drop("__enough")
    return Rel(last, xs.fields, xs.dirs)


def only(xs: Rel) -> DataFrame:
    """The element of a list of one, as a scalar (one row)."""
    return xs.plain().limit(1)


def tail(xs: Rel, within: Sequence[str] = ()) -> Rel:
    return drop(xs, 1, within)


def init(xs: Rel, within: Sequence[str] = ()) -> Rel:
    """All but the last: the position counted from the end is over 1."""
    d = drop(reverse(xs), 1, within)
    return Rel(d.df, xs.fields, xs.dirs)


def take_while(xs: Rel, p: Callable[[Row], Column], within: Sequence[str] = ()) -> Rel:
    return _up_to_first(xs, p, within, lambda pos, first: first.isNull() | (pos < first))


def drop_while(xs: Rel, p: Callable[[Row], Column], within: Sequence[str] = ()) -> Rel:
    """Nothing if all elements hold."""
    return _up_to_first(xs, p, within, lambda pos, first: pos >= first)


def _up_to_first(xs: Rel, p: Callable[[Row], Column], within: Sequence[str], keep: Callable[[Column, Column], Column]) -> Rel:
    """Rows by their rank against the first element that does not hold: its rank is found by an aggregate, not a window, on the whole list."""
    if within:
        d = number(xs, "__pos", within)
        first = F.min(F.when(~p(xs.row), F.col("__pos"))).over(Window.partitionBy(*within))
        df = d.df.withColumn("__first", first).where(keep(F.col("__pos"), F.col("__first"))).drop("__pos", "__first")
        return Rel(df, xs.fields, xs.dirs)
    r = xs.rising()
    first = r.df.where(~p(r.row)).agg(F.min(r.rank()).alias("__first"))
    df = r.df.crossJoin(F.broadcast(first)).where(keep(r.rank(), F.col("__first"))).drop("__first")  # one row
    return Rel(df, xs.fields, r.dirs)


def span(xs: Rel, p: Callable[[Row], Column]) -> tuple[Rel, Rel]:
    return take_while(xs, p), drop_while(xs, p)


def break_(xs: Rel, p: Callable[[Row], Column]) -> tuple[Rel, Rel]:
    return span(xs, lambda r: ~p(r))


def zip_(*lists: Rel) -> Rel:
    """Element by element, as long as the shortest; fields must differ."""
    numbered = [number(x, f"__z{i}") for i, x in enumerate(lists)]
    out, fields = None, []
    for i, (x, n) in enumerate(zip(lists, numbered, strict=True)):
        side = n.df.select(*[F.col(f"`{f}`") for f in x.fields], F.col(f"__z{i}"))
        out = side if out is None else out.join(side, F.col("__z0") == F.col(f"__z{i}"))
        fields += x.fields
    if len(set(fields)) < len(fields):
        raise ValueError("zip needs lists of different fields")
    return Rel(out.select(*fields, F.col("__z0").alias(f"{ORDER}0")), fields, [True])


def zip_with(f: RowFn, *lists: Rel) -> Rel:
    z = zip_(*lists)
    return z.with_fields(named(f(z.row)))
