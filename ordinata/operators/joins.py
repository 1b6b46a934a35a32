"""Joins of lists.  Results are in the order of the left list, then of the right one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinata.operators import positions
from ordinata.operators.aggregates import Agg
from ordinata.rel import ORDER, Rel, Row

On = Callable[[Row, Row], Column]
#: Pairs of key functions, one for each side.
Keys = Sequence[tuple[Callable[[Row], Column], Callable[[Row], Column]]]
RIGHT = "__r"


def _sides(xs: Rel, ys: Rel):
    if clash := set(xs.fields) & set(ys.fields):
        raise ValueError(f"both lists have {', '.join(sorted(clash))}: rename one")
    return xs.df, ys.df.select(*[F.col(f"`{f}`") for f in ys.fields], *[F.col(c).alias(f"{RIGHT}{i}") for i, c in enumerate(ys.order_columns)])


def theta_join(xs: Rel, ys: Rel, on: On | None = None, keys: Keys = (), below: tuple[Callable[[Row], Column], Callable[[Row], Column]] | None = None) -> Rel:
    """Pairs that meet `on` and have equal `keys`; Catalyst takes equal keys out of `on`, too.

    `below`, functions (f, g), asks for f(x) < g(y) besides.  Its pairs are made in
    tiles dealt over all tasks, whatever the files, the keys or the size of a side.
    """
    a, b = _sides(xs, ys)
    tests = [test for test in (_equal(keys, xs.row, ys.row), on and on(xs.row, ys.row)) if test is not None]
    if below:
        df = _below(a, b, [f(xs.row) for f, _ in keys], [g(ys.row) for _, g in keys], below[0](xs.row), below[1](ys.row), len(xs.dirs), len(ys.dirs))
        df = df.where(on(xs.row, ys.row)) if on else df
    elif tests:
        df = a.join(b, reduce(Column.__and__, tests))
    else:
        raise ValueError("theta_join needs a condition; product has none")
    n = len(xs.dirs)
    fields = [*xs.fields, *ys.fields]
    order = [*xs.order_columns, *[F.col(f"{RIGHT}{i}").alias(f"{ORDER}{n + i}") for i in range(len(ys.dirs))]]
    return Rel(df.select(*[F.col(f"`{f}`") for f in fields], *order), fields, [*xs.dirs, *ys.dirs])


#: Powers of two: rows of a side of a tile, and rows of the right side that are gathered in an array.
TILE, CHUNK = 13, 8


def _below(a: DataFrame, b: DataFrame, a_keys: list[Column], b_keys: list[Column], f: Column, g: Column, a_order: int, b_order: int) -> DataFrame:
    """The rows of a beside those of b with equal keys and f < g.

    Each side is sorted by key and value and cut in stretches.  Stretches meet where
    the least f is below the greatest g; each meeting is a tile, and tiles are dealt by
    hash to a number of tasks that does not follow the bytes, since pairs are many
    more than rows.  A task holds one tile's rows and the pairs of one x.
    """
    names = [f"__k{i}" for i in range(len(a_keys))]
    left = _stretches(a, names, a_keys, f, [f"{ORDER}{i}" for i in range(a_order)]).withColumn("__xt", F.shiftright("__id", TILE))
    right = _stretches(b, names, b_keys, g, [f"{RIGHT}{i}" for i in range(b_order)]).withColumn("__yt", F.shiftright("__id", TILE))
    lows = left.groupBy(*names, "__xt").agg(F.min("__v").alias("__low"))
    highs = right.groupBy(*names, "__yt").agg(F.max("__v").alias("__high"))
    tiles = (lows.join(highs, names) if names else lows.crossJoin(F.broadcast(highs))).where(F.col("__low") < F.col("__high")).select(*names, "__xt", "__yt")
    rows = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in b.columns], F.col("__v").alias("__w")))
    chunks = right.groupBy(*names, "__yt", F.shiftright("__id", CHUNK)).agg(F.max("__v").alias("__high"), rows.alias("__rows"))
    session, place = a.sparkSession, [*names, "__xt", "__yt"]
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    xs = left.join(tiles, [*names, "__xt"]).repartition(n, *place)
    ys = chunks.join(tiles, [*names, "__yt"]).repartition(n, *place)
    met = xs.hint("merge").join(ys, place).where(F.col("__v") < F.col("__high"))
    kept = [F.col(f"`{c}`") for c in a.columns]
    pairs = met.select(*kept, "__v", F.explode("__rows").alias("__y")).where(F.col("__v") < F.col("__y").getField("__w"))
    return pairs.select(*kept, *[F.col("__y").getField(c).alias(c) for c in b.columns])


def _stretches(df: DataFrame, names: list[str], keys: list[Column], value: Column, order: list[str]) -> DataFrame:
    """`df` with its keys, `__v` and an `__id` that rises with them; kept on disks, since all uses must see the same ids."""
    d = df.select("*", *[k.alias(n) for n, k in zip(names, keys, strict=True)], value.alias("__v"))
    d = d.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*names, "__v"]]))
    place = [*names, "__v", *order]
    return positions.kept(d.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("__id", F.monotonically_increasing_id()))


def equi_join(xs: Rel, ys: Rel, keys: Keys) -> Rel:
    return theta_join(xs, ys, lambda x, y: _equal(keys, x, y))


def _equal(keys: Keys, x: Row, y: Row) -> Column:
    out = None
    for f, g in keys:
        out = f(x) == g(y) if out is None else out & (f(x) == g(y))
    return out


def product(xs: Rel, ys: Rel) -> Rel:
    """All pairs; what a comprehension without a guard between its generators asks for."""
    a, b = _sides(xs, ys)
    n, fields = len(xs.dirs), [*xs.fields, *ys.fields]
    df = a.crossJoin(b).select(*[F.col(f"`{f}`") for f in fields], *xs.order_columns, *[F.col(f"{RIGHT}{i}").alias(f"{ORDER}{n + i}") for i in range(len(ys.dirs))])
    return Rel(df, fields, [*xs.dirs, *ys.dirs])


def semi_join(xs: Rel, ys: Rel, on: On, where: Callable[[Row], Column] | None = None) -> Rel:
    """The x that some y (that meets `where`) matches."""
    return _filtering(xs, ys, on, where, "left_semi")


def anti_join(xs: Rel, ys: Rel, on: On, where: Callable[[Row], Column] | None = None) -> Rel:
    """The x that no y (that meets `where`) matches."""
    return _filtering(xs, ys, on, where, "left_anti")


def _filtering(xs: Rel, ys: Rel, on: On, where: Callable[[Row], Column] | None, how: str) -> Rel:
    a, b = _sides(xs, ys)
    if where:
        b = b.where(where(ys.row))
    return Rel(a.join(b, on(xs.row, ys.row), how), xs.fields, xs.dirs)


def for_all(xs: Rel, ys: Rel, holds: On, given: On | None = None, among: Callable[[Row], Column] | None = None) -> Rel:
    """The x for which every y with `among(y)` and `given(x, y)` has `holds(x, y)`: an anti join with the y that break it.

    Fields have no nulls, so that a comparison may be negated.
    """
    broken = (lambda x, y: given(x, y) & ~holds(x, y)) if given else (lambda x, y: ~holds(x, y))
    return anti_join(xs, ys, broken, among)


def for_all_among(xs: Rel, ys: Rel, given: On, holds: Callable[[Row], Column]) -> Rel:
    """The x for which every y with `given(x, y)` has `holds(y)`: only the y that break it are joined."""
    return anti_join(xs, ys, given, lambda y: ~holds(y))


def nest_join(xs: Rel, ys: Rel, keys: Keys = (), on: On | None = None, name: str = "partners", item: Callable[[Row], Column] | None = None, where: Callable[[Row], Column] | None = None, outer: Callable[[Row], Column] | None = None) -> Rel:
    """Each x with the list of its partners in order, the empty list if it has none.

    `keys` alone: partners are gathered by key once, then joined.  With `on`, pairs
    are joined and gathered by x.  `where` filters partners; `outer`, a condition on
    x alone, empties the list of an x that fails it but keeps the x.
    """
    b = ys.rising()
    value = item(b.row) if item else (b.row.only() if len(b.fields) == 1 else b.row.struct())
    if where:
        b = Rel(b.df.where(where(b.row)), b.fields, b.dirs)
    kind = b.df.select(value.alias("v")).schema["v"].dataType.simpleString()
    gather = F.transform(F.sort_array(F.collect_list(F.struct(b.rank().alias("o"), value.alias("v")))), lambda s: s["v"])
    empty = F.array().cast(f"array<{kind}>")
    if on is None:
        if not keys:
            raise ValueError("nest_join needs keys or a condition; nest_product has neither")
        names = [f"__k{i}" for i in range(len(keys))]
        lists = b.df.groupBy(*[g(b.row).alias(n) for n, (_, g) in zip(names, keys, strict=True)]).agg(gather.alias("__list"))
        match = None
        for n, (f, _) in zip(names, keys, strict=True):
            match = f(xs.row) == F.col(n) if match is None else match & (f(xs.row) == F.col(n))
        df = xs.df.join(lists, match & outer(xs.row) if outer else match, "left")
        return _with(xs, df, {name: F.coalesce("__list", empty)})
    a, right = _sides(xs, b)
    pairs = on(xs.row, b.row)
    if keys:
        pairs = pairs & _equal(keys, xs.row, b.row)
    if outer:
        pairs = pairs & outer(xs.row)
    rank = F.struct(*[F.col(f"{RIGHT}{i}") for i in range(len(b.dirs))])
    members = F.collect_list(F.when(F.col(f"{RIGHT}0").isNotNull(), F.struct(rank.alias("o"), value.alias("v"))))
    df = a.join(right, pairs, "left").groupBy(*xs.order_columns).agg(*[F.first(f"`{f}`").alias(f) for f in xs.fields], F.transform(F.sort_array(members), lambda s: s["v"]).alias(name))
    return _with(xs, df, {name: F.col(f"`{name}`")})


def nest_product(xs: Rel, ys: Rel, name: str = "partners", item: Callable[[Row], Column] | None = None) -> Rel:
    """Each x with the whole list ys, built once as one row."""
    from ordinata.operators.basic import nest

    return _with(xs, xs.df.crossJoin(F.broadcast(nest(ys, name, item))), {name: F.col(f"`{name}`")})


def group_join(xs: Rel, ys: Rel, aggs: Mapping[str, Agg], keys: Keys = (), on: On | None = None, where: Callable[[Row], Column] | None = None) -> Rel:
    """Each x with folds of its partners; those of the empty list where it has none.

    `keys` alone: partners are folded by key before the join.  With `on`, pairs are
    joined first, and only matched ones count.
    """
    if where:
        ys = Rel(ys.df.where(where(ys.row)), ys.fields, ys.dirs)
    if on is None:
        names = [f"__k{i}" for i in range(len(keys))]
        folds = ys.df.groupBy(*[g(ys.row).alias(n) for n, (_, g) in zip(names, keys, strict=True)]).agg(*[a.fold(ys.row).alias(f"__a_{n}") for n, a in aggs.items()])
        match = None
        for n, (f, _) in zip(names, keys, strict=True):
            match = f(xs.row) == F.col(n) if match is None else match & (f(xs.row) == F.col(n))
        df = xs.df.join(folds, match, "left")
        return _with(xs, df, {n: a.filled(F.col(f"__a_{n}")) for n, a in aggs.items()})
    a, b = _sides(xs, ys)
    pairs = on(xs.row, ys.row) & _equal(keys, xs.row, ys.row) if keys else on(xs.row, ys.row)
    matched = a.join(b, pairs).groupBy(*[F.col(c).alias(f"__x{i}") for i, c in enumerate(xs.order_columns)]).agg(*[g.fold(Row([*xs.fields, *ys.fields])).alias(f"__a_{n}") for n, g in aggs.items()])
    same = None
    for i, c in enumerate(xs.order_columns):
        same = F.col(c) == F.col(f"__x{i}") if same is None else same & (F.col(c) == F.col(f"__x{i}"))
    return _with(xs, xs.df.join(matched, same, "left"), {n: g.filled(F.col(f"__a_{n}")) for n, g in aggs.items()})


def _with(xs: Rel, df, extra: Mapping[str, Column]) -> Rel:
    out = df.select(*[F.col(f"`{f}`") for f in xs.fields], *[c.alias(n) for n, c in extra.items()], *xs.order_columns)
    return Rel(out, [*xs.fields, *extra], xs.dirs)


def lifted_join(xss: Rel, field: str, ys: Rel, keys_of: Callable[[Column], Column], key: Callable[[Row], Column], name: str, item: Callable[[Row], Column] | None = None) -> Rel:
    """For each element the pairs of its inner list's members with their partners in ys, re-nested as (member, partner).

    The inner list is exploded with the outer order and joined with ys itself: ys
    is not copied for each outer element.
    """
    n = len(xss.dirs)
    member = xss.df.select(*xss.order_columns, F.posexplode(F.col(f"`{field}`")).alias("__pos", "__member"))
    b = ys.rising()
    value = item(b.row) if item else (b.row.only() if len(b.fields) == 1 else b.row.struct())
    right = b.df.select(key(b.row).alias("__key"), b.rank().alias("__rank"), value.alias("__item"))
    pairs = member.join(right, keys_of(F.col("__member")) == F.col("__key"))
    gathered = F.sort_array(F.collect_list(F.struct("__pos", "__rank", F.struct(F.col("__member").alias("_1"), F.col("__item").alias("_2")).alias("v"))))
    lists = pairs.groupBy(*[F.col(f"{ORDER}{i}").alias(f"__x{i}") for i in range(n)]).agg(F.transform(gathered, lambda s: s["v"]).alias("__list"))
    kind = lists.schema["__list"].dataType.simpleString()
    same = None
    for i in range(n):
        same = F.col(f"{ORDER}{i}") == F.col(f"__x{i}") if same is None else same & (F.col(f"{ORDER}{i}") == F.col(f"__x{i}"))
    return _with(xss, xss.df.join(lists, same, "left"), {name: F.coalesce("__list", F.array().cast(kind))})


def _members(xss: Rel, field: str) -> Rel:
    """The inner lists' members as one list, field `member`, in the outer order and then their own."""
    from ordinata.operators.basic import concat_map

    return concat_map(xss, lambda r: r[field], (), "member")


def _renested(xss: Rel, flat: Rel, value: Column, name: str) -> Rel:
    """`xss` with list `name` of what `flat`, ordered by the outer order first, has for each outer element; empty for none."""
    n = len(xss.dirs)
    rest = F.struct(*[F.col(f"{ORDER}{i}") for i in range(n, len(flat.dirs))])
    gathered = F.transform(F.sort_array(F.collect_list(F.struct(rest.alias("o"), value.alias("v")))), lambda s: s["v"])
    lists = flat.df.groupBy(*[F.col(f"{ORDER}{i}").alias(f"__x{i}") for i in range(n)]).agg(gathered.alias("__list"))
    kind = lists.schema["__list"].dataType.simpleString()
    same = None
    for i in range(n):
        same = F.col(f"{ORDER}{i}") == F.col(f"__x{i}") if same is None else same & (F.col(f"{ORDER}{i}") == F.col(f"__x{i}"))
    return _with(xss, xss.df.join(lists, same, "left"), {name: F.coalesce("__list", F.array().cast(kind))})


#: A condition on a member of an inner list and an element of a table.
MemberOn = Callable[[Column, Row], Column]


def lifted_semi_join(xss: Rel, field: str, ys: Rel, on: MemberOn, name: str, where: Callable[[Row], Column] | None = None) -> Rel:
    """For each element the members of its inner list that some y matches, in order."""
    return _renested(xss, semi_join(_members(xss, field), ys, lambda x, y: on(x.member, y), where), F.col("member"), name)


def lifted_anti_join(xss: Rel, field: str, ys: Rel, on: MemberOn, name: str, where: Callable[[Row], Column] | None = None) -> Rel:
    """For each element the members of its inner list that no y matches, in order."""
    return _renested(xss, anti_join(_members(xss, field), ys, lambda x, y: on(x.member, y), where), F.col("member"), name)


def lifted_theta_join(xss: Rel, field: str, ys: Rel, on: MemberOn, name: str, item: Callable[[Row], Column] | None = None) -> Rel:
    """For each element the pairs (member, partner) of its inner list and ys that meet `on`, left-major."""
    b = ys.rising()
    value = item(b.row) if item else (b.row.only() if len(b.fields) == 1 else b.row.struct())
    pairs = theta_join(_members(xss, field), b, lambda x, y: on(x.member, y))
    return _renested(xss, pairs, F.struct(F.col("member").alias("_1"), value.alias("_2")), name)


def lifted_nest_join(xss: Rel, field: str, ys: Rel, keys: Sequence[tuple[Callable[[Column], Column], Callable[[Row], Column]]], name: str, item: Callable[[Row], Column] | None = None) -> Rel:
    """For each element the pairs (member, list of partners) of its inner list: members without partners have the empty list."""
    joined = nest_join(_members(xss, field), ys, [((lambda x, f=f: f(x.member)), g) for f, g in keys], name="partners", item=item)
    return _renested(xss, joined, F.struct(F.col("member").alias("_1"), F.col("partners").alias("_2")), name)


def lifted_group_join(xss: Rel, field: str, ys: Rel, agg: Agg, keys: Sequence[tuple[Callable[[Column], Column], Callable[[Row], Column]]], name: str) -> Rel:
    """For each element the pairs (member, fold of its partners) of its inner list; the fold of the empty list for none."""
    joined = group_join(_members(xss, field), ys, {"folded": agg}, [((lambda x, f=f: f(x.member)), g) for f, g in keys])
    return _renested(xss, joined, F.struct(F.col("member").alias("_1"), F.col("folded").alias("_2")), name)


def lookup(xs: Rel, key: Callable[[Row], Column], pairs: Rel, of: Callable[[Row], Column], item: Callable[[Row], Column], name: str = "found") -> Rel:
    """Each x with all values that the list `pairs` has under its key, in order; the empty list for none."""
    return nest_join(xs, pairs, [(key, of)], name=name, item=item)
