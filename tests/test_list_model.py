"""Operators on random literal lists against plain Python lists, order included."""

import datetime
import decimal
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ordinata.functions import lists as A
from ordinata.functions import maybe as M
from ordinata.functions.records import from_list, to_list
from ordinata.operators import aggregates as G
from ordinata.operators import basic as B
from ordinata.operators import grouping, windows
from ordinata.operators import joins as J
from ordinata.operators import positions as P
from ordinata.plans import catalog
from ordinata.sources import default_hints, literal, table

rng = random.Random(12)
LISTS = [[], [4], [2, 2, 2], *[[rng.randrange(-5, 9) for _ in range(rng.randrange(1, 25))] for _ in range(5)]]
NESTED = [[], [1], [-3, 2], *[[rng.randrange(-5, 6) for _ in range(rng.randrange(9))] for _ in range(20)]]


def even(x):
    return x % 2 == 0


def rem(a, b):
    return a - b * int(a / b)


@pytest.mark.parametrize("values", LISTS, ids=str)
def test_flat_operators(spark, values):
    xs = literal(spark, values, "bigint")
    small = lambda r: r.value < 5
    assert xs.collect() == values
    assert B.map_(xs, lambda r: r.value * 2).collect() == [v * 2 for v in values]
    assert B.filter_(xs, small).collect() == [v for v in values if v < 5]
    assert P.number(xs).collect() == [(v, i + 1) for i, v in enumerate(values)]
    assert P.reverse(xs).collect() == values[::-1]
    assert P.number(P.reverse(xs)).collect() == [(v, i + 1) for i, v in enumerate(values[::-1])]
    pairs = B.map_(P.number(xs), lambda r: {"k": r.value % 3, "i": r.pos})
    model = [(rem(v, 3), i + 1) for i, v in enumerate(values)]
    assert P.sort_with(pairs, lambda r: r.k).collect() == sorted(model, key=lambda p: p[0])
    assert P.top_k(pairs, 3, lambda r: r.k).collect() == sorted(model, key=lambda p: p[0])[:3]
    assert B.nub(xs).collect() == list(dict.fromkeys(values))
    assert P.take_while(xs, small).collect() == list(itertools.takewhile(lambda v: v < 5, values))
    assert P.drop_while(xs, small).collect() == list(itertools.dropwhile(lambda v: v < 5, values))
    assert P.tail(xs).collect() == values[1:] and P.init(xs).collect() == values[:-1]
    assert P.head(xs).collect() == values[:1] and P.last(xs).collect() == values[-1:]
    assert P.index(xs, 2).collect() == values[2:3]
    groups = grouping.group_with_key(xs, lambda r: r.value % 3).members(item=lambda r: r.value, n=G.length())
    keys = sorted({rem(v, 3) for v in values})
    assert groups.collect() == [(k, sum(rem(v, 3) == k for v in values), [v for v in values if rem(v, 3) == k]) for k in keys]
    assert B.append(xs, P.reverse(xs)).collect() == values + values[::-1]
    assert P.zip_with(lambda r: r.value - r.o_value, xs, B.renamed(P.drop(xs, 1), "o_")).collect() == [a - b for a, b in zip(values, values[1:])]
    running = windows.window(xs, "s", "sum", lambda r: r.value, 2)
    assert running.collect() == [(v, sum(values[max(0, i - 2) : i + 1])) for i, v in enumerate(values)]
    got = G.fold(xs, s=G.total(lambda r: r.value), n=G.length(), a=G.every(small), o=G.some(small), lo=G.minimum(lambda r: r.value), d=G.count_distinct(lambda r: r.value)).first()
    assert tuple(got) == (sum(values), len(values), all(v < 5 for v in values), any(v < 5 for v in values), min(values, default=None), len(set(values)))
    assert G.null(xs).first()[0] == (not values)


def test_long_lists_are_numbered_in_parts(spark):
    values = [rng.randrange(1000) for _ in range(700)]
    xs = P.sort_with(P.number(literal(spark, values, "bigint"), "i"), lambda r: -r.value)
    numbered = P.number(xs, "p")
    assert [p for *_, p in numbered.collect()] == list(range(1, 701))
    assert "rangepartitioning" in numbered.df._jdf.queryExecution().toString()


@pytest.mark.parametrize("preceding", [None, 0, 3, 9])
def test_windows_over_a_whole_list(spark, monkeypatch, preceding):
    monkeypatch.setattr(windows, "STRETCH", 4)
    values = [rng.randrange(-9, 30) for _ in range(41)]
    xs = P.reverse(literal(spark, values[::-1], "bigint"))
    frames = [values[0 if preceding is None else max(0, i - preceding) : i + 1] for i in range(len(values))]
    models = {"sum": sum, "min": min, "max": max, "avg": lambda f: sum(f) / len(f), "count": len, "first_value": lambda f: f[0]}
    for name, model in models.items():
        got = windows.window(xs, "w", name, lambda r: r.value, preceding).collect()
        assert got == [(v, model(f)) for v, f in zip(values, frames, strict=True)], name
    for name, model in {"all": all, "any": any}.items():
        got = windows.window(xs, "w", name, lambda r: r.value > 0, preceding).collect()
        assert got == [(v, model(x > 0 for x in f)) for v, f in zip(values, frames, strict=True)], name


JOINS = [([1, 2, 2, 5], [2, 2, 3, 1]), ([], [1]), ([3, 4], []), ([rng.randrange(6) for _ in range(15)], [rng.randrange(6) for _ in range(12)])]


@pytest.mark.parametrize(("left", "right"), JOINS)
def test_joins(spark, left, right):
    xs, ys = literal(spark, left, "bigint"), B.renamed(literal(spark, right, "bigint"), "y_")
    assert J.product(xs, ys).collect() == [(x, y) for x in left for y in right]
    assert J.equi_join(xs, ys, [(lambda x: x.value, lambda y: y.y_value)]).collect() == [(x, y) for x in left for y in right if x == y]
    assert J.theta_join(xs, ys, lambda x, y: x.value < y.y_value).collect() == [(x, y) for x in left for y in right if x < y]
    assert J.semi_join(xs, ys, lambda x, y: x.value == y.y_value).collect() == [x for x in left if x in right]
    assert J.anti_join(xs, ys, lambda x, y: x.value > y.y_value).collect() == [x for x in left if not any(x > y for y in right)]
    by_key, by_theta = J.nest_join(xs, ys, [(lambda x: x.value, lambda y: y.y_value)]), J.nest_join(xs, ys, on=lambda x, y: x.value > y.y_value)
    assert by_key.collect() == [(x, [y for y in right if x == y]) for x in left]
    assert by_theta.collect() == [(x, [y for y in right if x > y]) for x in left]
    assert J.nest_product(xs, ys).collect() == [(x, right) for x in left]
    aggs = {"s": G.total(lambda y: y.y_value), "n": G.length(), "a": G.every(lambda y: y.y_value > 1)}
    got = J.group_join(xs, ys, aggs, on=lambda x, y: x.value >= y.y_value).collect()
    partners = [[y for y in right if x >= y] for x in left]
    assert got == [(x, sum(p), len(p), all(y > 1 for y in p)) for x, p in zip(left, partners, strict=True)]


@pytest.mark.parametrize("keyed", [False, True])
def test_joins_by_below_in_tiles(spark, monkeypatch, keyed):
    """Nulls match nothing, NaN is above all numbers; ties, a key that only one side has, tiles cut within ties and keys."""
    monkeypatch.setattr(J, "TILE", 2)
    monkeypatch.setattr(J, "CHUNK", 1)
    values = [None, float("nan"), 0.0, -0.0, 1.5, 1.5, 1.5, -7.0, float("inf")]
    side = lambda n, ks: [(i, rng.choice(ks), rng.choice(values), rng.randrange(3)) for i in range(n)]
    left, right = side(61, ["a", "a", "b", None]), side(47, ["a", "b", "c", None])
    xs, ys = (table(spark.createDataFrame(rows, "i bigint, k string, v double, s int"), "t", None, default_hints("i")) for rows in (left, right))
    less = lambda a, b: a is not None and b is not None and a == a and (b != b or a < b)
    want = [(x[0], y[0]) for x in left for y in right if less(x[2], y[2]) and x[3] != y[3] and (not keyed or (x[1] is not None and x[1] == y[1]))]
    for a, ids in ((xs, 1), (P.reverse(xs), -1)):
        d = J.theta_join(a, B.renamed(ys, "y_"), lambda x, y: x.s != y.y_s, [(lambda x: x.k, lambda y: y.y_k)] * keyed, (lambda x: x.v, lambda y: y.y_v))
        assert d.fields == ["i", "k", "v", "s", "y_i", "y_k", "y_v", "y_s"]
        assert B.map_(d, lambda r: {"x": r.i, "y": r.y_i}).collect() == sorted(want, key=lambda p: (ids * p[0], p[1]))
    nothing = J.theta_join(B.filter_(xs, lambda r: r.i < 0), B.renamed(ys, "y_"), below=(lambda x: x.v, lambda y: y.y_v))
    assert nothing.collect() == []


@pytest.mark.parametrize("name", ["j3_range_join", "j3_theta_join"])
def test_pairs_of_one_file_are_made_by_many_tasks(spark, small, monkeypatch, name):
    monkeypatch.setattr(J, "TILE", 3, raising=False)
    monkeypatch.setattr(J, "CHUNK", 1, raising=False)
    d = catalog.queries()[name](spark, small)
    tasks = [r["count"] for r in d.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) >= 16 and max(tasks) < sum(tasks) / 4


CASES = {
    "map": (lambda xs: A.map_(lambda x: x + 1, xs), lambda v: [x + 1 for x in v]),
    "filter": (lambda xs: A.filter_(lambda x: x > 0, xs), lambda v: [x for x in v if x > 0]),
    "concat_map": (lambda xs: A.concat_map(lambda x: F.array(x, x), xs), lambda v: [y for x in v for y in (x, x)]),
    "append": (lambda xs: A.append(xs, A.tail(xs)), lambda v: v + v[1:]),
    "cons": (lambda xs: A.cons(F.lit(9).cast("bigint"), xs), lambda v: [9, *v]),
    "snoc": (lambda xs: A.snoc(xs, F.lit(9).cast("bigint")), lambda v: [*v, 9]),
    "reverse": (A.reverse, lambda v: v[::-1]),
    "nub": (A.nub, lambda v: list(dict.fromkeys(v))),
    "number": (A.number, lambda v: [(x, i + 1) for i, x in enumerate(v)]),
    "sort_with": (lambda xs: A.sort_with(lambda x: x % 2, xs), lambda v: sorted(v, key=lambda x: rem(x, 2))),
    "group_with": (lambda xs: A.group_with(lambda x: x % 3, xs), lambda v: [[x for x in v if rem(x, 3) == k] for k in sorted({rem(x, 3) for x in v})]),
    "zip": (lambda xs: A.zip_(xs, A.drop(2, xs)), lambda v: list(zip(v, v[2:]))),
    "zip3": (lambda xs: A.zip3(xs, A.tail(xs), A.drop(2, xs)), lambda v: list(zip(v, v[1:], v[2:]))),
    "zip_with3": (lambda xs: A.zip_with3(lambda a, b, c: a + b + c, xs, xs, A.tail(xs)), lambda v: [2 * a + b for a, b in zip(v, v[1:])]),
    "unzip": (lambda xs: A.unzip(A.zip_(xs, A.reverse(xs))), lambda v: (v, v[::-1])),
    "take": (lambda xs: A.take(2, xs), lambda v: v[:2]),
    "take_negative": (lambda xs: A.take(-1, xs), lambda v: []),
    "drop": (lambda xs: A.drop(2, xs), lambda v: v[2:]),
    "drop_negative": (lambda xs: A.drop(-1, xs), lambda v: v),
    "split_at": (lambda xs: A.split_at(3, xs), lambda v: (v[:3], v[3:])),
    "head": (A.head, lambda v: v[0] if v else None),
    "last": (A.last, lambda v: v[-1] if v else None),
    "index": (lambda xs: A.index(xs, 1), lambda v: v[1] if len(v) > 1 else None),
    "tail": (A.tail, lambda v: v[1:]),
    "init": (A.init, lambda v: v[:-1]),
    "take_while": (lambda xs: A.take_while(lambda x: x > -2, xs), lambda v: list(itertools.takewhile(lambda x: x > -2, v))),
    "drop_while": (lambda xs: A.drop_while(lambda x: x > -2, xs), lambda v: list(itertools.dropwhile(lambda x: x > -2, v))),
    "span": (lambda xs: A.span(lambda x: x < 3, xs), lambda v: (list(itertools.takewhile(lambda x: x < 3, v)), list(itertools.dropwhile(lambda x: x < 3, v)))),
    "break": (lambda xs: A.break_(lambda x: x < 0, xs), lambda v: (list(itertools.takewhile(lambda x: x >= 0, v)), list(itertools.dropwhile(lambda x: x >= 0, v)))),
    "sum": (A.total, sum),
    "average": (A.average, lambda v: sum(v) / len(v) if v else None),
    "minimum": (A.minimum, lambda v: min(v, default=None)),
    "maximum": (A.maximum, lambda v: max(v, default=None)),
    "length": (A.length, len),
    "count_distinct": (A.count_distinct, lambda v: len(set(v))),
    "and": (lambda xs: A.and_(A.map_(lambda x: x > 0, xs)), lambda v: all(x > 0 for x in v)),
    "or": (lambda xs: A.or_(A.map_(lambda x: x > 0, xs)), lambda v: any(x > 0 for x in v)),
    "elem": (lambda xs: A.elem(F.lit(2).cast("bigint"), xs), lambda v: 2 in v),
    "not_elem": (lambda xs: A.not_elem(F.lit(2).cast("bigint"), xs), lambda v: 2 not in v),
    "null": (A.null, lambda v: not v),
    "lookup": (lambda xs: A.lookup(F.lit(1).cast("bigint"), A.map_(lambda x: F.struct((x % 2).alias("_1"), x.alias("_2")), xs)), lambda v: [x for x in v if rem(x, 2) == 1]),
    "join": (lambda xs: A.join(lambda x, y: x == y, xs, A.tail(xs)), lambda v: [(x, y) for x in v for y in v[1:] if x == y]),
    "semi_join": (lambda xs: A.semi_join(lambda x, y: x < y, xs, xs), lambda v: [x for x in v if any(x < y for y in v)]),
    "anti_join": (lambda xs: A.anti_join(lambda x, y: x < y, xs, xs), lambda v: [x for x in v if not any(x < y for y in v)]),
    "nest_join": (lambda xs: A.nest_join(lambda x, y: x == -y, xs, xs), lambda v: [(x, [y for y in v if x == -y]) for x in v]),
    "maybe": (lambda xs: M.maybe(F.lit(0).cast("bigint"), lambda x: x * 2, A.take(1, xs)), lambda v: v[0] * 2 if v else 0),
    "from_maybe": (lambda xs: M.from_maybe(F.lit(7).cast("bigint"), A.take(1, xs)), lambda v: v[0] if v else 7),
    "cat_maybes": (lambda xs: M.cat_maybes(A.map_(lambda x: F.when(x > 0, M.just(x)).otherwise(M.nothing("bigint")), xs)), lambda v: [x for x in v if x > 0]),
    "nested_maybe": (lambda xs: M.just(M.just(A.length(xs))), lambda v: [[len(v)]]),
    "partition_eithers": (lambda xs: M.partition_eithers(A.map_(lambda x: F.when(x > 0, M.left(x, "bigint")).otherwise(M.right(x, "bigint")), xs)), lambda v: ([x for x in v if x > 0], [x for x in v if x <= 0])),
}


def test_inner_list_operators(spark):
    xss = literal(spark, NESTED, "array<bigint>")
    got = B.map_(xss, lambda r: {n: f(r.value) for n, (f, _) in CASES.items()}).collect()
    for v, row in zip(NESTED, got, strict=True):
        for (name, (_, model)), value in zip(CASES.items(), row, strict=True):
            assert value == model(v), (name, v)


def test_types_make_the_round_trip(spark):
    rows = [(True, "é", "text", datetime.date(1999, 2, 3), decimal.Decimal("1.25"), -7, 0.5, [[1], []], (1, "a"))]
    kind = "struct<b:boolean,c:string,t:string,d:date,n:decimal(38,2),i:bigint,f:double,l:array<array<bigint>>,p:struct<a:bigint,b:string>>"
    assert literal(spark, rows, kind).collect() == rows
    assert B.concat(literal(spark, [[1, 2], [], [3]], "array<bigint>")).collect() == [1, 2, 3]


def test_records(spark):
    import dataclasses

    @dataclasses.dataclass
    class Point:
        x: int
        names: list[str]

    points = [Point(2, ["a"]), Point(1, [])]
    assert from_list(to_list(spark, points, Point), Point) == points
    with pytest.raises(TypeError):
        to_list(spark, [], dataclasses.make_dataclass("Bad", [("z", complex)]))


def test_tables_need_a_key_and_flat_columns(spark, small):
    with pytest.raises(ValueError, match="key"):
        table(spark, "nation", None, default_hints(), small)
    with pytest.raises(ValueError, match="scalar"):
        table(spark, "embeddings", ("vec_id", "embedding"), default_hints("vec_id"), small)
    with pytest.raises(ValueError, match="no column"):
        table(spark, "nation", ("nope",), default_hints("n_nationkey"), small)


def test_plans_as_json_and_dot(spark):
    from ordinata.plans import export

    df = spark.range(5).where("id > 2").join(spark.range(3).withColumnRenamed("id", "b"), F.col("id") == F.col("b"))
    nodes = export.plan_json(df)
    assert any(n["class"].endswith("Join") for n in nodes) and sum(n["num-children"] for n in nodes) == len(nodes) - 1
    dot = export.plan_dot(df)
    assert dot.count("->") == len(nodes) - 1 and dot.startswith("digraph")


def test_release_gives_back_what_numbering_keeps(spark):
    from ordinata.operators import positions
    from ordinata.sources import literal

    positions.release()
    xs = literal(spark, [(v,) for v in (3, 1, 2)], "struct<x:bigint>")
    assert [r["pos"] for r in positions.number(xs).df.collect()] and len(positions._dealt) == 1
    positions.release()
    assert not positions._dealt and positions.index(xs, 1).collect() == [1] and not positions._dealt
    assert positions.index(xs, 7).collect() == [] == positions.index(xs, -1).collect()
