"""Small lists with results stated beforehand, through comprehensions."""

import pytest

from ordinata.functions import lists as A
from ordinata.functions import scalars as S
from ordinata.operators import aggregates as G
from ordinata.operators import basic as B
from ordinata.operators import joins
from ordinata.operators import positions as P
from ordinata.plans.comp import Comp
from ordinata.plans.export import plan_text
from ordinata.sources import literal
from pyspark.sql import functions as F

XS1, YS1 = [1, 2, 3, 4, 5, 6], [3, 4, 5, 6, 3, 6, 4, 1, 1, 1]
XS2, YS2, ZS2 = [1, 2, 3, 4, 5, 5, 2], [2, 1, 0, 5, 4, 4, 4], [6, 1, 1, 3, 2, 5]
XS3, YS3 = [1, 2, 3, 4, 5, 6, 7, 8, 12], [2, 3, 2, 4, 5, 5, 9, 12, 2, 2, 13]
ZS3 = [(2, 20), (5, 60), (3, 30), (3, 80), (4, 40), (5, 10), (5, 30), (12, 120)]
SEVEN, EVEN = [1, 2, 3, 4, 5, 6, 7], [2, 4, 6, 7]


@pytest.fixture(scope="module")
def ints(spark):
    return lambda values: literal(spark, values, "bigint")


@pytest.fixture(scope="module")
def pairs(spark):
    return lambda values: literal(spark, values, "struct<k:bigint,v:bigint>")


SAME = [(lambda x: x.value, lambda y: y.value)]


def first(c):
    return c.yield_(lambda x: {"x": x.value}).collect()


def test_equi_join_with_nested_elements(spark, ints):
    xs = literal(spark, [(10, ["a"]), (20, ["b"]), (30, ["c", "d"]), (40, [])], "struct<k:bigint,cs:array<string>>")
    c = Comp().bind("x", xs).bind("y", ints([20, 30, 30, 40, 50])).where(lambda x, y: x.k == y.value)
    assert c.yield_(lambda x, y: {"x": F.struct(x.k, x.cs), "y": y.value}).collect() == [((20, ["b"]), 20), ((30, ["c", "d"]), 30), ((30, ["c", "d"]), 30), ((40, []), 40)]
    assert c.plan == ["theta y"]


def test_semi_joins(ints):
    x = Comp().bind("x", ints(SEVEN))
    assert first(x.exists("y", ints(EVEN), equal=SAME)) == [2, 4, 6, 7]
    assert first(x.exists("y", ints([2, 4, 6]), lambda y: y.value < 6, equal=SAME)) == [2, 4]
    assert first(x.exists("y", ints(EVEN), lambda x, y: (x.value == y.value) & (y.value > 5))) == [6, 7]


def test_anti_joins(ints):
    x = Comp().bind("x", ints(SEVEN))
    assert first(x.not_exists("y", ints(EVEN), equal=SAME)) == [1, 3, 5]
    assert first(x.not_exists("y", ints(EVEN), lambda y: y.value < 5, equal=SAME)) == [1, 3, 5, 6, 7]


def test_universal_quantifiers(ints):
    c = Comp().bind("x", ints([6, 7, 8, 9, 10, 12])).for_all("y", ints([8, 9, 12, 13, 15, 16]), lambda x, y: x.value < y.value, lambda y: y.value > 10)
    assert first(c) == [6, 7, 8, 9, 10] and c.plan == ["anti y"]
    c = Comp().bind("x", ints([3, 4, 5, 6, 7, 8])).for_all("y", ints([4, 5, 8, 16]), lambda y: S.rem(y.value, F.lit(4)) == 0, lambda x, y: x.value < y.value)
    assert first(c) == [5, 6, 7, 8]
    c = Comp().bind("x", ints([3, 4, 5, 6])).for_all("y", ints(list(range(1, 9))), lambda x, y: y.value <= 2 * x.value, lambda x, y: x.value < y.value)
    assert first(c) == [4, 5, 6]


def test_leading_guard(ints):
    xs = joins.nest_product(ints([10, 20, 30]), B.renamed(B.filter_(ints([1, 2, 3, 4]), lambda r: r.value < 3), "y_"), "ys")
    assert B.map_(xs, lambda r: S.cond(r.value > 13, r.ys, A.nil("bigint"))).collect() == [[], [1, 2], [1, 2]]


def nested(ints, xs, ys, *guards, equal=(), head=lambda x, l: {"l": l.value}):
    return Comp().bind("x", ints(xs)).nest("l", "y", ints(ys), *guards, equal=equal, item=lambda y: y.value).yield_(head)


def test_nest_joins(ints):
    assert nested(ints, XS1, YS1, equal=SAME).collect() == [[1, 1, 1], [], [3, 3], [4, 4], [5], [6, 6]]
    more = F.array(*[F.lit(v).cast("bigint") for v in (100, 200, 300)])
    got = nested(ints, XS1, YS1, equal=SAME, head=lambda x, l: {"x": x.value, "l": A.append(l.value, more)}).collect()
    assert got[0] == (1, [1, 1, 1, 100, 200, 300]) and got[1] == (2, [100, 200, 300]) and got[5] == (6, [6, 6, 100, 200, 300])
    pair = lambda x, l: {"x": x.value, "l": l.value}
    assert nested(ints, XS1, YS1, lambda x, y: x.value + y.value > 15, head=pair).collect() == [(x, []) for x in XS1]
    assert nested(ints, XS1, YS1, lambda x, y: x.value + y.value > 10, lambda y: y.value < 7, head=pair).collect() == [(1, []), (2, []), (3, []), (4, []), (5, [6, 6]), (6, [5, 6, 6])]
    plus = lambda x, l: {"l": A.map_(lambda y: x.value + y, l.value)}
    assert nested(ints, XS1, YS1, equal=[(lambda x: x.value + 2, lambda y: y.value)], head=plus).collect() == [[4, 4], [6, 6], [8], [10, 10], [], []]
    c = Comp().bind("x", ints(XS1)).where(lambda x: x.value > 3).nest("l", "y", ints(YS1), lambda y: y.value < 5, equal=SAME, item=lambda y: y.value)
    assert c.yield_(plus).collect() == [[8, 8], [], []]
    got = nested(ints, XS1, YS1, lambda y: y.value > 2, lambda x: x.value < 6, equal=[(lambda x: x.value + 1, lambda y: y.value)], head=plus)
    assert got.collect() == [[], [5, 5], [7, 7], [9], [11, 11], []]
    got = nested(ints, XS1, YS1, lambda x, y: x.value > y.value, lambda x, y: x.value < y.value * 2, head=plus)
    assert got.collect() == [[], [], [], [7, 7], [8, 9, 8, 9], [10, 11, 10]]


def test_nest_product_and_range(ints):
    assert nested(ints, [1, 2, 3, 4, 5, 6], YS1, lambda x, y: x.value > y.value).collect() == [[], [1, 1, 1], [1, 1, 1], [3, 3, 1, 1, 1], [3, 4, 3, 4, 1, 1, 1], [3, 4, 5, 3, 4, 1, 1, 1]]
    assert nested(ints, [2, 1], [7, 8, 7]).collect() == [[7, 8, 7], [7, 8, 7]]


def test_fold_of_a_nested_comprehension(ints):
    c = Comp().bind("x", ints(XS1)).fold("s", "y", ints(YS1), G.total(lambda y: y.value), equal=SAME)
    assert c.yield_(lambda x, s: {"v": x.value + s.value * x.value}).collect() == [4, 2, 21, 36, 30, 78]
    assert c.plan == ["group y"]


def test_two_levels_of_nest_joins(ints):
    ys = joins.nest_join(B.renamed(ints(YS2), "y_"), B.renamed(ints(ZS2), "z_"), [(lambda y: y.y_value, lambda z: z.z_value)], name="zs", item=lambda z: z.z_value)
    xs = joins.nest_join(ints(XS2), ys, [(lambda x: x.value, lambda y: y.y_value)], name="ys", item=lambda y: F.struct(y.y_value.alias("y"), y.zs))
    got = B.map_(xs, lambda r: A.map_(lambda y: A.map_(lambda z: F.struct(r.value, y["y"], z), y["zs"]), r.ys)).collect()
    assert got == [[[(1, 1, 1), (1, 1, 1)]], [[(2, 2, 2)]], [], [[], [], []], [[(5, 5, 5)]], [[(5, 5, 5)]], [[(2, 2, 2)]]]


def test_guards_on_folds(ints, pairs):
    key = [(lambda x: x.value, lambda z: z.k)]
    c = Comp().bind("x", ints(XS3)).where(lambda x: x.value < 8).fold("s", "z", pairs(ZS3), G.total(lambda z: z.v), equal=key).where(lambda s: s.value > 100)
    assert first(c) == [3]
    c = Comp().bind("x", ints(XS3)).for_all("y", ints(YS3), lambda y: y.value > 1, equal=SAME).where(lambda x: x.value < 8)
    assert first(c) == [1, 2, 3, 4, 5, 6, 7]
    c = Comp().bind("x", ints(XS3)).fold("n", "z", pairs(ZS3), G.length(), equal=key).where(lambda n: n.value > 2).bind("y", ints(YS3))
    got = c.yield_(lambda x, y: {"x": x.value, "y": y.value})
    assert got.collect() == [(5, y) for y in YS3]
    c = Comp().bind("x", ints(XS3)).fold("a", "y", ints(YS3), G.length(), equal=SAME).fold("b", "z", pairs(ZS3), G.length(), equal=key)
    assert first(c.where(lambda a, b: a.value > b.value)) == [2]
    c = Comp().bind("x", ints(XS3)).fold("s", "y", ints(YS3), G.total(lambda y: y.value), lambda x, y: x.value < y.value, lambda y: y.value > 5)
    assert first(c.where(lambda s: s.value < 10)) == [x for x in XS3 if sum(y for y in YS3 if x < y and y > 5) < 10]


def test_filtering_joins_are_below_nested_results(ints):
    c = Comp().bind("x", ints(XS3)).exists("z", ints([2, 5]), equal=[(lambda x: x.value, lambda z: z.value)]).nest("l", "y", ints(YS3), equal=SAME, item=lambda y: y.value)
    assert c.plan == ["semi z", "nest y"]
    assert c.yield_(lambda x, l: {"x": x.value, "l": l.value}).collect() == [(2, [2, 2, 2, 2]), (5, [5, 5])]


def test_folds_of_negative_and_empty_lists(spark, ints):
    assert G.fold(ints([-1, -4, -5, 2]), s=G.total(lambda r: r.value)).first()[0] == -8
    xss = literal(spark, [[10, 20, 30], [-10, -20, -30], [], [0]], "array<bigint>")
    assert B.map_(xss, lambda r: A.total(r.value)).collect() == [60, -60, 0, 0]


def test_index_into_each_inner_list(spark):
    xss = literal(spark, [(["a", "b"], [1, 0, 1]), (["c", "d", "e"], [2]), (["f", "g"], [1, 0]), (["h"], [0])], "struct<xs:array<string>,at:array<int>>")
    assert B.map_(xss, lambda r: A.map_(lambda i: F.get(r.xs, i), r.at)).collect() == [["b", "a", "b"], ["e"], ["g", "f"], ["h"]]


def test_correlated_generators_are_no_product(spark, small):
    from ordinata.plans.catalog import flagship

    plan = flagship(spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "o_totalprice" not in plan.split("== Physical Plan ==")[1], "columns that are not used are not read"


def test_a_plan_can_be_exported(spark, small):
    from ordinata.sources import default_hints, table

    xs = B.filter_(table(spark, "part", ("p_partkey", "p_size"), default_hints("p_partkey"), small), lambda r: r.p_size > 40)
    text = B.map_(xs, lambda r: {"k": r.p_partkey}).plan()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in text and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in text


def test_aggregates_are_not_gathered_first(spark, small):
    from ordinata.plans.catalog import QUERIES

    for name in ("a12_fold_group_fusion", "a14_having", "j8_group_join", "j9_group_join_merged", "c4_fold_in_head"):
        plan = plan_text(QUERIES[name](spark, small))
        assert "collect_list" not in plan and "Join" in plan or name.startswith("a"), name


def test_a_limit_keeps_few_rows_a_task(spark, small):
    from ordinata.plans.catalog import QUERIES

    assert "TakeOrderedAndProject" in plan_text(QUERIES["o5_top_k"](spark, small))


def test_laws(ints):
    values = [3, 1, 2, 3, 1, 5]
    xs = ints(values)
    for n in (-2, 0, 2, 6, 9):
        assert P.take(xs, n).collect() + P.drop(xs, n).collect() == values
    assert P.reverse(P.reverse(xs)).collect() == values
    assert P.reverse(P.sort_with(P.reverse(xs), lambda r: r.value)).collect() == sorted(values, reverse=True)


def test_generators_are_joined_where_guards_tie_them(spark, ints):
    c = Comp().bind("a", ints([1, 2])).bind("s", ints([2, 3])).bind("n", ints([1, 2, 3])).equal(lambda a: a.value + 1, lambda n: n.value).equal(lambda s: s.value, lambda n: n.value)
    assert c.plan == ["theta n", "theta s"]
    assert c.yield_(lambda a, s, n: {"a": a.value, "s": s.value, "n": n.value}).collect() == [(1, 2, 2), (2, 3, 3)]
    c = Comp().bind("a", ints([1, 2])).bind("s", P.reverse(ints([1, 2, 3]))).bind("n", ints([3, 1])).equal(lambda s: s.value, lambda n: n.value)
    assert c.plan == ["theta n", "product s n"]
    assert c.yield_(lambda a, s, n: {"a": a.value, "s": s.value, "n": n.value}).collect() == [(a, s, s) for a in (1, 2) for s in (3, 1)]
    c = Comp().bind("a", ints([1, 2])).bind("s", ints([1, 2])).bind("n", ints([2, 3])).where(lambda a, s, n: a.value + s.value == n.value)
    assert c.plan == ["product s", "theta n"]
    assert c.yield_(lambda a, s, n: {"a": a.value, "s": s.value, "n": n.value}).collect() == [(1, 1, 2), (1, 2, 3), (2, 1, 3)]
    c = Comp().bind("a", ints([1, 2])).bind("s", ints([1, 2, 3])).exists("z", ints([2]), equal=[(lambda s: s.value, lambda z: z.value)]).let("t", lambda a: a.value * 10).equal(lambda a: a.value, lambda s: s.value)
    assert c.plan == ["semi z", "theta s"]
    assert c.yield_(lambda s, t: {"s": s.value, "t": t.value}).collect() == [(2, 20)]
    with pytest.raises(ValueError):
        c.where(lambda q: q.value > 1).yield_(lambda s: {"s": s.value})


def test_folds_under_equal_guards_share_a_join(ints, pairs):
    key, zs = [(lambda x: x.value, lambda z: z.k)], pairs([(1, 5), (1, 7), (3, 1)])
    c = Comp().bind("x", ints([1, 2])).fold("n", "z", zs, G.length(), lambda z: z.v > 1, equal=key)
    again = [(lambda x: x.value, lambda w: w.k)]
    d = c.fold("s", "w", zs, G.total(lambda w: w.v), lambda w: w.v > 1, equal=again)
    assert d.plan == ["group z"]
    assert d.yield_(lambda x, n, s: {"x": x.value, "n": n.value, "s": s.value}).collect() == [(1, 2, 12), (2, 0, 0)]
    d = c.fold("s", "w", zs, G.total(lambda w: w.v), lambda w: w.v > 5, equal=again)
    assert d.plan == ["group z", "group w"]
    assert d.yield_(lambda x, n, s: {"x": x.value, "n": n.value, "s": s.value}).collect() == [(1, 2, 7), (2, 0, 0)]
    d = c.where(lambda n: n.value > 0).fold("s", "w", zs, G.total(lambda w: w.v), lambda w: w.v > 1, equal=again)
    assert d.plan == ["group z", "group w"]
    assert d.yield_(lambda x, s: {"x": x.value, "s": s.value}).collect() == [(1, 12)]
