"""The catalog: a query for each operator of the list language, over whole tables, and its SQL.

Keys start with the operator's number in the blueprint.  Where order is the point,
a position is part of the result.  Money is counted in cents, so that sums do not
depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinata.functions import lists as A
from ordinata.functions import maybe as M
from ordinata.functions import scalars as S
from ordinata.operators import aggregates as G
from ordinata.operators import basic as B
from ordinata.operators import grouping, joins, windows
from ordinata.operators import positions as P
from ordinata.plans.comp import Comp
from ordinata.rel import ORDER, Rel
from ordinata.sources import default_hints, literal, table

LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: The key of each table; lineitem has none but all of its columns.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": LINE, "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The base tables of a folder as lists."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, *columns: str) -> Rel:
        return table(self.spark, name, columns or None, default_hints(*KEYS[name]), self.sf_dir)


def query(name: str, sql: str) -> Callable[[Callable[[Tables], Rel | DataFrame]], None]:
    def add(f: Callable[[Tables], Rel | DataFrame]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.plain() if isinstance(out, Rel) else out

        QUERIES[name], SQL[name] = run, sql

    return add


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def sql_cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def day(c: Column) -> Column:
    return c.cast("date")


def lit_list(spark: SparkSession, values: list[int], name: str) -> Rel:
    return literal(spark, [(v,) for v in values], f"struct<{name}:bigint>")


# --- scans, sources, sinks -------------------------------------------------------


@query("s1_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return t("nation")


@query("s2_default_hints", "SELECT r_name, CAST(row_number() OVER (ORDER BY r_name) AS BIGINT) AS pos FROM region")
def _(t):
    return P.number(table(t.spark, "region", ("r_name",), default_hints("r_name"), t.sf_dir))


@query("s3_literal", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(3 AS BIGINT), 'a'), (2, 1, 'b'), (3, 3, 'c')) AS v(pos, x, s)")
def _(t):
    return P.number(literal(t.spark, [(3, "a"), (1, "b"), (3, "c")], "struct<x:bigint,s:string>"))


@query("s4_unit_true_false", "SELECT true AS yes, false AS no, CAST(count(*) AS BIGINT) AS units FROM region")
def _(t):
    return G.fold(B.map_(t("region", "r_name"), lambda r: F.lit(True)), yes=G.Agg(lambda r: F.lit(True)), no=G.Agg(lambda r: F.lit(False)), units=G.length())


@query("s5_record_selectors", "SELECT s_name, s_nationkey FROM supplier")
def _(t):
    return B.map_(t("supplier"), lambda r: {"s_name": r.s_name, "s_nationkey": r["s_nationkey"]})


@query("s6_materialize", "SELECT r_name, CAST(r_regionkey + 1 AS BIGINT) AS pos FROM region")
def _(t):
    values = t("region", "r_name").collect()  # host values in list order: five regions
    return P.number(literal(t.spark, [(v,) for v in values], "struct<r_name:string>"))


# --- projections, tuples, conditionals -------------------------------------------


@query("p1_map", f"SELECT l_orderkey, {sql_cents('l_extendedprice')} AS price, CAST(l_quantity AS BIGINT) * 2 AS twice FROM lineitem")
def _(t):
    return B.map_(t("lineitem", "l_orderkey", "l_extendedprice", "l_quantity"), lambda r: {"l_orderkey": r.l_orderkey, "price": cents(r.l_extendedprice), "twice": r.l_quantity.cast("bigint") * 2})


@query("p2_concat_map", "SELECT p_partkey, CAST(i - 1 AS BIGINT) AS pos, w AS word FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, unnest(generate_series(1, len(string_split(p_type, ' ')))) AS i FROM part)")
def _(t):
    d = B.concat_map(t("part", "p_partkey", "p_type"), lambda r: F.split(r.p_type, " "), ("p_partkey",), "word")
    return d.df.select("p_partkey", F.col(d.order_columns[-1]).cast("bigint").alias("pos"), "word")


@query("p2_concat_map_table", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def _(t):
    return Comp().bind("r", t("region")).bind("n", t("nation")).equal(lambda r: r.r_regionkey, lambda n: n.n_regionkey).yield_(lambda r, n: {"r_name": r.r_name, "n_name": n.n_name})


@query("p3_concat", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS BIGINT) AS pos FROM nation")
def _(t):
    xss = grouping.group_with(t("nation"), lambda r: r.n_regionkey, item=lambda r: r.n_name)
    n = P.number(B.concat(xss))
    return n.with_fields({"n_name": F.col("value"), "pos": F.col("pos")})


@query("p4_singleton", "SELECT r_regionkey, r_name AS value FROM region")
def _(t):
    return B.concat_map(t("region"), lambda r: A.singleton(r.r_name), ("r_regionkey",))


@query("p5_tuples", "SELECT s_suppkey, s_name AS a, s_nationkey AS b FROM supplier")
def _(t):
    d = B.map_(t("supplier"), lambda r: {"s_suppkey": r.s_suppkey, "t": F.struct(r.s_name, r.s_nationkey)})
    return d.with_fields({"s_suppkey": F.col("s_suppkey"), "a": F.col("t.s_name"), "b": F.col("t.s_nationkey")})


@query("p5_tuples_wide", "SELECT l_orderkey AS a, l_partkey AS b, l_suppkey AS c, l_linenumber AS d, l_returnflag AS e, l_linestatus AS f FROM lineitem")
def _(t):
    d = B.map_(t("lineitem"), lambda r: {"t": F.struct(*[r[c].alias(f"_{i}") for i, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), 1)])})
    return d.with_fields({n: F.col(f"t._{i}") for i, n in enumerate("abcdef", 1)})


@query("p6_tuple_elements", "SELECT c_custkey AS a, c_mktsegment AS b FROM customer")
def _(t):
    pairs = B.map_(t("customer"), lambda r: F.struct(r.c_custkey.alias("_1"), r.c_mktsegment.alias("_2")))
    return B.map_(pairs, lambda r: {"a": r.value["_1"], "b": r.value["_2"]})


@query("p7_view", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    return B.map_(B.filter_(t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), lambda r: r.o_orderpriority == "1-URGENT"), lambda r: {"o_orderkey": r.o_orderkey, "o_orderstatus": r.o_orderstatus})


@query("p8_cond", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part")
def _(t):
    return B.map_(t("part", "p_partkey", "p_size"), lambda r: {"p_partkey": r.p_partkey, "kind": S.cond(r.p_size > 25, F.lit("large"), F.lit("small"))})


@query("p9_let", f"SELECT o_orderkey, {sql_cents('o_totalprice')} * {sql_cents('o_totalprice')} AS square FROM orders")
def _(t):
    return Comp().bind("o", t("orders")).let("c", lambda o: cents(o.o_totalprice)).yield_(lambda o, c: {"o_orderkey": o.o_orderkey, "square": c.value * c.value})


@query("p10_comprehension", f"SELECT c_name, n_name, o_orderkey, {sql_cents('o_totalprice')} AS price FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
def _(t):
    c = Comp().bind("c", t("customer")).where(lambda c: c.c_mktsegment == "BUILDING").bind("n", t("nation")).equal(lambda c: c.c_nationkey, lambda n: n.n_nationkey)
    c = c.bind("o", t("orders")).equal(lambda o: o.o_custkey, lambda c: c.c_custkey).where(lambda o: o.o_totalprice > 100000)
    return c.yield_(lambda c, n, o: {"c_name": c.c_name, "n_name": n.n_name, "o_orderkey": o.o_orderkey, "price": cents(o.o_totalprice)})


@query("p11_constant_folding", "SELECT r_regionkey, true AS yes, CAST(7 AS BIGINT) AS seven FROM region")
def _(t):
    return B.map_(t("region"), lambda r: {"r_regionkey": r.r_regionkey, "yes": ~(~F.lit(True)), "seven": F.struct(F.lit(7).cast("bigint").alias("a"), F.lit(8).alias("b"))["a"]})


# --- filters and predicates ------------------------------------------------------


@query("f1_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(t):
    d = B.filter_(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), lambda r: (r.l_quantity > 45) & (r.l_returnflag == "R"))
    return B.map_(d, lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber})


@query("f2_guard", "SELECT p_partkey FROM part WHERE p_size = 15")
def _(t):
    return Comp().bind("p", t("part")).where(lambda p: p.p_size == 15).yield_(lambda p: {"p_partkey": p.p_partkey})


@query("f3_leading_guard", "SELECT n_nationkey FROM nation WHERE 2 > 1")
def _(t):
    return B.map_(B.leading_guard(F.lit(2) > F.lit(1), t("nation")), lambda r: {"n_nationkey": r.n_nationkey})


@query("f3_leading_guard_per_row", "SELECT n_nationkey, r_name FROM nation, region WHERE n_regionkey > 1 AND r_regionkey < 3")
def _(t):
    d = joins.nest_product(t("nation", "n_nationkey", "n_regionkey"), B.filter_(t("region", "r_regionkey", "r_name"), lambda r: r.r_regionkey < 3), "rs", lambda r: r.r_name)
    guarded = B.map_(d, lambda r: {"n_nationkey": r.n_nationkey, "rs": S.cond(r.n_regionkey > 1, r.rs, A.nil("string"))})
    return B.concat_map(guarded, lambda r: r.rs, ("n_nationkey",), "r_name")


@query("f4_eq_neq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def _(t):
    return B.map_(B.filter_(t("orders"), lambda r: (r.o_orderstatus == "F") & (r.o_orderpriority != "5-LOW")), lambda r: {"o_orderkey": r.o_orderkey})


@query("f5_orderings", "SELECT p_partkey, p_size < 10 AS lt, p_size <= 10 AS lte, p_size > 10 AS gt, p_size >= 10 AS gte FROM part")
def _(t):
    return B.map_(t("part"), lambda r: {"p_partkey": r.p_partkey, "lt": r.p_size < 10, "lte": r.p_size <= 10, "gt": r.p_size > 10, "gte": r.p_size >= 10})


@query("f6_connectives", "SELECT p_partkey, (p_size > 10 AND p_size < 40) AS a, (p_size < 10 OR p_size > 40) AS o, NOT (p_size > 10) AS n FROM part")
def _(t):
    return B.map_(t("part"), lambda r: {"p_partkey": r.p_partkey, "a": (r.p_size > 10) & (r.p_size < 40), "o": (r.p_size < 10) | (r.p_size > 40), "n": ~(r.p_size > 10)})


@query("f7_min_max", "SELECT o_orderkey, least(o_orderkey, o_custkey) AS a, greatest(o_orderkey, o_custkey) AS b FROM orders")
def _(t):
    return B.map_(t("orders"), lambda r: {"o_orderkey": r.o_orderkey, "a": S.minimum_of(r.o_orderkey, r.o_custkey), "b": S.maximum_of(r.o_orderkey, r.o_custkey)})


@query("f8_null", "SELECT (SELECT count(*) FROM part WHERE p_size > 1000) = 0 AS value")
def _(t):
    return G.null(B.filter_(t("part"), lambda r: r.p_size > 1000))


@query("f9_any_all", "SELECT bool_or(p_size = 50) AS some, bool_and(p_size > 0) AS every FROM part")
def _(t):
    return G.fold(t("part"), some=G.some(lambda r: r.p_size == 50), every=G.every(lambda r: r.p_size > 0))


@query("f10_elem", "SELECT bool_or(n_name = 'FRANCE') AS yes, NOT bool_or(n_name = 'ATLANTIS') AS no FROM nation")
def _(t):
    names = t("nation", "n_name")
    return G.elem(F.lit("FRANCE"), names).withColumnRenamed("value", "yes").crossJoin(F.broadcast(G.not_elem(F.lit("ATLANTIS"), names).withColumnRenamed("value", "no")))


@query("f10_elem_table", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def _(t):
    rich = B.filter_(t("customer"), lambda r: r.c_acctbal > 9000)
    return B.map_(joins.semi_join(t("supplier"), rich, lambda x, y: x.s_nationkey == y.c_nationkey), lambda r: {"s_suppkey": r.s_suppkey})


# --- joins -----------------------------------------------------------------------


@query("j1_product", "SELECT r_name, n_name FROM region, nation")
def _(t):
    return B.map_(joins.product(t("region"), t("nation")), lambda r: {"r_name": r.r_name, "n_name": r.n_name})


@query("j2_equi_join", f"SELECT o_orderkey, c_name, {sql_cents('o_totalprice')} AS price FROM customer JOIN orders ON c_custkey = o_custkey")
def _(t):
    d = joins.equi_join(t("customer"), t("orders"), [(lambda x: x.c_custkey, lambda y: y.o_custkey)])
    return B.map_(d, lambda r: {"o_orderkey": r.o_orderkey, "c_name": r.c_name, "price": cents(r.o_totalprice)})


@query("j3_theta_join", "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_retailprice < b.p_retailprice AND a.p_size <> b.p_size")
def _(t):
    xs = t("part", "p_partkey", "p_brand", "p_retailprice", "p_size")
    d = joins.theta_join(xs, B.renamed(xs, "y_"), lambda x, y: x.p_size != y.y_p_size, [(lambda x: x.p_brand, lambda y: y.y_p_brand)], (lambda x: x.p_retailprice, lambda y: y.y_p_retailprice))
    return B.map_(d, lambda r: {"x": r.p_partkey, "y": r.y_p_partkey})


@query("j3_range_join", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal")
def _(t):
    xs = t("supplier", "s_suppkey", "s_acctbal")
    d = joins.theta_join(xs, B.renamed(xs, "y_"), below=(lambda x: x.s_acctbal, lambda y: y.y_s_acctbal))
    return B.map_(d, lambda r: {"x": r.s_suppkey, "y": r.y_s_suppkey})


@query("j4_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(t):
    d = joins.semi_join(t("customer"), t("orders"), lambda x, y: x.c_custkey == y.o_custkey, lambda y: y.o_totalprice > 200000)
    return B.map_(d, lambda r: {"c_custkey": r.c_custkey})


@query("j5_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(t):
    d = joins.anti_join(t("customer"), t("orders"), lambda x, y: x.c_custkey == y.o_custkey, lambda y: y.o_totalprice > 200000)
    return B.map_(d, lambda r: {"c_custkey": r.c_custkey})


@query("j5a_for_all", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE NOT (s_nationkey >= n_nationkey - 20))")
def _(t):
    d = joins.for_all(t("supplier"), t("nation"), lambda x, y: x.s_nationkey >= y.n_nationkey - 20)
    return B.map_(d, lambda r: {"s_suppkey": r.s_suppkey})


@query("j5b_for_all_class12", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey > 2 AND NOT (s_nationkey < n_nationkey + 12))")
def _(t):
    return joins.for_all(t("supplier", "s_suppkey", "s_nationkey"), t("nation"), lambda x, y: x.s_nationkey < y.n_nationkey + 12, among=lambda y: y.n_regionkey > 2).with_fields({"s_suppkey": F.col("s_suppkey")})


@query("j5c_for_all_class15", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM region WHERE c_nationkey < r_regionkey * 5 AND NOT (r_regionkey % 4 = 0))")
def _(t):
    d = joins.for_all_among(t("customer", "c_custkey", "c_nationkey"), t("region"), lambda x, y: x.c_nationkey < y.r_regionkey * 5, lambda y: S.rem(y.r_regionkey, F.lit(4)) == 0)
    return d.with_fields({"c_custkey": F.col("c_custkey")})


@query("j5d_for_all_class16", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE c_nationkey < n_nationkey AND NOT (n_nationkey <= 2 * c_nationkey))")
def _(t):
    d = joins.for_all(t("customer", "c_custkey", "c_nationkey"), t("nation"), lambda x, y: y.n_nationkey <= 2 * x.c_nationkey, given=lambda x, y: x.c_nationkey < y.n_nationkey)
    return d.with_fields({"c_custkey": F.col("c_custkey")})


@query("j5_for_all_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND NOT (o_totalprice > c_acctbal * 20))")
def _(t):
    d = joins.for_all(t("customer"), t("orders"), lambda x, y: y.o_totalprice > x.c_acctbal * 20, given=lambda x, y: x.c_custkey == y.o_custkey, among=lambda y: y.o_orderstatus == "F")
    return B.map_(d, lambda r: {"c_custkey": r.c_custkey})


@query("j5e_not_exists", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0)")
def _(t):
    c = Comp().bind("n", t("nation")).not_exists("s", t("supplier"), lambda s: s.s_acctbal < 0, equal=[(lambda n: n.n_nationkey, lambda s: s.s_nationkey)])
    return c.yield_(lambda n: {"n_nationkey": n.n_nationkey})


def _exploded(d: Rel, keep: str, field: str, value: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(keep, pos from 1, v) for each member of an inner list."""
    return d.df.select(keep, F.posexplode(field).alias("pos", "m")).select(keep, (F.col("pos") + 1).cast("bigint").alias("pos"), value(F.col("m")).alias("v"))


@query("j6_nest_join", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, o_orderkey AS v FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O'")
def _(t):
    d = joins.nest_join(t("customer", "c_custkey"), t("orders"), [(lambda x: x.c_custkey, lambda y: y.o_custkey)], item=lambda y: y.o_orderkey, where=lambda y: y.o_orderstatus == "O")
    return _exploded(d, "c_custkey", "partners")


@query("j6_nest_join_empties", "SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS BIGINT) AS n FROM customer")
def _(t):
    d = joins.nest_join(t("customer", "c_custkey"), t("orders"), [(lambda x: x.c_custkey, lambda y: y.o_custkey)], where=lambda y: y.o_totalprice > 250000)
    return B.map_(d, lambda r: {"c_custkey": r.c_custkey, "n": A.length(r.partners)})


@query("j6_nest_join_theta", "SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS BIGINT) AS pos, s_suppkey AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 100 AND n_regionkey <> 2")
def _(t):
    d = joins.nest_join(t("nation"), t("supplier"), [(lambda x: x.n_nationkey, lambda y: y.s_nationkey)], on=lambda x, y: y.s_acctbal > x.n_nationkey * 100, item=lambda y: y.s_suppkey, outer=lambda x: x.n_regionkey != 2)
    return _exploded(d, "n_nationkey", "partners")


@query("j7_nest_product", "SELECT r_regionkey, CAST(n_nationkey + 1 AS BIGINT) AS pos, n_name AS v FROM region, nation")
def _(t):
    return _exploded(joins.nest_product(t("region"), t("nation"), item=lambda y: y.n_name), "r_regionkey", "partners")


@query("j8_group_join", f"SELECT c_custkey, CAST(coalesce(sum({sql_cents('o_totalprice')}), 0) AS BIGINT) AS total, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '2-HIGH' GROUP BY c_custkey")
def _(t):
    aggs = {"total": G.total(lambda r: cents(r.o_totalprice)), "n": G.length()}
    return joins.group_join(t("customer", "c_custkey"), t("orders"), aggs, [(lambda x: x.c_custkey, lambda y: y.o_custkey)], where=lambda y: y.o_orderpriority == "2-HIGH")


@query("j8_group_join_theta", "SELECT a.s_suppkey, count(b.s_suppkey) AS richer FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey")
def _(t):
    xs = t("supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    d = joins.group_join(xs, B.renamed(xs, "y_"), {"richer": G.length()}, [(lambda x: x.s_nationkey, lambda y: y.y_s_nationkey)], on=lambda x, y: y.y_s_acctbal > x.s_acctbal)
    return B.map_(d, lambda r: {"s_suppkey": r.s_suppkey, "richer": r.richer})


@query("j9_group_join_merged", "SELECT p_partkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS q, count(l_orderkey) AS n, CAST(max(l_quantity) AS BIGINT) AS most, count(DISTINCT l_suppkey) AS supps FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'A' GROUP BY p_partkey")
def _(t):
    q = lambda r: r.l_quantity.cast("bigint")
    aggs = {"q": G.total(q), "n": G.length(), "most": G.maximum(q), "supps": G.count_distinct(lambda r: r.l_suppkey)}
    return joins.group_join(t("part", "p_partkey"), t("lineitem"), aggs, [(lambda x: x.p_partkey, lambda y: y.l_partkey)], where=lambda y: y.l_returnflag == "A")


@query("j10_disjunction", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def _(t):
    return B.map_(B.filter_(t("orders"), lambda r: r.o_orderpriority.isin("1-URGENT", "3-MEDIUM")), lambda r: {"o_orderkey": r.o_orderkey})


@query("j11_zip_correlation", "SELECT p_partkey, CAST(i AS BIGINT) AS pos, w || '/' || p_brand AS v FROM (SELECT p_partkey, p_brand, unnest(string_split(p_type, ' ')) AS w, unnest(generate_series(1, len(string_split(p_type, ' ')))) AS i FROM part)")
def _(t):
    d = B.map_(t("part"), lambda r: {"p_partkey": r.p_partkey, "tmp": A.map_(lambda w: F.concat(w, F.lit("/"), r.p_brand), F.split(r.p_type, " "))})
    return _exploded(d, "p_partkey", "tmp")


@query("j12_lifted_join", "SELECT n_regionkey AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, s_suppkey) AS BIGINT) AS pos, s_suppkey AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def _(t):
    groups = grouping.group_with_key(t("nation"), lambda r: r.n_regionkey).members(item=lambda r: r.n_nationkey)
    d = joins.lifted_join(groups, "members", t("supplier"), lambda m: m, lambda y: y.s_nationkey, "pairs", lambda y: y.s_suppkey)
    return _exploded(d, "key", "pairs", lambda m: m["_2"])


def _regions(t: Tables) -> Rel:
    """Each region with the list of its nations' keys."""
    return grouping.group_with_key(t("nation"), lambda r: r.n_regionkey).members(item=lambda r: r.n_nationkey)


@query("j12_lifted_semi_join", "SELECT n_regionkey AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS pos, n_nationkey AS v FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def _(t):
    d = joins.lifted_semi_join(_regions(t), "members", t("supplier"), lambda m, y: m == y.s_nationkey, "kept", lambda y: y.s_acctbal > 5000)
    return _exploded(d, "key", "kept")


@query("j12_lifted_anti_join", "SELECT n_regionkey AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS pos, n_nationkey AS v FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def _(t):
    d = joins.lifted_anti_join(_regions(t), "members", t("supplier"), lambda m, y: m == y.s_nationkey, "kept", lambda y: y.s_acctbal > 5000)
    return _exploded(d, "key", "kept")


@query("j12_lifted_theta_join", "SELECT n_regionkey AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, r_regionkey) AS BIGINT) AS pos, n_nationkey * 10 + r_regionkey AS v FROM nation JOIN region ON n_nationkey < r_regionkey * 4")
def _(t):
    d = joins.lifted_theta_join(_regions(t), "members", t("region"), lambda m, y: m < y.r_regionkey * 4, "pairs", lambda y: y.r_regionkey)
    return _exploded(d, "key", "pairs", lambda p: p["_1"] * 10 + p["_2"])


@query("j12_lifted_nest_join", "SELECT n_regionkey AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS pos, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) * 100 + n_nationkey AS BIGINT) AS v FROM nation")
def _(t):
    d = joins.lifted_nest_join(_regions(t), "members", t("supplier"), [(lambda m: m, lambda y: y.s_nationkey)], "nested", lambda y: y.s_suppkey)
    return _exploded(d, "key", "nested", lambda p: (F.size(p["_2"]) * 100 + p["_1"]).cast("bigint"))


@query("j12_lifted_group_join", f"SELECT n_regionkey AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS pos, CAST(coalesce((SELECT sum({sql_cents('s_acctbal')}) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS BIGINT) AS v FROM nation")
def _(t):
    d = joins.lifted_group_join(_regions(t), "members", t("supplier"), G.total(lambda y: cents(y.s_acctbal)), [(lambda m: m, lambda y: y.s_nationkey)], "folds")
    return _exploded(d, "key", "folds", lambda p: p["_2"])


@query("f11_lookup_flat", "SELECT s_suppkey AS value, CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS pos FROM supplier WHERE s_nationkey = 7")
def _(t):
    return P.number(B.lookup(F.lit(7), t("supplier"), lambda r: r.s_nationkey, lambda r: r.s_suppkey))


@query("f11_lookup_table", "SELECT n_nationkey AS n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS BIGINT) AS pos, s_name AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def _(t):
    d = joins.lookup(t("nation", "n_nationkey"), lambda x: x.n_nationkey, t("supplier"), lambda y: y.s_nationkey, lambda y: y.s_name)
    return _exploded(d, "n_nationkey", "found")


@query("j13_join_chain", f"SELECT n_name, CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10")
def _(t):
    return flagship(t.spark, t.sf_dir)


@query("j13_nest_join_chain", "SELECT r_regionkey, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS nations, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey")
def _(t):
    inner = joins.nest_join(t("nation"), t("supplier"), [(lambda x: x.n_nationkey, lambda y: y.s_nationkey)], name="supps", item=lambda y: y.s_suppkey)
    d = joins.nest_join(t("region"), inner, [(lambda x: x.r_regionkey, lambda y: y.n_regionkey)], name="nations", item=lambda y: y.supps)
    return B.map_(d, lambda r: {"r_regionkey": r.r_regionkey, "nations": A.length(r.nations), "suppliers": A.length(A.concat(r.nations))})


@query("j14_selection_over_product", "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
def _(t):
    d = B.filter_(joins.product(t("supplier"), t("nation")), lambda r: r.s_nationkey == r.n_nationkey)
    return B.map_(d, lambda r: {"s_suppkey": r.s_suppkey, "n_name": r.n_name})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation of one market segment's customers, the ten largest."""
    t = Tables(spark, sf_dir)
    c = Comp().bind("c", t("customer", "c_custkey", "c_nationkey", "c_mktsegment")).where(lambda c: c.c_mktsegment == "BUILDING")
    c = c.bind("n", t("nation")).equal(lambda c: c.c_nationkey, lambda n: n.n_nationkey)
    c = c.bind("o", t("orders", "o_orderkey", "o_custkey")).equal(lambda c: c.c_custkey, lambda o: o.o_custkey)
    c = c.bind("l", t("lineitem", "l_orderkey", "l_extendedprice")).equal(lambda o: o.o_orderkey, lambda l: l.l_orderkey)
    lines = c.yield_(lambda n, l: {"n_name": n.n_name, "price": cents(l.l_extendedprice)})
    sums = grouping.group_aggr(lines, lambda r: {"n_name": r.n_name}, revenue=G.total(lambda r: r.price))
    return P.top_k(sums, 10, lambda r: [-r.revenue, r.n_name]).sorted()


# --- aggregates ------------------------------------------------------------------


@query("a1_sum", f"SELECT CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS total, CAST(0 AS BIGINT) AS none FROM lineitem")
def _(t):
    lines = t("lineitem", "l_extendedprice", "l_quantity")
    none = G.fold(B.filter_(lines, lambda r: r.l_quantity < 0), none=G.total(lambda r: cents(r.l_extendedprice)))
    return G.fold(lines, total=G.total(lambda r: cents(r.l_extendedprice))).crossJoin(F.broadcast(none))


@query("a2_avg", "SELECT round(avg(CAST(l_quantity AS DOUBLE)), 6) AS quantity FROM lineitem")
def _(t):
    return G.fold(t("lineitem", "l_quantity"), quantity=G.Agg(lambda r: F.round(F.avg(r.l_quantity), 6)))


@query("a3_minimum_maximum", f"SELECT min({sql_cents('o_totalprice')}) AS least, max({sql_cents('o_totalprice')}) AS most FROM orders")
def _(t):
    return G.fold(t("orders"), least=G.minimum(lambda r: cents(r.o_totalprice)), most=G.maximum(lambda r: cents(r.o_totalprice)))


@query("a4_length", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return G.fold(t("lineitem"), n=G.length())


@query("a5_and_or", "SELECT bool_and(l_quantity > 0) AS every, bool_or(l_quantity > 1000) AS some, true AS none_and, false AS none_or FROM lineitem")
def _(t):
    lines = t("lineitem", "l_quantity")
    none = G.fold(B.filter_(lines, lambda r: r.l_quantity < 0), none_and=G.every(lambda r: r.l_quantity > 0), none_or=G.some(lambda r: r.l_quantity > 0))
    return G.fold(lines, every=G.every(lambda r: r.l_quantity > 0), some=G.some(lambda r: r.l_quantity > 1000)).crossJoin(F.broadcast(none))


@query("a6_count_distinct", "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part")
def _(t):
    return G.fold(t("part"), brands=G.count_distinct(lambda r: r.p_brand), types=G.count_distinct(lambda r: r.p_type))


@query("a7_segmented_fold", "SELECT n_regionkey AS key, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def _(t):
    return grouping.group_with_key(t("nation"), lambda r: r.n_regionkey).aggregate(total=G.total(lambda r: r.n_nationkey))


@query("a8_default_for_missing", "SELECT n_nationkey, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000), 0) AS n, NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000 AND s_suppkey % 2 = 0) AS odd FROM nation")
def _(t):
    aggs = {"n": G.length(), "odd": G.every(lambda r: r.s_suppkey % 2 == 1)}
    d = joins.group_join(t("nation", "n_nationkey"), t("supplier"), aggs, [(lambda x: x.n_nationkey, lambda y: y.s_nationkey)], where=lambda y: y.s_acctbal > 9000)
    return d


@query("a9_group_with_key", "SELECT p_brand AS key, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS pos, p_partkey AS v FROM part")
def _(t):
    return _exploded(grouping.group_with_key(t("part"), lambda r: r.p_brand).members(item=lambda r: r.p_partkey), "key", "members")


@query("a10_group_with", "SELECT CAST(row_number() OVER (ORDER BY p_size) AS BIGINT) AS pos, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_size")
def _(t):
    folded = grouping.group_with_key(t("part"), lambda r: r.p_size).aggregate(n=G.length(), first=G.minimum(lambda r: r.p_partkey))
    return B.map_(P.number(folded), lambda r: {"pos": r.pos, "n": r.n, "first": r.first})


@query("a10_group_with_members", "SELECT CAST(dense_rank() OVER (ORDER BY n_regionkey) AS BIGINT) AS pos, n_name FROM nation")
def _(t):
    groups = P.number(grouping.group_with(t("nation"), lambda r: r.n_regionkey, item=lambda r: r.n_name))
    return B.concat_map(groups, lambda r: r.members, ("pos",), "n_name")


@query("a2_avg_decimal", "SELECT p_brand AS key, CAST(round(sum(CAST(p_retailprice AS DECIMAL(12,2))) * 100) AS BIGINT) AS cents, round(avg(CAST(p_retailprice AS DECIMAL(12,2))), 4) AS mean FROM part GROUP BY p_brand")
def _(t):
    price = lambda r: r.p_retailprice.cast("decimal(12,2)")
    sums = grouping.group_aggr(t("part"), lambda r: r.p_brand, total=G.total(price, "decimal(22,2)"), mean=G.average(price, "double"))
    return B.map_(sums, lambda r: {"key": r.key, "cents": (r.total * 100).cast("bigint"), "mean": F.round(r.mean, 4)})


@query("a11_group_aggr", f"SELECT l_returnflag AS key, CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def _(t):
    return grouping.group_aggr(t("lineitem"), lambda r: r.l_returnflag, total=G.total(lambda r: cents(r.l_extendedprice)))


@query("a12_fold_group_fusion", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey")
def _(t):
    return grouping.group_with_key(t("orders"), lambda r: r.o_custkey).aggregate(n=G.length())


@query("a13_more_folds", f"SELECT l_returnflag AS flag, l_linestatus AS status, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, min({sql_cents('l_extendedprice')}) AS least, bool_or(l_discount > 0.09) AS cheap FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(t):
    g = grouping.group_with_key(t("lineitem"), lambda r: {"flag": r.l_returnflag, "status": r.l_linestatus})
    return g.aggregate(q=G.total(lambda r: r.l_quantity.cast("bigint")), least=G.minimum(lambda r: cents(r.l_extendedprice)), cheap=G.some(lambda r: r.l_discount > 0.09))


@query("a14_having", f"SELECT o_custkey AS key, CAST(sum({sql_cents('o_totalprice')}) AS BIGINT) AS total FROM orders GROUP BY o_custkey HAVING sum({sql_cents('o_totalprice')}) > 150000000")
def _(t):
    return grouping.group_with_key(t("orders"), lambda r: r.o_custkey).aggregate(having=lambda g: g.total > 150000000, total=G.total(lambda r: cents(r.o_totalprice)))


@query("a15_fold_tuples", "SELECT l_suppkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, count(*) AS n, CAST(max(l_quantity) AS BIGINT) AS m FROM lineitem GROUP BY l_suppkey")
def _(t):
    q = lambda r: r.l_quantity.cast("bigint")
    return grouping.group_with_key(t("lineitem"), lambda r: r.l_suppkey).aggregate(s=G.total(q), n=G.length(), m=G.maximum(q))


@query("a16_nub", "SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey)) AS BIGINT) AS pos FROM part GROUP BY p_brand")
def _(t):
    return P.number(B.nub(t("part", "p_brand")))


# --- windows ---------------------------------------------------------------------


@query("w1_number", "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS pos FROM events")
def _(t):
    return P.number(t("events", "event_id"))


@query("w1_number_within", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS pos FROM events")
def _(t):
    return B.map_(P.number(t("events", "event_id", "user_id"), within=["user_id"]), lambda r: {"event_id": r.event_id, "pos": r.pos})


def _window(name: str, function: str, value: Callable, sql: str, preceding: int | None) -> None:
    frame = "UNBOUNDED PRECEDING" if preceding is None else f"{preceding} PRECEDING"

    @query(name, f"SELECT event_id, {sql.format(w=f'(PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {frame} AND CURRENT ROW)')} AS v FROM events")
    def _(t):
        d = windows.window(t("events", "event_id", "user_id", "value", "event_type"), "v", function, value, preceding, ["user_id"])
        return B.map_(d, lambda r: {"event_id": r.event_id, "v": r.v})


_VALUE = sql_cents("value")
_window("w2a_window_sum", "sum", lambda r: cents(r.value), f"CAST(sum({_VALUE}) OVER {{w}} AS BIGINT)", None)
_window("w2b_window_min", "min", lambda r: cents(r.value), f"min({_VALUE}) OVER {{w}}", None)
_window("w2c_window_max", "max", lambda r: cents(r.value), f"max({_VALUE}) OVER {{w}}", None)
_window("w2e_window_all", "all", lambda r: r.value > 10, "bool_and(value > 10) OVER {w}", None)
_window("w2f_window_any", "any", lambda r: r.value > 100, "bool_or(value > 100) OVER {w}", None)
_window("w2g_window_first_value", "first_value", lambda r: r.event_type, "first_value(event_type) OVER {w}", None)
_window("w2h_window_count", "count", lambda r: r.event_type, "count(event_type) OVER {w}", None)
_window("w3_all_preceding", "sum", lambda r: r.event_id, "CAST(sum(event_id) OVER {w} AS BIGINT)", None)
_window("w4_n_preceding", "max", lambda r: cents(r.value), f"max({_VALUE}) OVER {{w}}", 4)
_window("w5_running_aggregate", "count", lambda r: r.event_id, "count(event_id) OVER {w}", None)
_window("w6_sliding_window", "sum", lambda r: cents(r.value), f"CAST(sum({_VALUE}) OVER {{w}} AS BIGINT)", 4)
_window("w7_first_value_sliding", "first_value", lambda r: r.event_id, "first_value(event_id) OVER {w}", 2)


@query("w2d_window_avg", "SELECT event_id, round(avg(CAST(event_id AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS v FROM events")
def _(t):
    d = windows.window(t("events", "event_id", "user_id"), "v", "avg", lambda r: r.event_id, 4, ["user_id"])
    return B.map_(d, lambda r: {"event_id": r.event_id, "v": F.round(r.v, 6)})


@query("w3_all_preceding_whole_list", f"SELECT event_id, CAST(sum({sql_cents('value')}) OVER (ORDER BY event_id) AS BIGINT) AS v FROM events")
def _(t):
    d = windows.window(t("events", "event_id", "value"), "v", "sum", lambda r: cents(r.value))
    return B.map_(d, lambda r: {"event_id": r.event_id, "v": r.v})


@query("w4_n_preceding_whole_list", f"SELECT event_id, max({sql_cents('value')}) OVER (ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS v FROM events")
def _(t):
    d = windows.window(t("events", "event_id", "value"), "v", "max", lambda r: cents(r.value), 6)
    return B.map_(d, lambda r: {"event_id": r.event_id, "v": r.v})


@query("w8_projection_beside_window", "SELECT event_id, CAST(event_id * 2 AS BIGINT) AS twice, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS running FROM events")
def _(t):
    d = windows.window(t("events", "event_id", "user_id"), "running", "sum", lambda r: r.event_id, None, ["user_id"])
    return B.map_(d, lambda r: {"event_id": r.event_id, "twice": r.event_id * 2, "running": r.running})


# --- order, limits, positions ----------------------------------------------------


@query("o1_sort_with", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size, p_brand, p_partkey) AS BIGINT) AS pos FROM part")
def _(t):
    d = P.number(P.sort_with(t("part", "p_partkey", "p_size", "p_brand"), lambda r: [r.p_size, r.p_brand]))
    return B.map_(d, lambda r: {"p_partkey": r.p_partkey, "pos": r.pos})


@query("o2_reverse", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey DESC) AS BIGINT) AS pos FROM supplier")
def _(t):
    return P.number(P.reverse(t("supplier", "s_suppkey")))


@query("o3_take", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def _(t):
    return P.take(t("orders", "o_orderkey"), 25)


@query("o4_drop", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 90")
def _(t):
    return P.drop(t("supplier", "s_suppkey"), 90)


@query("o5_top_k", f"SELECT o_orderkey, {sql_cents('o_totalprice')} AS price FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 12")
def _(t):
    d = P.top_k(t("orders", "o_orderkey", "o_totalprice"), 12, lambda r: r.o_totalprice)
    return B.map_(d, lambda r: {"o_orderkey": r.o_orderkey, "price": cents(r.o_totalprice)})


@query("o5_top_k_within", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def _(t):
    d = P.top_k(t("orders", "o_custkey", "o_orderkey", "o_totalprice"), 3, lambda r: -r.o_totalprice, within=["o_custkey"])
    return B.map_(d, lambda r: {"o_custkey": r.o_custkey, "o_orderkey": r.o_orderkey})


@query("o6_head", "SELECT min(o_orderkey) AS o_orderkey FROM orders")
def _(t):
    return P.head(t("orders", "o_orderkey"))


@query("o6_last", "SELECT max(o_orderkey) AS o_orderkey FROM orders")
def _(t):
    return P.last(t("orders", "o_orderkey"))


@query("o6_index", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 7")
def _(t):
    return P.index(t("nation", "n_name"), 7)


@query("o7_tail", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 1")
def _(t):
    return P.tail(t("supplier", "s_suppkey"))


@query("o7_init", "SELECT s_suppkey FROM supplier WHERE s_suppkey < (SELECT max(s_suppkey) FROM supplier)")
def _(t):
    return P.init(t("supplier", "s_suppkey"))


@query("o8_only", "SELECT n_name FROM nation WHERE n_nationkey = 3")
def _(t):
    return P.only(B.map_(B.filter_(t("nation"), lambda r: r.n_nationkey == 3), lambda r: {"n_name": r.n_name}))


@query("o9_split_at", "SELECT n_nationkey, n_nationkey >= 10 AS second FROM nation")
def _(t):
    a, b = P.split_at(t("nation", "n_nationkey"), 10)
    return a.plain().withColumn("second", F.lit(False)).union(b.plain().withColumn("second", F.lit(True)))


@query("o10_take_while", "SELECT o_orderkey FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE NOT (o_totalprice < 280000)), 1e18)")
def _(t):
    return B.map_(P.take_while(t("orders", "o_orderkey", "o_totalprice"), lambda r: r.o_totalprice < 280000), lambda r: {"o_orderkey": r.o_orderkey})


@query("o11_drop_while", "SELECT o_orderkey FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE NOT (o_totalprice < 280000))")
def _(t):
    return B.map_(P.drop_while(t("orders", "o_orderkey", "o_totalprice"), lambda r: r.o_totalprice < 280000), lambda r: {"o_orderkey": r.o_orderkey})


@query("o12_span_break", "SELECT event_id, event_id >= (SELECT min(event_id) FROM events WHERE event_type = 'purchase') AS second FROM events")
def _(t):
    a, b = P.break_(t("events", "event_id", "event_type"), lambda r: r.event_type == "purchase")
    side = lambda x, s: x.plain().select("event_id", F.lit(s).alias("second"))
    return side(a, False).union(side(b, True))


# --- list construction and set operations ----------------------------------------


@query("l1_nil", "SELECT r_regionkey, CAST(0 AS BIGINT) AS n FROM region")
def _(t):
    return B.map_(t("region"), lambda r: {"r_regionkey": r.r_regionkey, "n": A.length(A.nil("bigint"))})


@query("l2_cons_snoc", "SELECT r_name, CAST(pos AS BIGINT) AS pos FROM (SELECT 'FIRST' AS r_name, 1 AS pos UNION ALL SELECT r_name, r_regionkey + 2 FROM region UNION ALL SELECT 'LAST', 7)")
def _(t):
    xs = t("region", "r_name")
    return P.number(B.snoc(B.cons({"r_name": F.lit("FIRST")}, xs), {"r_name": F.lit("LAST")}))


@query("l3_append", "SELECT name, CAST(row_number() OVER (ORDER BY side, key) AS BIGINT) AS pos FROM (SELECT 0 AS side, r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)")
def _(t):
    return P.number(B.append(B.map_(t("region"), lambda r: {"name": r.r_name}), B.map_(t("nation"), lambda r: {"name": r.n_name})))


@query("l4_union", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def _(t):
    return B.union(B.map_(t("customer"), lambda r: {"k": r.c_nationkey}), B.map_(t("supplier"), lambda r: {"k": r.s_nationkey}))


@query("l5_intersect", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return joins.semi_join(t("customer", "c_custkey"), t("supplier", "s_suppkey"), lambda x, y: x.c_custkey == y.s_suppkey)


@query("l6_except", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return joins.anti_join(t("customer", "c_custkey"), t("supplier", "s_suppkey"), lambda x, y: x.c_custkey == y.s_suppkey)


@query("l7_zip", "SELECT n_name, s_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS j FROM supplier) ON i = j")
def _(t):
    return P.zip_(t("nation", "n_name"), t("supplier", "s_name"))


@query("l8_zip_with", "SELECT n_name || '-' || s_name AS value FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS j FROM supplier) ON i = j")
def _(t):
    return P.zip_with(lambda r: F.concat(r.n_name, F.lit("-"), r.s_name), t("nation", "n_name"), t("supplier", "s_name"))


@query("l8_zip3", "SELECT r_name, n_name, s_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS h FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) ON h = i JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS j FROM supplier) ON i = j")
def _(t):
    return P.zip_(t("region", "r_name"), t("nation", "n_name"), t("supplier", "s_name"))


@query("l8_zip_with3", "SELECT r_name || n_name || s_name AS value FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS h FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) ON h = i JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS j FROM supplier) ON i = j")
def _(t):
    return P.zip_with(lambda r: F.concat(r.r_name, r.n_name, r.s_name), t("region", "r_name"), t("nation", "n_name"), t("supplier", "s_name"))


@query("l9_unzip", "SELECT i AS pos, a, b FROM (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS i, n_nationkey AS a, n_regionkey AS b FROM nation)")
def _(t):
    xs, ys = B.unzip(t("nation", "n_nationkey", "n_regionkey"))
    both = P.zip_(xs.with_fields({"a": xs.row.only()}), ys.with_fields({"b": ys.row.only()}))
    return P.number(both)


@query("l9_unzip3", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS pos, n_name AS c FROM nation")
def _(t):
    _, _, zs = B.unzip(t("nation", "n_nationkey", "n_regionkey", "n_name"))
    return P.number(zs.with_fields({"c": zs.row.only()}))


# --- inner lists -----------------------------------------------------------------

#: Each customer with the cents of its urgent orders, in order; many have none.
_LISTS = f"WITH o AS (SELECT o_custkey AS k, list({sql_cents('o_totalprice')} % 1000 ORDER BY o_orderkey) AS xs FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey), b AS (SELECT c_custkey AS k, coalesce(xs, CAST([] AS BIGINT[])) AS xs FROM customer LEFT JOIN o ON k = c_custkey)"


def _lists(t: Tables) -> Rel:
    d = joins.nest_join(t("customer", "c_custkey"), t("orders"), [(lambda x: x.c_custkey, lambda y: y.o_custkey)], name="xs", item=lambda y: cents(y.o_totalprice) % 1000, where=lambda y: y.o_orderpriority == "1-URGENT")
    return B.map_(d, lambda r: {"k": r.c_custkey, "xs": r.xs})


def inner_list(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """A query whose result is a list for each customer, exploded to (k, pos, v)."""

    @query(name, f"{_LISTS} SELECT k, CAST(unnest(generate_series(1, len(v))) AS BIGINT) AS pos, unnest(v) AS v FROM (SELECT k, {sql} AS v FROM b)")
    def _(t):
        d = _lists(t)
        return _exploded(B.map_(d, lambda r: {"k": r.k, "v": f(r.xs)}), "k", "v")


def inner_value(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """A query whose result is a value for each customer."""

    @query(name, f"{_LISTS} SELECT k, {sql} AS v FROM b")
    def _(t):
        return B.map_(_lists(t), lambda r: {"k": r.k, "v": f(r.xs)})


inner_list("r1_inner_map", lambda xs: A.map_(lambda x: x * 3 + 1, xs), "list_transform(xs, lambda x: x * 3 + 1)")
inner_list("r2_inner_filter", lambda xs: A.filter_(lambda x: x % 2 == 0, xs), "list_filter(xs, lambda x: x % 2 = 0)")
inner_list("r3_inner_concat_map", lambda xs: A.concat_map(lambda x: F.array(x, -x), xs), "flatten(list_transform(xs, lambda x: [x, -x]))")
inner_list("r4_inner_append", lambda xs: A.append(xs, A.reverse(xs)), "list_concat(xs, list_reverse(xs))")
inner_list("r4_inner_cons_snoc", lambda xs: A.snoc(A.cons(F.lit(0).cast("bigint"), xs), F.lit(9).cast("bigint")), "list_concat([CAST(0 AS BIGINT)], xs, [CAST(9 AS BIGINT)])")
inner_list("r5_inner_reverse", A.reverse, "list_reverse(xs)")
inner_list("r6_inner_nub", lambda xs: A.nub(A.map_(lambda x: x % 3, xs)), "list_filter(list_transform(xs, lambda x: x % 3), lambda x, i: list_position(list_transform(xs, lambda y: y % 3), x) = i)")
inner_list("r7_inner_number", lambda xs: A.map_(lambda p: p["value"] * 10 + p["pos"], A.number(xs)), "list_transform(xs, lambda x, i: x * 10 + i)")
inner_list("r8_inner_sort_with", lambda xs: A.sort_with(lambda x: -x, xs), "list_reverse_sort(xs)")
inner_list("r9_inner_group_with", lambda xs: A.map_(lambda g: g["key"] * 100 + F.size(g["members"]).cast("bigint"), A.group_with_key(lambda x: x % 4, xs)), "list_transform(list_sort(list_distinct(list_transform(xs, lambda x: x % 4))), lambda m: m * 100 + len(list_filter(xs, lambda x: x % 4 = m)))")
inner_list("r10_inner_zip", lambda xs: A.zip_with(lambda a, b: a - b, xs, A.tail(xs)), "list_transform(generate_series(1, len(xs) - 1), lambda i: xs[i] - xs[i + 1])")
inner_list("r11_inner_take", lambda xs: A.take(2, xs), "xs[1:2]")
inner_list("r11_inner_drop", lambda xs: A.drop(1, xs), "xs[2:]")
inner_list("r11_inner_tail", A.tail, "xs[2:]")
inner_list("r11_inner_init", A.init, "list_filter(xs, lambda x, i: i < len(xs))")
inner_value("r11_inner_head", A.head, "xs[1]")
inner_value("r11_inner_last", A.last, "xs[-1]")
inner_value("r11_inner_index", lambda xs: A.index(xs, 1), "xs[2]")
inner_value("r12_inner_sum", A.total, "CAST(coalesce(list_sum(xs), 0) AS BIGINT)")
inner_value("r12_inner_avg", lambda xs: F.round(A.average(xs), 6), "round(list_avg(xs), 6)")
inner_value("r12_inner_minimum", A.minimum, "list_min(xs)")
inner_value("r12_inner_maximum", A.maximum, "list_max(xs)")
inner_value("r12_inner_length", A.length, "CAST(len(xs) AS BIGINT)")
inner_value("r12_inner_and", lambda xs: A.and_(A.map_(lambda x: x > 100, xs)), "len(list_filter(xs, lambda x: NOT (x > 100))) = 0")
inner_value("r12_inner_or", lambda xs: A.or_(A.map_(lambda x: x > 900, xs)), "len(list_filter(xs, lambda x: x > 900)) > 0")
inner_value("r12_inner_count_distinct", lambda xs: A.count_distinct(A.map_(lambda x: x % 5, xs)), "CAST(len(list_distinct(list_transform(xs, lambda x: x % 5))) AS BIGINT)")
inner_value("r13_inner_elem", lambda xs: A.elem(F.lit(7).cast("bigint"), A.map_(lambda x: x % 10, xs)), "list_contains(list_transform(xs, lambda x: x % 10), 7)")
inner_value("r13_inner_any", lambda xs: A.any_(lambda x: x > 500, xs), "len(list_filter(xs, lambda x: x > 500)) > 0")
inner_value("r13_inner_all", lambda xs: A.all_(lambda x: x > 500, xs), "len(list_filter(xs, lambda x: x <= 500)) = 0")
inner_value("r13_inner_null", A.null, "len(xs) = 0")
inner_list("r14_inner_cond", lambda xs: S.cond(A.null(xs), F.array(F.lit(-1).cast("bigint")), xs), "CASE WHEN len(xs) = 0 THEN [CAST(-1 AS BIGINT)] ELSE xs END")
inner_list("r15_inner_take_while", lambda xs: A.take_while(lambda x: x > 200, xs), "list_filter(xs, lambda x, i: len(list_filter(xs[1:i], lambda y: NOT (y > 200))) = 0)")
inner_list("r15_inner_drop_while", lambda xs: A.drop_while(lambda x: x > 200, xs), "list_filter(xs, lambda x, i: len(list_filter(xs[1:i], lambda y: NOT (y > 200))) > 0)")
inner_value("r15_inner_span", lambda xs: F.size(A.span(lambda x: x > 200, xs)["_1"]).cast("bigint") * 100 + F.size(A.span(lambda x: x > 200, xs)["_2"]), "CAST(len(list_filter(xs, lambda x, i: len(list_filter(xs[1:i], lambda y: NOT (y > 200))) = 0)) * 100 + len(list_filter(xs, lambda x, i: len(list_filter(xs[1:i], lambda y: NOT (y > 200))) > 0)) AS BIGINT)")
inner_value("r15_inner_split_at", lambda xs: F.size(A.split_at(1, xs)["_2"]).cast("bigint"), "CAST(greatest(len(xs) - 1, 0) AS BIGINT)")
inner_list("r16_inner_join", lambda xs: A.map_(lambda p: p["_1"] * 1000 + p["_2"], A.join(lambda x, y: x % 3 == y % 3, xs, A.tail(xs))), "flatten(list_transform(xs, lambda x: list_transform(list_filter(xs[2:], lambda y: y % 3 = x % 3), lambda y: x * 1000 + y)))")
inner_list("r16_inner_semi_join", lambda xs: A.semi_join(lambda x, y: x < y, xs, A.tail(xs)), "list_filter(xs, lambda x: len(list_filter(xs[2:], lambda y: x < y)) > 0)")
inner_list("r16_inner_anti_join", lambda xs: A.anti_join(lambda x, y: x < y, xs, A.tail(xs)), "list_filter(xs, lambda x: len(list_filter(xs[2:], lambda y: x < y)) = 0)")
inner_list("r16_inner_nest_join", lambda xs: A.map_(lambda p: p["_1"] + F.size(p["_2"]), A.nest_join(lambda x, y: x > y, xs, xs)), "list_transform(xs, lambda x: x + len(list_filter(xs, lambda y: x > y)))")
inner_list("f11_lookup", lambda xs: A.lookup(F.lit(2).cast("bigint"), A.map_(lambda x: F.struct((x % 3).alias("_1"), x.alias("_2")), xs)), "list_filter(xs, lambda x: x % 3 = 2)")
inner_value("l9_inner_unzip3", lambda xs: A.total(A.unzip3(A.map_(lambda x: F.struct((x % 7).alias("_1"), x.alias("_2"), (x * 2).alias("_3")), xs))["_3"]), "CAST(coalesce(list_sum(list_transform(xs, lambda x: x * 2)), 0) AS BIGINT)")
inner_list("l8_inner_zip_with3", lambda xs: A.zip_with3(lambda a, b, c: a + b - c, xs, A.reverse(xs), A.tail(xs)), "list_transform(generate_series(1, len(xs) - 1), lambda i: xs[i] + xs[len(xs) + 1 - i] - xs[i + 1])")
inner_list("r16_inner_product", lambda xs: A.map_(lambda p: p["_1"] * 1000 + p["_2"], A.product(xs, A.take(2, xs))), "flatten(list_transform(xs, lambda x: list_transform(xs[1:2], lambda y: x * 1000 + y)))")
inner_list("r16_inner_group_join", lambda xs: A.map_(lambda p: p["_1"] * 10000 + p["_2"], A.group_join(lambda x, y: x > y, A.total, xs, xs)), "list_transform(xs, lambda x: x * 10000 + CAST(coalesce(list_sum(list_filter(xs, lambda y: x > y)), 0) AS BIGINT))")
inner_list("v7_inner_group_aggr", lambda xs: A.map_(lambda g: g["key"] * 10000 + g["value"], A.group_aggr(lambda x: x % 4, A.total, xs)), "list_transform(list_sort(list_distinct(list_transform(xs, lambda x: x % 4))), lambda k: k * 10000 + CAST(list_sum(list_filter(xs, lambda x: x % 4 = k)) AS BIGINT))")
inner_value("l9_inner_unzip", lambda xs: A.total(A.unzip(A.map_(lambda x: F.struct((x % 7).alias("_1"), x.alias("_2")), xs))["_1"]), "CAST(coalesce(list_sum(list_transform(xs, lambda x: x % 7)), 0) AS BIGINT)")

# Maybe and Either
inner_value("m1_list_to_maybe", lambda xs: M.to_nullable(M.list_to_maybe(xs)), "xs[1]")
inner_list("m1_maybe_to_list", lambda xs: M.maybe_to_list(A.take(1, xs)), "xs[1:1]")
inner_value("m2_just_nothing", lambda xs: F.size(S.cond(A.null(xs), M.nothing("bigint"), M.just(A.head(xs)))).cast("bigint"), "CAST(least(len(xs), 1) AS BIGINT)")
inner_value("m3_is_just", lambda xs: M.is_just(A.take(1, xs)), "len(xs) > 0")
inner_value("m3_is_nothing", lambda xs: M.is_nothing(A.take(1, xs)), "len(xs) = 0")
inner_value("m4_from_maybe", lambda xs: M.from_maybe(F.lit(-1).cast("bigint"), A.take(1, xs)), "coalesce(xs[1], -1)")
inner_value("m4_from_just", lambda xs: M.from_just(S.cond(A.null(xs), M.just(F.lit(-1).cast("bigint")), A.take(1, xs))), "coalesce(xs[1], -1)")
inner_value("m4_maybe", lambda xs: M.maybe(F.lit(0).cast("bigint"), lambda x: x + 5, A.take(1, xs)), "coalesce(xs[1] + 5, 0)")
inner_list("m5_cat_maybes", lambda xs: M.cat_maybes(A.map_(lambda x: S.cond(x > 300, M.just(x), M.nothing("bigint")), xs)), "list_filter(xs, lambda x: x > 300)")
inner_list("m5_map_maybe", lambda xs: M.map_maybe(lambda x: S.cond(x > 300, M.just(x * 2), M.nothing("bigint")), xs), "list_transform(list_filter(xs, lambda x: x > 300), lambda x: x * 2)")


def _eithers(xs: Column) -> Column:
    return A.map_(lambda x: S.cond(x % 2 == 0, M.left(x, "bigint"), M.right(-x, "bigint")), xs)


inner_list("e1_left_right", lambda xs: A.map_(lambda e: F.size(M.either_to_pair(e)["_1"]).cast("bigint"), _eithers(xs)), "list_transform(xs, lambda x: CAST(CASE WHEN x % 2 = 0 THEN 1 ELSE 0 END AS BIGINT))")
inner_list("e2_either", lambda xs: A.map_(lambda e: M.either(lambda a: a + 1, lambda b: b - 1, e), _eithers(xs)), "list_transform(xs, lambda x: CASE WHEN x % 2 = 0 THEN x + 1 ELSE -x - 1 END)")
inner_list("e2_is_left", lambda xs: A.map_(lambda e: M.is_left(e), _eithers(xs)), "list_transform(xs, lambda x: x % 2 = 0)")
inner_list("e2_is_right", lambda xs: A.map_(lambda e: M.is_right(e), _eithers(xs)), "list_transform(xs, lambda x: x % 2 <> 0)")
inner_list("e1_pair_to_either", lambda xs: A.map_(lambda x: M.is_left(M.pair_to_either(S.cond(x % 2 == 0, M.just(x), M.nothing("bigint")), S.cond(x % 2 == 0, M.nothing("bigint"), M.just(x)))), xs), "list_transform(xs, lambda x: x % 2 = 0)")
inner_list("e3_lefts", lambda xs: M.lefts(_eithers(xs)), "list_filter(xs, lambda x: x % 2 = 0)")
inner_list("e3_rights", lambda xs: M.partition_eithers(_eithers(xs))["_2"], "list_transform(list_filter(xs, lambda x: x % 2 <> 0), lambda x: -x)")

# --- scalar functions ------------------------------------------------------------


def scalar_query(name: str, source: str, key: str, f: Callable, sql: str) -> None:
    @query(name, f"SELECT {key}, {sql} FROM {source}")
    def _(t):
        return B.map_(t(source), lambda r: {key: r[key]} | f(r))


scalar_query("n1_arithmetic", "orders", "o_orderkey", lambda r: {"a": r.o_orderkey + r.o_custkey, "b": r.o_orderkey - r.o_custkey, "c": r.o_custkey * 3}, "o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS b, o_custkey * 3 AS c")
scalar_query("n1_double_arithmetic", "orders", "o_orderkey", lambda r: {"a": F.round(r.o_totalprice + 0.5, 4), "b": F.round(r.o_totalprice - 1.25, 4), "c": F.round(r.o_totalprice * 0.1, 4)}, "round(o_totalprice + 0.5, 4) AS a, round(o_totalprice - 1.25, 4) AS b, round(o_totalprice * 0.1, 4) AS c")


def _exact(c: Column) -> Column:
    return c.cast("decimal(12,2)")


scalar_query("n1_decimal_arithmetic", "part", "p_partkey", lambda r: {"a": ((_exact(r.p_retailprice) + _exact(F.lit("10.25"))) * 100).cast("bigint"), "b": ((_exact(r.p_retailprice) - _exact(F.lit("3.99"))) * 100).cast("bigint"), "c": (_exact(r.p_retailprice) * _exact(F.lit("1.07")) * 10000).cast("bigint")}, "CAST((CAST(p_retailprice AS DECIMAL(12,2)) + 10.25) * 100 AS BIGINT) AS a, CAST((CAST(p_retailprice AS DECIMAL(12,2)) - 3.99) * 100 AS BIGINT) AS b, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(1.07 AS DECIMAL(5,2)) * 10000 AS BIGINT) AS c")
scalar_query("n2_decimal_division", "part", "p_partkey", lambda r: {"v": F.round((_exact(r.p_retailprice) / _exact(F.lit("7"))).cast("double"), 5)}, "round(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) / 7, 5) AS v")
scalar_query("n2_division", "part", "p_partkey", lambda r: {"v": F.round(r.p_retailprice / 7, 6)}, "round(p_retailprice / 7, 6) AS v")
scalar_query("n3_quot", "customer", "c_custkey", lambda r: {"v": S.quot(cents(r.c_acctbal), F.lit(300).cast("bigint"))}, f"{sql_cents('c_acctbal')} // 300 AS v")
scalar_query("n4_rem", "customer", "c_custkey", lambda r: {"v": S.rem(cents(r.c_acctbal), F.lit(7).cast("bigint"))}, f"{sql_cents('c_acctbal')} % 7 AS v")
scalar_query("n5_abs_signum_negate", "customer", "c_custkey", lambda r: {"a": F.abs(cents(r.c_acctbal)), "s": S.signum(cents(r.c_acctbal)), "n": -cents(r.c_acctbal)}, f"abs({sql_cents('c_acctbal')}) AS a, CAST(sign({sql_cents('c_acctbal')}) AS BIGINT) AS s, -{sql_cents('c_acctbal')} AS n")
scalar_query("n6_trigonometry", "part", "p_partkey", lambda r: {n: F.round(v, 6) for n, v in {"a": F.sin(r.p_size), "b": F.cos(r.p_size), "c": F.tan(r.p_size), "d": F.asin(r.p_size / 50), "e": F.acos(r.p_size / 50), "f": F.atan(r.p_size)}.items()}, "round(sin(p_size), 6) AS a, round(cos(p_size), 6) AS b, round(tan(p_size), 6) AS c, round(asin(p_size / 50), 6) AS d, round(acos(p_size / 50), 6) AS e, round(atan(p_size), 6) AS f")
scalar_query("n7_sqrt_exp_log_pi", "part", "p_partkey", lambda r: {"a": F.round(F.sqrt(r.p_retailprice), 6), "b": F.round(F.exp(r.p_size / 20), 6), "c": F.round(F.log(r.p_retailprice), 6), "d": F.round(F.pi(), 9)}, "round(sqrt(p_retailprice), 6) AS a, round(exp(p_size / 20), 6) AS b, round(ln(p_retailprice), 6) AS c, round(pi(), 9) AS d")
scalar_query("n8_integer_to_double", "part", "p_partkey", lambda r: {"v": S.integer_to_double(r.p_size)}, "CAST(p_size AS DOUBLE) AS v")
scalar_query("n9_integer_to_decimal", "part", "p_partkey", lambda r: {"v": (S.integer_to_decimal(r.p_size) * 100).cast("bigint")}, "CAST(CAST(p_size AS DECIMAL(18,2)) * 100 AS BIGINT) AS v")
scalar_query("t1_like", "part", "p_partkey", lambda r: {"a": S.like(r.p_type, "%STEEL%"), "b": S.not_like(r.p_brand, "Brand#1_")}, "p_type LIKE '%STEEL%' AS a, p_brand NOT LIKE 'Brand#1_' AS b")
scalar_query("t2_sub_string", "customer", "c_custkey", lambda r: {"v": S.sub_string(r.c_name, 3, 5)}, "substring(c_name, 3, 5) AS v")
scalar_query("t3_re_match", "customer", "c_custkey", lambda r: {"v": S.re_match(r.c_name, "[05]$")}, "regexp_matches(c_name, '[05]$') AS v")
scalar_query("t4_text_literal", "region", "r_regionkey", lambda r: {"v": F.lit("text")}, "'text' AS v")
scalar_query("d1_add_sub_days", "orders", "o_orderkey", lambda r: {"a": S.add_days(r.o_custkey, day(r.o_orderdate)).cast("string"), "b": S.sub_days(F.lit(30), day(r.o_orderdate)).cast("string")}, "CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey AS INTEGER) AS VARCHAR) AS a, CAST(CAST(o_orderdate AS DATE) - 30 AS VARCHAR) AS b")
scalar_query("d2_diff_days", "orders", "o_orderkey", lambda r: {"v": S.diff_days(day(r.o_orderdate), F.lit("1992-01-01").cast("date"))}, "CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS BIGINT) AS v")
scalar_query("d3_to_gregorian", "orders", "o_orderkey", lambda r: {"y": S.to_gregorian(day(r.o_orderdate))["year"], "m": S.to_gregorian(day(r.o_orderdate))["month"], "d": S.to_gregorian(day(r.o_orderdate))["day"]}, "CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d")
scalar_query("d4_date_year", "orders", "o_orderkey", lambda r: {"v": S.date_year(day(r.o_orderdate))}, "CAST(year(o_orderdate) AS BIGINT) AS v")

# --- host-level composition ------------------------------------------------------


def _discounted(price: Column, discount: Column) -> Column:
    """A user's scalar function: inlined where it is used."""
    return cents(price * (1 - discount))


@query("u1_host_functions", "SELECT CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem")
def _(t):
    square = lambda x: x * x
    return G.fold(t("lineitem", "l_quantity"), v=G.total(lambda r: square(r.l_quantity.cast("bigint"))))


@query("u2_composed_aggregate", "SELECT l_returnflag AS key, CAST(max(l_quantity) - min(l_quantity) AS BIGINT) AS span FROM lineitem GROUP BY l_returnflag")
def _(t):
    span = G.Agg(lambda r: (F.max(r.l_quantity) - F.min(r.l_quantity)).cast("bigint"))
    return grouping.group_aggr(t("lineitem"), lambda r: r.l_returnflag, span=span)


@query("u3_composed_table_function", "SELECT n_nationkey, CAST(unnest(generate_series(1, n_regionkey)) AS BIGINT) AS v FROM nation")
def _(t):
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(A.nil("bigint"))
    return B.concat_map(t("nation"), lambda r: upto(r.n_regionkey), ("n_nationkey",), "v")


@query("u4_records", "SELECT 'ann' AS name, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'bob', 5")
def _(t):
    import dataclasses

    from ordinata.functions.records import to_list

    @dataclasses.dataclass
    class Person:
        name: "str"
        n: "int"

    return to_list(t.spark, [Person("ann", 3), Person("bob", 5)], Person)


# --- per-segment forms -----------------------------------------------------------


@query("v7_group_aggr_within", "SELECT n_regionkey, s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, s_nationkey")
def _(t):
    d = joins.equi_join(t("nation"), t("supplier"), [(lambda x: x.n_nationkey, lambda y: y.s_nationkey)])
    return grouping.group_aggr(d, lambda r: {"n_regionkey": r.n_regionkey, "s_nationkey": r.s_nationkey}, n=G.length())


@query("v8_take_within", "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier) WHERE i <= 2")
def _(t):
    return P.take(t("supplier", "s_nationkey", "s_suppkey"), 2, within=["s_nationkey"])


@query("v8_take_while_within", "SELECT user_id, event_id FROM (SELECT user_id, event_id, min(CASE WHEN NOT (value < 100) THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events) WHERE f IS NULL OR event_id < f")
def _(t):
    d = P.take_while(t("events", "user_id", "event_id", "value"), lambda r: r.value < 100, within=["user_id"])
    return B.map_(d, lambda r: {"user_id": r.user_id, "event_id": r.event_id})


@query("v10_replicate_over_inner", "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' WHERE o_totalprice > c_acctbal GROUP BY c_custkey")
def _(t):
    d = joins.nest_join(t("customer", "c_custkey", "c_acctbal"), t("orders"), [(lambda x: x.c_custkey, lambda y: y.o_custkey)], name="xs", item=lambda y: y.o_totalprice, where=lambda y: y.o_orderpriority == "1-URGENT")
    counted = B.map_(d, lambda r: {"k": r.c_custkey, "n": A.length(A.filter_(lambda x: x > r.c_acctbal, r.xs))})
    return B.filter_(counted, lambda r: r.n > 0)


@query("v11_replicate_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) * 0.9")
def _(t):
    most = G.fold(t("orders"), most=G.maximum(lambda r: r.o_totalprice))
    xs = t("orders", "o_orderkey", "o_totalprice")
    d = Rel(xs.df.crossJoin(F.broadcast(most)).where(F.col("o_totalprice") > F.col("most") * 0.9), ["o_orderkey"], xs.dirs)  # one row
    return d


@query("v14_unbox_default", "SELECT p_partkey, coalesce((SELECT CAST(max(l_quantity) AS BIGINT) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A'), -1) AS v FROM part")
def _(t):
    most = G.Agg(lambda r: F.max(r.l_quantity).cast("bigint"), -1)
    return joins.group_join(t("part", "p_partkey"), t("lineitem"), {"v": most}, [(lambda x: x.p_partkey, lambda y: y.l_partkey)], where=lambda y: y.l_returnflag == "A")


@query("v17_combine", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE lower(n_name) END AS v FROM nation")
def _(t):
    return B.map_(t("nation"), lambda r: {"n_nationkey": r.n_nationkey, "v": S.cond(r.n_regionkey == 0, r.n_name, F.lower(r.n_name))})


@query("v18_explode_renest", "SELECT n_regionkey AS key, string_agg(n_name, ',' ORDER BY n_nationkey) AS v FROM nation GROUP BY n_regionkey")
def _(t):
    groups = grouping.group_with_key(t("nation"), lambda r: r.n_regionkey).members(item=lambda r: r.n_name)
    flat = B.concat_map(groups, lambda r: r.members, ("key",), "name")
    again = grouping.group_with_key(flat, lambda r: r.key).members(item=lambda r: r.name)
    return B.map_(again, lambda r: {"key": r.key, "v": F.array_join(r.members, ",")})


# --- comprehensions with quantifiers and nested heads ----------------------------


@query("c1_exists", "SELECT s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'N')")
def _(t):
    c = Comp().bind("s", t("supplier")).exists("l", t("lineitem"), lambda l: l.l_quantity > 49, lambda l: l.l_returnflag == "N", equal=[(lambda s: s.s_suppkey, lambda l: l.l_suppkey)])
    return c.yield_(lambda s: {"s_name": s.s_name})


@query("c2_for_all", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND NOT (s_acctbal > -900))")
def _(t):
    c = Comp().bind("n", t("nation")).for_all("s", t("supplier"), lambda s: s.s_acctbal > -900, equal=[(lambda n: n.n_nationkey, lambda s: s.s_nationkey)])
    return c.yield_(lambda n: {"n_name": n.n_name})


@query("c3_nested_head", f"SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, {sql_cents('o_totalprice')} AS v FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10 WHERE c_mktsegment = 'MACHINERY'")
def _(t):
    c = Comp().bind("c", t("customer")).where(lambda c: c.c_mktsegment == "MACHINERY")
    c = c.nest("os", "o", t("orders"), lambda c, o: o.o_totalprice > c.c_acctbal * 10, equal=[(lambda c: c.c_custkey, lambda o: o.o_custkey)], item=lambda o: cents(o.o_totalprice))
    return _exploded(c.yield_(lambda c, os: {"c_custkey": c.c_custkey, "os": os.value}), "c_custkey", "os")


@query("c4_fold_in_head", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_acctbal > 5000 GROUP BY c_custkey")
def _(t):
    c = Comp().bind("c", t("customer")).where(lambda c: c.c_acctbal > 5000)
    c = c.fold("n", "o", t("orders"), G.length(), lambda o: o.o_orderstatus == "P", equal=[(lambda c: c.c_custkey, lambda o: o.o_custkey)])
    return c.yield_(lambda c, n: {"c_custkey": c.c_custkey, "n": n.value})


@query("c5_guard_on_fold", "SELECT s_suppkey FROM supplier WHERE (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.05) > 280")
def _(t):
    c = Comp().bind("s", t("supplier")).fold("n", "l", t("lineitem"), G.length(), lambda l: l.l_discount > 0.05, equal=[(lambda s: s.s_suppkey, lambda l: l.l_suppkey)])
    return c.where(lambda n: n.value > 280).yield_(lambda s: {"s_suppkey": s.s_suppkey})


@query("c6_generators_tied_late", "SELECT r_name, p_name, CAST(count(*) AS BIGINT) AS n FROM region, part, nation, supplier, lineitem WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey AND p_size > 45 GROUP BY r_name, p_name")
def _(t):
    c = Comp().bind("r", t("region")).bind("p", t("part")).bind("n", t("nation")).bind("s", t("supplier")).bind("l", t("lineitem"))
    c = c.equal(lambda l: l.l_partkey, lambda p: p.p_partkey).equal(lambda l: l.l_suppkey, lambda s: s.s_suppkey).equal(lambda s: s.s_nationkey, lambda n: n.n_nationkey)
    c = c.equal(lambda n: n.n_regionkey, lambda r: r.r_regionkey).where(lambda p: p.p_size > 45)
    return c.yield_(lambda r, p: {"r_name": r.r_name, "p_name": p.p_name}).plain().groupBy("r_name", "p_name").agg(F.count("*").alias("n"))


@query("c7_folds_share_a_join", "SELECT c_custkey, count(o_orderkey) AS n, max(o_orderkey) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def _(t):
    c, key = Comp().bind("c", t("customer")), [(lambda c: c.c_custkey, lambda o: o.o_custkey)]
    c = c.fold("n", "o", t("orders"), G.length(), lambda o: o.o_orderstatus == "O", equal=key)
    c = c.fold("latest", "o", t("orders"), G.maximum(lambda o: o.o_orderkey), lambda o: o.o_orderstatus == "O", equal=key)
    return c.yield_(lambda c, n, latest: {"c_custkey": c.c_custkey, "n": n.value, "latest": latest.value})


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
