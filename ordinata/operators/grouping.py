"""Groups, kept unbuilt until it is known whether their members or only folds of them are wanted."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordinata.operators.aggregates import Agg
from ordinata.rel import ORDER, Rel, Row, RowFn, named


@dataclasses.dataclass(frozen=True)
class Grouped:
    """Groups by rising key, members in list order.  `aggregate` never gathers members."""

    xs: Rel
    keys: Mapping[str, Column]

    def aggregate(self, having: Callable[[Row], Column] | None = None, **aggs: Agg) -> Rel:
        """(key, folds ...): one aggregation for all folds, then the guard on them."""
        return self._built(self.xs, having, {n: a.over(self.xs.row) for n, a in aggs.items()})

    def members(self, name: str = "members", item: Callable[[Row], Column] | None = None, having: Callable[[Row], Column] | None = None, **aggs: Agg) -> Rel:
        """(key, folds ..., list of members).  A group's members must fit in a row."""
        r = self.xs.rising()
        value = item(r.row) if item else r.row.struct()
        gathered = F.transform(F.sort_array(F.collect_list(F.struct(r.rank().alias("o"), value.alias("v")))), lambda s: s["v"])
        return self._built(r, having, {n: a.over(r.row) for n, a in aggs.items()} | {name: gathered})

    def _built(self, xs: Rel, having: Callable[[Row], Column] | None, values: Mapping[str, Column]) -> Rel:
        df = xs.df.groupBy(*[k.alias(n) for n, k in self.keys.items()]).agg(*[v.alias(n) for n, v in values.items()])
        fields = [*self.keys, *values]
        if having:
            df = df.where(having(Row(fields)))
        return Rel(df.select(*fields, *[F.col(f"`{k}`").alias(f"{ORDER}{i}") for i, k in enumerate(self.keys)]), fields, [True] * len(self.keys))


def group_with_key(xs: Rel, f: RowFn) -> Grouped:
    return Grouped(xs, named(f(xs.row), "key"))


def group_with(xs: Rel, f: RowFn, name: str = "members", item: Callable[[Row], Column] | None = None) -> Rel:
    """The groups' members alone."""
    g = group_with_key(xs, f).members(name, item)
    return g.with_fields({name: F.col(f"`{name}`")})


def group_aggr(xs: Rel, key: RowFn, **aggs: Agg) -> Rel:
    return group_with_key(xs, key).aggregate(**aggs)
