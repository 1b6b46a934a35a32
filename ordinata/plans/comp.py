"""Comprehensions: generators and guards that become joins.

    Comp().bind("c", customers).where(lambda c: c.c_mktsegment == "BUILDING") \\
          .bind("o", orders).equal(lambda c: c.c_custkey, lambda o: o.o_custkey) \\
          .exists("l", lines, equal=[(lambda o: o.o_orderkey, lambda l: l.l_orderkey)]) \\
          .yield_(lambda c, o: {"name": c.c_name, "key": o.o_orderkey})

A function's parameter names say which variables it sees.  A guard over one
variable filters its list before any join.  Generators are joined when the result
is needed: those that guards tie first, equal keys before other guards, whatever
the order they were bound in, so that a product is made only of generators that no
guard ties.  The result keeps the order of the generators.  Quantified guards
become semi and anti joins on the list of their outer variables, below nested
results; nested comprehensions in the head become nest joins, or group joins where
only a fold of them is wanted.  Folds of one list under equal guards, one after the
other, share a group join.
"""

from __future__ import annotations

import dataclasses
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordinata.operators import joins
from ordinata.operators.aggregates import Agg
from ordinata.rel import ORDER, Rel, Row, RowFn, named

Fn = Callable[..., Column]
Pair = tuple[Fn, Fn]


def _names(f: Callable) -> list[str]:
    return list(inspect.signature(f).parameters)


@dataclasses.dataclass
class _Inner:
    """An inner generator with its guards."""

    var: str
    rel: Rel
    equal: Sequence[Pair]
    guards: Sequence[Fn]


@dataclasses.dataclass
class _Part:
    """A list that runs over some variables and is not joined with the others yet."""

    vars: list[str]
    rel: Rel


@dataclasses.dataclass
class _Folds:
    """Folds of one inner list under the same guards, and the comprehension before them."""

    before: Comp
    inner: _Inner
    aggs: dict[str, Agg]


class Comp:
    """A comprehension under construction; every method gives a new one."""

    def __init__(self):
        self._parts: list[_Part] = []
        self._vars: dict[str, list[str]] = {}
        #: Guards over variables of several parts, or not bound yet.
        self._waiting: list[Fn | Pair] = []
        self._plan: list[str] = []
        self._folds: _Folds | None = None

    @property
    def plan(self) -> list[str]:
        """The joins that were chosen, in order."""
        return list(self._joined()._plan)

    def _copy(self, parts: list[_Part], *steps: str) -> Comp:
        out = Comp()
        out._parts, out._vars, out._waiting, out._plan = list(parts), dict(self._vars), list(self._waiting), [*self._plan, *steps]
        return out

    def _row(self, var: str) -> Row:
        return Row(self._vars[var], f"{var}__")

    def _call(self, f: Fn, **inner: Row) -> Column:
        return f(*[inner[v] if v in inner else self._row(v) for v in _names(f)])

    def _test(self, g: Fn | Pair) -> Column:
        return self._call(g[0]) == self._call(g[1]) if isinstance(g, tuple) else self._call(g)

    def bind(self, var: str, xs: Rel) -> Comp:
        """A generator: `var` runs over a list."""
        if var in self._vars:
            raise ValueError(f"{var} is bound already")
        out = self._copy([*self._parts, _Part([var], _prefixed(var, xs))])
        out._vars[var] = list(xs.fields)
        return out._settled()

    def where(self, guard: Fn) -> Comp:
        """A guard over variables that are bound, or will be."""
        return self._guard(guard)

    def equal(self, f: Fn, g: Fn) -> Comp:
        """The guard that two keys are equal."""
        return self._guard((f, g))

    def _guard(self, g: Fn | Pair) -> Comp:
        out = self._copy(self._parts)
        out._waiting.append(g)
        return out._settled()

    def _settled(self) -> Comp:
        """Guards over one part filter it."""
        out = self._copy(self._parts)
        out._waiting = []
        for g in self._waiting:
            i = self._part_of(_vars_of(g))
            if i is None:
                out._waiting.append(g)
                continue
            part = out._parts[i]
            out._parts[i] = _Part(part.vars, Rel(part.rel.df.where(self._test(g)), part.rel.fields, part.rel.dirs))
        return out

    def _part_of(self, seen: set[str]) -> int | None:
        return next((i for i, p in enumerate(self._parts) if seen <= set(p.vars)), None)

    def _over(self, seen: set[str]) -> tuple[Comp, int]:
        """The part over these variables; all joined if there is none."""
        i = self._part_of(seen)
        return (self._joined(), 0) if i is None else (self, i)

    def _with(self, i: int, rel: Rel, new: Sequence[str] = (), *steps: str) -> Comp:
        """Part i replaced, with new variables of one value."""
        out = self._copy(self._parts, *steps)
        out._parts[i] = _Part([*self._parts[i].vars, *new], rel)
        out._vars |= {v: ["value"] for v in new}
        return out._settled()

    def _joined(self) -> Comp:
        """All parts as one list, in the order of the generators."""
        out, places, widths = self, [[i] for i in range(len(self._parts))], [len(p.rel.dirs) for p in self._parts]
        while len(out._parts) > 1:
            i, j, ready = out._next_join()
            left, right = out._parts[i], out._parts[j]
            tests = [out._test(g) for g in ready]
            rel = joins.theta_join(left.rel, right.rel, lambda x, y, tests=tests: _conjunction(tests)) if tests else joins.product(left.rel, right.rel)
            parts = [_Part(left.vars + right.vars, rel) if k == i else p for k, p in enumerate(out._parts) if k != j]
            out = out._copy(parts, f"{'theta' if tests else 'product'} {' '.join(right.vars)}")
            out._waiting = [g for g in out._waiting if g not in ready]
            places[i] += places.pop(j)
        if places and places[0] != sorted(places[0]):
            out = out._copy([_Part(out._parts[0].vars, _reordered(out._parts[0].rel, places[0], widths))])
        return out

    def _next_join(self) -> tuple[int, int, list[Fn | Pair]]:
        """Two parts and the guards over both: those with equal keys first, then other guards, then a product."""
        n = len(self._parts)
        found = []
        for i in range(n):
            for j in range(i + 1, n):
                both = {*self._parts[i].vars, *self._parts[j].vars}
                if ready := [g for g in self._waiting if _vars_of(g) <= both]:
                    found.append((not any(isinstance(g, tuple) for g in ready), i, j, ready))
        if found:
            return min(found, key=lambda x: x[:3])[1:]
        for g in self._waiting:  # one over three parts or more
            if (seen := _vars_of(g)) <= self._vars.keys():
                i, j = [k for k, p in enumerate(self._parts) if seen & set(p.vars)][:2]
                return i, j, []
        return 0, 1, []

    def let(self, var: str, f: Callable[..., Column]) -> Comp:
        """A name for an expression, computed once a row."""
        ready, i = self._over(set(_names(f)))
        rel = ready._parts[i].rel
        return ready._with(i, Rel(rel.df.withColumn(f"{var}__value", ready._call(f)), [*rel.fields, f"{var}__value"], rel.dirs), [var])

    def exists(self, var: str, ys: Rel, *guards: Fn, equal: Sequence[Pair] = ()) -> Comp:
        """Some y meets all guards: a semi join."""
        return self._quantified(_Inner(var, ys, equal, guards), joins.semi_join, "semi")

    def not_exists(self, var: str, ys: Rel, *guards: Fn, equal: Sequence[Pair] = ()) -> Comp:
        """No y meets all guards: an anti join."""
        return self._quantified(_Inner(var, ys, equal, guards), joins.anti_join, "anti")

    def for_all(self, var: str, ys: Rel, holds: Fn, *guards: Fn, equal: Sequence[Pair] = ()) -> Comp:
        """Every y that meets the guards has `holds`: an anti join with those that do not."""
        breaks = _negated(holds)
        return self._quantified(_Inner(var, ys, equal, [*guards, breaks]), joins.anti_join, "anti")

    def _quantified(self, inner: _Inner, join: Callable, kind: str) -> Comp:
        outer = {v for g in [*inner.guards, *[f for pair in inner.equal for f in pair]] for v in _names(g)} - {inner.var}
        ready, i = self._over(outer)
        right = _prefixed(inner.var, inner.rel)
        row = Row(inner.rel.fields, f"{inner.var}__")
        own = [g for g in inner.guards if set(_names(g)) == {inner.var}]
        both = [g for g in inner.guards if set(_names(g)) != {inner.var}]
        if own:
            right = Rel(right.df.where(_conjunction([g(row) for g in own])), right.fields, right.dirs)
        tests = ready._tests(_Inner(inner.var, inner.rel, inner.equal, both))
        if not tests:
            raise ValueError(f"no guard ties {inner.var} to an outer variable")
        return ready._with(i, join(ready._parts[i].rel, right, lambda x, y: _conjunction(tests)), (), f"{kind} {inner.var}")

    def _tests(self, inner: _Inner, name: str | None = None) -> list[Column]:
        """The guards of an inner generator, its fields under the name of another one if given."""
        row = Row(inner.rel.fields, f"{name or inner.var}__")
        call = lambda f: self._call(f, **{inner.var: row})
        return [*[call(f) == call(g) for f, g in inner.equal], *[call(g) for g in inner.guards]]

    def nest(self, name: str, var: str, ys: Rel, *guards: Fn, equal: Sequence[Pair] = (), item: Callable[[Row], Column] | None = None) -> Comp:
        """The list [item | y <- ys, guards] for each element, as variable `name`: a nest join; without a guard over both, the whole list."""
        ready = self._joined()
        xs = ready._parts[0].rel
        inner, where, outer, on, keys = ready._split(_Inner(var, ys, equal, guards))
        value = (lambda r: item(Row(ys.fields, f"{var}__"))) if item else None
        if not keys and on is None:
            if where:
                inner = Rel(inner.df.where(where(inner.row)), inner.fields, inner.dirs)
            if outer:
                raise ValueError("a guard over outer variables alone needs one that ties the inner list to them")
            new, step = joins.nest_product(xs, inner, f"{name}__value", value), f"nest product {var}"
        else:
            new, step = joins.nest_join(xs, inner, keys, on, f"{name}__value", value, where, outer), f"nest {var}"
        return ready._with(0, new, [name], step)

    def fold(self, name: str, var: str, ys: Rel, agg: Agg, *guards: Fn, equal: Sequence[Pair] = ()) -> Comp:
        """A fold of [y | y <- ys, guards] for each element, as variable `name`: a group join.

        `agg` folds over a row with the fields of y, or over all fields if a guard ties them otherwise than by equal keys.
        A fold right after one of the same list under equal guards is made by the same group join.
        """
        inner = _Inner(var, ys, equal, guards)
        folds = self._folds
        if folds and name not in self._vars and self._alike(folds.inner, inner):
            folds = _Folds(folds.before, folds.inner, {**folds.aggs, name: agg})
        else:
            folds = _Folds(self._joined(), inner, {name: agg})
        before, first = folds.before, folds.inner
        right, where, outer, on, keys = before._split(first)
        if outer:
            test, on0 = outer, on
            on = lambda x, y: test(x) & on0(x, y) if on0 else test(x)
        row = Row(ys.fields, f"{first.var}__")
        plain = {f"{n}__value": Agg(lambda r, a=a: a.fold(row), a.empty) for n, a in folds.aggs.items()}
        out = before._with(0, joins.group_join(before._parts[0].rel, right, plain, keys, on, where), list(folds.aggs), f"group {first.var}")
        if len(out._waiting) == len(before._waiting):  # no guard filtered by a fold meanwhile
            out._folds = folds
        return out

    def _alike(self, a: _Inner, b: _Inner) -> bool:
        """The same list under equal guards."""
        if len(a.equal) != len(b.equal) or len(a.guards) != len(b.guards) or a.rel.fields != b.rel.fields:
            return False
        if a.rel is not b.rel and not a.rel.df.sameSemantics(b.rel.df):
            return False
        return all(x._jc.equals(y._jc) for x, y in zip(self._tests(a), self._tests(b, a.var), strict=True))

    def _split(self, inner: _Inner):
        """(prefixed list, guard over it alone, guard over outer variables alone, guard over both, key pairs)."""
        row = Row(inner.rel.fields, f"{inner.var}__")
        kinds: dict[str, list[Fn]] = {"own": [], "outer": [], "both": []}
        for g in inner.guards:
            seen = set(_names(g))
            kinds["own" if seen == {inner.var} else "both" if inner.var in seen else "outer"].append(g)
        tests = {k: [self._call(g, **{inner.var: row}) for g in gs] for k, gs in kinds.items()}
        keys = []
        for f, g in inner.equal:
            if inner.var in _names(f):
                f, g = g, f
            keys.append((lambda x, f=f: self._call(f), lambda y, g=g: g(row)))
        where = (lambda y: _conjunction(tests["own"])) if tests["own"] else None
        outer = (lambda x: _conjunction(tests["outer"])) if tests["outer"] else None
        on = (lambda x, y: _conjunction(tests["both"])) if tests["both"] else None
        return _prefixed(inner.var, inner.rel), where, outer, on, keys

    def yield_(self, f: Callable[..., RowFn]) -> Rel:
        """The head: one field or several for each binding of the variables."""
        ready = self._joined()
        if not ready._parts:
            raise ValueError("no variable is bound")
        if ready._waiting:
            raise ValueError("a guard names a variable that is not bound")
        return ready._parts[0].rel.with_fields(named(f(*[ready._row(v) for v in _names(f)])))


def _reordered(rel: Rel, places: Sequence[int], widths: Sequence[int]) -> Rel:
    """A list whose parts were joined in the order `places`, in the parts' own order."""
    starts, at = {}, 0
    for p in places:
        starts[p], at = at, at + widths[p]
    old = [starts[p] + k for p in sorted(places) for k in range(widths[p])]
    hidden = [F.col(f"{ORDER}{o}").alias(f"{ORDER}{n}") for n, o in enumerate(old)]
    return Rel(rel.df.select(*[F.col(f"`{f}`") for f in rel.fields], *hidden), rel.fields, [rel.dirs[o] for o in old])


def _prefixed(var: str, xs: Rel) -> Rel:
    return xs.with_fields({f"{var}__{f}": F.col(f"`{f}`") for f in xs.fields})


def _vars_of(g: Fn | Pair) -> set[str]:
    return set(_names(g[0])) | set(_names(g[1])) if isinstance(g, tuple) else set(_names(g))


def _conjunction(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _negated(f: Fn) -> Fn:
    def g(*rows: Row) -> Column:
        return ~f(*rows)

    g.__signature__ = inspect.signature(f)
    return g
