"""Window aggregates over positions: all preceding elements, or the last few."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ordinata.operators.positions import number
from ordinata.rel import Rel, Row

#: The functions that windows have.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "all": F.bool_and,
    "any": F.bool_or,
    "first_value": F.first,
    "count": F.count,
}
#: What joins the fold of all stretches before with the fold inside one.
JOINED: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a + b, b),
    "min": F.least,
    "max": F.greatest,
    "all": lambda a, b: F.coalesce(a & b, b),
    "any": lambda a, b: F.coalesce(a | b, b),
    "first_value": F.coalesce,
    "count": lambda a, b: F.coalesce(a + b, b),
}
#: Elements of a stretch of a whole list: stretches are folded side by side.
STRETCH = 1 << 16


def window(xs: Rel, name: str, function: str, f: Callable[[Row], Column], preceding: int | None = None, within: Sequence[str] = ()) -> Rel:
    """`xs` with field `name`: a function of the elements from `preceding` before (None: all before) to this one.

    `within` names the fields whose equal values make a list of their own.
    Without it the list is cut into stretches by position, so that no task sees the
    whole list.  A stretch borrows the last `preceding` elements of those before
    it, or, for all preceding ones, adds the fold of the stretches before it.
    """
    if within:
        w = Window.partitionBy(*within).orderBy(*xs.order()).rowsBetween(_first(preceding), Window.currentRow)
        return Rel(xs.df.withColumn(name, FUNCTIONS[function](f(xs.row)).over(w)), [*xs.fields, name], xs.dirs)
    numbered = number(xs, "__pos")
    value = f(xs.row)
    long = STRETCH if preceding is None else max(STRETCH, preceding)
    d = numbered.df.withColumn("__stretch", F.floor((F.col("__pos") - 1) / long))
    rows = Window.partitionBy("__stretch").orderBy("__pos").rowsBetween(_first(preceding), Window.currentRow)
    if preceding is not None:
        lent = d.where((F.col("__pos") - 1) % long >= long - preceding).withColumn("__stretch", F.col("__stretch") + 1)
        d = d.withColumn("__own", F.lit(True)).unionByName(lent.withColumn("__own", F.lit(False)))
        d = d.withColumn(name, FUNCTIONS[function](value).over(rows)).where("__own")
        return _back(xs, d, name)
    folds = {"sum": "sum", "count": "count"} if function == "avg" else {function: function}
    # the first element of a stretch is the one at the least position
    one = {k: F.min_by(value, "__pos") if k == "first_value" else FUNCTIONS[k](value) for k in folds}
    parts = d.groupBy("__stretch").agg(*[v.alias(f"__of_{k}") for k, v in one.items()])
    earlier = Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    before = parts.select("__stretch", *[FUNCTIONS["sum" if k == "count" else k](f"__of_{k}").over(earlier).alias(f"__before_{k}") for k in folds])
    d = d.join(before, "__stretch")
    joined = {k: JOINED[k](F.col(f"__before_{k}"), FUNCTIONS[k](value).over(rows)) for k in folds}
    return _back(xs, d.withColumn(name, joined["sum"] / joined["count"] if function == "avg" else joined[function]), name)


def _first(preceding: int | None) -> int:
    return Window.unboundedPreceding if preceding is None else -preceding


def _back(xs: Rel, df, name: str) -> Rel:
    return Rel(df.select(*[F.col(f"`{c}`") for c in xs.fields], name, *xs.order_columns), [*xs.fields, name], xs.dirs)
