"""An ordered list of rows: a DataFrame and the columns that order it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hidden columns that carry the order: `__o0`, `__o1`, ...
ORDER = "__o"


class Row:
    """What a function over elements gets: the element's fields as attributes or items."""

    def __init__(self, fields: Sequence[str], prefix: str = ""):
        self._fields, self._prefix = tuple(fields), prefix

    def __getitem__(self, name: str) -> Column:
        if name not in self._fields:
            raise KeyError(f"no field {name!r}; there are {', '.join(self._fields)}")
        return F.col(f"`{self._prefix}{name}`")

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def only(self) -> Column:
        """The value of an element with one field."""
        (name,) = self._fields
        return self[name]

    def struct(self) -> Column:
        return F.struct(*[self[f].alias(f) for f in self._fields])


Fields = Column | Mapping[str, Column]
RowFn = Callable[[Row], Fields]


def named(value: Fields, default: str = "value") -> dict[str, Column]:
    """The fields that a function over elements gave."""
    return dict(value) if isinstance(value, Mapping) else {default: value}


class Rel:
    """An ordered list.  `fields` are its elements' columns, `dirs` says of each order column whether it rises.

    Order is a property until it is seen: operators only change the order columns,
    and a physical sort is made by `collect`, by limits and inside aggregated lists.
    The order columns together must be unique, so that order is total.
    """

    def __init__(self, df: DataFrame, fields: Sequence[str], dirs: Sequence[bool]):
        self.df, self.fields, self.dirs = df, list(fields), list(dirs)

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str | tuple[str, bool]], fields: Sequence[str] | None = None) -> Rel:
        """A list of the rows of `df` in the order of some columns, (name, False) for falling ones."""
        spec = [(o, True) if isinstance(o, str) else o for o in order]
        fields = list(fields or df.columns)
        hidden = [F.col(f"`{name}`").alias(f"{ORDER}{i}") for i, (name, _) in enumerate(spec)]
        return cls(df.select(*[F.col(f"`{f}`") for f in fields], *hidden), fields, [up for _, up in spec])

    @property
    def row(self) -> Row:
        return Row(self.fields)

    @property
    def order_columns(self) -> list[str]:
        return [f"{ORDER}{i}" for i in range(len(self.dirs))]

    def order(self) -> list[Column]:
        """The sort expressions of this order."""
        return [F.col(c).asc() if up else F.col(c).desc() for c, up in zip(self.order_columns, self.dirs, strict=True)]

    def rank(self) -> Column:
        """A struct that rises in list order where all order columns rise; used to sort gathered members."""
        if not all(self.dirs):
            raise ValueError("number() the list first: a falling order has no rising struct")
        return F.struct(*self.order_columns)

    def with_fields(self, fields: Mapping[str, Column]) -> Rel:
        """The same order with other elements."""
        out = self.df.select(*[c.alias(n) for n, c in fields.items()], *self.order_columns)
        return Rel(out, list(fields), self.dirs)

    def with_order(self, keys: Sequence[Column], dirs: Sequence[bool]) -> Rel:
        """The same elements, ordered by `keys` first, then as before."""
        hidden = [*keys, *[F.col(c) for c in self.order_columns]]
        df = self.df.select(*[F.col(f"`{f}`") for f in self.fields], *[c.alias(f"{ORDER}{i}") for i, c in enumerate(hidden)])
        return Rel(df, self.fields, [*dirs, *self.dirs])

    def rising(self) -> Rel:
        """The same list with one rising order column where some order column falls."""
        if all(self.dirs):
            return self
        from ordinata.operators.positions import number

        n = number(self, "__pos")
        return Rel(n.df.select(*[F.col(f"`{f}`") for f in self.fields], F.col("__pos").alias(f"{ORDER}0")), self.fields, [True])

    def plain(self) -> DataFrame:
        """The elements as an unordered DataFrame."""
        return self.df.select(*[F.col(f"`{f}`") for f in self.fields])

    def sorted(self) -> DataFrame:
        """The elements as a DataFrame in list order."""
        return self.df.orderBy(*self.order()).select(*[F.col(f"`{f}`") for f in self.fields])

    def collect(self) -> list:
        """Host values in list order: bare values for one field, tuples for several, nested lists for arrays."""
        rows = self.sorted().collect()
        return [_host(r[0]) if len(self.fields) == 1 else tuple(_host(v) for v in r) for r in rows]

    def plan(self, mode: str = "formatted") -> str:
        """The plan of the ordered list as text, to be shown or written to a file."""
        from ordinata.plans.export import plan_text

        return plan_text(self.sorted(), mode)

    def explain(self, mode: str = "formatted") -> None:
        """Print the plan of the ordered list."""
        self.sorted().explain(mode)


def _host(value: object) -> object:
    if isinstance(value, list):
        return [_host(v) for v in value]
    if isinstance(value, tuple):  # a Row of a struct
        return tuple(_host(v) for v in value)
    return value
