"""Base tables: files with a declared key."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ordinata.rel import Rel


@dataclasses.dataclass(frozen=True)
class Hints:
    """Candidate keys of a table, at least one, and whether it is known to have rows.

    The first key orders the list; the others must exist.  Spark needs no hint
    about rows: whether there are any is seen at run time.
    """

    keys: tuple[tuple[str, ...], ...]
    non_empty: bool = False

    def __post_init__(self):
        if not self.keys or not all(self.keys):
            raise ValueError("a table needs a candidate key")


def default_hints(*key: str) -> Hints:
    """Hints with one key and nothing known about emptiness."""
    return Hints((tuple(key),))


def table(source: SparkSession | DataFrame, name: str, columns: Sequence[str] | None, hints: Hints, sf_dir: str = "") -> Rel:
    """A base table as a list in the order of its first key.

    Columns are those named, in that order, and must be flat; all for None.
    The scan reads only these, the key, and what later filters need.
    """
    df = source if isinstance(source, DataFrame) else source.read.parquet(f"{sf_dir}/{name}.parquet")
    names = list(columns) if columns is not None else df.columns
    missing = [c for c in [*names, *[c for key in hints.keys for c in key]] if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} has no column {', '.join(missing)}")
    nested = [c for c in names if df.schema[c].dataType.typeName() in ("array", "struct", "map")]
    if nested:
        raise ValueError(f"columns of a table must be scalar: {', '.join(nested)}")
    return Rel.of(df, hints.keys[0], names)
