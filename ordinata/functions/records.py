"""Host records: dataclasses as elements of lists."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ordinata.rel import Rel
from ordinata.sources.literals import literal

SCALARS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), datetime.date: T.DateType(), decimal.Decimal: T.DecimalType(38, 8)}


def struct_of(record: type) -> T.StructType:
    """The struct of a dataclass: scalars, lists of them, and nested dataclasses."""
    import typing

    hints = typing.get_type_hints(record)
    return T.StructType([T.StructField(f.name, _kind(hints[f.name])) for f in dataclasses.fields(record)])


def _kind(hint: object) -> T.DataType:
    import typing

    if hint in SCALARS:
        return SCALARS[hint]
    if dataclasses.is_dataclass(hint):
        return struct_of(hint)
    if typing.get_origin(hint) is list:
        return T.ArrayType(_kind(typing.get_args(hint)[0]))
    if typing.get_origin(hint) is tuple:
        return T.StructType([T.StructField(f"_{i + 1}", _kind(a)) for i, a in enumerate(typing.get_args(hint))])
    raise TypeError(f"{hint} has no column type")


def to_list(spark: SparkSession, records: Sequence, record: type) -> Rel:
    """A literal list of dataclass instances; fields are selected by name."""
    return literal(spark, [dataclasses.astuple(r) for r in records], struct_of(record))


def from_list(xs: Rel, record: type) -> list:
    """Instances of a dataclass with the list's fields, in list order."""
    hints = {f.name for f in dataclasses.fields(record)}
    if hints != set(xs.fields):
        raise ValueError("the record's fields are not the list's")
    return [record(**{f: row[f] for f in xs.fields}) for row in xs.sorted().collect()]
