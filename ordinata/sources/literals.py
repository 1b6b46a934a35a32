"""Literal lists and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordinata.rel import ORDER, Rel


def literal(spark: SparkSession, values: Sequence, schema: str | T.DataType) -> Rel:
    """A literal list.  `schema` is the type of an element: a struct's fields become the list's, another type the field `value`."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = kind.fields if isinstance(kind, T.StructType) else [T.StructField("value", kind)]
    rows = [(i + 1, *(v if isinstance(kind, T.StructType) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(f"{ORDER}0", T.LongType(), False), *fields]))
    return Rel(df.select(*[f.name for f in fields], f"{ORDER}0"), [f.name for f in fields], [True])


def scalar(spark: SparkSession, **columns: Column) -> DataFrame:
    """A scalar result is a list of one row: a one-row DataFrame of the given columns."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()])


def unit() -> Column:
    """The unit value; only its presence counts."""
    return F.lit(True)
