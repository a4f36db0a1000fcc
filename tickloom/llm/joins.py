"""Joins against tables whose size is looked at before they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, that may be sent to every executor.
MOST_ROWS, MOST_BYTES = 200_000, 16 << 20


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; nested ones are added up."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(0), lambda a, x: a + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)) + 8


def is_small(table: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> bool:
    """Counted, and its values measured, no further than the limit."""
    each = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(0))
    s = table.limit(most + 1).agg(F.count("*").alias("n"), F.sum(each.cast("long")).alias("b")).first()
    return s["n"] <= most and (s["b"] or 0) <= most_bytes


def attached(rows: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """rows joined with a table: broadcast if it was measured and is small, else joined by shuffle, where
    adaptive execution splits skewed keys. The table should be cheap to read, as a written one is."""
    return rows.join(F.broadcast(table) if is_small(table) else table, on, how)
