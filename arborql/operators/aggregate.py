"""Aggregates over nodes: count, countUnique, sum, avg, min, max; in all, by start, or over the first rows of an order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS = ("count", "countUnique", "sum", "avg", "min", "max")


def first_number(df: DataFrame, args: list[str]) -> Column:
    """The first numeric field that has a value."""
    numeric = [a for a in args if "." in a or isinstance(df.schema[a].dataType, (T.NumericType, T.BooleanType)) if a.split(".")[0] in df.columns]
    return F.coalesce(*(F.col(a).cast("double") for a in numeric)) if numeric else F.lit(None).cast("double")


def aggregate_column(df: DataFrame, function: str, args: list[str], compat: bool = False) -> Column:
    """The aggregate expression. An empty sum is 0, other empty aggregates are null; compat gives the old engine's bounds."""
    if function == "count":
        return F.count("*")
    if function == "countUnique":
        present = [F.col(a) for a in args if a.split(".")[0] in df.columns]
        # Strings and numbers are counted apart, as are whole and other numbers.
        tagged = [F.concat(F.lit({"bigint": "l", "int": "l", "double": "d"}.get(df.select(c).schema[0].dataType.simpleString(), "s")), c.cast("string")) for c in present]
        return F.count_distinct(F.coalesce(*tagged)) if tagged else F.lit(0).cast("long")
    x = first_number(df, args)
    if function == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if function == "avg":
        return F.avg(x)
    if function == "min":
        return F.coalesce(F.min(x), F.lit(1.7976931348623157e308)) if compat else F.min(x)
    if function == "max":
        return F.greatest(F.coalesce(F.max(x), F.lit(2.2250738585072014e-308)), F.lit(2.2250738585072014e-308)) if compat else F.max(x)
    raise ValueError(f"unknown aggregate {function}")


def aggregate(df: DataFrame, function: str, args: list[str] = (), by: list[str] = (), name: str = "value", compat: bool = False) -> DataFrame:
    """One row (or one for each value of by)."""
    return df.groupBy(*by).agg(aggregate_column(df, function, list(args), compat).alias(name))


def items_column(items: Column, function: str, values: Callable[[Column], list[tuple[Column | None, T.DataType | None]]], compat: bool = False) -> Column:
    """The aggregate of an array's objects, in the row. values: the arguments of one object, with their types."""
    if function == "count":
        return F.size(F.filter(items, lambda e: e.isNotNull())).cast("long")
    if function == "countUnique":
        one = lambda e: F.coalesce(F.lit(None).cast("string"), *(c.cast("string") for c, _ in values(e) if c is not None))
        return F.size(F.array_distinct(F.filter(F.transform(items, one), lambda x: x.isNotNull()))).cast("long")
    number = lambda e: F.coalesce(F.lit(None).cast("double"), *(c.cast("double") for c, k in values(e) if isinstance(k, (T.NumericType, T.BooleanType))))
    x = F.filter(F.transform(items, number), lambda v: v.isNotNull())
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    if function == "sum":
        return total
    if function == "avg":
        return F.when(F.size(x) > 0, total / F.size(x))
    if function == "min":
        return F.coalesce(F.array_min(x), F.lit(1.7976931348623157e308)) if compat else F.array_min(x)
    return F.greatest(F.coalesce(F.array_max(x), F.lit(2.2250738585072014e-308)), F.lit(2.2250738585072014e-308)) if compat else F.array_max(x)
