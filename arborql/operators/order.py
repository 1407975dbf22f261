"""Sorting, limits and offsets of nodes.

Ascending order is numbers, then text, then missing values, ties by id; descending order
is its exact reverse. Without a sort the order is that of the traversal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages with a collation of their own; all others sort by the root collation.
LOCALES = {c: c for c in "en de fr es nl it pt sv fi da pl cs sk sl hr hu ro tr et lv lt el bg ru uk is ga ca eu gl sq mk sr".split()}


def sort_keys(df: DataFrame, field: str, order: str = "asc", language: str | None = None) -> list[Column]:
    """Rank of the kind, number, text and id."""
    kind = df.select(field).schema[0].dataType
    c = F.col(field)
    if isinstance(kind, T.MapType):
        c = c[language] if language else F.map_values(c)[0]
        kind = T.StringType()
    text = isinstance(kind, T.StringType)
    number = isinstance(kind, (T.NumericType, T.BooleanType))
    rank = F.when(c.isNull(), 2).otherwise(1 if text else 0)
    keys = [rank]
    if text:
        keys.append(F.collate(c, LOCALES.get(language[:2], "UNICODE")) if language else c)
    elif number:
        keys.append(c.cast("double") if isinstance(kind, T.BooleanType) else c)
    else:
        keys.append(F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType)) else c)
    keys.append(F.col("id"))
    if order == "desc":
        return [k.desc() for k in keys]
    return [k.asc_nulls_last() for k in keys]


def walk_keys(df: DataFrame) -> list[Column]:
    """The order of a breadth-first walk; by depth and id where no path was kept."""
    return [F.col("depth"), F.col("path")] if "path" in df.columns else [F.col("depth"), F.col("id")] if "depth" in df.columns else [F.col("id")]


def take(df: DataFrame, keys: list[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """The first rows of all, by a distributed top-k."""
    if limit < 0 and offset <= 0:
        return df
    out = df.orderBy(*keys)
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit >= 0 else out


def take_each(df: DataFrame, by: list[str], keys: list[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """The first rows of each start, with their position (pos, from 0).

    The bound is on the bare row number, so that each task first cuts its own rows
    (WindowGroupLimit) and a start with very many rows isn't sorted in one task.
    """
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))
    if limit >= 0:
        out = out.where(F.col("_rank") <= max(offset, 0) + limit)
    if offset > 0:
        out = out.where(F.col("_rank") > offset)
    return out.withColumn("pos", F.col("_rank") - 1).drop("_rank")


def sort_items(field: Column, key: str | Callable[[Column], Column | None], order: str = "asc") -> Column:
    """An object array sorted by a field of its elements; missing ones last (first, if descending)."""
    value = (lambda e: e[key]) if isinstance(key, str) else key
    sign = 1 if order == "asc" else -1

    def compare(a: Column, b: Column) -> Column:
        x, y = value(a), value(b)
        if x is None or y is None:  # no element has the field
            return F.lit(0)
        return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), sign).when(y.isNull(), -sign).when(x < y, -sign).when(x > y, sign).otherwise(0)

    return F.array_sort(field, compare)
