"""Reads on a path of one node: its value, whether it is there, how long it is, and what it is."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import GraphStore


def length(c: Column, kind: T.DataType) -> Column:
    """Members of an object that are set, keys of a record or text, elements, characters; 1 for a number; 0 if missing."""
    if isinstance(kind, T.StructType):
        n = sum((F.when(c[f.name].isNotNull(), 1).otherwise(0) for f in kind.fields), F.lit(0))
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        n = F.size(c)
    else:
        n = F.length(c) if isinstance(kind, T.StringType) else F.lit(1)
    return F.when(c.isNull(), 0).otherwise(n).cast("long")


def kind_of(kind: T.DataType, spec: dict | None) -> str:
    """string, double, longlong, set, array or object."""
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "set" if (spec or {}).get("type") in ("set", "references") else "array"
    return "string" if isinstance(kind, T.StringType) else "double" if isinstance(kind, T.DoubleType) else "longlong"


def meta_of(spec: dict | None) -> str | None:
    """object, record, text or timeseries; or what set_meta put there."""
    if spec is None:
        return None
    return spec.get("meta") or ("timeseries" if spec.get("timeseries") else spec["type"] if spec["type"] in ("object", "record", "text") else None)


def read(store: GraphStore, command: str, node_id: str, path: str | None = None) -> DataFrame:
    """One row with value; none if the node doesn't exist."""
    from ..plans.compile import Compiler

    rows = store.find([node_id])
    if path is None:
        present = F.struct(*rows.columns)
        return rows.select({"exists": F.lit(True), "len": length(present, rows.select(present.alias("x")).schema[0].dataType), "type": F.lit("object"), "get": present, "getmeta": F.lit("object")}[command].alias("value"))
    c, spec = Compiler(store).path(rows, path), store.schema.lookup(store.schema.type_of(node_id) or "", path)
    if c is None:
        return rows.select({"exists": F.lit(False), "len": F.lit(0).cast("long")}.get(command, F.lit(None).cast("string")).alias("value"))
    kind = rows.select(c.alias("x")).schema[0].dataType
    made = {"get": lambda: c, "exists": lambda: c.isNotNull(), "len": lambda: length(c, kind), "type": lambda: F.when(c.isNotNull(), kind_of(kind, spec)), "getmeta": lambda: F.when(c.isNotNull(), meta_of(spec))}
    return rows.select(made[command]().alias("value"))


def set_meta(store: GraphStore, node_id: str, path: str, value: Any) -> GraphStore:
    """The store whose schema marks the field of the node's type."""
    t = store.schema.type_of(node_id)
    d = store.schema.types[t]
    types = {**store.schema.types, t: replace(d, fields={**d.fields, path: {**d.fields[path], "meta": value}})}
    return store.with_(schema=replace(store.schema, types=types))
