"""Filters: JSON leaves with and/or forks -> a reduced tree -> a Spark Column.

Missing values follow the graph model, not SQL: `!=` on a missing field holds, every
other comparison with a missing field fails. With compat=True the comparisons of one
field are merged as in the older engine (`>` and `<` become an inclusive range, and a
contradiction drops the whole filter).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", ">", "<", "..", "exists", "notExists", "has", "includes", "distance", "textSearch")
UNITS = {"": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_NOW = re.compile(r"^now(?:\s*([+-])\s*(\d+)\s*([smhd]?))?$")


class FilterError(ValueError):
    """A filter isn't well formed, or contradicts itself."""


@dataclass
class Leaf:
    field: str
    operator: str
    value: Any = None


@dataclass
class Fork:
    any: bool
    parts: list


def validate(leaf: dict) -> None:
    if not isinstance(leaf, dict) or not isinstance(leaf.get("$field"), str):
        raise FilterError(f"a filter needs a $field: {leaf}")
    if leaf.get("$operator") not in OPERATORS:
        raise FilterError(f"unknown operator {leaf.get('$operator')}")
    if leaf["$operator"] not in ("exists", "notExists") and "$value" not in leaf:
        raise FilterError(f"{leaf['$operator']} needs a $value")
    if extra := set(leaf) - {"$field", "$operator", "$value", "$and", "$or"}:
        raise FilterError(f"unknown filter keys {sorted(extra)}")


def parse(told: dict | list) -> Fork:
    """A list is a conjunction. A leaf with $and and $or reads (leaf and $and) or $or."""
    parts: list = []
    for x in told if isinstance(told, list) else [told]:
        validate(x)
        value = x.get("$value")
        if x["$operator"] == "..":
            if not isinstance(value, (list, tuple)) or len(value) != 2:
                raise FilterError(".. needs two values")
        one: Any = Leaf(x["$field"], x["$operator"], value)
        if "$and" in x:
            one = Fork(False, [one, parse(x["$and"])])
        if "$or" in x:
            one = Fork(True, [one, parse(x["$or"])])
        parts.append(one)
    return Fork(False, parts)


def flatten(node):
    """Forks of the same kind inside each other become one."""
    if isinstance(node, Leaf):
        return node
    parts = []
    for p in map(flatten, node.parts):
        parts += p.parts if isinstance(p, Fork) and (p.any == node.any or len(p.parts) == 1) else [p]
    return Fork(node.any, parts)


def _is_now(v: Any) -> bool:
    return isinstance(v, str) and bool(_NOW.match(v))


def _pair(a: Leaf, b: Leaf) -> Leaf | None:
    """What two comparisons of one field in a conjunction become; None if they stay apart."""
    listed = lambda v: list(v) if isinstance(v, (list, tuple)) else [v]
    ops = {a.operator, b.operator}
    by = {x.operator: x for x in (a, b)}
    if ops == {"="}:
        return Leaf(a.field, "=", list(dict.fromkeys(listed(a.value) + listed(b.value))))
    if ops == {"!="}:
        return Leaf(a.field, "!=", list(dict.fromkeys(listed(a.value) + listed(b.value))))
    if ops == {"=", "!="}:
        if by["="].value == by["!="].value:
            raise FilterError("= and != of one value")
        return by["="]
    if ops == {"exists", "notExists"}:
        raise FilterError("exists and notExists")
    if any(_is_now(v) for x in (a, b) for v in listed(x.value)):
        return None
    if ops == {">"}:
        return Leaf(a.field, ">", max(a.value, b.value))
    if ops == {"<"}:
        return Leaf(a.field, "<", min(a.value, b.value))
    if ops == {">", "<"}:
        if by[">"].value > by["<"].value:
            raise FilterError("empty range")
        return Leaf(a.field, "..", [by[">"].value, by["<"].value])
    if ".." in ops and ops & {">", "<"}:
        r, s = by[".."], by[">"] if ">" in ops else by["<"]
        if s.operator == ">" and s.value > r.value[1] or s.operator == "<" and s.value < r.value[0]:
            raise FilterError("out of range")
        return r
    return None


def reduce(node):
    """Merges the comparisons of one field in conjunctions (compat)."""
    if isinstance(node, Leaf):
        return node
    parts = [reduce(p) for p in node.parts]
    if not node.any:
        out: list = []
        for p in parts:
            for i, o in enumerate(out):
                if isinstance(p, Leaf) and isinstance(o, Leaf) and o.field == p.field and (m := _pair(o, p)) is not None:
                    out[i] = m
                    break
            else:
                out.append(p)
        parts = out
    return Fork(node.any, parts)


def tree(told: dict | list, compat: bool = False) -> Fork | None:
    """The filter's tree; with compat None (everything matches) where it contradicts itself."""
    node = flatten(parse(told))
    if not compat:
        return node
    try:
        return reduce(node)
    except FilterError:
        return None


def leaves(node) -> list[Leaf]:
    return [] if node is None else [node] if isinstance(node, Leaf) else [x for p in node.parts for x in leaves(p)]


def types_of(node, known: set[str]) -> set[str] | None:
    """The types a match can have, if the filter limits them: prunes the tables to read."""
    if isinstance(node, Leaf):
        if node.field == "type" and node.operator == "=":
            return set(node.value if isinstance(node.value, (list, tuple)) else [node.value]) & known
        if node.field == "type" and node.operator == "!=":
            return known - set(node.value if isinstance(node.value, (list, tuple)) else [node.value])
        return None
    if node is None:
        return None
    found = [types_of(p, known) for p in node.parts]
    if node.any:
        return None if not found or any(f is None for f in found) else set().union(*found)
    limits = [f for f in found if f is not None]
    return set.intersection(*limits) if limits else None


def moment(v: Any, now_ms: int | None) -> Any:
    """A number, or now with an offset, in milliseconds."""
    if not isinstance(v, str):
        return F.lit(v)
    m = _NOW.match(v)
    if not m:
        raise FilterError(f"not a number: {v}")
    base = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    shift = int(m[2] or 0) * UNITS[m[3] or ""]
    return base + (-shift if m[1] == "-" else shift)


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres between two points."""
    p, q = F.radians(lat), F.radians(F.lit(lat0))
    a = F.pow(F.sin((p - q) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(a))


FOLDED = ("äöüÄÖÜáàâéèêëíìîóòôúùûñç", "aouaouaaaeeeeiiiooouuunc")


def tokens(text: Column) -> Column:
    """Search tokens: lower case, common accents folded, split at everything but letters and digits."""
    return F.filter(F.split(F.translate(F.lower(text), *FOLDED), r"[^\p{L}\p{N}]+"), lambda x: x != "")


class Fields:
    """How a filter reads a node: the column of a path, its kind, and set-like relations."""

    def __init__(self, column: Callable[[str], Column | None], kind: Callable[[str], str | None], relation: Callable[[str, Any], Column | None] | None = None, language: str | None = None, now_ms: int | None = None):
        self.column, self.kind, self.relation, self.language, self.now_ms = column, kind, relation or (lambda f, v: None), language, now_ms


def _equal(c: Column, v: Any) -> Column:
    if isinstance(v, bool):
        return c.cast("boolean") == F.lit(v)
    if isinstance(v, (int, float)):
        return c.cast("double") == F.lit(float(v))
    return c.cast("string") == F.lit(v)


def _leaf(x: Leaf, f: Fields) -> Column:
    values = list(x.value) if isinstance(x.value, (list, tuple)) else [x.value]
    if x.operator in ("exists", "notExists"):
        r = f.relation(x.field, None)
        c = f.column(x.field)
        found = r if r is not None else F.lit(False) if c is None else c.isNotNull()
        return found if x.operator == "exists" else ~found
    if x.operator == "has":
        hits = []
        for v in values:
            r, c = f.relation(x.field, v), f.column(x.field)
            hits.append(r if r is not None else F.lit(False) if c is None else F.coalesce(F.array_contains(c, F.lit(v)), F.lit(False)))
        return _any(hits)
    if x.operator == "textSearch":
        c = f.column(x.field)
        text = F.lit("") if c is None else F.concat_ws(" ", F.map_values(c)) if f.kind(x.field) == "text" else c
        return F.coalesce(F.size(F.array_except(tokens(F.lit(str(x.value))), tokens(text))) == 0, F.lit(False))
    c = f.column(x.field)
    if c is None:
        return F.lit(x.operator == "!=")
    if x.operator == "distance":
        lon, lat, metres = ([x.value["$lon"], x.value["$lat"], x.value["$radius"]] if isinstance(x.value, dict) else list(x.value)[:3])
        return F.coalesce(haversine(c["lat"], c["lon"], lat, lon) <= metres, F.lit(False))
    if x.operator == "..":
        low, high = (moment(v, f.now_ms) for v in values)
        return F.coalesce(c.between(low, high), F.lit(False))
    if x.operator in "<>":
        m = moment(x.value, f.now_ms)
        return F.coalesce(c > m if x.operator == ">" else c < m, F.lit(False))
    if f.kind(x.field) == "text":
        choices = [c[f.language]] if f.language else []
        one = lambda v: _any([F.coalesce(k == v, F.lit(False)) for k in choices]) if choices else F.exists(F.map_values(c), lambda t: t == v)
        if x.operator == "includes":
            return F.coalesce(choices[0].contains(x.value) if choices else F.exists(F.map_values(c), lambda t: t.contains(x.value)), F.lit(False))
        hit = F.coalesce(_any([one(v) for v in values]), F.lit(False))
        return hit if x.operator == "=" else ~hit
    if x.operator == "includes":
        return F.coalesce(c.contains(x.value), F.lit(False))
    if any(_is_now(v) for v in values):
        hit = _any([c == moment(v, f.now_ms) for v in values])
    else:
        hit = _any([_equal(c, v) for v in values])
    hit = F.coalesce(hit, F.lit(False))
    return hit if x.operator == "=" else ~hit


def _any(parts: list[Column]) -> Column:
    out = parts[0] if parts else F.lit(True)
    for p in parts[1:]:
        out = out | p
    return out


def condition(node, f: Fields) -> Column:
    """The Column of a tree; never null."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Leaf):
        return _leaf(node, f)
    parts = [condition(p, f) for p in node.parts]
    if not parts:
        return F.lit(True)
    if node.any:
        return _any(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def refresh_at(rows: DataFrame, filter_: Any, now_ms: int, fields: Fields | None = None) -> DataFrame:
    """refresh_at: the next time at which a row crosses a bound that moves with now; null if none will.

    Rows must match the other parts of the filter, as only these can enter or leave the result.
    """
    node = tree(filter_)
    moving = [x for x in leaves(node) if isinstance(x.value, str) and _NOW.match(x.value)]
    still = [p for p in node.parts if not any(x in moving for x in leaves(p))]
    f = fields or Fields(lambda p: F.col(p) if p in rows.columns else None, lambda p: None, None, None, now_ms)
    rows = rows.where(condition(Fork(False, still), f))
    cross = []
    for x in moving:
        m = _NOW.match(x.value)
        shift = int(m[2] or 0) * UNITS[m[3] or ""] * (-1 if m[1] == "-" else 1)
        at = f.column(x.field) - shift
        cross.append(F.min(F.when(at > now_ms, at)))
    return rows.agg((F.least(*cross) if len(cross) > 1 else cross[0]).alias("refresh_at"))
