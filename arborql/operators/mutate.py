"""Mutations as snapshot transforms: each returns a new store; nothing is changed in place.

set_nodes takes payloads as a client sends them; their number is bounded by the driver's
memory as they come from there, and only the nodes they name are fetched. update_where,
upsert_rows and delete_nodes are joins and column expressions over any number of rows.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RELATIONS, SchemaError, spark_type
from ..sources.store import EDGES, ROOT, GraphStore
from .tables import materialize

CHANGES = "seq long, op string, id string, type string, changed array<string>, before string, after string"
MAX_UPDATE_FIELDS = 300


@dataclass
class Result:
    store: GraphStore
    ids: list[str | None] = field(default_factory=list)
    #: Rows of the change log, of payloads (as many as the caller sent), or the log itself, of bulk mutations.
    changes: list[tuple] | DataFrame = field(default_factory=list)
    #: By payload: which fields changed and which stayed as they were.
    meta: list[dict] = field(default_factory=list)

    def change_log(self) -> DataFrame:
        return self.changes if isinstance(self.changes, DataFrame) else self.store.spark.createDataFrame(self.changes, CHANGES)


def new_id(store: GraphStore, type_name: str) -> str:
    return store.schema.types[type_name].prefix + uuid.uuid4().hex[:8]


def _plain(v: Any) -> Any:
    return {k: _plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else [_plain(x) for x in v] if isinstance(v, list) else {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def _check(spec: dict, value: Any, path: str) -> Any:
    """The stored form of a plain value, or SchemaError."""
    kind = spec["type"]
    bad = SchemaError(f"{path} takes a {kind}, not {value!r}")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("string", "url", "email", "phone", "id", "type"):
        if not isinstance(value, str) or kind == "email" and not re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", value) or kind == "url" and not re.match(r"\w+://\S+$", value) or kind == "phone" and not re.fullmatch(r"\+?[\d ().-]{5,}", value):
            raise bad
        return value
    if kind == "digest":
        return digest(value)
    if kind == "json":
        return value if isinstance(value, str) else json.dumps(value)
    if kind in ("number", "float"):
        if not number:
            raise bad
        return float(value)
    if kind in ("int", "timestamp"):
        if kind == "timestamp" and value == "now":
            import time

            return int(time.time() * 1000)
        if not number or int(value) != value:
            raise bad
        return int(value)
    if kind == "boolean":
        if not isinstance(value, bool):
            raise bad
        return value
    if kind == "geo":
        return {"lat": float(value["lat"]), "lon": float(value["lon"])}
    if kind == "text":
        if not isinstance(value, dict):
            raise bad
        return value
    if kind == "object":
        if not isinstance(value, dict):
            raise bad
        if extra := set(value) - set(spec.get("properties", {})):
            raise SchemaError(f"unknown fields {sorted(extra)} of {path}")
        return {k: _check(spec["properties"][k], v, f"{path}.{k}") for k, v in value.items()}
    if kind == "record":
        if any("." in k for k in value):
            raise SchemaError(f"keys of {path} can't hold a dot")
        return {k: _check(spec["values"], v, f"{path}.{k}") for k, v in value.items()}
    items = [_check(spec["items"], v, path) for v in (value if isinstance(value, list) else [value])]
    return sorted(set(items)) if kind == "set" else items


def digest(text: str, secret: str = "arborql") -> str:
    import hashlib
    import hmac

    return hmac.new(secret.encode(), text.encode(), hashlib.sha256).hexdigest()


def _apply(spec: dict, old: Any, value: Any, path: str) -> Any:
    """A field's new value after an operation or a plain value."""
    kind = spec["type"]
    if value is None or isinstance(value, dict) and value.get("$delete") is True:
        return None
    ops = {k: v for k, v in value.items() if k.startswith("$")} if isinstance(value, dict) else {}
    if kind in ("object", "text", "record") and isinstance(value, dict):
        merge = ops.get("$merge", True)
        out = dict(old or {}) if merge else {}
        for k, v in value.items():
            if not k.startswith("$"):
                inner = spec.get("properties", {}).get(k) if kind == "object" else spec["values"] if kind == "record" else {"type": "string"}
                if inner is None:
                    raise SchemaError(f"unknown field {path}.{k}")
                new = _apply(inner, out.get(k), v, f"{path}.{k}")
                if new is None:
                    out.pop(k, None)
                else:
                    out[k] = new
        return out
    if "$increment" in ops:
        if kind not in ("int", "number", "float", "timestamp"):
            raise SchemaError(f"{path} can't be incremented")
        return _check(spec, ops["$default"] if old is None and "$default" in ops else (old or 0) + ops["$increment"], path)
    if "$default" in ops:
        return _check(spec, ops["$default"], path) if old is None else old
    if "$value" in ops:
        return _check(spec, ops["$value"], path)
    if kind == "set" and ops:
        add, drop = ops.get("$add", []), ops.get("$delete", [])
        listed = lambda v: v if isinstance(v, list) else [v]
        return sorted((set(old or []) | set(_check(spec, listed(add), path))) - set(listed(drop)))
    if kind == "array" and ops:
        out = list(old or [])
        one = lambda v: _check(spec["items"], v, path)
        if "$push" in ops:
            out += [one(x) for x in (ops["$push"] if isinstance(ops["$push"], list) else [ops["$push"]])]
        if "$unshift" in ops:
            told = ops["$unshift"]
            v, most = (told["$value"], told.get("$maxLen")) if isinstance(told, dict) and "$value" in told else (told, None)
            out = [one(x) for x in (v if isinstance(v, list) else [v])] + out
            out = out[:most] if most is not None else out
        if "$insert" in ops:
            v = ops["$insert"]["$value"]
            out[ops["$insert"]["$idx"] : ops["$insert"]["$idx"]] = [one(x) for x in (v if isinstance(v, list) else [v])]
        if "$assign" in ops:
            i = ops["$assign"]["$idx"]
            out += [None] * (i + 1 - len(out))
            out[i] = _apply(spec["items"], out[i], ops["$assign"]["$value"], path)
        if "$remove" in ops and -len(out) <= ops["$remove"]["$idx"] < len(out):
            out.pop(ops["$remove"]["$idx"])
        return out
    return _check(spec, value, path)


class _Batch:
    """Payloads applied one after another to the nodes they name."""

    def __init__(self, store: GraphStore, now: int, validator=None):
        self.store, self.now, self.validator = store, now, validator
        self.rows: dict[str, dict] = {}
        self.known: set[str] = set()
        self.link_add: dict[tuple[str, str], None] = {}
        self.link_del: set[tuple[str, str]] = set()
        self.clear_parents: set[str] = set()
        self.clear_children: set[str] = set()
        self.edge_add: dict[tuple, dict | None] = {}
        self.edge_del: set[tuple] = set()
        self.edge_clear: set[tuple] = set()
        self.alias_add: dict[str, str] = {}
        self.changes: list[tuple] = []

    def fetch(self, ids: set[str]) -> None:
        """Current rows of the named nodes; only these reach the driver."""
        ids = {i for i in ids if i not in self.known}
        self.known |= ids
        by_type: dict[str, list[str]] = {}
        for i in ids:
            if (t := self.store.schema.type_of(i)) is not None:
                by_type.setdefault(t, []).append(i)
        for t, some in by_type.items():
            if t in self.store.nodes and not _is_empty(self.store.nodes[t]):
                for r in self.store.nodes[t].where(F.col("id").isin(some)).collect():
                    self.rows[r.id] = {k: v for k, v in _plain(r).items() if v is not None}

    def resolve(self, payload: dict) -> tuple[str, str]:
        s = self.store.schema
        alias = payload.get("$alias")
        node_id = payload.get("$id")
        if node_id is None and alias is not None:
            for a in alias if isinstance(alias, list) else [alias]:
                node_id = self.alias_add.get(a) or next((r.node_id for r in self.store.alias_rows().where(F.col("alias") == a).take(1)), None)
                if node_id:
                    break
        t = payload.get("type") or (s.type_of(node_id) if node_id else None)
        if t is None or t not in s.types:
            raise SchemaError(f"no type for {payload}")
        if node_id is None:
            node_id = new_id(self.store, t)
            if alias is not None:
                self.alias_add[alias if isinstance(alias, str) else alias[0]] = node_id
        return node_id, t

    def set(self, payload: dict, parent: str | None = None) -> tuple[str | None, dict]:
        node_id, t = self.resolve(payload)
        self.fetch({node_id})
        old = self.rows.get(node_id)
        how = payload.get("$operation", "upsert")
        if how == "insert" and old is not None or how == "update" and old is None:
            return None, {"changed": [], "unchanged": []}
        created = old is None
        row = {"id": node_id, "type": t, "createdAt": self.now, "updatedAt": self.now} if created else dict(old)
        if not created and payload.get("$merge") is False:
            row = {k: row[k] for k in ("id", "type", "createdAt", "aliases") if k in row}
        fields, changed, same = self.store.schema.types[t].all_fields(), [], []
        related = False
        for k, v in payload.items():
            if k.startswith("$") or k in ("id", "type"):
                continue
            path = k.split(".")
            spec = fields.get(path[0])
            if spec is None:
                raise SchemaError(f"unknown field {k} of {t}")
            if self.validator and not self.validator(self.store.schema, t, path, v):
                raise SchemaError(f"{k} was refused")
            if k in RELATIONS or spec["type"] in ("reference", "references"):
                related |= k in ("parents", "children") and bool(v)
                self.relate(node_id, t, k, spec, v)
                changed.append(k)
                continue
            if len(path) > 1:
                for p in reversed(path[1:]):
                    v = {p: v}
            if spec["type"] == "text" and isinstance(v, str):
                if "$language" not in payload:
                    raise SchemaError(f"{k} needs a $language")
                v = {payload["$language"]: v}
            new = _apply(spec, row.get(path[0]), v, path[0])
            (same if new == row.get(path[0]) else changed).append(k)
            row[path[0]] = new
            if k == "aliases":
                for a in new or []:
                    self.alias_add[a] = node_id
        if created and parent is None and not related and node_id != ROOT and not any(c == node_id for _, c in self.link_add) and not _no_root(payload):
            self.link_add[(ROOT, node_id)] = None
        row = {k: v for k, v in row.items() if v is not None}
        if created or changed:
            row["updatedAt"] = self.now
            before = None if created else json.dumps(old, sort_keys=True, default=str)
            self.changes.append((len(self.changes), "created" if created else "updated", node_id, t, changed, before, json.dumps(row, sort_keys=True, default=str)))
        self.rows[node_id] = row
        return node_id, {"changed": changed, "unchanged": same}

    def relate(self, node_id: str, t: str, name: str, spec: dict, value: Any) -> None:
        ops = {k: v for k, v in value.items() if k.startswith("$")} if isinstance(value, dict) else {}
        listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        plain = isinstance(value, (list, str)) or isinstance(value, dict) and not ({"$add", "$delete", "$value"} & set(ops))
        add = listed(value) if plain else listed(ops.get("$add", ops.get("$value")))
        drop = [] if plain or ops.get("$delete") is True else listed(ops.get("$delete"))
        replaces = plain and spec["type"] != "none" or "$value" in ops or ops.get("$delete") is True
        targets = []
        for x in add:
            targets.append(x if isinstance(x, str) else self.set(x, parent=node_id)[0])
        self.fetch({*targets, *drop})
        for x in targets:  # missing destinations come into being
            if x not in self.rows and x != ROOT and (kind := self.store.schema.type_of(x)):
                self.rows[x] = {"id": x, "type": kind, "createdAt": self.now, "updatedAt": self.now}
                self.changes.append((len(self.changes), "created", x, kind, [], None, json.dumps(self.rows[x])))
                if name != "children" and not any(c == x for _, c in self.link_add):
                    self.link_add[(ROOT, x)] = None
        if name in ("parents", "children"):
            pair = (lambda x: (x, node_id)) if name == "parents" else (lambda x: (node_id, x))
            if replaces:
                (self.clear_parents if name == "parents" else self.clear_children).add(node_id)
                side = 1 if name == "parents" else 0
                self.link_add = {p: None for p in self.link_add if p[side] != node_id}
            for x in targets:
                self.link_add[pair(x)] = None
                self.link_del.discard(pair(x))
            for x in drop:
                self.link_del.add(pair(x))
                self.link_add.pop(pair(x), None)
            return
        if replaces or spec["type"] == "reference":
            self.edge_clear.add((node_id, name))
            self.edge_add = {e: m for e, m in self.edge_add.items() if e[:2] != (node_id, name)}
        told = ops.get("$edgeMeta")
        back = spec.get("bidirectional", {}).get("fromField")
        for x in targets:
            self.edge_add[(node_id, name, x)] = self.edge_meta(node_id, name, x, told)
            if back:
                kind = self.store.schema.types[self.store.schema.type_of(x)].fields.get(back, {}).get("type")
                if kind == "reference":
                    self.edge_clear.add((x, back))
                self.edge_add[(x, back, node_id)] = None
        for x in drop:
            for e in ((node_id, name, x), (x, back, node_id)) if back else ((node_id, name, x),):
                self.edge_del.add(e)
                self.edge_add.pop(e, None)

    def edge_meta(self, src: str, name: str, dst: str, told: dict | None) -> dict | None:
        """An edge's metadata after operations on it: values, {$default}, {$increment}, {$delete: true}; {$delete: true} as a whole clears it."""
        if told is None:
            return self.edge_add.get((src, name, dst))
        if told.get("$delete") is True:
            return None
        old = self.edge_add.get((src, name, dst))
        if old is None and any(isinstance(v, dict) for v in told.values()) or told.get("$merge"):
            head, _, key = name.partition(".")
            same = (F.col("src") == src) & (F.col("dst") == dst) & (F.col("key").eqNullSafe(F.lit(key or None)))
            old = old or next((dict(r.meta) for r in self.store.edge_rows(head).where(same).take(1) if r.meta), None)
        out = dict(old or {}) if old and (told.get("$merge") or any(isinstance(v, dict) for v in told.values())) else {}
        for k, v in told.items():
            if k.startswith("$"):
                continue
            if isinstance(v, dict):
                if v.get("$delete") is True:
                    out.pop(k, None)
                    continue
                if "$increment" in v:
                    v = v.get("$default", v["$increment"]) if k not in out else (float(out[k]) if "." in out[k] or isinstance(v["$increment"], float) else int(out[k])) + v["$increment"]
                elif "$default" in v:
                    v = out.get(k, v["$default"])
            out[k] = None if v is None else str(v)
        return out

    def done(self) -> GraphStore:
        store, spark = self.store, self.store.spark
        touched: dict[str, list[dict]] = {}
        for r in self.rows.values():
            touched.setdefault(r["type"], []).append(r)
        nodes = dict(store.nodes)
        for t, rows in touched.items():
            kind = store.schema.types[t].struct()
            new = spark.createDataFrame([tuple(_typed(r.get(f.name), f.dataType) for f in kind.fields) for r in rows], kind)
            old = nodes.get(t)
            nodes[t] = new if old is None or _is_empty(old) or t == "root" and len(rows) == 1 else old.where(~F.col("id").isin([r["id"] for r in rows])).unionByName(new, allowMissingColumns=True)
        store = store.with_(nodes=nodes)
        if self.link_add or self.link_del or self.clear_parents or self.clear_children:
            links = store.hierarchy()
            if self.clear_parents or self.clear_children:
                links = links.where(~F.col("child").isin(sorted(self.clear_parents)) & ~F.col("parent").isin(sorted(self.clear_children)))
            if self.link_del:
                links = links.join(F.broadcast(spark.createDataFrame(sorted(self.link_del), "parent string, child string")), ["parent", "child"], "left_anti")
            if self.link_add:
                links = links.unionByName(spark.createDataFrame(list(self.link_add), "parent string, child string"))
            store = store.with_links(links)
        if self.edge_add or self.edge_del or self.edge_clear:
            rows = store.edge_rows()
            gone = sorted({(s, f) for s, f in self.edge_clear})
            if gone:
                rows = rows.join(F.broadcast(spark.createDataFrame(gone, "src string, field string")), ["src", "field"], "left_anti")
            named = sorted({*self.edge_del, *self.edge_add})
            rows = rows.join(F.broadcast(spark.createDataFrame(named, "src string, field string, dst string")), ["src", "field", "dst"], "left_anti").select("src", "field", "key", "dst", "meta")
            new = [(s, f.partition(".")[0], f.partition(".")[2] or None, d, m) for (s, f, d), m in self.edge_add.items()]
            store = store.with_edges(rows.unionByName(spark.createDataFrame(new, EDGES)))
        if self.alias_add:
            rows = store.alias_rows().where(~F.col("alias").isin(list(self.alias_add)))
            store = store.with_(aliases=rows.unionByName(spark.createDataFrame(list(self.alias_add.items()), "alias string, node_id string")))
        return store


def _no_root(payload: dict) -> bool:
    p = payload.get("parents")
    return isinstance(p, dict) and bool(p.get("$noRoot"))


def _is_empty(df: DataFrame) -> bool:
    return type(df) is not None and df._jdf.queryExecution().optimizedPlan().maxRows().toString() == "Some(0)"


def _typed(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_typed(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {k: _typed(x, kind.valueType) for k, x in v.items()}
    return float(v) if isinstance(kind, T.DoubleType) else v


def set_all(store: GraphStore, payloads: list[dict], now: int = 0, validator=None) -> Result:
    """Applies payloads in order: ids, change log and what changed."""
    batch = _Batch(store, now, validator)
    batch.fetch({p["$id"] for p in payloads if "$id" in p})
    done = [batch.set(p) for p in payloads]
    return Result(batch.done(), [d[0] for d in done], batch.changes, [d[1] for d in done])


def set_nodes(store: GraphStore, payloads: list[dict], now: int = 0) -> GraphStore:
    return set_all(store, payloads, now).store


# bulk


def upsert_rows(old: DataFrame, new: DataFrame, operation: str = "upsert", now: int = 0) -> DataFrame:
    """Nodes of one type after a bulk write of rows (id and some fields), with op: created, updated, same or kept.

    insert leaves existing nodes alone, update makes no new ones. Null fields of new rows change nothing.
    """
    fields = [c for c in new.columns if c not in ("id", "type")]
    n = new.select("id", *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("is_new"))
    o = old.withColumn("is_old", F.lit(True))
    both = o.join(n, "id", {"insert": "full", "upsert": "full", "update": "left"}[operation])
    use = F.col("is_new").isNotNull() & (F.col("is_old").isNull() if operation == "insert" else F.lit(True))
    differs = F.lit(False)
    for c in fields:
        differs = differs | (F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)))
    op = F.when(~use, "kept").when(F.col("is_old").isNull(), "created").when(differs, "updated").otherwise("same")
    out = both.withColumn("op", op)
    cols = [F.when(use, F.coalesce(F.col(f"new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns if c not in ("createdAt", "updatedAt")]
    times = [F.when(F.col("op") == "created", now).otherwise(F.col("createdAt")).alias("createdAt"), F.when(F.col("op").isin("created", "updated"), now).otherwise(F.col("updatedAt")).alias("updatedAt")] if "createdAt" in old.columns else []
    return out.select(*cols, *times, "op")


def increment(column: str, by: float, default: float | None = None) -> Column:
    """A field raised by a number, or set to the default where it is missing."""
    c = F.col(column)
    return F.when(c.isNull(), F.lit(by if default is None else default)).otherwise(c + by)


def column_of(spec: dict, old: Column, value: Any, path: str) -> Column:
    """The Column of a field after an operation or a plain value: what set does to one node, for all rows at once."""
    kind = spark_type(spec)
    typed = lambda v: F.lit(None).cast(kind) if v is None else _constant(_typed(_check(spec, v, path), kind), kind)
    if isinstance(value, Column):
        return value.cast(kind)
    ops = {k: v for k, v in value.items() if k.startswith("$")} if isinstance(value, dict) else {}
    listed = lambda v: list(v) if isinstance(v, (list, tuple)) else [v]
    items = lambda v: typed(listed(v))
    if value is None or ops.get("$delete") is True:
        return F.lit(None).cast(kind)
    if "$increment" in ops:
        if spec["type"] not in ("int", "number", "float", "timestamp"):
            raise SchemaError(f"{path} can't be incremented")
        _check(spec, ops["$increment"], path)
        return F.when(old.isNull(), typed(ops.get("$default", ops["$increment"]))).otherwise(old + _constant(_typed(ops["$increment"], kind), kind))
    if "$default" in ops:
        return F.coalesce(old, typed(ops["$default"]))
    if "$value" in ops:
        return typed(ops["$value"])
    if spec["type"] == "set" and ops:
        have = F.coalesce(old, F.array().cast(kind))
        return F.array_sort(F.array_except(F.array_union(have, items(ops.get("$add", []))), items(ops.get("$delete", []))))
    if spec["type"] == "array" and ops:
        out = F.coalesce(old, F.array().cast(kind))
        if "$push" in ops:
            out = F.concat(out, items(ops["$push"]))
        if "$unshift" in ops:
            told = ops["$unshift"]
            v, most = (told["$value"], told.get("$maxLen")) if isinstance(told, dict) and "$value" in told else (told, None)
            out = F.concat(items(v), out)
            out = F.slice(out, 1, most) if most is not None else out
        if "$insert" in ops:
            at = ops["$insert"]["$idx"]
            cut = F.lit(at) if at >= 0 else F.greatest(F.size(out) + at, F.lit(0))
            out = F.concat(F.slice(out, F.lit(1), cut), items(ops["$insert"]["$value"]), F.slice(out, cut + 1, F.greatest(F.size(out) - cut, F.lit(0))))
        if "$assign" in ops or "$remove" in ops:
            at = ops["$assign" if "$assign" in ops else "$remove"]["$idx"]
            place = F.lit(at) if at >= 0 else F.size(out) + at
            if "$remove" in ops:
                out = F.filter(out, lambda _, i: i != place)
            else:
                new = _constant(_typed(_check(spec["items"], ops["$assign"]["$value"], path), kind.elementType), kind.elementType)
                longer = F.concat(out, F.array_repeat(F.lit(None).cast(kind.elementType), F.greatest(place + 1 - F.size(out), F.lit(0))))
                out = F.transform(longer, lambda x, i: F.when(i == place, new).otherwise(x))
        return out
    if spec["type"] == "object" and isinstance(value, dict):
        if extra := {k for k in value if not k.startswith("$")} - set(spec.get("properties", {})):
            raise SchemaError(f"unknown fields {sorted(extra)} of {path}")
        keep = ops.get("$merge", True)
        member = lambda k, t: column_of(spec["properties"][k], old[k] if keep else F.lit(None).cast(t), value[k], f"{path}.{k}") if k in value else old[k] if keep else F.lit(None).cast(t)
        return F.struct(*(member(f.name, f.dataType).alias(f.name) for f in kind.fields))
    if spec["type"] in ("text", "record") and isinstance(value, dict):
        inner = spec["values"] if spec["type"] == "record" else {"type": "string"}
        told = {k: v for k, v in value.items() if not k.startswith("$")}
        base = F.coalesce(old, F.create_map().cast(kind)) if ops.get("$merge", True) else F.create_map().cast(kind)
        rest = F.map_filter(base, lambda k, _: ~k.isin(list(told))) if told else base
        new = {k: column_of(inner, base[k], v, f"{path}.{k}") for k, v in told.items()}
        both = F.map_concat(rest, F.create_map(*(x for k, c in new.items() for x in (F.lit(k), c)))) if new else rest
        return F.map_filter(both, lambda _, v: v.isNotNull())
    return typed(value)


def _constant(v: Any, kind: T.DataType) -> Column:
    if v is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(_constant(x, f.dataType).alias(f.name) for x, f in zip(v, kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.array(*(_constant(x, kind.elementType) for x in v)).cast(kind) if v else F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*(y for k, x in v.items() for y in (F.lit(k), _constant(x, kind.valueType)))).cast(kind)
    return F.lit(v).cast(kind)


def update_where(store: GraphStore, type_name: str, where: Column | DataFrame, values: dict[str, Any], now: int | None = None) -> tuple[GraphStore, DataFrame]:
    """Sets fields of all nodes of a type that match: a condition (one pass over the table, no shuffle), or ids (a join).

    values are plain values, operations or Columns. Returns the store and the change log:
    only rows in which a value differs are changes, and only these get the time.
    """
    if len(values) > MAX_UPDATE_FIELDS:
        raise ValueError("too many fields")
    df, fields = store.nodes[type_name], store.schema.types[type_name].all_fields()
    for k in values:
        if k not in fields or k in ("id", "type", "createdAt", "updatedAt"):
            raise SchemaError(f"{k} of {type_name} can't be updated")
        if fields[k]["type"] in ("reference", "references") or k in RELATIONS:
            raise SchemaError(f"{k}: relations can't be updated in bulk")
    rows = df
    for k in values:
        if k not in df.columns:
            rows = rows.withColumn(k, F.lit(None).cast(spark_type(fields[k])))
    columns = rows.columns
    if isinstance(where, DataFrame):
        hit = where.select("id").distinct().withColumn("_hit", F.lit(True))
        rows = rows.join(hit, "id", "left").select(*columns, F.coalesce("_hit", F.lit(False)).alias("_hit"))
    else:
        rows = rows.withColumn("_hit", F.coalesce(where, F.lit(False)))
    new = {k: column_of(fields[k], F.col(k), v, k).cast(rows.schema[k].dataType.simpleString()) for k, v in values.items()}
    plain = lambda c, kind: F.to_json(c) if "map<" in kind.simpleString() else c  # noqa: E731  # maps can't be compared
    differs = {k: F.col("_hit") & ~plain(F.col(k), rows.schema[k].dataType).eqNullSafe(plain(c, rows.schema[k].dataType)) for k, c in new.items()}
    touched = rows.withColumn("_changed", F.array_compact(F.array(*(F.when(d, k) for k, d in differs.items()))))
    out = {c: F.when(F.array_contains("_changed", c), new[c]).otherwise(F.col(c)) if c in new else F.col(c) for c in columns}
    if now is not None and "updatedAt" in out:
        out["updatedAt"] = F.when(F.size("_changed") > 0, F.lit(now)).otherwise(F.col("updatedAt")).cast(df.schema["updatedAt"].dataType)
    after = F.to_json(F.struct(*(c.alias(k) for k, c in out.items())))
    log = touched.where(F.size("_changed") > 0).select(F.monotonically_increasing_id().alias("seq"), F.lit("updated").alias("op"), "id", F.lit(type_name).alias("type"), F.col("_changed").alias("changed"), F.to_json(F.struct(*columns)).alias("before"), after.alias("after"))
    return store.with_(nodes={**store.nodes, type_name: touched.select(*(c.alias(k) for k, c in out.items()))}), log


def deletion(store: GraphStore, ids: DataFrame, recursive: bool = False) -> DataFrame:
    """The ids that go when some nodes are deleted: children follow if no other parent, and no edge, still holds them.

    A fixpoint of anti-joins; with recursive children follow in any case.
    """
    links = store.hierarchy()
    held = store.edge_rows().select("src", F.col("dst").alias("id"))
    gone = materialize(ids.select("id").distinct())
    frontier = gone
    while True:
        children = links.join(frontier.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct().join(gone, "id", "left_anti")
        if not recursive:
            others = links.join(gone.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("child").alias("id"))
            edges = held.join(gone.select(F.col("id").alias("src")), "src", "left_anti").select("id")
            children = children.join(others, "id", "left_anti").join(edges, "id", "left_anti")
        frontier = materialize(children)
        if frontier.isEmpty():
            return gone
        gone = materialize(gone.unionByName(frontier))


def delete_nodes(store: GraphStore, ids: list[str], recursive: bool = False) -> tuple[GraphStore, DataFrame]:
    """The store without some nodes and those that go with them, and the change log. Deleting the root empties the store."""
    if ROOT in ids:
        gone = store.node_rows(needed=set()).where(F.col("id") != ROOT).select("id")
        return GraphStore.empty(store.spark, store.schema), deletion_log(store, gone)
    gone = deletion(store, store.spark.createDataFrame([(i,) for i in ids], "id string"), recursive)
    without = lambda df, c: df.join(gone.select(F.col("id").alias(c)), c, "left_anti").select(*df.columns)
    nodes = {t: without(df, "id") for t, df in store.nodes.items()}
    links = {k: without(without(df, "parent"), "child") for k, df in store.links.items()}
    edges = {k: without(without(df, "src"), "dst") for k, df in store.edges.items()}
    return store.with_(nodes=nodes, links=links, edges=edges, aliases=without(store.alias_rows(), "node_id")), deletion_log(store, gone)


def deletion_log(store: GraphStore, gone: DataFrame) -> DataFrame:
    """The change log of the nodes that were there and go, with their last state."""
    parts = []
    for t, df in store.nodes.items():
        if t != "root":
            last = df.join(gone.select("id"), "id", "left_semi")
            parts.append(last.select(F.monotonically_increasing_id().alias("seq"), F.lit("deleted").alias("op"), "id", F.lit(t).alias("type"), F.array().cast("array<string>").alias("changed"), F.to_json(F.struct(*df.columns)).alias("before"), F.lit(None).cast("string").alias("after")))
    out = parts[0] if parts else store.spark.createDataFrame([], CHANGES)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def convert_field(store: GraphStore, type_name: str, field_name: str, spec: dict) -> GraphStore:
    """A schema mutation: the field in its new type, null where a value can't be converted."""
    df, kind = store.nodes[type_name], spark_type(spec)
    cols = [F.expr(f"try_cast(`{c}` as {kind.simpleString()})").alias(c) if c == field_name and kind is not None else F.col(c) for c in df.columns if c != field_name or kind is not None]
    return store.with_(nodes={**store.nodes, type_name: df.select(*cols)})
