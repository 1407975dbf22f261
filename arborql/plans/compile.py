"""Nested JSON queries compiled to one DataFrame plan.

Every level is a set of rows with a node id (nid); a nested list or aggregate becomes a
grouped join keyed by the distinct ids of the level above, never a query for each row.
"""

from __future__ import annotations

import json
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import Fields, condition, leaves, refresh_at, tree, types_of
from ..operators import aggregate as agg
from ..operators import inherit as inh
from ..operators import order
from ..operators import traverse as tr
from ..sources.store import ROOT, GraphStore

RELATIONS = ("children", "parents", "descendants", "ancestors")
SPECIAL = {"$id", "$alias", "$db", "$language", "$all", "$list", "$find", "$aggregate", "$field", "$default", "$inherit", "$value", "$flatten", "$fieldsByType", "$raw", "$includeMeta", "$rawAncestors", "$version", "$trigger"}
LIST_KEYS, FIND_KEYS = {"$find", "$sort", "$limit", "$offset", "$inherit", "$field"}, {"$traverse", "$filter", "$find", "$recursive", "$db", "$edgeFilter"}
AGGREGATE_KEYS = {"$function", "$traverse", "$filter", "$sort", "$limit", "$offset", "$find", "$db", "$recursive"}


class QueryError(ValueError):
    """A query isn't well formed."""


def literal(v: Any) -> Column:
    """A constant: objects become structs, lists arrays; members of different kinds become strings."""
    if isinstance(v, dict):
        return F.struct(*(literal(x).alias(k) for k, x in v.items())) if v else F.create_map().cast("map<string,string>")
    if isinstance(v, (list, tuple)):
        if not v:
            return F.array().cast("array<string>")
        if all(isinstance(x, dict) for x in v):
            keys = list(dict.fromkeys(k for x in v for k in x))
            return F.array(*(F.struct(*(literal(x.get(k)).alias(k) for k in keys)) for x in v))
        kinds = {type(x) for x in v if x is not None}
        if len(kinds) > 1 and not kinds <= {int, float}:
            return F.array(*(F.lit(None if x is None else x if isinstance(x, str) else json.dumps(x)) for x in v))
        return F.array(*(literal(float(x) if float in kinds and isinstance(x, int) else x) for x in v))
    return F.lit(v)


def nest(spec: dict) -> dict:
    """The query with dotted keys as nested objects, as its result is nested; a key with an index stays as it is."""
    out: dict = {}
    for k, v in spec.items():
        head, _, rest = k.partition(".")
        if not rest or k.startswith(("$", "!")) or "[" in k:
            out[k] = {**out[k], **v} if isinstance(out.get(k), dict) and isinstance(v, dict) else v
        elif out.get(head) is not True:
            deeper = nest({rest: v})
            old = out.get(head)
            out[head] = _merged(old, deeper) if isinstance(old, dict) else deeper
    return out


def _merged(a: dict, b: dict) -> dict:
    return {**a, **{k: _merged(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}}


def validate(spec: Any, where: str = "") -> None:
    """Checks the operators of a query, at every level."""
    if isinstance(spec, list):
        for x in spec:
            validate(x, where)
        return
    if not isinstance(spec, dict):
        return
    for k, v in spec.items():
        if k.startswith("$") and k not in SPECIAL:
            raise QueryError(f"unknown operator {k} {where}")
        if k == "$list" and isinstance(v, dict) and (extra := set(v) - LIST_KEYS):
            raise QueryError(f"unknown keys of $list {sorted(extra)}")
        if k == "$list" and isinstance(v, dict) and isinstance(v.get("$inherit"), dict) and {"$merge", "$deepMerge"} & set(v["$inherit"]):
            raise QueryError("a list can't be merged, nor a merge limited")
        if k == "$inherit" and isinstance(v, dict):
            if extra := set(v) - {"$type", "$item", "$required", "$merge", "$deepMerge"}:
                raise QueryError(f"unknown keys of $inherit {sorted(extra)}")
        if k == "$aggregate":
            told = v if isinstance(v, dict) else {"$function": v}
            if extra := set(told) - AGGREGATE_KEYS:
                raise QueryError(f"unknown keys of $aggregate {sorted(extra)}")
        find = v.get("$find") if k in ("$list", "$aggregate") and isinstance(v, dict) else v if k == "$find" else None
        while isinstance(find, dict):
            if extra := set(find) - FIND_KEYS:
                raise QueryError(f"unknown keys of $find {sorted(extra)}")
            find = find.get("$find")
        sort = v.get("$sort") if isinstance(v, dict) else None
        for s in sort if isinstance(sort, list) else [sort] if sort else []:
            if "$field" not in s or s.get("$order", "asc") not in ("asc", "desc"):
                raise QueryError(f"bad $sort {s}")
        if not k.startswith("$"):
            validate(v, f"at {where}.{k}")


def walk(c: Column, kind: T.DataType, parts: list[str]) -> tuple[Column | None, T.DataType | None]:
    """The column and type at a path below a column: members, keys, [n] from either end, and * for all keys of a record."""
    for n, p in enumerate(parts):
        if p.startswith("[") and isinstance(kind, T.ArrayType):
            i = int(p[1:-1])
            c, kind = F.get(c, i) if i >= 0 else F.try_element_at(c, F.lit(i)), kind.elementType
        elif isinstance(kind, T.StructType) and p in kind.names:
            c, kind = c[p], kind[p].dataType
        elif isinstance(kind, T.MapType) and p == "*":
            return _each_key(c, kind.valueType, parts[n + 1 :])
        elif isinstance(kind, T.MapType):
            c, kind = c[p], kind.valueType
        else:
            return None, None
    return c, kind


def _each_key(c: Column, kind: T.DataType, rest: list[str]) -> tuple[Column, T.DataType]:
    """The record with the rest of the path taken in each of its values."""
    found: list[T.DataType | None] = []

    def below(_: Column, v: Column) -> Column:
        x, k = walk(v, kind, rest)
        found.append(k)
        return F.lit(None).cast("string") if x is None else x

    out = F.transform_values(c, below)
    return out, T.MapType(T.StringType(), found[0] or T.StringType())


class Compiler:
    def __init__(self, store: GraphStore, language: str | None = None, now_ms: int | None = None, compat: bool = False, others: dict[str, GraphStore] | None = None):
        self.store, self.language, self.now_ms, self.compat, self.others = store, language, now_ms, compat, others or {}
        self.number = count()

    def name(self) -> str:
        return f"_c{next(self.number)}"

    # filters

    def paths_of(self, node, field: str) -> str:
        return field.split(".")[0].split("[")[0]

    def filtered(self, rows: DataFrame, told: Any, types: set[str] | None) -> DataFrame:
        """rows (id and node columns) that match; relations are joined in as flags."""
        node = tree(told, self.compat) if told else None
        if node is None:
            return rows
        flags: dict[tuple[str, Any], str] = {}
        base = rows.columns
        for leaf in leaves(node):
            values = leaf.value if isinstance(leaf.value, (list, tuple)) else [leaf.value]
            for v in values if leaf.operator == "has" else [None] if leaf.operator in ("exists", "notExists") else []:
                if (leaf.field, v) not in flags and (ids := self.related(leaf.field, v, types)) is not None:
                    flags[leaf.field, v] = n = self.name()
                    rows = rows.join(ids.select("id").distinct().withColumn(n, F.lit(True)), "id", "left")
        fields = Fields(lambda p: self.path(rows, p), self.kind, lambda f, v: F.coalesce(F.col(flags[f, v]), F.lit(False)) if (f, v) in flags else None, self.language, self.now_ms)
        return rows.where(condition(node, fields)).select(*base)

    def related(self, field: str, value: Any, types: set[str] | None = None) -> DataFrame | None:
        """Ids of nodes (of some types) whose set-like field holds value (any value, if None). A node is among its own ancestors and descendants here."""
        s = self.store
        if field not in RELATIONS and not any(f == field for _, f, _ in s.edges) and s.schema.relation_kind(field) is None:
            return None
        if field in ("children", "parents"):
            own, other = ("parent", "child") if field == "children" else ("child", "parent")
            rows = s.hierarchy()
            return (rows if value is None else rows.where(F.col(other) == value)).select(F.col(own).alias("id"))
        if field in ("ancestors", "descendants"):
            if value is None:
                return self.related("parents" if field == "ancestors" else "children", None)
            go = tr.descendants if field == "ancestors" else tr.ancestors
            return go(s, tr.starts(s, [value]), tr.start_types(s, [value]), types, include_head=True).select("id")
        rows = s.edge_rows(field, types)
        return (rows if value is None else rows.where(F.col("dst") == value)).select(F.col("src").alias("id"))

    def kind(self, path: str) -> str | None:
        for t in self.store.types:
            if t in self.store.schema.types and (f := self.store.schema.lookup(t, path)):
                return f["type"]
        return None

    def path(self, rows: DataFrame, path: str) -> Column | None:
        """The column of a dot path over structs, maps and arrays; None if no node has it."""
        head, *rest = path.replace("[", ".[").split(".")
        if head not in rows.columns:
            return None
        if rest and self.kind(head) == "json":
            return F.get_json_object(head, "$." + ".".join(rest).replace(".[", "["))
        return walk(F.col(head), rows.schema[head].dataType, rest)[0]

    # finding

    def hop(self, starts: DataFrame, types: set[str] | None, find: dict, targets: set[str] | None, paths: bool, head: bool = False) -> DataFrame:
        """One $find step: (start_id, id, depth, path?) from (start_id, id); with head the start comes first."""
        if head:
            begin = starts.select("start_id", "id", F.lit(0).alias("depth"), *([F.array("id").alias("path")] if paths else []))
            if targets is not None:  # a start of another type doesn't count
                begin = begin.join(self.store.node_rows(targets, set()).select("id"), "id", "left_semi").select(begin.columns)
            found = self.hop(starts, types, find, targets, paths).select(begin.columns)
            return begin.unionByName(found.where("start_id <> id"))
        s, via = self.store, find.get("$traverse", "descendants")
        recursive = find.get("$recursive", False)
        if isinstance(via, dict) and "$db" in via:
            return self.pathed(self.existing(starts, self.listed_ids(via), targets), paths)
        if via == "node":
            return self.pathed(starts.select("start_id", "id", F.lit(0).alias("depth")), paths)
        if isinstance(via, str) and via in ("descendants", "ancestors"):
            return tr.descendants(s, starts, types, targets, each_once=True, paths=paths) if via == "descendants" else tr.ancestors(s, starts, types, targets, paths=paths)
        if isinstance(via, list):
            known = [v for v in via if s.schema.type_of(v) and not any(v == f for _, f, _ in s.edges) and v not in RELATIONS]
            if len(known) == len(via):  # an explicit list of ids
                ids = s.spark.createDataFrame([(i, p) for p, i in enumerate(via)], "id string, depth int")
                return self.pathed(self.existing(starts, ids, targets), paths)
            via = {"$any": {"$first": via}}
        if isinstance(via, str):
            kind = "children" if via == "children" else "parents" if via == "parents" else None
            if recursive:
                return tr.bfs(s, starts, tr.field_hops(s, via), types, targets, paths=paths)
            hops = tr.field_hops(s, via)
            found = tr.one_hop(starts, hops, targets, types)
            return self.pathed(found if kind else found.dropDuplicates(["start_id", "id"]), paths)
        where = (lambda e: F.expr(find["$edgeFilter"])) if "$edgeFilter" in find else None
        if recursive:
            return tr.bfs_expression(s, starts, via, types, targets, where, paths=paths)
        return self.pathed(tr.by_expression(s, starts, via, types, targets, where), paths)

    def existing(self, starts: DataFrame, ids: DataFrame, targets: set[str] | None) -> DataFrame:
        """start_id, id, depth: for each start the listed ids (id, depth) that are nodes. The list is broadcast, so that no node is shuffled."""
        there = self.store.node_rows(targets, set()).select("id").join(F.broadcast(ids), "id")
        return starts.select("start_id").crossJoin(F.broadcast(there)).select("start_id", "id", "depth")

    def listed_types(self, via: Any) -> set[str] | None:
        """The types that listed ids can have, told by the ids or by the edge field that lists them; None if unknown, or if via lists no ids."""
        s = self.store
        if isinstance(via, list) and via and all(s.schema.type_of(v) and v not in RELATIONS and not any(v == f for _, f, _ in s.edges) for v in via):
            return {s.schema.type_of(v) for v in via} & set(s.types)
        if isinstance(via, dict) and "$db" in via and isinstance(via.get("$field"), str):
            other = self.others.get(via["$db"], s)
            plain = any(via["$field"] in df.columns for df in other.nodes.values()) or via["$field"] in RELATIONS
            led = {b for (_, f, b) in other.edges if f == via["$field"]}
            return led & set(s.types) if led and not plain and other.schema.prefixes == s.schema.prefixes else None
        return None

    def listed_ids(self, via: dict) -> DataFrame:
        """id, depth (place): the ids that a field of one node, maybe of another database, lists. One node's list: bounded."""
        if "$id" not in via or "$field" not in via:
            raise QueryError("$traverse over a database needs $id and $field")
        other = Compiler(self.others[via["$db"]], self.language, self.now_ms, self.compat, self.others) if via["$db"] in self.others else self
        found = other.get({"$id": via["$id"], "ids": {"$field": via["$field"]}})
        ids = found.select("ids") if isinstance(found.schema["ids"].dataType, T.ArrayType) else found.select(F.array("ids").alias("ids"))
        return ids.select(F.posexplode("ids").alias("depth", "id")).where("id is not null").select("id", "depth")

    @staticmethod
    def pathed(rows: DataFrame, paths: bool) -> DataFrame:
        return rows.withColumn("path", F.array("start_id", "id")) if paths else rows

    def found(self, starts: DataFrame, types: set[str] | None, find: dict, needed: set[str] | None = None, paths: bool = False, head: bool = False) -> tuple[DataFrame, set[str] | None]:
        """Nodes of a $find pipeline with the needed columns: start_id, id, depth, ... . Types prune the tables to read."""
        inner, told = find.get("$find"), find.get("$filter")
        node = tree(told, self.compat) if told else None
        limit = types_of(node, set(self.store.types)) if node is not None else None
        names = {self.paths_of(None, x.field) for x in leaves(node)} | {"type"}
        want = names if inner else None if needed is None else names | needed
        via = find.get("$traverse", "descendants")
        if (kinds := self.listed_types(via)) is not None:
            limit = kinds if limit is None else limit & kinds
        rows = self.hop(starts, types, find, limit, paths, head and not inner)
        nodes = self.store.node_rows(limit, want)
        if (kinds is not None or isinstance(via, dict) and "$db" in via) and tr.few(starts):
            rows = F.broadcast(rows)  # one list of ids, for few starts
        rows = self.filtered(rows.join(nodes, "id"), told, limit)
        if inner:
            # The next step starts from what was found; each start of the whole pipeline keeps its results.
            mid = rows.select(F.col("start_id").alias("origin"), F.col("id").alias("start_id"))
            step, out_types = self.found(mid.select("start_id", F.col("start_id").alias("id")).distinct(), limit, inner, needed, paths, head)
            back = mid.join(step, "start_id").drop("start_id").withColumnRenamed("origin", "start_id")
            return back, out_types
        return rows, limit

    # projection

    def get(self, query: dict) -> DataFrame:
        """One row (or none, if the node doesn't exist): the columns of the query."""
        validate(query)
        language = query.get("$language")
        if language:
            return Compiler(self.store, language, self.now_ms, self.compat, self.others).get({k: v for k, v in query.items() if k != "$language"})
        rows, types = self.start(query)
        rows, out = self.project(rows, query, types)
        return rows.select(*(c.alias(k) for k, c in out.items())) if out else rows.select(F.col("nid").alias("id")).limit(1)

    def each(self, ids: DataFrame, types: set[str] | None, query: dict) -> DataFrame:
        """A row for each listed node (id, _cseq) that matches the query's $filter, in the order of _cseq: one plan for all."""
        language = query.get("$language", self.language)
        if language != self.language:
            return Compiler(self.store, language, self.now_ms, self.compat, self.others).each(ids, types, query)
        rows = self.store.node_rows(types).join(ids, "id")
        rows = self.filtered(rows, query.get("$filter"), types).withColumn("nid", F.col("id"))
        rows, out = self.project(rows, {k: v for k, v in query.items() if k not in ("$filter", "$language", "$id", "$db")} or {"id": True}, types)
        return rows.orderBy("_cseq").select(*(c.alias(k) for k, c in out.items()))

    def next_refresh(self, query: dict) -> int | None:
        """When a filter that moves with now will next change the result, with nothing written; null if never."""
        if '"now' not in json.dumps(query, default=str):
            return None
        rows, types = self.start(query)
        times = [t for df in self._moments(rows, query, types) if (t := df.first().refresh_at) is not None]
        return min(times) if times else None

    def _moments(self, rows: DataFrame, spec: dict, types: set[str] | None) -> list[DataFrame]:
        out: list[DataFrame] = []
        for k, v in spec.items():
            if k.startswith("$") or not isinstance(v, dict) or '"now' not in json.dumps(v, default=str):
                continue
            told = next((v[x] for x in ("$list", "$aggregate") if isinstance(v.get(x), dict)), v)
            find = told.get("$find") or ({x: told[x] for x in ("$traverse", "$filter", "$recursive") if x in told} if "$filter" in told else None)
            at, kinds = rows, types
            while find:
                start = at.select(F.col("nid").alias("start_id"), F.col("nid").alias("id")).distinct()
                asked = find.get("$filter", [])
                asked = asked if isinstance(asked, list) else [asked]
                still = [x for x in asked if '"now' not in json.dumps(x, default=str)]
                step = {**{x: y for x, y in find.items() if x not in ("$find", "$filter")}, **({"$filter": still} if still else {})}
                if len(still) < len(asked):
                    names = {self.paths_of(None, x.field) for x in leaves(tree(asked))}
                    near, _ = self.found(start, kinds, step, names)
                    out.append(refresh_at(near, asked, self.now_ms, Fields(lambda p, near=near: self.path(near, p), self.kind, None, self.language, self.now_ms)))
                found, kinds = self.found(start, kinds, {**step, **({"$filter": asked} if asked else {})}, set())
                at, find = found.select(F.col("id").alias("nid")).distinct(), find.get("$find")
            deeper = {x: y for x, y in v.items() if not x.startswith("$")}
            out += self._moments(at if told is not v or "$find" in v else rows, deeper, kinds)
        return out

    def start(self, query: dict) -> tuple[DataFrame, set[str] | None]:
        """The queried node as one row: the first id, or alias, that exists."""
        s = self.store
        ids = query.get("$id", None)
        alias = query.get("$alias")
        if ids is None and alias is None:
            ids = ROOT
        names = [x for x in ([*ids] if isinstance(ids, list) else [ids] if ids else [])]
        tried = [x for x in ([*alias] if isinstance(alias, list) else [alias] if alias else [])]
        listed = s.spark.createDataFrame([(n, i) for i, n in enumerate([*names, *tried])], "_name string, _ord int")
        types = {s.schema.type_of(n) or "?" for n in names} if not tried else None
        types = types & set(s.types) if types is not None else None
        nodes = s.node_rows(types)
        if not tried:  # by the source's own keys
            nodes = s.find(names)
        found = nodes.join(F.broadcast(listed), nodes.id == F.col("_name"))
        if tried:
            via = s.alias_rows().join(F.broadcast(listed), F.col("alias") == F.col("_name")).select("node_id", "_name", "_ord")
            found = found.unionByName(nodes.join(via, nodes.id == via.node_id).select(*nodes.columns, "_name", "_ord"))
        row = found.orderBy("_ord", "id").limit(1).drop("_name", "_ord")
        return row.withColumn("nid", F.col("id")), types

    def project(self, rows: DataFrame, spec: dict, types: set[str] | None) -> tuple[DataFrame, dict[str, Column]]:
        """rows (nid and node columns) with what the spec needs joined in, and the output columns."""
        spec = nest(spec)
        out: dict[str, Column] = {}
        if spec.get("$rawAncestors"):
            rows, out["rawAncestors"] = self.field(rows, "ancestors", types)
        if spec.get("$all"):
            for c in rows.columns:
                if c not in ("nid", "createdAt", "updatedAt", "aliases", "start_id", "depth", "path", "pos") and not c.startswith(("_c", "^", "@")) and c not in RELATIONS and spec.get(c) is not False:
                    out[c] = self.shown(rows, c)
        for k, v in spec.items():
            if k.startswith("$") and k != "$fieldsByType" or v is False:
                continue
            if k == "$fieldsByType":
                for t, inner in v.items():
                    rows, more = self.project(rows, inner, {t})
                    for n, c in more.items():
                        # A type prefix keeps the fields of other types apart from one of the same name.
                        mine = F.when(F.col("type") == t, c)
                        out[n] = F.coalesce(out[n], mine) if n in out else mine
                continue
            if isinstance(v, dict) and v.get("$flatten"):
                rows, c, fields = self.nested(rows, k, v, types)
                out |= {f: c[f] for f in fields}
                continue
            rows, c = self.value(rows, k, v, types)
            if c is not None:
                out[k] = c
        return rows, out

    def shown(self, rows: DataFrame, path: str) -> Column | None:
        c = self.path(rows, path)
        if c is not None and self.language and self.kind(path) == "text":
            return inh.language_value(c, self.language, self.store.schema.languages)
        return c

    def value(self, rows: DataFrame, key: str, v: Any, types: set[str] | None) -> tuple[DataFrame, Column | None]:
        if v is True:
            return self.field(rows, key, types)
        if isinstance(v, list):
            parts = []
            for x in v:
                rows, c = self.value(rows, key, x, types)
                parts.append(c if isinstance(x, dict) and "$list" in x else F.array(c))
            return rows, F.concat(*parts)
        if not isinstance(v, dict):
            raise QueryError(f"bad value of {key}: {v!r}")
        if "$value" in v:
            return rows, literal(v["$value"])
        if "$raw" in v:
            return self.field(rows, key if v["$raw"] is True else v["$raw"], types)
        if "$id" in v or "$alias" in v or "$db" in v:
            other = self if "$db" not in v else Compiler(self.others[v["$db"]], self.language, self.now_ms, self.compat, self.others)
            sub = other.get({k: x for k, x in v.items() if k != "$db"})
            n = self.name()
            one = sub.select(F.struct(*sub.columns).alias(n))  # one row at most
            return rows.join(F.broadcast(one), F.lit(True), "left"), F.col(n)
        if "$list" in v:
            return self.listed(rows, key, v, types)
        if "$find" in v:
            return self.listed(rows, key, {**{k: x for k, x in v.items() if k != "$find"}, "$list": {"$find": v["$find"], "$limit": 1}}, types, single=True)
        if "$aggregate" in v:
            return self.aggregated(rows, v["$aggregate"], types)
        if "$inherit" in v and "$default" not in v:
            return self.inherited(rows, key, v, types)
        names = v.get("$field", key)
        plain = {k: x for k, x in v.items() if not k.startswith("$")}
        if plain and "$field" not in v or v.get("$all") and not plain:
            rows, c, _ = self.nested(rows, key, v, types)
            return rows, c
        cols = []
        for n in names if isinstance(names, list) else [names]:
            rows, c = self.field(rows, n, types)
            if c is not None:
                cols.append(c)
        if "$default" in v and (v["$default"] or not self.compat):
            cols.append(literal(v["$default"]))
        return rows, F.coalesce(*cols) if len(cols) > 1 else cols[0] if cols else None

    def field(self, rows: DataFrame, path: str, types: set[str] | None) -> tuple[DataFrame, Column | None]:
        s, head = self.store, path.split(".")[0]
        if path in RELATIONS:
            start = rows.select(F.col("nid").alias("start_id"), F.col("nid").alias("id")).distinct()
            found = self.hop(start, types, {"$traverse": path}, None, True)
            n = self.name()
            ids = found.groupBy("start_id").agg(F.sort_array(F.collect_list(F.struct("depth", "path", "id"))).alias(n)).select(F.col("start_id").alias("nid"), F.col(f"{n}.id").alias(n))
            return rows.join(ids, "nid", "left"), F.coalesce(F.col(n), F.array().cast("array<string>"))
        kind = s.schema.relation_kind(head)
        if kind and head not in rows.columns:
            rest = path.partition(".")[2]
            if rest:
                rows, c, _ = self.nested(rows, head, {rest: True} if rest != "*" else {"$all": True}, types)
                return rows, (c[rest] if kind == "reference" and rest != "*" else F.transform(c, lambda x: x[rest]) if rest != "*" else c) if c is not None else None
            n = self.name()
            edges = s.edge_rows(head, types)
            if tr.few(rows):  # only their edges are grouped
                edges = edges.join(F.broadcast(rows.select(F.col("nid").alias("src")).distinct()), "src", "left_semi")
            ids = edges.groupBy(F.col("src").alias("nid")).agg(F.sort_array(F.collect_set("dst")).alias(n))
            return rows.join(ids, "nid", "left"), F.get(n, 0) if kind == "reference" else F.col(n)
        return rows, self.shown(rows, path)

    def nested(self, rows: DataFrame, key: str, v: dict, types: set[str] | None) -> tuple[DataFrame, Column | None, list[str]]:
        """An object under a key: of a reference (joined), or of an object field."""
        s, name = self.store, v.get("$field", key)
        kind = s.schema.relation_kind(name) if isinstance(name, str) and name not in rows.columns else None
        inner = {k: x for k, x in v.items() if not k.startswith("$") or k in ("$all", "$fieldsByType")}
        if kind:
            edges = s.edge_rows(name, types).select(F.col("src").alias("start_id"), F.col("dst").alias("id")).distinct()
            targets = {b for (a, f, b) in s.edges if f == name and (types is None or a in types)}
            items = edges.join(s.node_rows(targets), "id").withColumn("nid", F.col("id"))
            items, cols = self.project(items, inner, targets)
            n = self.name()
            one = F.struct(*(c.alias(k) for k, c in cols.items()))
            grouped = items.groupBy("start_id").agg((F.min_by(one, "nid") if kind == "reference" else F.sort_array(F.collect_list(F.struct(F.col("nid").alias("_id"), one.alias("_item"))))).alias(n))
            joined = rows.join(grouped.select(F.col("start_id").alias("nid"), F.col(n) if kind == "reference" else F.col(f"{n}._item").alias(n)), "nid", "left")
            return joined, F.col(n), list(cols)
        base = self.path(rows, name)
        if base is None:  # a made-up object: its members are read from the node
            rows, cols = self.project(rows, inner, types)
            return rows, F.struct(*(c.alias(k) for k, c in cols.items())), list(cols)
        whole = rows.select(base.alias("x")).schema[0].dataType
        if isinstance(whole, T.MapType) and "*" in inner:  # all keys of a record
            each = inner["*"]
            return rows, F.transform_values(base, lambda _, x: self.element(x, whole.valueType, each if isinstance(each, dict) else {})), []
        members = list(whole.names) if isinstance(whole, T.StructType) else []
        keys = [m for m in members if inner.get(m) is not False] if v.get("$all") else [k for k, x in inner.items() if x is not False and (not members or k in members)]
        cols = []
        for k in keys:
            told = inner.get(k, True)
            if isinstance(told, dict):
                rows, c = self.value(rows, f"{name}.{k}", told if "$field" in told or "$default" not in told else {"$field": f"{name}.{k}", **told}, types)
            else:
                c = self.shown(rows, f"{name}.{k}")
            if c is not None:
                cols.append(c.alias(k))
        return rows, F.struct(*cols) if cols else None, keys

    def objects(self, rows: DataFrame, via: Any) -> tuple[Column, T.DataType] | None:
        """The column and element type of a path to an array of objects; None for anything else."""
        c = self.path(rows, via) if isinstance(via, str) and via not in RELATIONS else None
        kind = rows.select(c.alias("x")).schema[0].dataType if c is not None else None
        return (c, kind.elementType) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else None

    def element(self, e: Column, kind: T.DataType, spec: dict) -> Column:
        """The projection of one object inside an array or record; the whole object if nothing is asked."""
        spec = nest(spec)
        plain = {k: x for k, x in spec.items() if not k.startswith("$") and x is not False}
        if not isinstance(kind, T.StructType) or not plain and not spec.get("$all"):
            return e
        told = {n: True for n in kind.names if spec.get(n) is not False} if spec.get("$all") else {}
        cols = []
        for k, x in {**told, **plain}.items():
            if isinstance(x, dict) and "$value" in x:
                cols.append(literal(x["$value"]).alias(k))
                continue
            inner = {n: y for n, y in x.items() if not n.startswith("$") or n == "$all"} if isinstance(x, dict) else {}
            names = x.get("$field", k) if isinstance(x, dict) else k
            found = [w for n in (names if isinstance(names, list) else [names]) if (w := walk(e, kind, n.replace("[", ".[").split(".")))[0] is not None]
            parts = [F.when(c.isNotNull(), self.element(c, t, inner)) if inner else inh.language_value(c, self.language, self.store.schema.languages) if self.language and isinstance(t, T.MapType) else c for c, t in found]
            if isinstance(x, dict) and "$default" in x:
                parts.append(literal(x["$default"]))
            if parts:
                cols.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(k))
        return F.struct(*cols) if cols else e

    def chosen(self, items: Column, kind: T.StructType, find: dict, told: dict, limit: int) -> Column:
        """The objects of an array that match, in order and cut: column expressions only, no row moves."""
        if find.get("$filter"):
            node = tree(find["$filter"], self.compat)
            items = F.filter(items, lambda e: condition(node, Fields(lambda p: walk(e, kind, p.replace("[", ".[").split("."))[0], lambda p: None, None, self.language, self.now_ms)))
        sort = told.get("$sort")
        sort = sort[0] if isinstance(sort, list) else sort
        if sort:
            items = order.sort_items(items, lambda e: walk(e, kind, sort["$field"].split("."))[0], sort.get("$order", "asc"))
            if self.compat:  # objects with equal sort values count as one
                value = lambda e: walk(e, kind, sort["$field"].split("."))[0]
                every = items
                items = F.filter(items, lambda e, i: (i == 0) | ~value(e).eqNullSafe(value(F.get(every, i - 1))))
        offset = max(told.get("$offset", 0), 0)
        if offset or limit >= 0:
            items = F.slice(items, offset + 1, limit) if limit >= 0 else F.slice(items, F.lit(offset + 1), F.greatest(F.size(items) - offset, F.lit(0)))
        return items

    def listed(self, rows: DataFrame, key: str, v: dict, types: set[str] | None, single: bool = False) -> tuple[DataFrame, Column]:
        told = v["$list"] if isinstance(v["$list"], dict) else {}
        sort = told.get("$sort")
        sort = sort[0] if isinstance(sort, list) else sort
        limit, offset = told.get("$limit", -1), told.get("$offset", 0)
        if limit == 0 and "$find" not in told:
            limit = -1
        find = told.get("$find") or {"$traverse": v.get("$field", key)}
        inner = {k: x for k, x in v.items() if not k.startswith("$") or k in ("$all", "$fieldsByType")}
        if "$inherit" not in told and (found := self.objects(rows, find.get("$traverse", "descendants"))) is not None:
            items = F.transform(self.chosen(found[0], found[1], find, told, limit), lambda e: self.element(e, found[1], inner))
            return rows, F.get(items, 0) if single else F.coalesce(items, F.array().cast(rows.select(items.alias("x")).schema[0].dataType))
        owner, name = "nid", v.get("$field", key)
        if "$inherit" in told and isinstance(name, str) and self.only_edges(name):
            # The list is made once for each holder, and joined to all that inherit from it.
            accept = self.accepted(told["$inherit"], [name])
            rows, owner = self.holder(rows, rows.select(F.col("nid").alias("start_id"), F.col("nid").alias("id")).distinct(), name, accept, types)
            edges, item_types = self.store.edge_rows(name), {b for (_, f, b) in self.store.edges if f == name}
            near = edges.join(rows.select(F.col(owner).alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("start_id"), F.col("dst").alias("id"))
            near = near.groupBy("start_id").agg(F.min("id").alias("id")) if self.store.schema.relation_kind(name) == "reference" else near if sort else near.distinct()
            items = near.withColumn("depth", F.lit(0)).join(self.store.node_rows(item_types), "id")
        elif "$inherit" in told:
            rows, ids = self.inherited(rows, key, {"$inherit": told["$inherit"], "$field": v.get("$field", key)}, types)
            if ids is None:
                raise QueryError(f"{key} has no references to inherit")
            one = not isinstance(rows.select(ids.alias("x")).schema[0].dataType, T.ArrayType)
            near = rows.select(F.col("nid").alias("start_id"), F.posexplode(F.array(ids) if one else ids).alias("depth", "id")).dropDuplicates(["start_id", "id"])
            items, item_types = near.join(self.store.node_rows(), "id"), None
        else:
            start = rows.select(F.col("nid").alias("start_id"), F.col("nid").alias("id")).distinct()
            items, item_types = self.found(start, types, find, paths=sort is None, head=offset < 0)
        if sort:
            by = sort["$field"]
            if isinstance(v.get(by), dict) and "$inherit" in v[by]:  # by the value that each item inherits
                items, c = self.inherited(items.withColumn("nid", F.col("id")), by, v[by], item_types)
                items = items.drop("nid").withColumn("_sort", F.lit(None).cast("string") if c is None else c)
            else:
                c = self.path(items, by)
                items = items.withColumn("_sort", F.lit(None).cast("string") if c is None else c)
            items = items.dropDuplicates(["start_id", "id"])
        keys = order.sort_keys(items, "_sort", sort.get("$order", "asc"), self.language) if sort else order.walk_keys(items)
        items = order.take_each(items, ["start_id"], keys, limit, offset).withColumn("nid", F.col("id")).drop("_sort")
        items, cols = self.project(items, inner or {"id": True}, item_types)
        n = self.name()
        one = F.struct(*(c.alias(k) for k, c in cols.items()))
        grouped = items.groupBy("start_id").agg(F.sort_array(F.collect_list(F.struct("pos", one.alias("item")))).alias(n)) if _orderable(items, one) else items.groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("item"))), lambda a, b: a["pos"] - b["pos"]).alias(n))
        if owner == "nid":
            rows = rows.join(grouped.select(F.col("start_id").alias("nid"), F.col(f"{n}.item").alias(n)), "nid", "left")
        else:
            rows = rows.join(grouped.select(F.col("start_id").alias(f"{n}s"), F.col(f"{n}.item").alias(n)), F.col(owner) == F.col(f"{n}s"), "left").drop(f"{n}s")
        return rows, F.get(n, 0) if single else F.coalesce(F.col(n), F.array().cast(rows.schema[n].dataType))

    def aggregated(self, rows: DataFrame, told: Any, types: set[str] | None) -> tuple[DataFrame, Column]:
        told = told if isinstance(told, dict) else {"$function": told}
        function = told["$function"]
        name, args = (function, []) if isinstance(function, str) else (function["$name"], function.get("$args", []))
        args = [args] if isinstance(args, str) else list(args)
        if name not in agg.FUNCTIONS:
            name = "count"
        sort = told.get("$sort")
        sort = sort[0] if isinstance(sort, list) else sort
        limit, offset = told.get("$limit") or -1, told.get("$offset", 0)
        find = told.get("$find") or {k: told[k] for k in ("$traverse", "$filter", "$recursive") if k in told}
        if told.get("$find") and told.get("$filter"):
            find = {**told["$find"], "$filter": told["$filter"]}
        if (found := self.objects(rows, find.get("$traverse", "descendants"))) is not None:
            items = self.chosen(F.coalesce(found[0], F.array().cast(T.ArrayType(found[1]))), found[1], find, told, limit)
            return rows, agg.items_column(items, name, lambda e: [walk(e, found[1], a.split(".")) for a in args], self.compat)
        cut = limit >= 0 or offset > 0
        start = rows.select(F.col("nid").alias("start_id"), F.col("nid").alias("id")).distinct()
        needed = {a.split(".")[0] for a in args} | ({sort["$field"].split(".")[0]} if sort else set())
        items, _ = self.found(start, types, find, needed, paths=cut and sort is None, head=offset < 0)
        if cut:
            if sort:
                c = self.path(items, sort["$field"])
                items = items.withColumn("_sort", F.lit(None).cast("string") if c is None else c)
            keys = order.sort_keys(items, "_sort", sort.get("$order", "asc"), self.language) if sort else order.walk_keys(items)
            items = order.take_each(items, ["start_id"], keys, limit, offset)
        n = self.name()
        out = items.groupBy(F.col("start_id").alias("nid")).agg(agg.aggregate_column(items, name, args, self.compat).alias(n))
        empty = {"count": F.lit(0), "countUnique": F.lit(0), "sum": F.lit(0.0)}.get(name)
        return rows.join(out, "nid", "left"), F.coalesce(F.col(n), empty) if empty is not None else F.col(n)

    def accepted(self, told: Any, names: list[str]) -> set[str] | None:
        """The types that values may be inherited from, None for all; the fields must be of one kind in them."""
        accept = told.get("$type") if isinstance(told, dict) else None
        accept = set([accept] if isinstance(accept, str) else accept) if accept else None
        for name in names:
            kinds = {f["type"] for t in sorted(accept or ()) if t in self.store.schema.types and (f := self.store.schema.lookup(t, name))}
            if len(kinds) > 1:
                raise QueryError(f"{name} has different kinds in {sorted(accept)}: {sorted(kinds)}")
        return accept

    def only_edges(self, name: str) -> bool:
        """Whether a field is kept in edges, and in no node table."""
        s = self.store
        return bool(s.schema.relation_kind(name)) and name not in RELATIONS and any(f == name for _, f, _ in s.edges) and not any(name.split(".")[0] in df.columns for df in s.nodes.values())

    def inherited(self, rows: DataFrame, key: str, v: dict, types: set[str] | None) -> tuple[DataFrame, Column | None]:
        told = v["$inherit"] if isinstance(v["$inherit"], dict) else {}
        start = rows.select(F.col("nid").alias("start_id"), F.col("nid").alias("id")).distinct()
        names = v.get("$field", key)
        names = names if isinstance(names, list) else [names]
        plain = [k for k in v if not k.startswith("$")]
        n = self.name()
        accept = self.accepted(told, names)
        if "$item" in told:
            item = told["$item"]
            fields = [f for f in plain if any(f.split(".")[0] in df.columns for df in self.store.nodes.values())]
            out = inh.inherit_item(self.store, start, [f for f in fields if f != "id"], set([item] if isinstance(item, str) else item), told.get("$required", []), types)
            one = F.struct(*((F.col("item_id") if f == "id" else F.col(f)).alias(f) for f in fields))
            return rows.join(out.select(F.col("start_id").alias("nid"), F.when(F.col("item_id").isNotNull(), one).alias(n)), "nid", "left"), F.col(n)
        if told.get("$deepMerge") or told.get("$merge"):
            out = inh.deep_merge(self.store, start, names[0], accept, types) if told.get("$deepMerge") else inh.merge_maps(self.store, start, names[0], plain or None, accept, types)
            return rows.join(out.select(F.col("start_id").alias("nid"), F.col(names[0]).alias(n)), "nid", "left"), F.col(n)
        cols = []
        for name in names:
            if plain and self.store.schema.relation_kind(name) is None and any(name in df.columns for df in self.store.nodes.values()):
                m = self.name()
                out = inh.inherit_fields(self.store, start, [name], accept, types)
                rows = rows.join(out.select(F.col("start_id").alias("nid"), F.col(name).alias(m)), "nid", "left")
                cols.append(F.struct(*(F.col(m)[p].alias(p) for p in plain)))
            elif any(name in df.columns for df in self.store.nodes.values()):
                m = self.name()
                out = inh.inherit_fields(self.store, start, [name], accept, types)
                c = F.col(name)
                if self.language and self.kind(name) == "text":
                    c = inh.language_value(c, self.language, self.store.schema.languages)
                rows = rows.join(out.select(F.col("start_id").alias("nid"), c.alias(m)), "nid", "left")
                cols.append(F.col(m))
            elif name in RELATIONS:
                rows, c = self.field(rows, name, types)
                cols.append(c)
            elif "." in name and any(name.split(".")[0] in df.columns for df in self.store.nodes.values()):
                m = self.name()
                inside = {t: df.withColumn(m, c) if (c := self.path(df, name)) is not None else df for t, df in self.store.nodes.items()}
                out = inh.inherit_fields(self.store.with_(nodes=inside), start, [m], accept, types)
                rows = rows.join(out.select(F.col("start_id").alias("nid"), F.col(m).alias(f"{m}i")), "nid", "left")
                cols.append(F.col(f"{m}i"))
            elif self.store.schema.relation_kind(name):
                rows, c = self.inherited_relation(rows, start, name, {k: x for k, x in v.items() if not k.startswith("$")}, accept, types)
                cols.append(c)
        return rows, F.coalesce(*cols) if cols else None

    def inherited_relation(self, rows: DataFrame, start: DataFrame, name: str, inner: dict, accept: set[str] | None, types: set[str] | None) -> tuple[DataFrame, Column]:
        """The reference (or references) of the nearest node at or above that has some; with inner, the fields of the nodes that they lead to.

        A reference comes down with the fields of its target, which is so read once for
        each holder; of references only the holder's id comes down, and their list is joined to it.
        """
        s, m, one_ref = self.store, self.name(), self.store.schema.relation_kind(name) == "reference"
        holders = {a for (a, f, _) in s.edges if f == name}
        if not holders:
            if not inner:
                return rows, F.lit(None).cast("string" if one_ref else "array<string>")
            kind = self.leading(s.edge_rows(name), None, inner, m, one_ref).schema[m].dataType
            return rows, F.lit(None).cast(kind)
        if not one_ref:
            rows, holder = self.holder(rows, start, name, accept, types)
            edges, targets = s.edge_rows(name), {b for (_, f, b) in s.edges if f == name}
            lists = self.leading(edges, targets, inner, m, False) if inner else edges.groupBy(F.col("src").alias("start_id")).agg(F.sort_array(F.collect_set("dst")).alias(m))
            return rows.join(lists.withColumnRenamed("start_id", f"{m}s"), F.col(holder) == F.col(f"{m}s"), "left").drop(f"{m}s"), F.col(m)
        targets = {b for (_, f, b) in s.edges if f == name}
        nodes, wide = dict(s.nodes), dict(s.wide)
        for a in holders & set(nodes):
            if a in wide and f"@{name}" in wide[a].columns:
                held = wide[a].withColumn(f"{m}d", F.col(f"@{name}"))
                if inner:
                    to, got = self.project(s.node_rows(targets).withColumn("nid", F.col("id")), inner, targets)
                    to = to.select(F.col("nid").alias(f"{m}s"), F.struct(*(c.alias(k) for k, c in got.items())).alias(f"{m}i"))
                    held = held.join(to, F.col(f"{m}d") == F.col(f"{m}s"), "left")
            else:
                edges = s.edge_rows(name, {a})
                held = (wide[a] if a in wide else nodes[a]).join(edges.groupBy(F.col("src").alias(f"{m}s")).agg(F.min("dst").alias(f"{m}d")), F.col("id") == F.col(f"{m}s"), "left").drop(f"{m}s")
                if inner:
                    to = self.leading(edges, targets, inner, f"{m}i", True).withColumnRenamed("start_id", f"{m}s")
                    held = held.join(to, F.col("id") == F.col(f"{m}s"), "left")
            value = F.struct(F.col(f"{m}d").alias("id"), *([F.col(f"{m}i").alias("one")] if inner else []))
            held = held.withColumn(m, F.when(F.col(f"{m}d").isNotNull(), value)).drop(f"{m}d", f"{m}s", f"{m}i")
            nodes[a] = held
            if a in wide:
                wide[a] = held
        rows = self.come_down(s.with_(nodes=nodes, wide=wide), rows, start, m, accept, types)
        return rows, F.col(m)["one" if inner else "id"]

    def leading(self, edges: DataFrame, targets: set[str] | None, inner: dict, name: str, one_ref: bool) -> DataFrame:
        """start_id, and as name the fields of the nodes that its edges lead to: of the first one, or of all by id."""
        pairs = edges.select(F.col("src").alias("start_id"), F.col("dst").alias("id")).distinct()
        items, got = self.project(pairs.join(self.store.node_rows(targets), "id").withColumn("nid", F.col("id")), inner, targets)
        one = F.struct(*(c.alias(k) for k, c in got.items()))
        if one_ref:
            return items.groupBy("start_id").agg(F.min_by(one, "nid").alias(name))
        by_id = lambda a, b: F.when(a["_id"] < b["_id"], -1).when(a["_id"] > b["_id"], 1).otherwise(0)
        every = items.groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct(F.col("nid").alias("_id"), one.alias("_item"))), by_id).alias(name))
        return every.select("start_id", F.col(f"{name}._item").alias(name))

    def holder(self, rows: DataFrame, start: DataFrame, name: str, accept: set[str] | None, types: set[str] | None) -> tuple[DataFrame, str]:
        """rows with the id of the nearest node at or above that has an edge of the field, and that column's name."""
        s, m = self.store, self.name()
        nodes, wide = dict(s.nodes), dict(s.wide)
        for a in {a for (a, f, _) in s.edges if f == name} & set(nodes):
            has = s.edge_rows(name, {a}).select(F.col("src").alias(f"{m}s")).distinct()
            held = (wide[a] if a in wide else nodes[a]).join(has, F.col("id") == F.col(f"{m}s"), "left").withColumnRenamed(f"{m}s", m)
            nodes[a] = held
            if a in wide:
                wide[a] = held
        return self.come_down(s.with_(nodes=nodes, wide=wide), rows, start, m, accept, types), m

    @staticmethod
    def come_down(store: GraphStore, rows: DataFrame, start: DataFrame, m: str, accept: set[str] | None, types: set[str] | None) -> DataFrame:
        """rows with the nearest value of field m."""
        if types and len(types) == 1 and (found := inh.attach(store, rows, next(iter(types)), [m], accept)) is not None:
            return found
        out = inh.inherit_fields(store, start, [m], accept, types)
        return rows.join(out.withColumnRenamed("start_id", f"{m}n"), F.col("nid") == F.col(f"{m}n"), "left").drop(f"{m}n")


def _orderable(items: DataFrame, one: Column) -> bool:
    """Whether the item can stand in sort_array (maps can't); the position alone decides the order."""

    def holds_map(kind: T.DataType) -> bool:
        return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.StructType) and any(holds_map(f.dataType) for f in kind.fields) or isinstance(kind, T.ArrayType) and holds_map(kind.elementType)

    return not holds_map(items.select(one.alias("x")).schema[0].dataType)
