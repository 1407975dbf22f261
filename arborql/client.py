"""The API: get, set, update, delete, schema updates, subscriptions and triggers over named databases."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import objects
from .functions.filters import Fields, condition, tree
from .operators import mutate
from .operators.tables import materialize
from .plans.compile import Compiler, QueryError, validate
from .schema import GraphSchema
from .sources.store import GraphStore
from .streaming.live import Observable, Triggers, summary


def to_python(v: Any) -> Any:
    """Nested rows as plain values; missing fields are left out."""
    if hasattr(v, "asDict"):
        return {k: to_python(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, dict):
        return {k: to_python(x) for k, x in v.items() if x is not None}
    if isinstance(v, (list, tuple)):
        return [to_python(x) for x in v]
    return v


class GraphClient:
    """Queries and mutations over graph snapshots, one for each database."""

    def __init__(self, spark: SparkSession, schema: dict | GraphSchema | None = None, store: GraphStore | None = None, clock=None, compat: bool = False):
        self.spark, self.compat = spark, compat
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.stores: dict[str, GraphStore] = {}
        self.validator = None
        self.observers: list[Observable] = []
        self.schema_listeners: list[tuple[str, Any]] = []
        #: Folder to which values of fields marked as timeseries are appended.
        self.timeseries: str | None = None
        self.triggers = Triggers()
        schema = schema if isinstance(schema, GraphSchema) else GraphSchema.of(schema or {})
        self.stores["default"] = store or GraphStore.empty(spark, schema)

    def store(self, db: str = "default") -> GraphStore:
        return self.stores[db]

    def add_database(self, name: str, schema: dict | None = None, store: GraphStore | None = None) -> None:
        self.stores[name] = store or GraphStore.empty(self.spark, GraphSchema.of(schema or {}))

    plain = staticmethod(to_python)

    def compiler(self, db: str = "default") -> Compiler:
        return Compiler(self.stores[db], None, self.clock(), self.compat, self.stores)

    def plan(self, query: dict) -> DataFrame:
        """The query as a lazy DataFrame."""
        told = {k: v for k, v in query.items() if k not in ("$db", "$trigger", "$includeMeta")}
        return self.compiler(query.get("$db", "default")).get(told)

    def get(self, query: dict) -> dict:
        """The result, or {"$isNull": True} if the node doesn't exist; with $includeMeta also the database and the next refresh."""
        row = self.plan(query).take(1)
        out = to_python(row[0]) if row else {"$isNull": True}
        if query.get("$includeMeta"):
            at = self.next_refresh(query)
            out["$meta"] = {query.get("$db", "default"): {}, **({"refreshAt": at} if at is not None else {})}
        return out

    def next_refresh(self, query: dict) -> int | None:
        """When filters that move with now will next change the result."""
        told = {k: v for k, v in query.items() if k not in ("$db", "$trigger", "$includeMeta")}
        return self.compiler(query.get("$db", "default")).next_refresh(told)

    def refresh_due(self, now_ms: int | None = None) -> int | None:
        """Evaluates the standing queries whose time has come; when to call again (null if never)."""
        now_ms = self.clock() if now_ms is None else now_ms
        for o in list(self.observers):
            o.due(now_ms)
        times = [o.refresh_at for o in self.observers if o.refresh_at is not None]
        return min(times) if times else None

    def keep_refreshing(self, stop, most_ms: int = 600_000) -> None:
        """Calls refresh_due in time until the event stop is set; run it in a thread."""
        while not stop.is_set():
            at = self.refresh_due()
            left = most_ms if at is None else min(max(at - self.clock(), 1), most_ms)
            stop.wait(left / 1000)

    def object(self, command: str, node_id: str, path: str | None = None, value: Any = None, db: str = "default") -> Any:
        """get, exists, len, type, getmeta, setmeta, set or del on a path of one node."""
        if command in ("set", "del"):
            return self.set({"$id": node_id, path: {"$delete": True} if command == "del" else value}, db)
        if command == "setmeta":
            self.stores[db] = objects.set_meta(self.stores[db], node_id, path, value)
            return value
        row = objects.read(self.stores[db], command, node_id, path).take(1)
        return to_python(row[0].value) if row else None

    def id(self, type: str, db: str = "default") -> str:
        return mutate.new_id(self.stores[db], type)

    def _done(self, db: str, result: mutate.Result) -> None:
        self.stores[db] = result.store
        if isinstance(result.changes, DataFrame) and (self.triggers.all or self.observers):
            result.changes = materialize(result.changes, "changes")
        self._keep_series(result)
        self.triggers.fire(self, db, result.changes)
        if self.observers:
            told = summary(result.changes)
            for o in list(self.observers):
                o.refresh(told)

    def _keep_series(self, result: mutate.Result) -> None:
        """Appends what changed in fields marked as timeseries: node_id, field, ts, value."""
        marked = [(t, k) for t, d in result.store.schema.types.items() for k, f in d.fields.items() if f.get("timeseries")]
        if self.timeseries and marked:
            log = result.change_log()
            parts = [log.where((F.col("type") == t) & (F.col("op") != "deleted") & F.array_contains("changed", k)).select(F.col("id").alias("node_id"), F.lit(k).alias("field"), F.lit(self.clock()).alias("ts"), F.get_json_object("after", f"$.{k}").alias("value")) for t, k in marked]
            rows = parts[0]
            for x in parts[1:]:
                rows = rows.unionByName(x)
            result.store.append_timeseries(rows, self.timeseries)

    def set(self, payload: dict | list[dict], db: str = "default"):
        """Applies payloads; the id (or ids), null where the operation didn't apply."""
        payloads = payload if isinstance(payload, list) else [payload]
        result = mutate.set_all(self.stores[db], payloads, self.clock(), self.validator)
        self._done(db, result)
        return result.ids if isinstance(payload, list) else result.ids[0]

    def set_with_meta(self, payload: dict, db: str = "default") -> dict:
        result = mutate.set_all(self.stores[db], [payload], self.clock(), self.validator)
        self._done(db, result)
        return {"id": result.ids[0], **result.meta[0]}

    def update(self, values: dict, query: dict, db: str = "default") -> None:
        """Sets fields of all nodes of a type that a query finds.

        values: {type, field: value or operation}. query: {$id or $alias (else the root),
        $find: {$traverse, $filter, $find, ...}}; without $find the node itself, and
        {$filter} alone means all nodes of the type.
        """
        if extra := set(query) - {"$id", "$alias", "$find", "$filter", "$db"}:
            raise QueryError(f"unknown keys of an update {sorted(extra)}")
        db, t = query.get("$db", db), values["type"]
        store, c = self.stores[db], self.compiler(db)
        fields = {k: v for k, v in values.items() if k != "type"}
        named = {k: query[k] for k in ("$id", "$alias") if k in query}
        where: Any
        if "$find" not in query and not named:
            rows = store.nodes[t]
            node = tree(query.get("$filter", []), self.compat)
            where = condition(node, Fields(lambda p: c.path(rows, p), c.kind, None, None, self.clock()))
        else:
            begin, types = c.start(named)
            begin = begin.select(F.col("nid").alias("start_id"), F.col("nid").alias("id"))
            if "$find" in query:
                validate({"found": {"$list": {"$find": query["$find"]}}})
                begin = c.found(begin, types, _of_type(query["$find"], t), set())[0]
            where = begin.select("id") if "$filter" not in query else c.filtered(store.node_rows({t}).join(begin.select("id").distinct(), "id"), query["$filter"], {t}).select("id")
        new, log = mutate.update_where(store, t, where, fields, self.clock())
        self._done(db, mutate.Result(new, [], log))

    def delete(self, what: str | dict, db: str = "default"):
        """Deletes a node and what goes with it: whether anything went, or the ids with $returnIds."""
        told = {"$id": what} if isinstance(what, str) else what
        store, log = mutate.delete_nodes(self.stores[db], [told["$id"]], told.get("$recursive", False))
        log = materialize(log, "changes")
        self._done(db, mutate.Result(store, [], log))
        return [r.id for r in log.select("id").orderBy("id").collect()] if told.get("$returnIds") else not log.isEmpty()

    def digest(self, text: str) -> str:
        return mutate.digest(text)

    def get_schema(self, db: str = "default") -> GraphSchema:
        return self.stores[db].schema

    def update_schema(self, told: dict, db: str = "default", allow_mutations: bool = False, handle_mutations=None) -> list[dict]:
        """Merges a schema; existing data follows its mutations (or the handler's store)."""
        from .schema import spark_type

        store = self.stores[db]
        schema, changes = store.schema.merged(told, allow_mutations)
        nodes = dict(store.nodes)
        for m in changes:
            if m["mutation"] == "delete_type":
                nodes.pop(m["type"], None)
        store = store.with_(schema=schema, nodes=nodes)
        for m in changes:
            if handle_mutations and (own := handle_mutations(m, store)) is not None:
                store = own
            elif m["mutation"] == "remove_field" and m["type"] in store.nodes:
                store = store.with_(nodes={**store.nodes, m["type"]: store.nodes[m["type"]].drop(m["field"])})
            elif m["mutation"] == "change_field":
                store = mutate.convert_field(store, m["type"], m["field"], m["new"])
        nodes = dict(store.nodes)
        for t, d in schema.types.items():
            if t not in nodes:
                nodes[t] = self.spark.createDataFrame([], d.struct())
            for k, spec in d.all_fields().items():
                kind = spark_type(spec)
                if kind is not None and k not in nodes[t].columns and k not in ("parents", "children", "ancestors", "descendants"):
                    nodes[t] = nodes[t].withColumn(k, F.lit(None).cast(kind))
        self.stores[db] = store.with_(nodes=nodes)
        for name, on in list(self.schema_listeners):
            if name == db:
                on(schema)
        for o in list(self.observers):
            o.refresh(None)
        return changes

    def observe_schema(self, on, db: str = "default"):
        """Calls on(schema) now and after each change of the schema; returns what ends it."""
        self.schema_listeners.append((db, on))
        on(self.stores[db].schema)
        return lambda: self.schema_listeners.remove((db, on))

    def conform_to_schema(self, payload: dict, db: str = "default") -> dict:
        s = self.stores[db].schema
        return s.conform(payload.get("type") or s.type_of(payload["$id"]), payload)

    def set_custom_validator(self, fn) -> None:
        self.validator = fn

    def observe(self, query: dict) -> Observable:
        o = Observable(self, query)
        self.observers.append(o)
        return o

    def observe_event(self, event: str, query: dict, on) -> None:
        """Calls on(result) when a node is created, updated or deleted and matches query's $filter."""
        self.triggers.add(event, query, on)

    def destroy(self) -> None:
        self.observers.clear()
        self.triggers.clear()
        self.schema_listeners.clear()


def _of_type(find: dict, t: str) -> dict:
    """The $find whose last step also asks for a type, so that only its table is read."""
    if "$find" in find:
        return {**find, "$find": _of_type(find["$find"], t)}
    told = find.get("$filter", [])
    return {**find, "$filter": [*(told if isinstance(told, list) else [told]), {"$field": "type", "$operator": "=", "$value": t}]}
