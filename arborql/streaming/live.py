"""Live queries: subscriptions, triggers and time-based refresh; in process, and over a change log as a stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import Fields, condition, refresh_at, tree
from ..operators.mutate import CHANGES

__all__ = ["Observable", "Triggers", "apply_diff", "change_matches", "diff", "event_kinds", "fires", "latest", "read_changes", "refresh_at", "run_query", "version"]


def subscription_id(query: dict) -> str:
    return hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()


def version(result: Any) -> str:
    """A hash of a result that doesn't depend on the order of keys."""
    return hashlib.sha256(json.dumps(result, sort_keys=True, default=str).encode()).hexdigest()


def diff(old: Any, new: Any, path: str = "") -> list[tuple[str, Any]]:
    """(path, new value) where the results differ; None where a value went."""
    if isinstance(old, dict) and isinstance(new, dict):
        return [d for k in sorted({*old, *new}) for d in diff(old.get(k), new.get(k), f"{path}.{k}" if path else k)]
    return [] if old == new else [(path, new)]


def apply_diff(value: Any, patch: list[tuple[str, Any]]) -> Any:
    """The new result, from the old one and what diff gave."""
    for path, new in patch:
        if not path:
            value = new
            continue
        value = dict(value)
        at, keys = value, path.split(".")
        for k in keys[:-1]:
            at[k] = dict(at.get(k) or {})
            at = at[k]
        if new is None:
            at.pop(keys[-1], None)
        else:
            at[keys[-1]] = new
    return value


def summary(changes: list[tuple] | DataFrame | None) -> set[tuple[str, str | None]] | None:
    """(op, changed path) pairs: as many as there are paths, however many nodes changed. None: anything may have changed."""
    if changes is None:
        return None
    if isinstance(changes, DataFrame):
        return {(r.op, r.path) for r in changes.select("op", F.explode_outer("changed").alias("path")).distinct().collect()}
    return {(c[1], p) for c in changes for p in (c[4] or [None])}


class Observable:
    """A standing query: subscribers get the first result and each changed version, or what changed from version to version."""

    def __init__(self, client, query: dict):
        self.client, self.query, self.id = client, query, subscription_id(query)
        self.listeners: list[Callable] = []
        self.diff_listeners: list[Callable] = []
        self.value: Any = None
        self.version: str | None = None
        self.watch = watched_fields(query)
        #: When a filter that moves with now changes the result next.
        self.refresh_at: int | None = None

    def subscribe(self, on_next: Callable[[Any], None], on_error: Callable[[Exception], None] | None = None, on_diff: Callable[[list, str | None, str], None] | None = None):
        """on_diff(patch, from version, to version) hears of every change after the first result."""
        self.listeners.append(on_next)
        if on_diff is not None:
            self.diff_listeners.append(on_diff)
        if self.version is None:
            try:
                self._run()
            except Exception as e:  # the first evaluation's error belongs to the subscriber
                if on_error is None:
                    raise
                on_error(e)
        else:
            on_next(self.value)
        return lambda: self.unsubscribe(on_next, on_diff)

    def unsubscribe(self, on_next: Callable, on_diff: Callable | None = None) -> None:
        self.listeners.remove(on_next)
        if on_diff is not None:
            self.diff_listeners.remove(on_diff)
        if not self.listeners and self in self.client.observers:
            self.client.observers.remove(self)

    def _run(self) -> None:
        value = self.client.get(self.query)
        self.refresh_at = self.client.next_refresh(self.query)
        v = version(value)
        if v != self.version:
            old, was = self.value, self.version
            self.value, self.version = value, v
            for f in list(self.listeners):
                f(value)
            if was is not None:
                patch = diff(old, value)
                for f in list(self.diff_listeners):
                    f(patch, was, v)

    def refresh(self, changes: set[tuple[str, str | None]] | None) -> None:
        """Evaluates again if a change can matter: anything but an update of fields that aren't watched."""
        if not self.listeners:
            return
        if changes is None or any(op != "updated" or self.watch is None or touches([path] if path else [], self.watch) for op, path in changes):
            self._run()

    def due(self, now_ms: int) -> None:
        """Evaluates again if the time for it has come."""
        if self.listeners and self.refresh_at is not None and self.refresh_at <= now_ms:
            self._run()


def watched_fields(query: Any) -> set[str] | None:
    """Fields that a query reads; None for all."""
    out: set[str] = set()

    def walk(spec: Any) -> bool:
        if isinstance(spec, list):
            return all(map(walk, spec))
        if not isinstance(spec, dict):
            return True
        for k, v in spec.items():
            if k in ("$all", "$traverse") and v not in ("descendants", "ancestors", "children", "parents") or k == "$merge":
                return False
            if k == "$field":
                out.update(v if isinstance(v, list) else [v])
            elif k == "$args":
                out.update(v if isinstance(v, list) else [v])
            elif not k.startswith("$"):
                out.add(k)
            if not walk(v):
                return False
        return True

    return out | {"children", "parents"} if walk(query) else None


def touches(changed: list[str], watched: set[str]) -> bool:
    """Whether a changed path is watched, or lies above or below a watched one."""
    return any(c == w or c.startswith(w + ".") or w.startswith(c + ".") for c in changed for w in watched)


class Triggers:
    def __init__(self):
        self.all: list[tuple[str, dict, Callable]] = []

    def add(self, event: str, query: dict, on: Callable) -> None:
        if event not in ("created", "updated", "deleted"):
            raise ValueError(f"unknown event {event}")
        self.all.append((event, query, on))

    def clear(self) -> None:
        self.all.clear()

    def fire(self, client, db: str, changes: list[tuple] | DataFrame) -> None:
        """For each trigger one plan over all changes of its event: a join with the nodes, the filter, the projection."""
        listed = not isinstance(changes, DataFrame)
        for event, query, on in self.all:
            if listed and not any(c[1] == event for c in changes):
                continue
            log = (client.spark.createDataFrame([c for c in changes if c[1] == event], CHANGES) if listed else changes.where(F.col("op") == event)).groupBy("id", "type").agg(F.min("seq").alias("_cseq"))
            if event == "deleted":  # no fields are left to filter by
                for r in log.orderBy("_cseq").toLocalIterator():
                    on({"$isNull": True, "id": r.id})
                continue
            types = {c[3] for c in changes if c[1] == event} if listed else {r.type for r in log.select("type").distinct().collect()}
            for r in client.compiler(db).each(log.select("id", "_cseq"), types, query).toLocalIterator():
                on(client.plain(r))


# over a change log


def fires(before: Column, after: Column, changed: Column) -> Column:
    """A field change matters if the node matched before or after only, or matched both and a watched field changed."""
    return (before & after & changed) | (before != after)


def change_matches(log: DataFrame, filter_: Any, watched: list[str], schema: str) -> DataFrame:
    """Rows of a change log (batch or stream) that a subscription with a filter on node fields must hear of.

    before and after are JSON of the node; schema its fields. Deletions always matter.
    """
    node = tree(filter_) if filter_ else None
    old, new = F.from_json("before", schema), F.from_json("after", schema)

    def test(c: Column) -> Column:
        return F.coalesce(condition(node, Fields(lambda p: c.getField(p.split(".")[0]) if "." not in p else None, lambda p: None)) & c.isNotNull(), F.lit(False))

    paths = F.transform("changed", lambda p: F.regexp_replace(p, r"\[\d+\]", "[n]"))
    hit = F.exists(paths, lambda p: _any([p.eqNullSafe(w) | p.startswith(w + ".") | F.lit(w).startswith(F.concat(p, F.lit("."))) for w in watched])) if watched else F.lit(True)
    return log.where((F.col("op") == "deleted") | fires(test(old), test(new), hit))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A change log folder as a stream."""
    return spark.readStream.schema(CHANGES).parquet(path)


def event_kinds(changed: Column) -> Column:
    """The kinds of change that a list of changed paths stands for: hierarchy, alias, field."""
    return F.array_distinct(F.transform(changed, lambda c: F.when(c.isin("parents", "children"), "hierarchy").when(c == "aliases", "alias").otherwise("field")))


def run_query(stream: DataFrame, evaluate: Callable[[DataFrame], Any], publish: Callable[..., None], checkpoint: str, name: str = "live", every: str | None = None, diffs: bool = False):
    """Evaluates again in each micro-batch that has matching changes, and publishes results whose version is new.

    The last published result stands beside the checkpoint, so a restart publishes nothing
    twice. every is a processing time between batches; without it what is there is worked
    off and the query ends. With diffs, publish also gets the patch from the last result.
    """
    spark, place = stream.sparkSession, f"{checkpoint}/published"
    said = json.JSONEncoder(sort_keys=True, default=str).encode

    def last() -> tuple[str | None, Any]:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return None, None
        rows = spark.read.text(place).collect()  # one line
        told = json.loads(rows[0][0]) if rows else {}
        return told.get("version"), told.get("value")

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            value = evaluate(batch)
            v, (was, old) = version(value), last()
            if was != v:
                publish(number, value, *([diff(old, json.loads(said(value)))] if diffs else []))
                spark.createDataFrame([(said({"version": v, "value": value}),)], "value string").coalesce(1).write.mode("overwrite").text(place)

    pace = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**pace).start()


def latest(log: DataFrame) -> DataFrame:
    """The last change of each node: state rebuilt from a change log."""
    return log.groupBy("id").agg(F.max_by(F.struct("op", "type", "after", "seq"), "seq").alias("m")).select("id", "m.*")
