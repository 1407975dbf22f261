"""Updates by query, arrays and records in queries, inherited lists, and live queries, through the client."""

import threading

import pytest

from arborql.client import GraphClient
from arborql.plans.compile import QueryError
from arborql.schema import SchemaError
from arborql.sources.store import GraphStore
from arborql.streaming import live

S, N = {"type": "string"}, {"type": "number"}
ITEM = {"type": "object", "properties": {"name": S, "value": N, "title": {"type": "text"}, "deep": {"type": "object", "properties": {"x": N}}}}
SCHEMA = {
    "languages": ["en", "de"],
    "types": {
        "sport": {"prefix": "sp", "fields": {"name": S, "menu": {"type": "references"}, "size": S}},
        "match": {"prefix": "ma", "fields": {"name": S, "value": N, "start": {"type": "timestamp"}, "ary": {"type": "array", "items": ITEM}, "rec": {"type": "record", "values": ITEM}, "tags": {"type": "set", "items": S}, "size": N, "score": {"type": "number", "timeseries": True}}},
    },
}
IS_MATCH = {"$field": "type", "$operator": "=", "$value": "match"}


@pytest.fixture
def client(spark):
    now = [1000]
    c = GraphClient(spark, SCHEMA, clock=lambda: now[0])
    c.now = now
    c.set([{"$id": "sp1", "name": "football", "menu": ["ma7", "ma8"]}, {"$id": "sp2", "name": "chess"}, *({"$id": f"ma{i}", "parents": ["sp1" if i < 3 else "sp2"], "name": f"m{i}", "value": i} for i in range(1, 6)), {"$id": "ma7", "name": "menu item"}, {"$id": "ma8", "name": "another"}])
    return c


def values(c, field="value"):
    return {r.id: r[field] for r in c.store().nodes["match"].collect() if r[field] is not None}


def test_update_reaches_only_what_the_query_finds(client):
    seen, updated = [], []
    client.observe({"$id": "root", "total": {"$aggregate": {"$function": {"$name": "sum", "$args": ["value"]}, "$traverse": "descendants", "$filter": IS_MATCH}}}).subscribe(seen.append)
    client.observe_event("updated", {"id": True, "value": True}, updated.append)
    client.now[0] = 2000
    client.update({"type": "match", "value": 2}, {"$id": "sp1", "$find": {"$traverse": "children", "$filter": IS_MATCH}})
    assert values(client) == {"ma1": 2, "ma2": 2, "ma3": 3, "ma4": 4, "ma5": 5}
    assert seen == [{"total": 15.0}, {"total": 16.0}] and updated == [{"id": "ma1", "value": 2.0}]
    assert {r.id for r in client.store().nodes["match"].where("updatedAt = 2000").collect()} == {"ma1"}  # ma2 had the value
    client.update({"type": "match", "value": {"$increment": 1}, "tags": {"$add": "x"}}, {"$find": {"$traverse": "descendants", "$filter": {"$field": "value", "$operator": ">", "$value": 3}}})
    assert values(client) == {"ma1": 2, "ma2": 2, "ma3": 3, "ma4": 5, "ma5": 6} and values(client, "tags") == {"ma4": ["x"], "ma5": ["x"]}
    client.update({"type": "match", "name": "one"}, {"$id": "ma1"})
    client.update({"type": "match", "rec": {"k": {"name": "a"}}, "ary": {"$push": {"name": "b"}}}, {"$find": {"$traverse": "children", "$filter": {"$field": "name", "$operator": "=", "$value": "chess"}, "$find": {"$traverse": "children"}}})
    assert client.get({"$id": "ma1", "name": True}) == {"name": "one"}
    assert client.get({"$id": "ma3", "rec": True, "ary": True}) == {"rec": {"k": {"name": "a"}}, "ary": [{"name": "b"}]}
    for bad, error in (({"type": "match", "parents": ["sp1"]}, SchemaError), ({"type": "match", "nope": 1}, SchemaError), ({"type": "match", "value": "x"}, SchemaError)):
        with pytest.raises(error):
            client.update(bad, {"$find": {"$traverse": "descendants"}})
    with pytest.raises(QueryError):
        client.update({"type": "match", "value": 1}, {"$traverse": "children"})


def test_arrays_of_objects(client):
    client.set({"$id": "ma1", "ary": [{"name": "a", "value": 3, "title": {"de": "A"}}, {"name": "b", "value": 1, "deep": {"x": 7}}, {"name": "c"}, {"name": "d", "value": 2}]})
    listed = lambda **told: {"name": True, "$list": told}
    below = {"$traverse": "ary", "$filter": {"$field": "value", "$operator": "exists"}}
    got = client.get({"$id": "ma1", "$language": "en", "all": {**listed(), "$field": "ary"}, "up": listed(**{"$sort": {"$field": "value", "$order": "asc"}, "$find": below}), "down": {"n": {"$field": "name"}, "t": {"$field": "title"}, "d": {"$field": "deep.x", "$default": 0}, "$list": {"$sort": {"$field": "value", "$order": "desc"}, "$offset": 1, "$limit": 2, "$find": {"$traverse": "ary"}}}, "one": {"name": True, "$find": {"$traverse": "ary", "$filter": {"$field": "value", "$operator": "<", "$value": 2}}}, "sum": {"$aggregate": {"$function": {"$name": "sum", "$args": ["value"]}, "$traverse": "ary"}}, "top": {"$aggregate": {"$function": {"$name": "max", "$args": ["deep.x"]}, "$traverse": "ary"}}, "none": {"$aggregate": {"$function": "count", "$traverse": "ary", "$filter": {"$field": "name", "$operator": "=", "$value": "z"}}}})
    names = lambda x: [{"name": n} for n in x]
    assert got == {"all": names("abcd"), "up": names("bda"), "down": [{"n": "a", "t": "A", "d": 0.0}, {"n": "d", "d": 0.0}], "one": {"name": "b"}, "sum": 6.0, "top": 7.0, "none": 0}
    assert client.get({"$id": "ma2", "ary": listed(), "sum": {"$aggregate": {"$function": {"$name": "sum", "$args": ["value"]}, "$traverse": "ary"}}}) == {"ary": [], "sum": 0.0}


def test_record_wildcards_dotted_keys_and_constants(client):
    client.set({"$id": "ma1", "rec": {"k": {"name": "a", "value": 1}, "l": {"name": "b", "deep": {"x": 2}}}})
    assert client.get({"$id": "ma1", "rec": {"*": {"name": True}}}) == {"rec": {"k": {"name": "a"}, "l": {"name": "b"}}}
    assert client.get({"$id": "ma1", "rec.*.name": True, "rec.*.deep": True}) == {"rec": {"k": {"name": "a"}, "l": {"name": "b", "deep": {"x": 2.0}}}}
    assert client.get({"$id": "ma1", "rec.k.value": True, "c": {"$value": {"a": [1, 2], "b": {"c": "d"}}}, "l": {"$value": [1, 2.5]}, "e": {"$value": []}, "f": {"$value": False}}) == {"rec": {"k": {"value": 1.0}}, "c": {"a": [1, 2], "b": {"c": "d"}}, "l": [1.0, 2.5], "e": [], "f": False}
    assert client.get({"$id": "ma2", "rec": {"*": {"name": True}}}) == {}


def test_inherited_lists_references_and_checks(client):
    got = client.get({"$id": "ma1", "menu": {"name": True, "$list": {"$inherit": {"$type": "sport"}, "$sort": {"$field": "name", "$order": "asc"}}}, "ids": {"$field": "menu", "$inherit": True}, "first": {"name": True, "$field": "menu", "$inherit": {"$type": "sport"}}})
    assert got == {"menu": [{"name": "another"}, {"name": "menu item"}], "ids": ["ma7", "ma8"], "first": [{"name": "menu item"}, {"name": "another"}]}
    assert client.get({"$id": "ma4", "menu": {"name": True, "$list": {"$inherit": {"$type": "sport"}}}}) == {"menu": []}
    with pytest.raises(QueryError):  # a string in one, a number in the other
        client.get({"$id": "ma1", "size": {"$inherit": {"$type": ["sport", "match"]}}})
    with pytest.raises(QueryError):
        client.get({"$id": "ma1", "rec": {"$list": {"$limit": 1, "$inherit": {"$merge": True}}}})
    assert client.get({"$id": "ma1", "$rawAncestors": True}) == {"rawAncestors": ["sp1", "root"]}
    found = client.get({"$id": "sp1", "x": {"id": True, "$list": {"$offset": -1, "$find": {"$traverse": "children"}}}})
    assert [x["id"] for x in found["x"]] == ["sp1", "ma1", "ma2"]
    listed = client.get({"$id": "root", "x": {"name": True, "$list": {"$find": {"$traverse": {"$db": "default", "$id": "sp1", "$field": "menu"}}}}})
    assert listed == {"x": [{"name": "menu item"}, {"name": "another"}]}


def test_time_based_refresh(client):
    client.set([{"$id": "ma1", "start": 5000}, {"$id": "ma2", "start": 7000}, {"$id": "ma4", "start": 6000}])
    query = {"$id": "sp1", "$includeMeta": True, "coming": {"id": True, "$list": {"$find": {"$traverse": "children", "$filter": [IS_MATCH, {"$field": "start", "$operator": ">", "$value": "now"}]}}}}
    assert client.get(query)["$meta"] == {"default": {}, "refreshAt": 5000}
    del query["$includeMeta"]
    seen = []
    client.observe(query).subscribe(lambda x: seen.append([y["id"] for y in x["coming"]]))
    assert client.refresh_due() == 5000 and seen == [["ma1", "ma2"]]
    client.now[0] = 5000
    assert client.refresh_due() == 7000 and seen == [["ma1", "ma2"], ["ma2"]]
    stop = threading.Event()
    client.now[0] = 7001
    runner = threading.Thread(target=client.keep_refreshing, args=(stop, 50))
    runner.start()
    for _ in range(600):
        if len(seen) == 3:
            break
        stop.wait(0.1)
    stop.set()
    runner.join()
    assert seen[-1] == [] and client.refresh_due() is None
    assert client.next_refresh({"$id": "root", "name": True}) is None


def test_diffs_schema_listeners_and_deletions(client):
    whole, patches, schemas, gone = [], [], [], []
    client.observe({"$id": "ma1", "name": True, "rec": True}).subscribe(whole.append, on_diff=lambda patch, was, now: patches.append(patch))
    client.set({"$id": "ma1", "rec": {"k": {"name": "new"}}, "name": "other"})
    assert live.apply_diff(whole[0], patches[0]) == whole[1] == {"name": "other", "rec": {"k": {"name": "new"}}}
    assert live.apply_diff(whole[1], live.diff(whole[1], whole[0])) == whole[0]
    end = client.observe_schema(lambda s: schemas.append(s.sha))
    client.update_schema({"types": {"sport": {"fields": {"city": S}}}})
    assert len(set(schemas)) == 2
    end()
    client.observe_event("deleted", {}, gone.append)
    assert client.delete({"$id": "sp2", "$returnIds": True}) == ["ma3", "ma4", "ma5", "sp2"]
    assert sorted(x["id"] for x in gone) == ["ma3", "ma4", "ma5", "sp2"] and client.delete("sp2") is False


def test_a_restarted_live_query_publishes_nothing_twice(spark, tmp_path):
    log, got = str(tmp_path / "log"), []
    row = lambda n, v: spark.createDataFrame([(n, "updated", f"ma{n}", "match", ["value"], None, '{"value": %d}' % v)], live.CHANGES)
    run = lambda: live.run_query(live.read_changes(spark, log), lambda batch: {"top": spark.read.parquet(log).count() > 1, "n": 1}, lambda n, v, patch: got.append((v, patch)), str(tmp_path / "c"), diffs=True).awaitTermination()
    for n in range(3):
        row(n, n).write.mode("append").parquet(log)
        run()  # each time by a new query object, as after a restart
    assert got == [({"top": False, "n": 1}, [("", {"top": False, "n": 1})]), ({"top": True, "n": 1}, [("top", True)])]


def test_object_commands_series_and_snapshots(client, spark, tmp_path):
    client.timeseries = str(tmp_path / "series")
    client.set({"$id": "ma1", "score": 4, "tags": ["a", "b"], "rec": {"k": {"name": "x"}}})
    client.set({"$id": "ma1", "score": 6})
    assert [(r.node_id, r.field, float(r.value)) for r in spark.read.parquet(client.timeseries).orderBy("value").collect()] == [("ma1", "score", 4.0), ("ma1", "score", 6.0)]
    ask = lambda *a: client.object(*a)
    assert [ask("len", "ma1", p) for p in ("name", "tags", "rec", "value", "ary")] == [2, 2, 1, 1, 0]
    assert [ask("type", "ma1", p) for p in ("name", "tags", "rec", "value", "start")] == ["string", "set", "object", "double", None]
    assert ask("get", "ma1", "rec.k.name") == "x" and ask("exists", "ma1", "ary") is False and ask("getmeta", "ma1", "rec") == "record" and ask("exists", "zz1") is None
    ask("set", "ma1", "name", "set")
    ask("del", "ma1", "tags")
    ask("setmeta", "ma1", "rec", "mine")
    assert client.get({"$id": "ma1", "name": True, "tags": True}) == {"name": "set"} and ask("getmeta", "ma1", "rec") == "mine"
    path = str(tmp_path / "graph")
    client.store().save(path)
    back = GraphStore.load(spark, path)
    back.with_(nodes={**back.nodes, "match": back.nodes["match"].where("id <> 'ma1'")}).save(path)  # over what it reads
    assert back.nodes["match"].count() == 7 and GraphStore.load(spark, path).nodes["match"].count() == 6
    back.backup(str(tmp_path / "b"), 10)
    back.with_(nodes={**back.nodes, "match": back.nodes["match"].limit(0)}).backup(str(tmp_path / "b"), 20)
    assert GraphStore.restore(spark, str(tmp_path / "b")).nodes["match"].count() == 0
    assert GraphStore.restore(spark, str(tmp_path / "b"), 15).nodes["match"].count() == 7


def test_edge_metadata(client):
    meta = lambda: {r.dst: r.meta for r in client.store().edge_rows("menu").where("src = 'sp1'").collect()}
    client.set({"$id": "sp1", "menu": {"$add": ["ma7"], "$edgeMeta": {"a": 1, "b": "x"}}})
    client.set({"$id": "sp1", "menu": {"$add": ["ma7"], "$edgeMeta": {"a": {"$increment": 2}, "b": {"$delete": True}, "c": {"$default": 5}}}})
    assert meta() == {"ma7": {"a": "3", "c": "5"}, "ma8": None}
    client.set({"$id": "sp1", "menu": {"$add": ["ma7"], "$edgeMeta": {"$delete": True}}})
    assert meta()["ma7"] is None


def test_plans(client):
    store = client.store()
    plan = client.compiler().filtered(store.nodes["match"].select("id", "type"), {"$field": "ancestors", "$operator": "has", "$value": "sp1"}, {"match"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3  # from the sport to its matches, and to the rows
    assert store.find(["ma1", "sp1", "zz"]).select("id").orderBy("id").collect() == [("ma1",), ("sp1",)]
