"""Schemas, filters and postfix expressions."""

import random

import pytest
from pyspark.sql import functions as F

from arborql.functions import filters, rpn
from arborql.schema import GraphSchema, SchemaError

SCHEMA = {"languages": ["en", "de"], "types": {"match": {"prefix": "ma", "fields": {"name": {"type": "string"}, "value": {"type": "number"}, "title": {"type": "text"}, "info": {"type": "object", "properties": {"a": {"type": "string"}}}, "rec": {"type": "record", "values": {"type": "int"}}, "ary": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "int"}}}}, "home": {"type": "reference"}}}}}


def test_schema_lookup_and_merge():
    s = GraphSchema.of(SCHEMA)
    assert s.lookup("match", "info.a") == {"type": "string"}
    assert s.lookup("match", "title.de") == {"type": "string"}
    assert s.lookup("match", "rec.any") == {"type": "int"}
    assert s.lookup("match", "ary[2].x") == {"type": "int"}
    assert s.lookup("match", "nope") is None and s.lookup("match", "name.x") is None
    assert s.type_of("ma12") == "match" and s.type_of("root") == "root" and s.type_of("zz") is None
    more, changes = s.merged({"languages": ["nl"], "types": {"team": {"prefix": "te", "fields": {"name": {"type": "string"}}}, "match": {"fields": {"info": {"type": "object", "properties": {"b": {"type": "int"}}}}}}})
    assert more.languages == ("en", "de", "nl") and not changes and more.sha != s.sha
    assert more.lookup("match", "info.a") and more.lookup("match", "info.b")
    for bad in ({"match": {"prefix": "xx"}}, {"other": {"prefix": "ma"}}, {"other": {"prefix": "ro"}}, {"match": {"fields": {"value": {"type": "string"}}}}, {"match": {"fields": {"bad.name": {"type": "string"}}}}):
        with pytest.raises(SchemaError):
            s.merged({"types": bad})
    assert s.merged({"types": {"match": {"fields": {"value": {"type": "string"}}}}}, True)[1][0]["mutation"] == "change_field"
    assert s.conform("match", {"$id": "ma1", "name": "x", "extra": 1, "info": {"a": "b", "c": 1}}) == {"$id": "ma1", "name": "x", "info": {"a": "b"}}


ROWS = [("a", 1.0, ["x", "y"], {"en": "hello", "de": "hallo"}), ("b", None, None, None), (None, 5.0, [], {"en": "world"}), ("abc", 3.0, ["z"], {})]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, s string, n double, tags array<string>, t map<string,string>").cache()


def leaf(field, op, value=None, **more):
    return {"$field": field, "$operator": op, **({} if value is None else {"$value": value}), **more}


@pytest.mark.parametrize(
    ("told", "want"),
    [
        (leaf("s", "=", "a"), [0]),
        (leaf("s", "=", ["a", "b"]), [0, 1]),
        (leaf("s", "!=", "a"), [1, 2, 3]),  # missing fields differ from everything
        (leaf("s", "!=", ["a", "b"]), [2, 3]),
        (leaf("n", "=", 5), [2]),
        (leaf("n", "!=", 5), [0, 1, 3]),
        (leaf("n", ">", 1), [2, 3]),
        (leaf("n", "<", 5), [0, 3]),
        (leaf("n", "..", [1, 3]), [0, 3]),
        (leaf("s", "exists"), [0, 1, 3]),
        (leaf("s", "notExists"), [2]),
        (leaf("s", "includes", "b"), [1, 3]),
        (leaf("tags", "has", "x"), [0]),
        (leaf("tags", "has", ["y", "z"]), [0, 3]),
        (leaf("nope", "=", 1), []),
        (leaf("nope", "!=", 1), [0, 1, 2, 3]),
        ([leaf("n", ">", 1), leaf("s", "exists")], [3]),
        (leaf("n", "=", 5, **{"$or": leaf("s", "=", "a")}), [0, 2]),
        (leaf("n", ">", 0, **{"$and": leaf("s", "=", "a"), "$or": leaf("n", "=", 3)}), [0, 3]),
        (leaf("t", "=", "world"), [2]),
        (leaf("n", ">", "now-2"), [2, 3]),
        (leaf("s", "textSearch", "ABC"), [3]),
    ],
)
def test_filters(rows, told, want):
    kinds = {"t": "text"}
    f = filters.Fields(lambda p: F.col(p) if p in rows.columns else None, kinds.get, None, None, now_ms=4)
    assert [r.i for r in rows.where(filters.condition(filters.tree(told), f)).orderBy("i").collect()] == want


def test_compat_reduction():
    both = [leaf("n", ">", 1), leaf("n", "<", 3)]
    assert filters.tree(both, True).parts == [filters.Leaf("n", "..", [1, 3])]
    assert len(filters.tree(both).parts) == 2
    assert filters.tree([leaf("n", "exists"), leaf("n", "notExists")], True) is None
    assert filters.tree([leaf("n", ">", 1), leaf("n", ">", 4)], True).parts == [filters.Leaf("n", ">", 4)]
    assert filters.types_of(filters.tree([leaf("type", "=", "a"), leaf("n", ">", 1)]), {"a", "b"}) == {"a"}
    for bad in ({"$field": "a"}, {"$field": "a", "$operator": "~", "$value": 1}, leaf("a", ">"), leaf("a", "..", 1)):
        with pytest.raises(filters.FilterError):
            filters.parse(bad)


@pytest.mark.parametrize(
    ("text", "registers", "want"),
    [
        ("#1 R A", [], 2),
        ("@2 #1 A @2 #2 A @1 T", [0, 3], 4),
        ("@2 #1 A @2 #2 A @1 T", [1, 3], 5),
        ("#7 @1 I >4 @1 #0 D Z .4: @1 #2 D", [3], 0),
        ("#7 @1 I >4 @1 #0 D Z .4: @1 #2 D", [9], 18),
        ("#2 #3 V A D", [], 10),
        ("@3 @2 @1 W B D", [10, 4, 5], 20),
        ("#4 #-9 E", [], -1),
        ("#0 #1 C", [], float("inf")),
        ("#0.5 L", [], 1),  # 0.5 counts as false
        ("#1 #2 N #0 M", [], 0),
        ("#1 P #7", [], 7),
        ("#0 P #7", [], 0),
        ("#3 Q #7", [], 3),
        ("#1 #5 #3 i", [], 0),
        ("#5 #3 #1 i", [], 1),
        ('"ab" "cab" m', [], 1),
        ('"x" {"x","y"} a', [], 1),
        ('{"a","b"} {"a"} l', [], 1),
        ('"missing" g #1 G', [], 1),
        ('"missing" g #1 F', [], 0),
    ],
)
def test_postfix_numbers(spark, text, registers, want):
    node = rpn.Node(column=lambda p: None)
    got = spark.range(1).select(rpn.rpn_double(text, [None, *registers], node).alias("x")).first().x
    assert got == want


def test_postfix_sets_and_errors(spark):
    one = spark.range(1)
    assert one.select(rpn.rpn_set('{"b"} {"a","b"} z').alias("x")).first().x == ["a", "b"]
    rec = F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(2), F.lit("e"), F.lit(3))
    node = rpn.Node(column=lambda p: {"rec": rec, "f": F.lit("v")}.get(p))
    assert one.select(rpn.rpn_set('"d" "lJ" "rec" o', None, node).alias("x")).first().x == ["rec.c"]
    assert one.select(rpn.rpn_set('{"zz","f"} j', None, node).alias("x")).first().x == ["f"]
    assert one.select(rpn.rpn_set('{"zz","f"} k', None, node).alias("x")).first().x == []
    for bad in ("A", "#1 ~", "", "@9", "#1 >7"):
        with pytest.raises(rpn.RpnError):
            rpn.compile_rpn(bad, [None])


def test_postfix_equals_plain_python(spark):
    r = random.Random(1)
    for _ in range(12):
        stack, parts = [], []
        for _ in range(r.randrange(3, 9)):
            if len(stack) < 2 or r.random() < 0.5:
                x = float(r.randrange(-5, 6))
                parts.append(f"#{x}")
                stack.append(x)
            else:
                op = r.choice("ABDHI")
                a, b = stack.pop(), stack.pop()
                stack.append({"A": a + b, "B": a - b, "D": a * b, "H": float(a < b), "I": float(a > b)}[op])
                parts.append(op)
        assert spark.range(1).select(rpn.rpn_double(" ".join(parts)).alias("x")).first().x == stack[-1]
