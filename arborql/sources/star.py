"""A graph over the star schema tables: regions, nations, customers, suppliers, orders, line items, parts, events, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GraphSchema
from .store import ROOT, GraphStore

_N, _S, _L, _TS = {"type": "number"}, {"type": "string"}, {"type": "int"}, {"type": "timestamp"}
SCHEMA = {
    "languages": ["en", "de", "fr", "es"],
    "types": {
        "region": {"prefix": "re", "fields": {"regionname": _S}},
        "nation": {"prefix": "na", "fields": {"nationname": _S}},
        "customer": {"prefix": "cu", "fields": {"name": _S, "acctbal": _N, "segment": _S, "orders": {"type": "references"}}},
        "supplier": {"prefix": "su", "fields": {"name": _S, "acctbal": _N}},
        "orders": {"prefix": "or", "fields": {"status": _S, "totalprice": _N, "orderdate": _TS, "priority": _S, "customer": {"type": "reference"}}},
        "lineitem": {"prefix": "li", "fields": {"linenumber": _L, "quantity": _N, "price": _N, "discount": _N, "returnflag": _S, "linestatus": _S, "shipdate": _TS, "part": {"type": "reference"}}},
        "part": {"prefix": "pa", "fields": {"name": _S, "brand": _S, "kind": _S, "size": _L, "retailprice": _N}},
        "event": {"prefix": "ev", "fields": {"ts": _TS, "user": _L, "eventtype": _S, "value": _N, "props": {"type": "json"}}},
        "document": {"prefix": "do", "fields": {"body": {"type": "text"}, "lang": _S, "source": _S, "n_chars": _L, "quality": _L, "toxic": _L}},
    },
}


def _id(prefix: str, *columns: str):
    return F.concat(F.lit(prefix), F.concat_ws("_", *(F.col(c).cast("string") for c in columns)))


def lineitem_id():
    """Six columns are needed: order and line number are not unique."""
    return F.concat(F.lit("li"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")))


_SCHEMAS: dict[tuple[str, str], object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its footer is read for the schema once in an application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(key[1]).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(key[1])


def star_graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The snapshot over sf_dir; nothing is read until a query needs it."""
    read = lambda t: read_table(spark, sf_dir, t)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    typed = lambda df, t, i, **f: df.select(i.alias("id"), F.lit(t).alias("type"), *(c.alias(k) for k, c in f.items()))
    c = F.col
    region, nation, customer, supplier, orders, item, part, event, document = (read(t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "part", "events", "documents"))
    labels = read("labels")
    judged = document.join(labels, "doc_id", "left")
    made, wide = {}, {}

    def node(t, df, key, prefix, up, **f):
        """The typed frame, with its parents and references, and how to read some of its ids by the integer key."""
        wide[t] = typed(df, t, _id(prefix, key), **f, **up)
        made[t] = lambda ids: typed(df.where(c(key).isin([int(i[2:]) for i in ids if i[2:].isascii() and i[2:].isdigit() and str(int(i[2:])) == i[2:]])), t, _id(prefix, key), **f)
        return typed(df, t, _id(prefix, key), **f)

    top = {"^root": F.lit(ROOT)}
    line = {"linenumber": c("l_linenumber").cast("long"), "quantity": c("l_quantity"), "price": c("l_extendedprice"), "discount": c("l_discount"), "returnflag": c("l_returnflag"), "linestatus": c("l_linestatus"), "shipdate": ms("l_shipdate")}
    wide["lineitem"] = typed(item, "lineitem", lineitem_id(), **line, **{"^orders": _id("or", "l_orderkey"), "^supplier": _id("su", "l_suppkey"), "@part": _id("pa", "l_partkey")})
    nodes = {
        "root": spark.range(1).select(F.lit(ROOT).alias("id"), F.lit(ROOT).alias("type")),
        "region": node("region", region, "r_regionkey", "re", top, regionname=c("r_name")),
        "nation": node("nation", nation, "n_nationkey", "na", {"^region": _id("re", "n_regionkey")}, nationname=c("n_name")),
        "customer": node("customer", customer, "c_custkey", "cu", {"^nation": _id("na", "c_nationkey")}, name=c("c_name"), acctbal=c("c_acctbal"), segment=c("c_mktsegment")),
        "supplier": node("supplier", supplier, "s_suppkey", "su", {"^nation": _id("na", "s_nationkey")}, name=c("s_name"), acctbal=c("s_acctbal")),
        "orders": node("orders", orders, "o_orderkey", "or", {"^customer": _id("cu", "o_custkey"), "@customer": _id("cu", "o_custkey")}, status=c("o_orderstatus"), totalprice=c("o_totalprice"), orderdate=ms("o_orderdate"), priority=c("o_orderpriority")),
        "lineitem": typed(item, "lineitem", lineitem_id(), **line),
        "part": node("part", part, "p_partkey", "pa", top, name=c("p_name"), brand=c("p_brand"), kind=c("p_type"), size=c("p_size").cast("long"), retailprice=c("p_retailprice")),
        "event": node("event", event, "event_id", "ev", top, ts=ms("ts"), user=c("user_id"), eventtype=c("event_type"), value=c("value"), props=c("props")),
        "document": node("document", judged, "doc_id", "do", top, body=F.create_map("lang", "text"), lang=c("lang"), source=c("source"), n_chars=c("n_chars"), quality=c("quality").cast("long"), toxic=c("toxic").cast("long")),
    }
    link = lambda df, a, b: df.select(a.alias("parent"), b.alias("child"))
    root = F.lit(ROOT)
    links = {
        ("root", "region"): link(region, root, _id("re", "r_regionkey")),
        ("region", "nation"): link(nation, _id("re", "n_regionkey"), _id("na", "n_nationkey")),
        ("nation", "customer"): link(customer, _id("na", "c_nationkey"), _id("cu", "c_custkey")),
        ("nation", "supplier"): link(supplier, _id("na", "s_nationkey"), _id("su", "s_suppkey")),
        ("customer", "orders"): link(orders, _id("cu", "o_custkey"), _id("or", "o_orderkey")),
        ("orders", "lineitem"): link(item, _id("or", "l_orderkey"), lineitem_id()),
        ("supplier", "lineitem"): link(item, _id("su", "l_suppkey"), lineitem_id()),
        ("root", "part"): link(part, root, _id("pa", "p_partkey")),
        ("root", "event"): link(event, root, _id("ev", "event_id")),
        ("root", "document"): link(document, root, _id("do", "doc_id")),
    }
    none = F.lit(None).cast("map<string,string>")
    edge = lambda df, s, f, d, meta=none: df.select(s.alias("src"), F.lit(f).alias("field"), F.lit(None).cast("string").alias("key"), d.alias("dst"), meta.alias("meta"))
    meta = F.create_map(F.lit("quantity"), c("l_quantity").cast("string"), F.lit("discount"), c("l_discount").cast("string"))
    edges = {
        ("lineitem", "part", "part"): edge(item, lineitem_id(), "part", _id("pa", "l_partkey"), meta),
        ("customer", "orders", "orders"): edge(orders, _id("cu", "o_custkey"), "orders", _id("or", "o_orderkey")),
        ("orders", "customer", "customer"): edge(orders, _id("or", "o_orderkey"), "customer", _id("cu", "o_custkey")),
    }
    aliases = region.select(F.col("r_name").alias("alias"), _id("re", "r_regionkey").alias("node_id"))
    return GraphStore(spark, GraphSchema.of(SCHEMA), nodes, links, edges, aliases, frozenset(links), made, wide)


def with_line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as an array of objects: id, items."""
    item = read_table(spark, sf_dir, "lineitem")
    one = F.struct(F.col("l_linenumber").cast("long").alias("linenumber"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("returnflag"))
    return item.groupBy(_id("or", "l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("items"))
