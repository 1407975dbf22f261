"""The registered queries over the star schema graph, each with the SQL that says the same over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rpn
from ..functions.filters import Fields, condition, tokens, tree
from ..operators import aggregate as agg
from ..operators import inherit as inh
from ..operators import mutate, order
from ..operators import traverse as tr
from ..operators.tables import new_path
from ..schema import GraphSchema
from ..sources.star import star_graph, with_line_arrays
from ..sources.store import GraphStore
from ..streaming import live
from ..streaming.live import fires, refresh_at

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400_000
NOW = 852_076_800_000  # 1997-01-01, so that results don't depend on the day


def registered(sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _root(g: GraphStore) -> DataFrame:
    return tr.starts(g, ["root"])


def _where(g: GraphStore, rows: DataFrame, told, **options) -> DataFrame:
    from .compile import Compiler

    c = Compiler(g, **options)
    return rows.where(condition(tree(told), Fields(lambda p: c.path(rows, p), c.kind, None, options.get("language"), options.get("now_ms"))))


def _below(g: GraphStore, ids: DataFrame, source: str, target: str, needed: set[str]) -> DataFrame:
    """Descendants of one type with the columns needed: start_id, id, ... ."""
    return tr.descendants(g, ids, {source}, {target}, each_once=True, columns=tuple(sorted(needed)))


def _items(df: DataFrame, name: str) -> DataFrame:
    """The items of a list in a result, as rows."""
    return df.select(F.explode(name).alias("x")).select("x.*")


def _shown(g: GraphStore, rows: DataFrame, spec: dict, types: set[str]) -> DataFrame:
    """A projection of many nodes at once."""
    from .compile import Compiler

    rows, out = Compiler(g).project(rows.withColumn("nid", F.col("id")), spec, types)
    return rows.select(*(c.alias(k) for k, c in out.items()))


def _get(g: GraphStore, query: dict) -> DataFrame:
    from .compile import Compiler

    return Compiler(g, now_ms=NOW).get(query)


def _client(spark: SparkSession, g: GraphStore):
    from ..client import GraphClient

    return GraphClient(spark, g.schema, g, clock=lambda: NOW)


def _find(find: dict, **more) -> dict:
    return {"id": True, **more, "$list": {"$find": find}}


def _typed(t: str, *filters: dict) -> list[dict]:
    return [_f("type", "=", t), *filters]


def _all(g: GraphStore, t: str) -> DataFrame:
    return g.nodes[t].select(F.col("id").alias("start_id"), "id")


_LI = "concat('li', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', CAST(epoch(l_shipdate) AS BIGINT), '_', CAST(round(l_extendedprice * 100) AS BIGINT))"
_LINKS = f"SELECT 'root' AS p, concat('re', r_regionkey) AS c FROM region UNION ALL SELECT concat('re', n_regionkey), concat('na', n_nationkey) FROM nation UNION ALL SELECT concat('na', c_nationkey), concat('cu', c_custkey) FROM customer UNION ALL SELECT concat('na', s_nationkey), concat('su', s_suppkey) FROM supplier UNION ALL SELECT concat('cu', o_custkey), concat('or', o_orderkey) FROM orders UNION ALL SELECT concat('or', l_orderkey), {_LI} FROM lineitem UNION ALL SELECT concat('su', l_suppkey), {_LI} FROM lineitem"
_MS = "epoch_ms({}::TIMESTAMP)"


# sources and lookups


@registered("SELECT concat('na', n_nationkey) AS id, n_name AS nationname FROM nation WHERE n_nationkey = 3")
def s_lookup_id(spark, d):
    return _get(star_graph(spark, d), {"$id": "na3", "id": True, "nationname": True})


@registered("SELECT concat('na', n_nationkey) AS id FROM nation WHERE n_nationkey = 7")
def s_lookup_first_of(spark, d):
    return _get(star_graph(spark, d), {"$id": ["na999", "na7", "na3"], "id": True})


@registered("SELECT 'x' AS id WHERE false")
def s_not_found(spark, d):
    return _get(star_graph(spark, d), {"$id": "na999", "id": True})


@registered("SELECT concat('re', r_regionkey) AS id, r_name AS regionname FROM region WHERE r_name = 'ASIA'")
def q_alias_lookup(spark, d):
    return _get(star_graph(spark, d), {"$alias": ["nobody", "ASIA", "EUROPE"], "id": True, "regionname": True})


@registered("SELECT concat('pa', p_partkey) AS id, p_size::BIGINT AS size FROM part WHERE p_partkey IN (1, 5, 9)")
def s_id_list(spark, d):
    return _items(_get(star_graph(spark, d), {"found": _find({"$traverse": ["pa1", "pa5", "pa9", "panone"]}, size=True)}), "found")


@registered("SELECT concat('na', n_nationkey) AS start_id, concat('cu', c_custkey) AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (3, 5)")
def s_multi_start(spark, d):
    g = star_graph(spark, d)
    return tr.one_hop(tr.starts(g, ["na3", "na5", "na999"]), tr.child_hops(g), {"customer"}, {"nation"}).select("start_id", "id")


@registered("SELECT * FROM (VALUES ('customer', 'cu'), ('document', 'do'), ('event', 'ev'), ('lineitem', 'li'), ('nation', 'na'), ('orders', 'or'), ('part', 'pa'), ('region', 're'), ('root', 'ro'), ('supplier', 'su')) AS t(type, prefix)")
def s_registry(spark, d):
    return star_graph(spark, d).registry().select("type", "prefix")


@registered("SELECT concat('ev', event_id) AS id, epoch_us(ts::TIMESTAMP) // 1000 AS raw, props FROM events")
def s_raw_field(spark, d):
    g = star_graph(spark, d)
    return _shown(g, g.nodes["event"], {"id": True, "raw": {"$raw": "ts"}, "props": {"$raw": True}}, {"event"})


@registered("SELECT 'part' AS type, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'links', count(*) FROM customer UNION ALL SELECT 'edges', count(*) FROM orders")
def s_save_load(spark, d):
    """A snapshot of the tables written and read back."""
    g = star_graph(spark, d)
    some = g.with_(nodes={t: g.nodes[t] for t in ("root", "part", "supplier", "customer")}, links={k: g.links[k] for k in [("nation", "customer")]}, edges={k: g.edges[k] for k in [("customer", "orders", "orders")]})
    path = new_path(spark, "snapshot")
    some.save(path)
    back = GraphStore.load(spark, path)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), "n")
    return count(back.nodes["part"], "part").unionByName(count(back.nodes["supplier"], "supplier")).unionByName(count(back.nodes["customer"], "customer")).unionByName(count(back.hierarchy(), "links")).unionByName(count(back.edge_rows("orders"), "edges"))


@registered("SELECT 'value' AS field, count(*) AS n, sum(value) AS total FROM events")
def s_timeseries(spark, d):
    g = star_graph(spark, d)
    path = new_path(spark, "series")
    g.append_timeseries(g.nodes["event"].select(F.concat(F.lit("us"), F.col("user").cast("string")).alias("node_id"), F.lit("value").alias("field"), "ts", "value"), path)
    return spark.read.parquet(path).groupBy("field").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@registered(f"SELECT 'props' AS path, 'string' AS type, length(props)::BIGINT AS len FROM events WHERE event_id = 5 UNION ALL SELECT 'value', 'double', 1 FROM events WHERE event_id = 5")
def s_object_commands(spark, d):
    from ..functions import objects

    g = star_graph(spark, d)
    parts = [objects.read(g, "type", "ev5", p).select(F.lit(p).alias("path"), F.col("value").alias("type")).join(objects.read(g, "len", "ev5", p).select(F.col("value").alias("len"))) for p in ("props", "value")]
    return parts[0].unionByName(parts[1])


@registered("SELECT 'root' AS id")
def s_heads(spark, d):
    return star_graph(spark, d).heads().select("id")


@registered("SELECT concat('cu', o_custkey) AS src, concat('or', o_orderkey) AS dst FROM orders")
def s_edge_list(spark, d):
    return star_graph(spark, d).edge_rows("orders", {"customer"}).select("src", "dst")


@registered(f"SELECT {_LI} AS src, l_quantity AS quantity, l_discount AS discount FROM lineitem WHERE l_quantity >= 49")
def s_edge_metadata(spark, d):
    e = star_graph(spark, d).edge_rows("part", {"lineitem"})
    return e.where(F.col("meta")["quantity"].cast("double") >= 49).select("src", F.col("meta")["quantity"].cast("double").alias("quantity"), F.col("meta")["discount"].cast("double").alias("discount"))


@registered("SELECT c_mktsegment AS segment, count(*) AS n, sum(CASE WHEN c_acctbal IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS present FROM customer GROUP BY 1")
def s_field_read(spark, d):
    g = star_graph(spark, d)
    rows = _shown(g, g.nodes["customer"], {"segment": True, "balance": {"$field": ["nope", "acctbal"]}}, {"customer"})
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.count("balance").alias("present"))


# traversals


@registered("SELECT concat('re', n_regionkey) AS start_id, concat('na', n_nationkey) AS id FROM nation")
def q_children(spark, d):
    g = star_graph(spark, d)
    return tr.one_hop(_all(g, "region"), tr.child_hops(g), sources={"region"}).select("start_id", "id")


@registered(f"SELECT {_LI} AS start_id, concat('or', l_orderkey) AS id FROM lineitem UNION ALL SELECT {_LI}, concat('su', l_suppkey) FROM lineitem")
def q_parents(spark, d):
    g = star_graph(spark, d)
    return tr.one_hop(_all(g, "lineitem"), tr.parent_hops(g), sources={"lineitem"}).select("start_id", "id")


@registered("""
WITH a AS (SELECT concat('or', o_orderkey) AS start_id, o_custkey, c_nationkey, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT start_id, concat('cu', o_custkey) AS id, 1 AS depth FROM a UNION ALL SELECT start_id, concat('na', c_nationkey), 2 FROM a UNION ALL SELECT start_id, concat('re', n_regionkey), 3 FROM a UNION ALL SELECT start_id, 'root', 4 FROM a
""")
def q_ancestors(spark, d):
    g = star_graph(spark, d)
    return tr.ancestors(g, _all(g, "orders"), {"orders"}).select("start_id", "id", "depth")


@registered("""
SELECT DISTINCT concat('na', k) AS start_id, concat('or', l_orderkey) AS order_id FROM (
  SELECT c_nationkey AS k, l_orderkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49
  UNION SELECT s_nationkey, l_orderkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity > 49)
""")
def q_descendants_filter(spark, d):
    g = star_graph(spark, d)
    items = _where(g, _below(g, _all(g, "nation"), "nation", "lineitem", {"quantity", "^orders"}), {"$field": "quantity", "$operator": ">", "$value": 49})
    return items.select("start_id", F.col("^orders").alias("order_id")).distinct()


@registered("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM part) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) AS n")
def q_descendants_all(spark, d):
    g = star_graph(spark, d)
    return tr.descendants(g, _root(g), {"root"}, each_once=True).agg(F.count("*").alias("n"))


@registered("WITH RECURSIVE e AS (" + _LINKS + ") , r AS (SELECT c AS id FROM e WHERE p = 're1' UNION SELECT e.c FROM r JOIN e ON e.p = r.id) SELECT id FROM r")
def q_descendants_loop(spark, d):
    """By the loop that graphs with cycles take: one level after the other over all links."""
    g = star_graph(spark, d)
    return tr.bfs(g, tr.starts(g, ["re1"]), tr.child_hops(g), None).select("id")


@registered("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM part) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + 1 AS n")
def q_every_node(spark, d):
    return tr.every_node(star_graph(spark, d)).agg(F.count("*").alias("n"))


@registered("SELECT id, row_number() OVER (ORDER BY path)::INTEGER AS nth FROM (SELECT concat('re', r_regionkey) AS id, concat('re', r_regionkey) AS path FROM region UNION ALL SELECT concat('na', n_nationkey), concat('re', n_regionkey, chr(1), 'na', n_nationkey) FROM nation)")
def q_depth_first(spark, d):
    from pyspark.sql import Window

    g = star_graph(spark, d)
    rows = tr.descendants(g, _root(g), {"root"}, {"region", "nation"}, paths=True)
    return tr.depth_first(rows).select("id", F.row_number().over(Window.orderBy("order_key")).alias("nth"))


@registered("SELECT concat('re', n_regionkey) AS start_id, concat('na', n_nationkey) AS id FROM nation")
def q_set_of_ids(spark, d):
    """Along ids kept as data in a set field; an id of no node is skipped."""
    g = star_graph(spark, d)
    members = g.links["region", "nation"].groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("members"))
    region = g.nodes["region"].join(members, F.col("id") == F.col("parent")).select("id", "type", F.concat("members", F.array(F.lit("nanone"))).alias("members"))
    g = g.with_(nodes={**g.nodes, "region": region})
    return tr.one_hop(_all(g, "region"), tr.field_hops(g, "members"), sources={"region"}).select("start_id", "id")


@registered("SELECT concat('or', o_orderkey) AS id, o_totalprice AS totalprice FROM orders WHERE o_custkey = 4")
def q_traverse_listed_ids(spark, d):
    """The ids that a field of a node of another database lists."""
    g = star_graph(spark, d)
    from .compile import Compiler

    c = Compiler(g, others={"other": star_graph(spark, d)})
    return _items(c.get({"found": _find({"$traverse": {"$db": "other", "$id": "cu4", "$field": "orders"}}, totalprice=True)}), "found")


@registered("SELECT concat('na', n_nationkey) AS id, r_name AS far FROM nation, region WHERE r_regionkey = 2 AND n_nationkey = 6")
def q_databases(spark, d):
    from .compile import Compiler

    c = Compiler(star_graph(spark, d), others={"other": star_graph(spark, d)})
    return c.get({"$id": "na6", "id": True, "there": {"$db": "other", "$id": "re2", "regionname": True}}).select("id", F.col("there.regionname").alias("far"))


@registered("SELECT concat('na', n_nationkey) AS id FROM nation WHERE n_nationkey = 3")
def q_node_only(spark, d):
    return _items(_get(star_graph(spark, d), {"$id": "na3", "found": _find({"$traverse": "node"})}), "found")


@registered("SELECT concat('or', o_orderkey) AS start_id, concat('cu', o_custkey) AS id FROM orders")
def q_edge_field(spark, d):
    g = star_graph(spark, d)
    return tr.one_hop(_all(g, "orders"), tr.edge_hops(g, "customer"), sources={"orders"}).select("start_id", "id")


@registered("SELECT concat('cu', c_custkey) AS start_id, concat('cu', c_custkey) AS id, 0 AS depth FROM customer UNION ALL SELECT concat('cu', o_custkey), concat('or', o_orderkey), 1 FROM orders")
def q_bfs_edge(spark, d):
    g = star_graph(spark, d)
    return tr.bfs(g, _all(g, "customer"), tr.edge_hops(g, "orders"), {"customer"}, include_head=True).select("start_id", "id", "depth")


@registered(f"SELECT {_LI} AS start_id, concat('pa', l_partkey) AS id FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
def q_edge_filter(spark, d):
    g = star_graph(spark, d)
    node = lambda e: rpn.Node(column=lambda p: e["meta"][p])
    test = lambda e: rpn.rpn_bool('#45 "quantity" g I #0.05 "discount" g K M', [None], node(e))
    return tr.one_hop(_all(g, "lineitem"), tr.edge_hops(g, "part", test), sources={"lineitem"}).select("start_id", "id")


@registered("SELECT concat('na', c_nationkey) AS start_id, concat('cu', c_custkey) AS id FROM customer UNION ALL SELECT concat('na', s_nationkey), concat('su', s_suppkey) FROM supplier UNION ALL SELECT concat('or', o_orderkey), concat('cu', o_custkey) FROM orders")
def q_expr_by_type(spark, d):
    g = star_graph(spark, d)
    rows = _all(g, "nation").unionByName(_all(g, "orders")).unionByName(_all(g, "region"))
    return tr.by_expression(g, rows, {"$any": False, "nation": "children", "orders": "customer"}).select("start_id", "id")


@registered("SELECT concat('cu', o_custkey) AS start_id, concat('or', o_orderkey) AS id FROM orders UNION ALL SELECT concat('cu', c_custkey), concat('na', c_nationkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_expr_first(spark, d):
    g = star_graph(spark, d)
    return tr.by_expression(g, _all(g, "customer"), {"customer": {"$first": ["orders", "parents"]}}, {"customer"}).select("start_id", "id")


@registered("SELECT concat('cu', o_custkey) AS start_id, concat('or', o_orderkey) AS id FROM orders UNION SELECT concat('cu', c_custkey), concat('na', c_nationkey) FROM customer")
def q_expr_all(spark, d):
    g = star_graph(spark, d)
    return tr.by_expression(g, _all(g, "customer"), {"$any": {"$all": ["orders", "parents", "children"]}}, {"customer"}).select("start_id", "id")


@registered("SELECT DISTINCT concat('re', n_regionkey) AS start_id, concat('or', o_orderkey) AS id FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey UNION SELECT concat('re', n_regionkey), concat('na', n_nationkey) FROM nation UNION SELECT concat('re', n_regionkey), concat('cu', c_custkey) FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT concat('re', n_regionkey), concat('su', s_suppkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def q_bfs_expression(spark, d):
    g = star_graph(spark, d)
    return tr.bfs_expression(g, _all(g, "region"), {"$any": False, "region": "children", "nation": "children", "customer": {"$first": ["orders"]}}, {"region"}).select("start_id", "id")


@registered("SELECT concat('na', c_nationkey) AS start_id, concat('or', o_orderkey) AS id, o_totalprice AS totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice > 100000")
def q_nested_find(spark, d):
    from .compile import Compiler

    g = star_graph(spark, d)
    find = {"$traverse": "children", "$filter": [{"$field": "type", "$operator": "=", "$value": "customer"}, {"$field": "acctbal", "$operator": ">", "$value": 9000}], "$find": {"$traverse": "children", "$filter": {"$field": "totalprice", "$operator": ">", "$value": 100000}}}
    rows, _ = Compiler(g).found(_all(g, "nation"), {"nation"}, find, {"totalprice"})
    return rows.select("start_id", "id", "totalprice")


@registered("SELECT concat('or', l_orderkey) AS id, l_linenumber::BIGINT AS linenumber, l_quantity AS quantity FROM lineitem WHERE l_quantity >= 48")
def q_array_traverse(spark, d):
    g, rows = _with_items(spark, d)
    rows = _shown(g, rows, {"id": True, "items": {"linenumber": True, "quantity": True, "$list": {"$find": {"$traverse": "items", "$filter": _f("quantity", ">", 47.5)}}}}, {"orders"})
    return rows.select("id", F.explode("items").alias("x")).select("id", "x.*")


@registered("SELECT id, pos, n, q FROM (SELECT concat('or', l_orderkey) AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_extendedprice, l_returnflag)::INTEGER - 1 AS pos, l_linenumber::BIGINT AS n, l_quantity AS q FROM lineitem WHERE l_returnflag <> 'A') WHERE pos BETWEEN 1 AND 2")
def q_array_sort_limit(spark, d):
    g, rows = _with_items(spark, d)
    told = {"n": {"$field": "linenumber"}, "q": {"$field": "quantity"}, "$list": {"$sort": {"$field": "quantity", "$order": "desc"}, "$offset": 1, "$limit": 2, "$find": {"$traverse": "items", "$filter": _f("returnflag", "!=", "A")}}}
    rows = _shown(g, rows, {"id": True, "items": told}, {"orders"})
    return rows.select("id", F.posexplode("items").alias("pos", "x")).select("id", (F.col("pos") + 1).alias("pos"), "x.*")


@registered("SELECT concat('or', l_orderkey) AS id, count(*) AS n, sum(l_quantity) AS total, max(l_extendedprice) AS top, avg(l_quantity) AS mean, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def q_array_aggregate(spark, d):
    g, rows = _with_items(spark, d)
    told = lambda f, *a: {"$aggregate": {"$function": {"$name": f, "$args": list(a)}, "$traverse": "items"}}
    return _shown(g, rows, {"id": True, "n": told("count"), "total": told("sum", "quantity"), "top": told("max", "price"), "mean": told("avg", "nope", "quantity"), "flags": told("countUnique", "returnflag")}, {"orders"})


@registered("SELECT concat('do', doc_id) AS id, lang, source, n_chars AS n FROM documents WHERE lang IS NOT NULL")
def q_record_wildcard(spark, d):
    """All keys of a record, with some fields of each value."""
    g = star_graph(spark, d)
    rows = g.nodes["document"].where("lang is not null").select("id", "type", F.create_map("lang", F.struct("source", F.col("n_chars").alias("n"), F.lit("x").alias("more"))).alias("rec"))
    one = _shown(g, rows, {"id": True, "rec": {"*": {"source": True, "n": True}}}, {"document"})
    return one.select("id", F.explode("rec").alias("lang", "x")).select("id", "lang", "x.*")


@registered("SELECT concat('do', doc_id) AS id, lang, n_chars AS n FROM documents WHERE lang IS NOT NULL")
def q_record_wildcard_path(spark, d):
    g = star_graph(spark, d)
    rows = g.nodes["document"].where("lang is not null").select("id", "type", F.create_map("lang", F.struct("source", F.col("n_chars").alias("n"))).alias("rec"))
    one = _shown(g, rows, {"id": True, "rec.*.n": True, "all": {"$field": "rec.*.n"}}, {"document"})
    return one.select("id", F.explode("rec").alias("lang", "x"), "all").where(F.col("all")[F.col("lang")] == F.col("x.n")).select("id", "lang", "x.n")


@registered("SELECT concat('or', l_orderkey) AS id, arg_max(l_linenumber, (l_linenumber, l_quantity))::BIGINT AS last FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_orderkey")
def q_record_key_leq(spark, d):
    g = with_line_arrays(spark, d)
    record = g.select("id", F.map_from_arrays(F.array_distinct(F.transform("items", lambda x: x["linenumber"].cast("string"))), F.array_distinct(F.transform("items", lambda x: x["linenumber"]))).alias("rec"))
    keys = rpn.record_keys(F.col("rec"), "lJ", F.lit("4"))
    return record.where(F.size(keys) > 0).select("id", F.get(keys, 0).cast("long").alias("last"))


def _with_items(spark, d) -> tuple[GraphStore, DataFrame]:
    """The graph whose orders have their line items as an array of objects, and these orders."""
    g = star_graph(spark, d)
    rows = with_line_arrays(spark, d).withColumn("type", F.lit("orders"))
    return g.with_(nodes={**g.nodes, "orders": rows}), rows


# filters


def _filter_query(name: str, t: str, told, sql: str, columns: tuple[str, ...] = ("id",), **options):
    def run(spark, d):
        g = star_graph(spark, d)
        return _where(g, g.nodes[t], told, **options).select(*columns)

    run.__name__ = name
    registered(sql)(run)


def _f(field, operator, value=None, **more):
    return {"$field": field, "$operator": operator, **({"$value": value} if value is not None else {}), **more}


_filter_query("q_eq_string", "customer", _f("segment", "=", "BUILDING"), "SELECT concat('cu', c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
_filter_query("q_eq_number", "part", _f("size", "=", 7), "SELECT concat('pa', p_partkey) AS id FROM part WHERE p_size = 7")
_filter_query("q_eq_list", "orders", _f("priority", "=", ["1-URGENT", "2-HIGH"]), "SELECT concat('or', o_orderkey) AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter_query("q_ne_missing", "document", _f("quality", "!=", 1), "SELECT concat('do', doc_id) AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
_filter_query("q_ne_list", "document", _f("lang", "!=", ["en", "fr"]), "SELECT concat('do', doc_id) AS id FROM documents WHERE lang NOT IN ('en', 'fr')")
_filter_query("q_range_incl", "orders", _f("totalprice", "..", [50000, 60000]), "SELECT concat('or', o_orderkey) AS id FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
_filter_query("q_greater_less", "part", [_f("retailprice", ">", 1200), _f("size", "<", 10)], "SELECT concat('pa', p_partkey) AS id FROM part WHERE p_retailprice > 1200 AND p_size < 10")
_filter_query("q_exists", "document", _f("quality", "exists"), "SELECT concat('do', doc_id) AS id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
_filter_query("q_not_exists", "document", _f("toxic", "notExists"), "SELECT concat('do', doc_id) AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
_filter_query("q_includes", "part", _f("kind", "includes", "STEEL"), "SELECT concat('pa', p_partkey) AS id FROM part WHERE contains(p_type, 'STEEL')")
_filter_query("q_and_or", "lineitem", [_f("quantity", ">", 40, **{"$and": _f("returnflag", "=", "R"), "$or": _f("discount", "=", 0.1)})], f"SELECT {_LI} AS id FROM lineitem WHERE (l_quantity > 40 AND l_returnflag = 'R') OR l_discount = 0.1")
_filter_query("q_text_lang", "document", _f("body", "includes", "the"), "SELECT concat('do', doc_id) AS id FROM documents WHERE lang = 'en' AND contains(text, 'the')", language="en")
_filter_query("q_now_offset", "orders", [_f("orderdate", ">", "now-90d"), _f("orderdate", "<", "now")], f"SELECT concat('or', o_orderkey) AS id FROM orders WHERE {_MS.format('o_orderdate')} > {NOW - 90 * DAY} AND {_MS.format('o_orderdate')} < {NOW}", now_ms=NOW)
_filter_query("q_text_search", "document", _f("body", "textSearch", "the thing"), r"SELECT concat('do', doc_id) AS id FROM documents WHERE list_has_all(string_split_regex(translate(lower(text), 'äöüÄÖÜáàâéèêëíìîóòôúùûñç', 'aouaouaaaeeeeiiiooouuunc'), '[^\p{L}\p{N}]+'), ['the', 'thing'])")


@registered("SELECT concat('or', o_orderkey) AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def q_has_ancestor(spark, d):
    from .compile import Compiler

    g = star_graph(spark, d)
    return Compiler(g).filtered(g.nodes["orders"].select("id", "type"), _f("ancestors", "has", "re2"), {"orders"}).select("id")


@registered("SELECT concat('na', n_nationkey) AS id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (7, 11))")
def q_has_set(spark, d):
    from .compile import Compiler

    g = star_graph(spark, d)
    return Compiler(g).filtered(g.nodes["nation"].select("id", "type"), _f("children", "has", ["cu7", "cu11"]), {"nation"}).select("id")


@registered("SELECT concat('cu', c_custkey) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_edge_not_exists(spark, d):
    from .compile import Compiler

    g = star_graph(spark, d)
    return Compiler(g).filtered(g.nodes["customer"].select("id", "type"), _f("orders", "notExists"), {"customer"}).select("id")


@registered("SELECT t AS type, n FROM (SELECT 'customer' AS t, count(*) AS n FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_acctbal > 0) WHERE n > 0")
def q_filter_mixed_types(spark, d):
    g = star_graph(spark, d)
    return _where(g, g.node_rows({"customer", "supplier", "nation"}, {"acctbal"}), _f("acctbal", ">", 0)).groupBy("type").agg(F.count("*").alias("n"))


# postfix expressions


@registered(f"SELECT {_LI} AS id, l_extendedprice * (1 - l_discount) AS net, l_quantity % 7 AS rest FROM lineitem")
def q_rpn_arith(spark, d):
    rows = star_graph(spark, d).nodes["lineitem"]
    node = rpn.Node(column=lambda p: F.col(p), id=F.col("id"))
    net = rpn.rpn_double('"discount" g #1 B "price" g D', None, node)
    rest = rpn.rpn_double('#7 "quantity" g E', None, node)
    return rows.select("id", net.alias("net"), rest.alias("rest"))


@registered("SELECT concat('pa', p_partkey) AS id, CASE WHEN p_size > 25 THEN p_retailprice ELSE 0.0 END AS big, CASE WHEN contains(p_type, 'BRASS') THEN 'brass' ELSE p_brand END AS label FROM part")
def q_rpn_ternary(spark, d):
    rows = star_graph(spark, d).nodes["part"]
    node = rpn.Node(column=lambda p: F.col(p), id=F.col("id"))
    big = rpn.rpn_double('#0 "retailprice" g #25 "size" g I T', None, node)
    label = rpn.rpn_string('"brand" f "brass" "BRASS" "kind" f m T', None, node)
    return rows.select("id", big.alias("big"), label.alias("label"))


@registered("SELECT concat('or', o_orderkey) AS id, CASE WHEN o_totalprice > 200000 THEN 2.0 WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END::DOUBLE AS grade FROM orders")
def q_rpn_jump(spark, d):
    node = rpn.Node(column=lambda p: F.col(p), id=F.col("id"))
    grade = rpn.rpn_double('@1 "totalprice" g I >1 @2 "totalprice" g I >2 #0 Z .1: #2 Z .2: #1', [None, 200000, 100000], node)
    return star_graph(spark, d).nodes["orders"].select("id", grade.alias("grade"))


@registered("SELECT concat('do', doc_id) AS id, 'do' AS prefix, lang = 'de' AS german, doc_id = 7 AS seven, true AS is_document, quality IS NOT NULL AS judged, source IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)")
def q_rpn_strings(spark, d):
    node = rpn.Node(column=lambda p: F.col(p), id=F.col("id"))
    b = lambda text: rpn.rpn_bool(text, [None], node)
    rows = star_graph(spark, d).nodes["document"]
    return rows.select("id", rpn.rpn_string("$0 b", [None], node).alias("prefix"), b('"de" "lang" f c').alias("german"), b('"do7" $0 d').alias("seven"), b('"do" e').alias("is_document"), b('"quality" h').alias("judged"), b('"source" h').alias("known"))


@registered("SELECT concat('pa', p_partkey) AS id, NOT (p_size > 10 AND p_retailprice > 1000) AS a, (p_size > 10) <> (p_retailprice > 1000) AS b, p_size > 10 OR p_retailprice > 1000 AS c, (p_size > 10 AND p_size < 40) AS d, CASE WHEN p_size > 45 THEN p_size ELSE p_retailprice END::DOUBLE AS e, p_retailprice / p_size AS f FROM part")
def q_rpn_logic(spark, d):
    node = rpn.Node(column=lambda p: F.col(p), id=F.col("id"))
    big, dear = '#10 "size" g I', '#1000 "retailprice" g I'
    b = lambda text: rpn.rpn_bool(text, [None], node)
    rows = star_graph(spark, d).nodes["part"]
    either = rpn.rpn_double('#45 "size" g I "size" g D Q U "retailprice" g', [None], node)
    return rows.select("id", b(f"{big} {dear} M L").alias("a"), b(f"{big} {dear} O").alias("b"), b(f"{big} Q U {dear}").alias("c"), b(f'{big} P U #40 "size" g H').alias("d"), either.alias("e"), rpn.rpn_double('"size" g "retailprice" g C', [None], node).alias("f"))


@registered("SELECT concat('do', doc_id) AS id, CASE WHEN quality IS NOT NULL THEN 'quality' ELSE 'source' END AS first, CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 'quality,toxic' ELSE '' END AS every, n_chars BETWEEN 100 AND 900 AS middle FROM documents LEFT JOIN labels USING (doc_id)")
def q_rpn_fields(spark, d):
    node = rpn.Node(column=lambda p: F.col(p), id=F.col("id"))
    some = lambda text, *names: F.array_join(rpn.rpn_set(text, [None, list(names)], node), ",")
    rows = star_graph(spark, d).nodes["document"]
    return rows.select("id", some("&1 j", "quality", "source").alias("first"), some("&1 k", "quality", "toxic").alias("every"), rpn.rpn_bool('#900 "n_chars" g #100 i', [None], node).alias("middle"))


@registered("SELECT concat('li', l_linenumber) AS id, count(*) AS n, sum(3 * (l_quantity - l_linenumber))::DOUBLE AS total FROM lineitem GROUP BY l_linenumber")
def q_rpn_stack(spark, d):
    """Copies, swaps and turns of the stack, and the clock, which is newer than any shipping."""
    node = rpn.Node(column=lambda p: F.col(p), id=F.col("id"), now=F.lit(4_000_000_000_000))
    rows = star_graph(spark, d).nodes["lineitem"].where(rpn.rpn_bool('"shipdate" g n I', [None], node))
    value = rpn.rpn_double('#3 "quantity" g "linenumber" g S B X V U D', [None], node)
    return rows.groupBy(F.concat(F.lit("li"), F.col("linenumber").cast("string")).alias("id")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


# set operations


def _tags(spark, d) -> DataFrame:
    """Orders with the sets of return flags and line states of their items."""
    item = spark.read.parquet(f"{d}/lineitem.parquet")
    return item.groupBy(F.concat(F.lit("or"), F.col("l_orderkey").cast("string")).alias("id")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"), F.sort_array(F.collect_set("l_linestatus")).alias("states"))


_TAGS = "SELECT concat('or', l_orderkey) AS id, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_linestatus)) AS states FROM lineitem GROUP BY l_orderkey"


@registered(f"SELECT id, array_to_string(list_sort(list_distinct(list_concat(flags, states))), ',') AS tags FROM ({_TAGS})")
def q_set_union(spark, d):
    node = rpn.Node()
    return _tags(spark, d).select("id", F.array_join(rpn.rpn_set("&1 &2 z", [None, F.col("flags"), F.col("states")], node), ",").alias("tags"))


@registered(f"SELECT id, list_has_all(['A', 'R'], flags) AS inside FROM ({_TAGS})")
def q_subset(spark, d):
    return _tags(spark, d).select("id", rpn.rpn_bool('{"A","R"} &1 l', [None, F.col("flags")]).alias("inside"))


@registered(f"SELECT id FROM ({_TAGS}) WHERE list_contains(flags, 'N') OR list_contains(states, 'F')")
def q_set_has(spark, d):
    rows = _tags(spark, d)
    return rows.where(condition(tree(_f("flags", "has", "N", **{"$or": _f("states", "has", ["F"])})), Fields(F.col, lambda p: None))).select("id")


@registered("SELECT concat('cu', c_custkey) AS id FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT concat('su', s_suppkey) FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT concat('cu', c_custkey) FROM customer WHERE c_acctbal > 9900")
def q_concat(spark, d):
    found = lambda t, low: _find({"$traverse": "descendants", "$filter": _typed(t, _f("acctbal", ">", low))})
    return _items(_get(star_graph(spark, d), {"found": [found("customer", 9500), found("supplier", 5000), found("customer", 9900)]}), "found")


# projection


@registered("SELECT concat('do', doc_id) AS id, coalesce(quality, -1)::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def q_default(spark, d):
    g = star_graph(spark, d)
    rows = _shown(g, g.nodes["document"], {"id": True, "quality": {"$default": -1}}, {"document"})
    return rows.select("id", F.col("quality").cast("long").alias("quality"))


@registered("SELECT concat('pa', p_partkey) AS id, p_name AS name, p_brand AS brand, 7 AS seven, 'b' AS letter, p_size::BIGINT AS size FROM part")
def q_nested_object(spark, d):
    """Made-up objects, dotted keys and constant objects and lists."""
    g = star_graph(spark, d)
    rows = _shown(g, g.nodes["part"], {"id": True, "box": {"name": True, "inner": {"brand": True}}, "c": {"$value": {"a": 7, "l": ["a", "b"]}}, "k.size": {"$field": "size"}}, {"part"})
    return rows.select("id", F.col("box.name").alias("name"), F.col("box.inner.brand").alias("brand"), F.col("c.a").alias("seven"), F.col("c.l")[1].alias("letter"), F.col("k.size").alias("size"))


@registered("SELECT concat('na', n_nationkey) AS id, r_name AS far, concat('re', n_regionkey) AS up FROM nation, region WHERE r_regionkey = 1")
def q_sub_query(spark, d):
    """A query by id inside another one, and a relation as a list of ids."""
    g = star_graph(spark, d)
    rows = _shown(g, g.nodes["nation"], {"id": True, "there": {"$id": "re1", "regionname": True}, "parents": True}, {"nation"})
    return rows.select("id", F.col("there.regionname").alias("far"), F.col("parents")[0].alias("up"))


@registered("SELECT concat('cu', c_custkey) AS id, coalesce(array_to_string(list_sort(list(concat('or', o_orderkey)) FILTER (o_orderkey IS NOT NULL)), ','), '') AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q_relation_as_value(spark, d):
    g = star_graph(spark, d)
    rows = _shown(g, g.nodes["customer"], {"id": True, "children": True}, {"customer"})
    return rows.select("id", F.array_join("children", ",").alias("children"))


@registered("SELECT concat('do', doc_id) AS id, coalesce(quality, n_chars)::BIGINT AS score FROM documents LEFT JOIN labels USING (doc_id)")
def q_field_alias(spark, d):
    g = star_graph(spark, d)
    from .compile import Compiler

    rows = g.nodes["document"].withColumn("nid", F.col("id"))
    rows, out = Compiler(g).project(rows, {"id": True, "score": {"$field": ["quality", "n_chars"]}}, {"document"})
    return rows.select(*(c.alias(k) for k, c in out.items()))


@registered("SELECT concat('pa', p_partkey) AS id, 'part' AS type, p_name AS name, p_brand AS brand, p_type AS kind, p_retailprice AS retailprice FROM part")
def q_all_except(spark, d):
    from .compile import Compiler

    g = star_graph(spark, d)
    rows, out = Compiler(g).project(g.nodes["part"].withColumn("nid", F.col("id")), {"$all": True, "size": False}, {"part"})
    return rows.select(*(c.alias(k) for k, c in out.items()))


@registered("SELECT concat('cu', c_custkey) AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT concat('su', s_suppkey), s_acctbal, NULL FROM supplier")
def q_fields_by_type(spark, d):
    from .compile import Compiler

    g = star_graph(spark, d)
    rows = g.node_rows({"customer", "supplier"}, {"acctbal", "segment"}).withColumn("nid", F.col("id"))
    rows, out = Compiler(g).project(rows, {"id": True, "balance": {"$field": "acctbal"}, "$fieldsByType": {"customer": {"segment": True}}}, {"customer", "supplier"})
    return rows.select(*(c.alias(k) for k, c in out.items()))


@registered("SELECT concat('or', o_orderkey) AS id, c_name AS customer_name, c_acctbal AS balance FROM orders JOIN customer ON c_custkey = o_custkey")
def q_deref_reference(spark, d):
    from .compile import Compiler

    g = star_graph(spark, d)
    rows, out = Compiler(g).project(g.nodes["orders"].select("id", "type").withColumn("nid", F.col("id")), {"id": True, "customer": {"$flatten": True, "customer_name": {"$field": "name"}, "balance": {"$field": "acctbal"}}}, {"orders"})
    return rows.select(*(c.alias(k) for k, c in out.items()))


@registered("SELECT concat('do', doc_id) AS id, CASE WHEN lang IN ('de', 'en') THEN length(text) END::BIGINT AS n FROM documents")
def q_language_fallback(spark, d):
    rows = star_graph(spark, d).nodes["document"]
    return rows.select("id", F.length(inh.language_value(F.col("body"), "de", ("en",))).cast("long").alias("n"))


@registered("SELECT concat('ev', event_id) AS id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def q_json_field(spark, d):
    g = star_graph(spark, d)
    return _shown(g, g.nodes["event"], {"id": True, "k": {"$field": "props.k"}}, {"event"}).select("id", F.col("k").cast("long").alias("k"))


# lists, sorting, paging


@registered("SELECT concat('or', o_orderkey) AS id, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, concat('or', o_orderkey) DESC LIMIT 20 OFFSET 10")
def q_list_sort_limit_offset(spark, d):
    rows = star_graph(spark, d).nodes["orders"]
    return order.take(rows, order.sort_keys(rows, "totalprice", "desc"), 20, 10).select("id", "totalprice")


@registered("SELECT start_id, id, pos FROM (SELECT concat('cu', o_custkey) AS start_id, concat('or', o_orderkey) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, concat('or', o_orderkey))::INTEGER - 1 AS pos FROM orders) WHERE pos BETWEEN 1 AND 3")
def q_list_per_parent(spark, d):
    g = star_graph(spark, d)
    rows = _below(g, _all(g, "customer"), "customer", "orders", {"totalprice"})
    return order.take_each(rows, ["start_id"], order.sort_keys(rows, "totalprice"), 3, 1).select("start_id", "id", "pos")


@registered("SELECT concat('do', doc_id) AS id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality IS NULL DESC, quality DESC, concat('do', doc_id) DESC LIMIT 40")
def q_sort_missing(spark, d):
    rows = star_graph(spark, d).nodes["document"].select("id", "quality")
    return order.take(rows, order.sort_keys(rows, "quality", "desc"), 40).select("id")


@registered("SELECT concat('na', n_nationkey) AS id FROM nation ORDER BY concat('re', n_regionkey), concat('na', n_nationkey) LIMIT 7")
def q_walk_limit(spark, d):
    g = star_graph(spark, d)
    rows = tr.descendants(g, _root(g), {"root"}, {"nation"}, paths=True)
    return order.take(rows, order.walk_keys(rows), 7).select("id")


@registered("SELECT concat('or', l_orderkey) AS id, list(l_quantity ORDER BY l_quantity DESC, l_linenumber)[1] AS top FROM lineitem GROUP BY l_orderkey")
def q_sort_items(spark, d):
    g, rows = _with_items(spark, d)
    rows = _shown(g, rows, {"id": True, "items": {"quantity": True, "$list": {"$sort": {"$field": "quantity", "$order": "desc"}, "$limit": 1}}}, {"orders"})
    return rows.select("id", F.col("items")[0]["quantity"].alias("top"))


@registered("SELECT 're1' AS start_id, -1 AS pos, 're1' AS id UNION ALL SELECT 're1', row_number() OVER (ORDER BY concat('na', n_nationkey))::INTEGER - 1, concat('na', n_nationkey) FROM nation WHERE n_regionkey = 1")
def q_list_with_head(spark, d):
    """An offset of -1 puts the start before what it leads to."""
    rows = _get(star_graph(spark, d), {"$id": "re1", "id": True, "found": {"id": True, "$list": {"$offset": -1, "$find": {"$traverse": "children"}}}})
    return rows.select(F.col("id").alias("start_id"), F.posexplode("found").alias("pos", "x")).select("start_id", (F.col("pos") - 1).alias("pos"), "x.id")


@registered("SELECT id, pos FROM (SELECT concat('cu', c_custkey) AS id, row_number() OVER (ORDER BY n_name DESC, concat('cu', c_custkey) DESC)::INTEGER - 1 AS pos FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE pos < 50")
def q_sort_by_inherited(spark, d):
    told = {"id": True, "nationname": {"$inherit": {"$type": "nation"}}, "$list": {"$sort": {"$field": "nationname", "$order": "desc"}, "$limit": 50, "$find": {"$traverse": "descendants", "$filter": _typed("customer")}}}
    return _get(star_graph(spark, d), {"found": told}).select(F.posexplode("found").alias("pos", "x")).select("x.id", "pos")


# aggregates


@registered("SELECT count(*) AS n FROM orders")
def q_count_desc_type(spark, d):
    g = star_graph(spark, d)
    return agg.aggregate(tr.descendants(g, _root(g), {"root"}, {"orders"}), "count", name="n")


@registered("SELECT concat('re', n_regionkey) AS start_id, sum(o_totalprice) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q_sum_desc(spark, d):
    g = star_graph(spark, d)
    return agg.aggregate(_below(g, _all(g, "region"), "region", "orders", {"totalprice"}), "sum", ["totalprice"], ["start_id"], "total")


@registered("SELECT concat('na', c_nationkey) AS start_id, avg(c_acctbal) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer GROUP BY 1")
def q_avg_min_max(spark, d):
    g = star_graph(spark, d)
    rows = _below(g, _all(g, "nation"), "nation", "customer", {"acctbal"})
    return rows.groupBy("start_id").agg(*(agg.aggregate_column(rows, f, ["acctbal"]).alias(n) for f, n in (("avg", "mean"), ("min", "low"), ("max", "high"), ("count", "n"))))


@registered("SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_nationkey) AS nations FROM customer")
def q_count_unique(spark, d):
    g = star_graph(spark, d)
    rows = g.links["nation", "customer"].join(g.nodes["customer"], F.col("child") == F.col("id"))
    return rows.agg(agg.aggregate_column(rows, "countUnique", ["segment"]).alias("segments"), agg.aggregate_column(rows, "countUnique", ["parent"]).alias("nations"))


@registered("SELECT sum(p) AS total FROM (SELECT o_totalprice AS p FROM orders ORDER BY o_totalprice, concat('or', o_orderkey) LIMIT 100)")
def q_sorted_topk_agg(spark, d):
    g = star_graph(spark, d)
    rows = g.nodes["orders"].select("id", "totalprice")
    return agg.aggregate(order.take(rows, order.sort_keys(rows, "totalprice"), 100), "sum", ["totalprice"], name="total")


@registered("SELECT sum(coalesce(quality, n_chars))::DOUBLE AS total FROM documents LEFT JOIN labels USING (doc_id)")
def q_sum_first_of(spark, d):
    rows = star_graph(spark, d).nodes["document"]
    return agg.aggregate(rows, "sum", ["quality", "n_chars"], name="total")


@registered("SELECT concat('cu', c_custkey) AS id, coalesce(sum(o_totalprice), 0.0) AS total, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q_agg_references(spark, d):
    g = star_graph(spark, d)
    told = lambda f: {"$aggregate": {"$function": f, "$traverse": "orders"}}
    return _shown(g, g.nodes["customer"].select("id", "type"), {"id": True, "total": told({"$name": "sum", "$args": ["totalprice"]}), "n": told("count")}, {"customer"})


@registered("SELECT concat('na', n_nationkey) AS id, (SELECT sum(b) FROM (SELECT c_acctbal AS b FROM customer WHERE c_nationkey = n_nationkey ORDER BY concat('cu', c_custkey) LIMIT 3)) AS total FROM nation")
def q_agg_limit(spark, d):
    """A limit without a sort takes the first nodes of the walk."""
    g = star_graph(spark, d)
    told = {"$aggregate": {"$function": {"$name": "sum", "$args": "acctbal"}, "$traverse": "children", "$filter": _f("type", "=", "customer"), "$limit": 3}}
    return _shown(g, g.nodes["nation"], {"id": True, "total": told}, {"nation"})


@registered("SELECT concat('re', r_regionkey) AS id, (SELECT count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND s_acctbal > 0) AS n FROM region")
def q_agg_nested_find(spark, d):
    g = star_graph(spark, d)
    told = {"$aggregate": {"$function": "count", "$find": {"$traverse": "children", "$find": {"$traverse": "children", "$filter": _typed("supplier", _f("acctbal", ">", 0))}}}}
    return _shown(g, g.nodes["region"], {"id": True, "n": told}, {"region"})


@registered("SELECT concat('su', l_suppkey) AS start_id, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def q_agg_expression(spark, d):
    g = star_graph(spark, d)
    rows = _below(g, _all(g, "supplier"), "supplier", "lineitem", {"price", "discount", "returnflag"})
    return _where(g, rows, _f("returnflag", "=", "R")).groupBy("start_id").agg(F.sum(F.col("price") * (1 - F.col("discount"))).alias("revenue"))


# inheritance


@registered(f"SELECT {_LI} AS start_id, c_mktsegment AS segment, r_name AS regionname FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def q_inherit_field(spark, d):
    # The supplier's region is the nearest: three steps up, the customer's is four.
    g = star_graph(spark, d)
    return inh.inherit_fields(g, None, ["segment", "regionname"], sources={"lineitem"}, paths=False)


@registered("SELECT concat('or', o_orderkey) AS start_id, n_name AS nationname FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F'")
def q_inherit_type(spark, d):
    g = star_graph(spark, d)
    rows = g.nodes["orders"].where("status = 'F'").select(F.col("id").alias("start_id"), "id")
    return inh.inherit_fields(g, rows, ["nationname"], {"nation"}, {"orders"}, paths=False)


@registered("SELECT concat('or', o_orderkey) AS start_id, CASE WHEN c_acctbal > 0 THEN concat('cu', c_custkey) END AS item_id, CASE WHEN c_acctbal > 0 THEN c_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def q_inherit_item_required(spark, d):
    g = star_graph(spark, d)
    some = g.with_(nodes={**g.nodes, "customer": g.nodes["customer"].withColumn("acctbal", F.when(F.col("acctbal") > 0, F.col("acctbal")))})
    return inh.inherit_item(some, _all(g, "orders"), ["name"], {"customer"}, ["acctbal"], {"orders"}, paths=False).select("start_id", "item_id", "name")


def _themed(g: GraphStore) -> GraphStore:
    """Regions, nations and customers with an object and a record field, parts of which are missing."""
    theme = lambda a, b: F.struct(a.alias("a"), F.struct(b.alias("b")).alias("in"))
    n = lambda c: F.length(c)
    nodes = dict(g.nodes)
    nodes["region"] = nodes["region"].select("id", "type", theme(F.col("regionname"), F.col("regionname")).alias("theme"), F.create_map(F.lit("r"), F.col("regionname"), F.lit("x"), F.lit("region")).alias("rec"))
    nodes["nation"] = nodes["nation"].select("id", "type", theme(F.when(n("nationname") > 6, F.col("nationname")), F.lit(None).cast("string")).alias("theme"), F.create_map(F.lit("n"), F.col("nationname"), F.lit("x"), F.lit("nation")).alias("rec"))
    nodes["customer"] = nodes["customer"].select("id", "type", theme(F.lit(None).cast("string"), F.when(F.col("segment") == "BUILDING", F.col("segment"))).alias("theme"), F.create_map(F.lit("s"), F.col("segment")).alias("rec"))
    return g.with_(nodes=nodes)


@registered("SELECT concat('cu', c_custkey) AS start_id, c_mktsegment AS s, n_name AS n, r_name AS r, 'nation' AS x FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def q_inherit_merge(spark, d):
    g = _themed(star_graph(spark, d))
    out = inh.merge_maps(g, _all(g, "customer"), "rec", None, None, {"customer"})
    return out.select("start_id", *(F.col("rec")[k].alias(k) for k in "snrx"))


@registered("SELECT concat('cu', c_custkey) AS start_id, CASE WHEN length(n_name) > 6 THEN n_name ELSE r_name END AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE r_name END AS b FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def q_inherit_deep_merge(spark, d):
    g = _themed(star_graph(spark, d))
    out = inh.deep_merge(g, _all(g, "customer"), "theme", None, {"customer"})
    return out.select("start_id", F.col("theme.a").alias("a"), F.col("theme.in.b").alias("b"))


@registered("SELECT concat('cu', c_custkey) AS start_id, n_name AS n, 'nation' AS x FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_inherit_named_merge(spark, d):
    """Only the listed keys of a record are merged."""
    g = _themed(star_graph(spark, d))
    out = inh.merge_maps(g, _all(g, "customer"), "rec", ["n", "x"], None, {"customer"})
    return out.select("start_id", F.col("rec")["n"].alias("n"), F.col("rec")["x"].alias("x"))


@registered("SELECT concat('or', o_orderkey) AS id, n_name AS place, c_name AS whose, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def q_inherit_query(spark, d):
    """Inheritance in a projection: the first of several fields that anybody above has, and an item's fields."""
    g = star_graph(spark, d)
    rows = _shown(g, g.nodes["orders"].select("id", "type"), {"id": True, "place": {"$field": ["nobody", "nationname", "regionname"], "$inherit": True}, "item": {"name": True, "segment": True, "$inherit": {"$item": "customer"}}}, {"orders"})
    return rows.select("id", "place", F.col("item.name").alias("whose"), F.col("item.segment").alias("segment"))


@registered(f"SELECT {_LI} AS id, concat('cu', o_custkey) AS customer, c_name AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def q_inherit_reference(spark, d):
    """The reference that the order above a line item has, and the node that it leads to."""
    g = star_graph(spark, d)
    rows = _shown(g, g.with_parents("lineitem", "id", "type"), {"id": True, "customer": {"$inherit": True}, "who": {"name": True, "$field": "customer", "$inherit": {"$type": "orders"}}}, {"lineitem"})
    return rows.select("id", "customer", F.col("who.name").alias("name"))


@registered("SELECT concat('or', o.o_orderkey) AS id, count(*) AS n, max(m.o_totalprice) AS top FROM orders o JOIN orders m ON m.o_custkey = o.o_custkey GROUP BY 1")
def q_inherit_list(spark, d):
    """A list of the references that an order inherits from its customer."""
    g = star_graph(spark, d)
    told = {"totalprice": True, "$field": "orders", "$list": {"$inherit": {"$type": "customer"}, "$sort": {"$field": "totalprice", "$order": "desc"}}}
    rows = _shown(g, g.with_parents("orders", "id", "type"), {"id": True, "mates": told}, {"orders"})
    return rows.select("id", F.size("mates").cast("long").alias("n"), F.col("mates")[0]["totalprice"].alias("top"))


# mutations


@registered("SELECT concat('pa', p_partkey) AS id, p_retailprice + CASE WHEN p_size > 40 THEN 5 ELSE 0 END AS retailprice FROM part")
def q_update_increment(spark, d):
    c = _client(spark, star_graph(spark, d))
    c.update({"type": "part", "retailprice": {"$increment": 5}}, {"$filter": _f("size", ">", 40)})
    return c.store().nodes["part"].select("id", "retailprice")


@registered("SELECT concat('or', o_orderkey) AS id, CASE WHEN c_nationkey = 3 AND o_totalprice > 100000 THEN 'X' ELSE o_orderpriority END AS priority, CASE WHEN c_nationkey = 3 AND o_totalprice > 100000 THEN NULL ELSE o_orderstatus END AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def q_update_find(spark, d):
    """Fields of what a pipeline of finds reaches from one node; all other orders stay."""
    c = _client(spark, star_graph(spark, d))
    find = {"$traverse": "children", "$filter": _f("type", "=", "customer"), "$find": {"$traverse": "children", "$filter": _f("totalprice", ">", 100000)}}
    c.update({"type": "orders", "priority": "X", "status": {"$delete": True}}, {"$id": "na3", "$find": find})
    return c.store().nodes["orders"].select("id", "priority", "status")


@registered("SELECT concat('pa', p_partkey) AS id, 'updated' AS op, 'size' AS changed, p_size::BIGINT AS before, 7 AS after FROM part WHERE contains(p_type, 'STEEL') AND p_size <> 7")
def q_update_log(spark, d):
    """The change log of an update: only where a value differs."""
    g = star_graph(spark, d)
    _, log = mutate.update_where(g, "part", F.col("kind").contains("STEEL"), {"size": 7}, NOW)
    size = lambda c: F.get_json_object(c, "$.size").cast("long")
    return log.select("id", "op", F.array_join("changed", ",").alias("changed"), size("before").alias("before"), size("after").cast("int").alias("after"))


@registered("SELECT concat('cu', c_custkey) AS id, CASE c_custkey WHEN 1 THEN 'one' WHEN 2 THEN c_name WHEN 3 THEN NULL WHEN 4 THEN 'four' ELSE c_name END AS name, CASE c_custkey WHEN 1 THEN c_acctbal + 10 WHEN 4 THEN NULL ELSE c_acctbal END AS acctbal, CASE c_custkey WHEN 4 THEN NULL ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT 'cunew', 'fresh', 5.0, NULL")
def q_set_operations(spark, d):
    """Values, increments, defaults, deletions, a replacement and a new node, set one after another."""
    c = _client(spark, star_graph(spark, d))
    c.set([{"$id": "cu1", "name": "one", "acctbal": {"$increment": 10}}, {"$id": "cu2", "name": {"$default": "late"}}, {"$id": "cu3", "name": {"$delete": True}}, {"$id": "cu4", "$merge": False, "name": "four"}, {"$id": "cunew", "name": {"$default": "fresh"}, "acctbal": {"$increment": 1, "$default": 5}}, {"$id": "cu5", "$operation": "insert", "name": "no"}, {"$id": "cunone", "$operation": "update", "name": "no"}])
    return c.store().nodes["customer"].select("id", "name", "acctbal", "segment")


@registered("SELECT concat('or', o_orderkey) AS src, CASE o_orderkey WHEN 1 THEN 'cu2' WHEN 2 THEN 'cufresh' ELSE concat('cu', o_custkey) END AS dst FROM orders WHERE o_orderkey <> 3")
def q_set_references(spark, d):
    """A single reference is replaced, a missing target comes into being, a deletion drops the edge."""
    c = _client(spark, star_graph(spark, d))
    c.set([{"$id": "or1", "customer": "cu2"}, {"$id": "or2", "customer": "cufresh"}, {"$id": "or3", "customer": {"$delete": True}}])
    store = c.store()
    fresh = store.nodes["customer"].where("id = 'cufresh'").select(F.col("id").alias("dst"))
    edges = store.edge_rows("customer").select("src", "dst")
    return edges.where("dst <> 'cufresh'").unionByName(edges.join(fresh, "dst", "left_semi").select("src", "dst"))


@registered("SELECT concat('re', n_regionkey) AS parent, concat('na', n_nationkey) AS child FROM nation WHERE n_nationkey NOT IN (0, 1) UNION ALL SELECT 're4', 'na0' UNION ALL SELECT concat('re', n_regionkey), 'na1' FROM nation WHERE n_nationkey = 1 AND n_regionkey <> 3 UNION ALL SELECT 're3', 'na1'")
def q_set_parents(spark, d):
    """A plain value replaces the parents, $add adds one."""
    c = _client(spark, star_graph(spark, d))
    c.set([{"$id": "na0", "parents": ["re4"]}, {"$id": "na1", "parents": {"$add": "re3"}}])
    return c.store().links["region", "nation"].select("parent", "child")


@registered("SELECT r_name AS alias, concat('re', r_regionkey) AS node_id FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'ASIA', 're0' UNION ALL SELECT 'home', 're0'")
def q_set_aliases(spark, d):
    """An alias leads to one node: setting it elsewhere moves it."""
    c = _client(spark, star_graph(spark, d))
    c.set({"$id": "re0", "aliases": ["ASIA", "home"]})
    return c.store().alias_rows()


@registered(f"SELECT {_LI} AS src, CASE WHEN l_orderkey = 1 THEN 'high' END AS mark, l_quantity + CASE WHEN l_orderkey = 1 THEN 1 ELSE 0 END AS quantity, CASE WHEN l_orderkey <> 1 THEN l_discount END AS discount FROM lineitem")
def q_edge_metadata_operations(spark, d):
    """The metadata of the part edges of one order's items: a default, an increment, a deletion."""
    g = star_graph(spark, d)
    c = _client(spark, g)
    some = [(r.src, r.dst) for r in g.edge_rows("part").join(g.links["orders", "lineitem"].where("parent = 'or1'"), F.col("src") == F.col("child")).select("src", "dst").collect()]  # the items of one order
    c.set([{"$id": src, "part": {"$value": dst, "$edgeMeta": {"mark": {"$default": "high"}, "quantity": {"$increment": 1}, "discount": {"$delete": True}}}} for src, dst in some])
    meta = F.col("meta")
    return c.store().edge_rows("part").select("src", meta["mark"].alias("mark"), meta["quantity"].cast("double").alias("quantity"), meta["discount"].cast("double").alias("discount"))


@registered("SELECT id, balance, op FROM (SELECT concat('cu', c_custkey) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS balance, CASE WHEN c_mktsegment = 'BUILDING' THEN 'updated' ELSE 'kept' END AS op FROM customer UNION ALL SELECT concat('cu9', lpad(s_suppkey::VARCHAR, 9, '0')), s_acctbal, 'created' FROM supplier)")
def q_upsert(spark, d):
    g = star_graph(spark, d)
    c, s = g.nodes["customer"], g.nodes["supplier"]
    key = F.substring("id", 3, 99)
    new = c.where("segment = 'BUILDING'").select("id", F.lit(0.0).alias("acctbal")).unionByName(s.select(F.concat(F.lit("cu9"), F.lpad(key, 9, "0")).alias("id"), "acctbal"))
    return mutate.upsert_rows(c.select("id", "acctbal"), new).select("id", F.col("acctbal").alias("balance"), "op")


@registered("SELECT concat('cu', c_custkey) AS id, c_name AS name FROM customer")
def q_insert_existing(spark, d):
    c = star_graph(spark, d).nodes["customer"].select("id", "name")
    return mutate.upsert_rows(c, c.select("id", F.lit("x").alias("name")), "insert").select("id", "name")


@registered("""
WITH gone AS (SELECT concat('na', n_nationkey) AS id FROM nation WHERE n_nationkey = 4 UNION ALL SELECT concat('cu', c_custkey) FROM customer WHERE c_nationkey = 4 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT concat('su', s_suppkey) FROM supplier WHERE s_nationkey = 4) SELECT id FROM gone
""")
def q_delete_cascade(spark, d):
    """Nation 4 goes with its suppliers, whose items orders still hold, and with the customers that no order refers to."""
    g = star_graph(spark, d)
    return mutate.deletion(g, spark.createDataFrame([("na4",)], "id string"))


@registered("""
SELECT 'cu1' AS id UNION ALL SELECT concat('or', o_orderkey) FROM orders WHERE o_custkey = 1 UNION ALL SELECT """ + _LI + """ FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 1
""")
def q_delete_recursive(spark, d):
    """With all that is below, whatever else holds it; the log tells which nodes were there."""
    return mutate.delete_nodes(star_graph(spark, d), ["cu1", "cunone"], True)[1].where("op = 'deleted'").select("id")


@registered("SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_append(flags, 'Z')), lambda x: x <> 'A')), ',') AS tags FROM (" + _TAGS + ")")
def q_set_add_delete(spark, d):
    g = _store_of(spark, "tagged", {"flags": {"type": "set", "items": {"type": "string"}}}, _tags(spark, d).select("id", "flags"))
    g, _ = mutate.update_where(g, "tagged", F.lit(True), {"flags": {"$add": "Z", "$delete": ["A"]}})
    return g.nodes["tagged"].select("id", F.array_join("flags", ",").alias("tags"))


@registered("SELECT concat('or', l_orderkey) AS id, count(*) + 1 AS n, 99 AS last, min((l_linenumber, l_quantity))[1]::BIGINT AS first FROM lineitem GROUP BY l_orderkey")
def q_array_push(spark, d):
    item = {"type": "object", "properties": {"linenumber": {"type": "int"}, "quantity": {"type": "number"}, "price": {"type": "number"}, "returnflag": {"type": "string"}}}
    g = _store_of(spark, "tagged", {"items": {"type": "array", "items": item}}, with_line_arrays(spark, d))
    g, _ = mutate.update_where(g, "tagged", F.lit(True), {"items": {"$push": [{"linenumber": 99, "quantity": 1, "price": 1, "returnflag": "N"}]}})
    return g.nodes["tagged"].select("id", F.size("items").cast("long").alias("n"), F.element_at("items", -1)["linenumber"].cast("int").alias("last"), F.col("items")[0]["linenumber"].alias("first"))


@registered("SELECT id, array_to_string(list_prepend('new', flags)[1:2], ',') AS a, array_to_string(list_concat(flags[1:1], ['in'], flags[2:]), ',') AS b, array_to_string(flags[2:], ',') AS c, array_to_string(list_prepend('first', flags[2:]), ',') AS e FROM (" + _TAGS + ")")
def q_array_operations(spark, d):
    """Elements put before, between, in place of others, and taken out."""
    kind = {"type": "array", "items": {"type": "string"}}
    rows = _tags(spark, d).select("id", *(F.col("flags").alias(c) for c in "abce"))
    g = _store_of(spark, "tagged", dict.fromkeys("abce", kind), rows)
    g, _ = mutate.update_where(g, "tagged", F.lit(True), {"a": {"$unshift": {"$value": "new", "$maxLen": 2}}, "b": {"$insert": {"$idx": 1, "$value": "in"}}, "c": {"$remove": {"$idx": 0}}, "e": {"$assign": {"$idx": 0, "$value": "first"}}})
    return g.nodes["tagged"].select("id", *(F.array_join(c, ",").alias(c) for c in "abce"))


def _store_of(spark: SparkSession, t: str, fields: dict, rows: DataFrame) -> GraphStore:
    """A store of one type."""
    return GraphStore(spark, GraphSchema.of({"types": {t: {"prefix": "or", "fields": fields}}}), {t: rows.withColumn("type", F.lit(t))})


# live queries


def _log(spark, d) -> DataFrame:
    """Events as a change log: each user's events are versions of one node."""
    from pyspark.sql import Window

    e = star_graph(spark, d).nodes["event"]
    w = Window.partitionBy("user").orderBy("ts", "id")
    return e.select(F.concat(F.lit("us"), F.col("user").cast("string")).alias("id"), "ts", F.col("id").alias("event"), "eventtype", "value", F.lag("value").over(w).alias("was"), F.row_number().over(w).alias("nth"))


def _changes(spark, d) -> DataFrame:
    """The same as rows of a change log."""
    state = lambda v: F.to_json(F.struct(v.alias("value")))
    log = _log(spark, d)
    return log.select(F.col("nth").cast("long").alias("seq"), F.when(F.col("nth") == 1, "created").otherwise("updated").alias("op"), "id", F.lit("event").alias("type"), F.when(F.col("nth") == 1, F.array(F.lit("value"))).when(F.col("nth") % 2 == 0, F.array(F.lit("list[3].value"))).otherwise(F.array(F.lit("other"))).alias("changed"), F.when(F.col("nth") > 1, state(F.col("was"))).alias("before"), state(F.col("value")).alias("after"), "event")


_LOG = f"SELECT concat('us', user_id) AS id, concat('ev', event_id) AS event, value, lag(value) OVER w AS was, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_MS.format('ts')}, concat('ev', event_id))"


@registered(f"SELECT id, event FROM ({_LOG}) WHERE nth = 1 AND value > 50")
def q_trigger_created(spark, d):
    """What a trigger on creations calls with: one plan over the log, the nodes and the filter."""
    from .compile import Compiler

    first = _log(spark, d).where("nth = 1").select("id", F.lit("event").alias("type"), "event", "value")
    g = star_graph(spark, d)
    g = g.with_(nodes={**g.nodes, "event": first})
    created = _changes(spark, d).where("op = 'created'").select("id", F.col("seq").alias("_cseq"))
    return Compiler(g).each(created, {"event"}, {"id": True, "event": True, "$filter": _f("value", ">", 50)})


@registered(f"SELECT event FROM ({_LOG}) WHERE coalesce(was > 50, false) <> (value > 50) OR coalesce(was > 50, false) AND value > 50 AND nth % 2 = 0")
def q_change_fields(spark, d):
    """A subscription on a field of array elements hears of changes at any index, and of nodes that begin or cease to match."""
    return live.change_matches(_changes(spark, d), _f("value", ">", 50), ["list[n].value"], "value double").select("event")


@registered(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'hierarchy' WHEN user_id % 3 = 1 THEN 'alias' ELSE 'field' END AS kind FROM events) GROUP BY 1")
def q_event_kinds(spark, d):
    user = F.col("user") % 3
    rows = star_graph(spark, d).nodes["event"].select(F.when(user == 0, F.array(F.lit("parents"), F.lit("children"))).when(user == 1, F.array(F.lit("aliases"))).otherwise(F.array(F.lit("value"), F.lit("ts"))).alias("changed"))
    return rows.select(F.explode(live.event_kinds(F.col("changed"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@registered(f"SELECT event, coalesce(was > 50, false) AS before, value > 50 AS after FROM ({_LOG}) WHERE (coalesce(was > 50, false) AND value > 50 AND was <> value) OR coalesce(was > 50, false) <> (value > 50)")
def q_change_match(spark, d):
    log = _log(spark, d)
    before, after = F.coalesce(F.col("was") > 50, F.lit(False)), F.col("value") > 50
    return log.where(fires(before, after, F.col("was") != F.col("value"))).select("event", before.alias("before"), after.alias("after"))


@registered(f"SELECT id, arg_max(value, nth) AS value, max(nth)::BIGINT AS versions FROM ({_LOG}) GROUP BY id")
def q_sub_latest(spark, d):
    last = live.latest(_changes(spark, d))
    return last.select("id", F.get_json_object("after", "$.value").cast("double").alias("value"), F.col("seq").alias("versions"))


@registered("SELECT count(*) AS n, sum(value) + 5 - max(CASE WHEN event_id = 1 THEN value END) AS total FROM events")
def q_sub_aggregate(spark, d):
    """A standing aggregate hears of a change of one of its nodes."""
    c = _client(spark, star_graph(spark, d))
    told = lambda f: {"$aggregate": {"$function": f, "$traverse": "descendants", "$filter": _f("type", "=", "event")}}
    seen: list[dict] = []
    c.observe({"$id": "root", "n": told("count"), "total": told({"$name": "sum", "$args": ["value"]})}).subscribe(seen.append)
    c.update({"type": "event", "value": 5.0}, {"$id": "ev1"})
    return spark.createDataFrame([(x["n"], x["total"]) for x in seen[1:]], "n long, total double")


@registered(f"SELECT min(CASE WHEN t > {NOW} THEN t END) AS refresh_at FROM (SELECT {_MS.format('o_orderdate')} + {30 * DAY} AS t FROM orders WHERE o_orderstatus = 'O')")
def q_now_refresh(spark, d):
    rows = star_graph(spark, d).nodes["orders"]
    return refresh_at(rows, [_f("status", "=", "O"), _f("orderdate", ">", "now-30d")], NOW)


@registered(f"SELECT min(CASE WHEN t > {NOW} THEN t END) AS refresh_at FROM (SELECT {_MS.format('o_orderdate')} AS t FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000)")
def q_now_refresh_query(spark, d):
    """When a standing query with a moving filter in a pipeline of finds is due again."""
    c = _client(spark, star_graph(spark, d))
    find = {"$traverse": "descendants", "$filter": _typed("customer", _f("acctbal", ">", 5000)), "$find": {"$traverse": "children", "$filter": _f("orderdate", ">", "now")}}
    return spark.createDataFrame([(c.next_refresh({"$id": "root", "coming": _find(find)}),)], "refresh_at long")


# extras


@registered("SELECT concat('cu', c_custkey) AS id FROM customer WHERE 2 * 6371008.8 * asin(sqrt(pow(sin((radians(c_custkey % 90) - radians(10.0)) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(10.0)) * pow(sin(radians(c_custkey % 180 - 20.0) / 2), 2))) <= 2000000")
def q_geo_distance(spark, d):
    key = F.substring("id", 3, 99).cast("long")
    rows = star_graph(spark, d).nodes["customer"].select("id", F.struct((key % 90).cast("double").alias("lat"), (key % 180).cast("double").alias("lon")).alias("place"))
    return rows.where(condition(tree(_f("place", "distance", {"$lon": 20.0, "$lat": 10.0, "$radius": 2000000})), Fields(F.col, lambda p: None))).select("id")


@registered(r"SELECT lang, token, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(list_filter(string_split_regex(translate(lower(text), 'äöüÄÖÜáàâéèêëíìîóòôúùûñç', 'aouaouaaaeeeeiiiooouuunc'), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS token FROM documents) GROUP BY 1, 2")
def q_text_index(spark, d):
    """The text index: in how many documents each token of each language is."""
    rows = star_graph(spark, d).nodes["document"].select("id", F.explode("body").alias("lang", "text"))
    each = rows.select("lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return each.groupBy("lang", "token").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total order value below each region."""
    return QUERIES["q_sum_desc"](spark, sf_dir)
