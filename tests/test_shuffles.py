"""How often the plans of the star schema's queries read the largest table: each more read is a shuffle of it."""

import pytest
from pyspark.sql import functions as F

from arborql.operators import traverse as tr
from arborql.plans import catalogue
from arborql.schema import GraphSchema
from arborql.sources.store import GraphStore

SMALL = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def reads(text: str, column: str) -> int:
    return sum("Relation [" in line and column in line for line in text.splitlines())


@pytest.mark.parametrize("name", ["q_inherit_reference", "q_inherit_field"])
def test_inherited_values_join_no_line_item_by_its_own_id(spark, name):
    assert reads(plan(spark, name), "l_orderkey") == 1


def test_every_node_reads_line_items_once(spark):
    assert reads(plan(spark, "q_every_node"), "l_orderkey") == 1


def test_filtered_descendants_are_cut_before_the_shuffle(spark):
    text = plan(spark, "q_descendants_filter")
    assert reads(text, "l_orderkey") == 1
    at = next(i for i, line in enumerate(text.splitlines()) if "Relation [" in line and "l_orderkey" in line)
    assert "l_quantity" in text.splitlines()[at - 1] and "Filter" in text.splitlines()[at - 1]  # the filter is right above the scan


def test_listed_ids_shuffle_no_nodes(spark):
    text = plan(spark, "q_traverse_listed_ids")
    assert reads(text, "l_orderkey") == reads(text, "event_id") == reads(text, "p_partkey") == 0
    physical = catalogue.QUERIES["q_traverse_listed_ids"](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in physical.splitlines() if "SortMergeJoin" in line and "[id#" in line]


def test_an_inherited_list_is_made_once_for_its_holder(spark):
    text = plan(spark, "q_inherit_list")
    assert reads(text, "l_orderkey") == reads(text, "event_id") == 0
    assert "posexplode" not in text  # no row for each pair of an order and what it inherits


def below_leagues(spark) -> GraphStore:
    """Leagues above matches and teams, matches above teams; some without a parent, some with a parent that is no node."""
    types = {"league": {"prefix": "le", "fields": {}}, "match": {"prefix": "ma", "fields": {}}, "team": {"prefix": "te", "fields": {}}}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    match = frame([(f"ma{i}", f"le{i % 4}" if i % 5 else None) for i in range(20)], "id string, `^league` string")
    team = frame([(f"te{i}", f"le{i % 3}" if i % 4 else None, f"ma{i % 23}" if i % 3 else None) for i in range(60)], "id string, `^league` string, `^match` string")
    typed = lambda df, t: df.withColumn("type", F.lit(t))
    wide = {"match": typed(match, "match"), "team": typed(team, "team")}
    nodes = {"league": typed(frame([(f"le{i}",) for i in range(3)], "id string"), "league"), **{t: x.select("id", "type") for t, x in wide.items()}}
    links = {(a, t): wide[t].where(F.col(f"^{a}").isNotNull()).select(F.col(f"^{a}").alias("parent"), F.col("id").alias("child")) for a, t in (("league", "match"), ("league", "team"), ("match", "team"))}
    return GraphStore(spark, GraphSchema.of({"types": types}), nodes, links, single_parent=frozenset(links), wide=wide)


def test_chains_as_columns_equal_chains_as_rows(spark):
    store = below_leagues(spark)
    rows = lambda df: sorted(tuple(r) for r in df.select("start_id", "id", "depth").collect())
    for t in ("league", "match"):
        start = store.nodes[t].select(F.col("id").alias("start_id"), "id")
        assert rows(tr.descendants(store, start, {t}, each_once=True)) == rows(tr.descendants(store, start, {t}))
    without = store.with_(links=dict(store.links), wide={})
    assert rows(tr.every_node(store)) == rows(tr.every_node(without))
    assert rows(tr.every_node(store, {"team"})) == rows(tr.every_node(without, {"team"}))
    assert sorted(r.id for r in store.heads().collect()) == sorted(r.id for r in without.heads().collect())
    assert store.with_(links={**store.links, ("league", "match"): store.links["league", "match"].limit(3)}).wide.keys() == {"team"}


def test_a_level_of_the_loop_reads_only_links_from_its_types(spark, monkeypatch):
    made, write = [], tr.materialize

    def kept(df, name="table"):
        made.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(tr, "materialize", kept)
    found = catalogue.QUERIES["q_descendants_loop"](spark, SMALL)
    assert sum(reads(x, "l_orderkey") for x in made) == 2  # below suppliers and below orders
    assert found.count() == found.distinct().count() > 1000


def test_the_loop_starts_from_ids_without_a_known_prefix(spark):
    store = below_leagues(spark)
    links = {("league", "match"): spark.createDataFrame([("zz1", "ma1"), ("le1", "ma2")], "parent string, child string"), ("match", "match"): spark.createDataFrame([("ma1", "ma3"), ("ma3", "ma1"), ("ma2", "ma3")], "parent string, child string")}
    store = store.with_(links=links)
    got = tr.bfs(store, tr.starts(store, ["zz1", "le1"]), tr.child_hops(store))
    assert sorted((r.start_id, r.id, r.depth) for r in got.collect()) == [("le1", "ma1", 3), ("le1", "ma2", 1), ("le1", "ma3", 2), ("zz1", "ma1", 1), ("zz1", "ma3", 2)]
