"""The graph as tables: a typed frame for each node type, hierarchy, edges and aliases; reading and writing them.

hierarchy and edges are kept apart by the types of their ends, so that a traversal whose
types are known reads only the tables it can pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import GraphSchema

EDGES = "src string, field string, key string, dst string, meta map<string,string>"
ROOT = "root"


@dataclass(frozen=True)
class GraphStore:
    """An immutable snapshot. nodes: by type; links: (parent, child) by (parent's type, child's type); edges: by (type, field, target's type)."""

    spark: SparkSession
    schema: GraphSchema
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    links: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    edges: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)
    aliases: DataFrame | None = None
    #: Pairs of types for which the source promises that a child has one parent of that type.
    single_parent: frozenset = frozenset()
    #: By type: nodes of some ids, read with a filter on the source's own key.
    finders: dict[str, Callable[[list[str]], DataFrame]] = field(default_factory=dict)
    #: By type: the nodes with the id of their one parent of each type a (^a) and of their one reference in a field f (@f), where the source keeps them in the nodes' own rows. All links to the type are among them.
    wide: dict[str, DataFrame] = field(default_factory=dict)

    # views

    def with_(self, **changes) -> GraphStore:
        if "wide" not in changes and {"nodes", "links", "edges"} & set(changes):  # only for types whose nodes, parents and edges are as they were
            new = replace(self, **changes)
            links = lambda g, t: {k: id(x) for k, x in g.links.items() if k[1] == t}
            edges = lambda g, t: {k: id(x) for k, x in g.edges.items() if k[0] == t}
            changes["wide"] = {t: x for t, x in self.wide.items() if new.nodes.get(t) is self.nodes.get(t) and links(new, t) == links(self, t) and edges(new, t) == edges(self, t)}
        if "nodes" in changes and "finders" not in changes:  # a finder reads the source: only for types that are as they were
            changes["finders"] = {t: f for t, f in self.finders.items() if changes["nodes"].get(t) is self.nodes.get(t)}
        return replace(self, **changes)

    def find(self, ids: list[str]) -> DataFrame:
        """The nodes of some ids with the columns of their types; only the tables of these types are read."""
        by_type: dict[str, list[str]] = {}
        for i in ids:
            if (t := self.schema.type_of(i)) in self.nodes:
                by_type.setdefault(t, []).append(i)
        kept = {t: self.finders[t](x) if t in self.finders else self.nodes[t].where(F.col("id").isin(x)) for t, x in by_type.items()}
        return replace(self, nodes=kept).node_rows()

    @property
    def types(self) -> list[str]:
        return sorted(self.nodes)

    def hierarchy(self) -> DataFrame:
        """parent, child."""
        return _union([x.select("parent", "child") for x in self.links.values()], self.spark, "parent string, child string")

    def edge_rows(self, field_: str | None = None, sources: set[str] | None = None) -> DataFrame:
        """src, field, key, dst, meta; of one field, or of some source types."""
        found = [x for (s, f, _), x in self.edges.items() if (field_ is None or f == field_) and (sources is None or s in sources)]
        return _union(found, self.spark, EDGES)

    def alias_rows(self) -> DataFrame:
        return self.aliases if self.aliases is not None else self.spark.createDataFrame([], "alias string, node_id string")

    def columns(self, types: set[str] | None = None) -> dict[str, T.DataType]:
        out: dict[str, T.DataType] = {}
        for t in self.types:
            if types is None or t in types:
                for f in self.nodes[t].schema.fields:
                    have = out.setdefault(f.name, f.dataType)
                    if have != f.dataType:
                        out[f.name] = T.StringType()  # types disagree: as text
        return out

    def node_rows(self, types: set[str] | None = None, needed: set[str] | None = None) -> DataFrame:
        """All nodes of some types with the union of their columns (or the needed ones)."""
        kinds = {c: k for c, k in self.columns(types).items() if needed is None or c in needed or c in ("id", "type")}
        parts = []
        for t in self.types:
            if types is None or t in types:
                df = self.nodes[t]
                parts.append(df.select(*((F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items())))
        return _union(parts, self.spark, T.StructType([T.StructField(c, k) for c, k in (kinds or {"id": T.StringType(), "type": T.StringType()}).items()]))

    def with_parents(self, t: str, *columns: str) -> DataFrame:
        """The nodes of a type with some columns, and with what wide adds to them."""
        if t not in self.wide:
            return self.nodes[t].select(*columns)
        return self.wide[t].select(*columns, *(c for c in self.wide[t].columns if c[0] in "^@"))

    def heads_of(self, t: str) -> DataFrame:
        """id, type: the nodes of a type without a parent."""
        links = [x.select(F.col("child").alias("id")) for (_, b), x in self.links.items() if b == t]
        if t not in self.wide or not links:
            rows = self.nodes[t].select("id", "type")
            return rows.join(_union(links, self.spark, "id string"), "id", "left_anti") if links else rows
        rows = self.wide[t]
        for a, b in self.links:
            rows = rows.where(F.col(f"^{a}").isNull()) if b == t else rows
        return rows.select("id", "type")

    def heads(self) -> DataFrame:
        """Nodes without a parent."""
        return _union([self.heads_of(t) for t in self.types], self.spark, "id string, type string")

    # building

    @classmethod
    def of(cls, spark: SparkSession, schema: GraphSchema, payloads: list[dict]) -> GraphStore:
        """A store with the payloads set one after another; for small graphs and tests."""
        from ..operators.mutate import set_nodes

        return set_nodes(cls.empty(spark, schema), payloads)

    @classmethod
    def empty(cls, spark: SparkSession, schema: GraphSchema) -> GraphStore:
        nodes = {t: spark.createDataFrame([], d.struct()) for t, d in schema.types.items()}
        root = spark.range(1).select(F.lit(ROOT).alias("id"), F.lit(ROOT).alias("type"))
        nodes["root"] = nodes["root"].unionByName(root, allowMissingColumns=True)
        return cls(spark, schema, nodes)

    # sources and sinks

    def save(self, path: str) -> None:
        """Writes the snapshot as parquet tables below path: a new version folder, then the index that names it.

        Older versions stay, as snapshots loaded from them may still be read (also the one that is saved).
        """
        import json
        import uuid

        version = f"{path}/versions/{uuid.uuid4().hex}"
        for t, df in self.nodes.items():
            df.write.parquet(f"{version}/nodes/{t}")
        for (a, b), df in self.links.items():
            df.write.parquet(f"{version}/links/{a}/{b}")
        for (a, f, b), df in self.edges.items():
            df.write.parquet(f"{version}/edges/{a}/{f}/{b}")
        self.alias_rows().write.parquet(f"{version}/aliases")
        told = {"languages": self.schema.languages, "types": {k: {"prefix": v.prefix, "fields": v.fields} for k, v in self.schema.types.items() if k != "root"}, "rootType": {"fields": self.schema.types["root"].fields}}
        index = {"version": version, "schema": told, "nodes": list(self.nodes), "links": list(self.links), "edges": list(self.edges)}
        self.spark.createDataFrame([(json.dumps(index),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphStore:
        import json

        index = json.loads(spark.read.text(f"{path}/index").first()[0])
        read = lambda name: spark.read.parquet(f"{index['version']}/{name}")
        return cls(spark, GraphSchema.of(index["schema"]), {t: read(f"nodes/{t}") for t in index["nodes"]}, {(a, b): read(f"links/{a}/{b}") for a, b in index["links"]}, {(a, f, b): read(f"edges/{a}/{f}/{b}") for a, f, b in index["edges"]}, read("aliases"))

    def backup(self, path: str, now_ms: int) -> str:
        """A snapshot below path, named by its time; any store that Spark writes to will do."""
        name = f"{path}/{now_ms:015d}"
        self.save(name)
        self.spark.createDataFrame([(now_ms, name)], "at long, path string").coalesce(1).write.mode("append").parquet(f"{path}/backups")
        return name

    @classmethod
    def restore(cls, spark: SparkSession, path: str, before_ms: int | None = None) -> GraphStore:
        """The last backup, or the last one up to a time."""
        known = spark.read.parquet(f"{path}/backups")
        last = known.where(F.col("at") <= before_ms) if before_ms is not None else known
        found = last.agg(F.max_by("path", "at").alias("path")).first().path
        if found is None:
            raise ValueError("no backup")
        return cls.load(spark, found)

    def registry(self) -> DataFrame:
        """type, prefix, fields: the types as rows."""
        return self.spark.createDataFrame([(t, d.prefix, sorted(d.fields)) for t, d in sorted(self.schema.types.items())], "type string, prefix string, fields array<string>")

    def dump_json(self, path: str) -> None:
        """Nodes and relations as JSON lines, one folder a table."""
        for t, df in self.nodes.items():
            df.write.mode("overwrite").json(f"{path}/nodes/{t}")
        self.hierarchy().write.mode("overwrite").json(f"{path}/hierarchy")
        self.edge_rows().write.mode("overwrite").json(f"{path}/edges")
        self.alias_rows().write.mode("overwrite").json(f"{path}/aliases")

    @classmethod
    def import_json(cls, spark: SparkSession, schema: GraphSchema, path: str) -> GraphStore:
        nodes = {t: spark.read.schema(d.struct()).json(f"{path}/nodes/{t}") for t, d in schema.types.items()}
        store = cls(spark, schema, nodes, aliases=spark.read.schema("alias string, node_id string").json(f"{path}/aliases"))
        return store.with_links(spark.read.schema("parent string, child string").json(f"{path}/hierarchy")).with_edges(spark.read.schema(EDGES).json(f"{path}/edges"))

    def _type_column(self, c: str):
        return F.when(F.col(c) == ROOT, ROOT).otherwise(F.create_map(*(F.lit(x) for p, t in self.schema.prefixes.items() for x in (p, t)))[F.substring(c, 1, 2)])

    def with_links(self, rows: DataFrame) -> GraphStore:
        """The store with the hierarchy (parent, child), dealt by the types that the ids' prefixes tell."""
        typed = rows.select("parent", "child", self._type_column("parent").alias("a"), self._type_column("child").alias("b"))
        known = set(self.schema.types)
        pairs = [(r.a, r.b) for r in typed.select("a", "b").distinct().collect() if r.a in known and r.b in known]  # pairs of types: few
        return self.with_(single_parent=frozenset(), links={(a, b): typed.where((F.col("a") == a) & (F.col("b") == b)).select("parent", "child").distinct() for a, b in pairs})

    def with_edges(self, rows: DataFrame) -> GraphStore:
        typed = rows.select("*", self._type_column("src").alias("a"), self._type_column("dst").alias("b"))
        known = set(self.schema.types)
        keys = [(r.a, r.field, r.b) for r in typed.select("a", "field", "b").distinct().collect() if r.a in known and r.b in known]
        return self.with_(edges={(a, f, b): typed.where((F.col("a") == a) & (F.col("field") == f) & (F.col("b") == b)).drop("a", "b") for a, f, b in keys})

    def append_timeseries(self, rows: DataFrame, path: str) -> None:
        """The sink for timeseries fields: node_id, field, ts, value rows are appended."""
        rows.select("node_id", "field", "ts", "value").write.mode("append").partitionBy("field").parquet(path)


def _union(parts: list[DataFrame], spark: SparkSession, empty) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], empty)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
