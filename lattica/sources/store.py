"""Durable graphs: a folder of Parquet tables, nodes/<labels> and edges/<type>, with what else a graph has in meta; or a
store of versions, to which every statement adds the tables it has changed."""

from __future__ import annotations

import json
import urllib.parse
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..graph import Constraint, PropertyGraph


def _name(labels: tuple[str, ...]) -> str:
    return urllib.parse.quote(":".join(labels) or "-", safe="")


def save_graph(graph: PropertyGraph, path: str, mode: str = "errorifexists") -> None:
    """Writes all tables, then the meta file that makes them a graph."""
    for labels, df in graph.nodes.items():
        df.write.mode(mode).parquet(f"{path}/nodes/{_name(labels)}")
    for kind, df in graph.edges.items():
        df.write.mode(mode).parquet(f"{path}/edges/{urllib.parse.quote(kind, safe='')}")
    graph.spark.createDataFrame([(json.dumps(_meta(graph)),)], "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def _meta(graph: PropertyGraph) -> dict:
    return {
        "nodes": [list(k) for k in graph.nodes],
        "edges": list(graph.edges),
        "ends": {k: [list(a), list(b)] for k, (a, b) in graph.ends.items()},
        "constraints": [[c.label, list(c.properties), c.kind, c.type_name] for c in graph.constraints],
        "next": [graph.next_node, graph.next_edge],
    }


def _graph(spark: SparkSession, meta: dict, nodes: dict[tuple[str, ...], DataFrame], edges: dict[str, DataFrame]) -> PropertyGraph:
    ends = {k: (tuple(a), tuple(b)) for k, (a, b) in meta["ends"].items()}
    constraints = tuple(Constraint(label, tuple(ps), kind, t) for label, ps, kind, t in meta["constraints"])
    return PropertyGraph(spark, nodes, edges, ends, {}, constraints, *meta["next"])


def load_graph(spark: SparkSession, path: str) -> PropertyGraph:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    nodes = {tuple(k): spark.read.parquet(f"{path}/nodes/{_name(tuple(k))}") for k in meta["nodes"]}
    edges = {k: spark.read.parquet(f"{path}/edges/{urllib.parse.quote(k, safe='')}") for k in meta["edges"]}
    return _graph(spark, meta, nodes, edges)


class GraphStore:
    """Versions of a graph in a folder: tables/<id> are written once, versions/<n> says which tables a version has. A
    commit writes the tables that have changed, then the version, which counts from then on; tables that neither of
    the last two versions has are deleted. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def _files(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._files().listStatus(p)] if self._files().exists(p) else []

    def _complete(self) -> list[int]:
        """Versions, but those whose writer was lost."""
        done = lambda n: self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{n}/_SUCCESS"))
        return sorted(int(n) for n in self._listed("versions") if n.isdigit() and done(n))

    def _meta_of(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}").first()[0])

    def _read(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.path}/tables/{name}")
        return self._known[name]

    def load(self) -> tuple[PropertyGraph, dict]:
        """The last version, an empty graph if there is none; and the marks it was committed with."""
        versions = self._complete()
        if not versions:
            return PropertyGraph(self.spark), {}
        meta = self._meta_of(versions[-1])
        nodes = {tuple(k): self._read(t) for k, t in zip(meta["nodes"], meta["node_tables"], strict=True)}
        return _graph(self.spark, meta, nodes, {k: self._read(t) for k, t in zip(meta["edges"], meta["edge_tables"], strict=True)}), meta["marks"]

    def commit(self, graph: PropertyGraph, marks: dict | None = None) -> PropertyGraph:
        """Writes a version, and gives the graph over the tables of the store."""
        written = {id(df): name for name, df in self._known.items()}

        def kept(df: DataFrame) -> str:
            if id(df) not in written:
                name = uuid.uuid4().hex
                df.write.parquet(f"{self.path}/tables/{name}")
                self._read(name)
                written[id(df)] = name
            return written[id(df)]

        node_tables, edge_tables = [kept(df) for df in graph.nodes.values()], [kept(df) for df in graph.edges.values()]
        meta = _meta(graph) | {"node_tables": node_tables, "edge_tables": edge_tables, "marks": marks or {}}
        before = self._complete()
        version = max([-1, *(int(n) for n in self._listed("versions") if n.isdigit())]) + 1
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{self.path}/versions/{version}")
        used = {*node_tables, *edge_tables}
        for n in before[-1:]:
            older = self._meta_of(n)
            used |= {*older["node_tables"], *older["edge_tables"]}
        for name in set(self._listed("tables")) - used:
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tables/{name}"), True)
            self._known.pop(name, None)
        for n in before[:-1]:
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{n}"), True)
        nodes = {k: self._read(t) for k, t in zip(graph.nodes, node_tables, strict=True)}
        return replace(graph, nodes=nodes, edges={k: self._read(t) for k, t in zip(graph.edges, edge_tables, strict=True)})
