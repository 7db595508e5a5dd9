"""Running statements: text to syntax to DataFrames, clause by clause."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import NotImplementedFeature, QueryRuntimeError, SemanticError
from .graph import Constraint, PropertyGraph
from .operators import write
from .operators.bulk import create_constants, pinned
from .operators.frame import Frame
from .operators.match import Matcher
from .operators.project import project, result, unwind
from .plans import syntax as s
from .plans.parser import parse
from .sources.csv import load_csv
from .sources.export import export_cypher
from .sources.store import GraphStore


def usage(clauses: tuple[s.Node, ...]) -> dict[str, set[str] | None] | None:
    """What is used of each variable besides its id: names of properties, or None for everything. Patterns, id(),
    count(), tests for null and passing it on under its name use nothing; what SET, REMOVE and DELETE change is used
    as a whole, and so is a node whose labels are asked for again. None: everything is used of all."""
    used: dict[str, set[str] | None] = {}
    bound: set[str] = set()

    def visit(e: s.Node) -> None:
        todo = [e]
        while todo:
            x = todo.pop()
            if isinstance(x, (s.NodePattern, s.RelPattern)) and x.name:
                used.setdefault(x.name, set())
                if isinstance(x, s.NodePattern) and x.labels and x.name in bound:
                    used[x.name] = None
                bound.add(x.name)
                if used[x.name] is not None:
                    used[x.name].update(k for k, _ in x.properties)
            if isinstance(x, (s.Call, s.IsNull)):
                args = x.args if isinstance(x, s.Call) else (x.value,)
                if (isinstance(x, s.IsNull) or x.name in ("id", "count")) and len(args) == 1 and isinstance(args[0], s.Variable):
                    used.setdefault(args[0].name, set())
                    continue
            if isinstance(x, s.Property) and isinstance(x.base, s.Variable):
                used.setdefault(x.base.name, set())
                if used[x.base.name] is not None:
                    used[x.base.name].add(x.name)
                continue
            if isinstance(x, s.Variable):
                used[x.name] = None
            if isinstance(x, s.SetItem):
                used[x.name] = None
            if isinstance(x, s.MapProjection):
                used.update({i[1]: None for i in x.items if i[0] == "variable"})
            todo.extend(x.children())

    for c in clauses:
        if isinstance(c, s.Projection) and c.star:
            return None
        if isinstance(c, s.Projection):
            for i in c.items:
                if not (not c.final and isinstance(i.value, s.Variable) and i.alias in (None, i.value.name)):
                    visit(i.value)
            for x in (*c.order, *[y for y in (c.where, c.skip, c.limit) if y is not None]):
                visit(x)
        elif isinstance(c, (s.Match, s.Create, s.Merge)):
            for p in (c.path,) if isinstance(c, s.Merge) else c.paths:
                visit(p)
                if p.name:
                    used.update({n.name: None for n in p.nodes if n.name})
            for x in (c.where,) if isinstance(c, s.Match) else (*c.on_create, *c.on_match) if isinstance(c, s.Merge) else ():
                if x is not None:
                    visit(x)
        else:
            visit(c)
    return used


class GraphSession:
    """A graph, and queries over it. Reads are lazy; a write makes a new version of the graph, which takes the old
    one's place once it is complete and keeps the constraints."""

    def __init__(self, graph: PropertyGraph, relationship_uniqueness: bool = False, store: GraphStore | None = None, marks: dict[str, Any] | None = None) -> None:
        self.graph, self.unique, self.store, self.marks = graph, relationship_uniqueness, store, dict(marks or {})

    @classmethod
    def stored(cls, spark: SparkSession, path: str, relationship_uniqueness: bool = False) -> GraphSession:
        """The graph that a folder keeps, to which every statement that writes commits what it has changed."""
        store = GraphStore(spark, path)
        graph, marks = store.load()
        return cls(graph, relationship_uniqueness, store, marks)

    @property
    def spark(self):
        return self.graph.spark

    def cypher(self, text: str, params: dict[str, Any] | None = None, marks: dict[str, Any] | None = None) -> DataFrame:
        """The result of a statement; one without RETURN gives no columns and no rows. ``marks`` are kept in the store
        along with what the statement writes."""
        statement = parse(text)
        if isinstance(statement, s.CreateConstraint):
            c = Constraint(statement.label, statement.properties, statement.kind, statement.type_name)
            self.adopt(self.graph.with_constraint(c), marks)
            return self.nothing()
        graph, out = self.graph, None
        for k, q in enumerate(statement.queries):
            graph, df = self.run(q, graph, params or {})
            if out is None:
                out = df
                continue
            if df is None or len(df.columns) != len(out.columns):
                raise SemanticError("the queries of a UNION return equally many columns")
            out = _union(out, df)
            if not statement.keep[k - 1]:
                out = out.distinct()
        self.adopt(graph, marks)
        return self.nothing() if out is None else out

    execute = cypher

    def adopt(self, graph: PropertyGraph, marks: dict[str, Any] | None = None) -> None:
        """A new version of the graph takes the old one's place, in the store too."""
        if self.store is not None and (graph is not self.graph or marks):
            now = self.marks | (marks or {})
            graph = self.store.commit(graph, now)
            self.marks = now
        self.graph = graph

    # -- single nodes and relationships, without a query's text -----------------------------------------------------

    def create_node(self, labels: Iterable[str], properties: dict[str, Any] | None = None) -> int:
        """The id of the node that is made."""
        made = self.graph.next_node
        self._create(s.PathPattern(None, (s.NodePattern(None, tuple(labels), _constants(properties)),), ()), {})
        return made

    def create_edge(self, kind: str, src: int, dst: int, properties: dict[str, Any] | None = None) -> int:
        """The id of the relationship that is made between two nodes, which must exist."""
        found = {r[0] for r in self.graph.node_table().filter(F.col("_id").isin(src, dst)).select("_id").collect()}
        if missing := {src, dst} - found:
            raise QueryRuntimeError(f"no node has the id {min(missing)}")
        made = self.graph.next_edge
        ends = s.NodePattern("a", (), ()), s.NodePattern("b", (), ())
        self._create(s.PathPattern(None, ends, (s.RelPattern(None, (kind,), "out", False, None, None, _constants(properties)),)), {"a": src, "b": dst})
        return made

    def _create(self, path: s.PathPattern, known: dict[str, int]) -> None:
        m = Matcher(self.graph, {}, s.Names())
        create_constants(m, (path,), known)
        self.adopt(m.graph)

    def get_node(self, id_: int) -> dict[str, Any] | None:
        """Id, labels and properties (those that it has) of a node."""
        r = self.graph.node_table().filter(F.col("_id") == id_).first()
        return None if r is None else {"id": r["_id"], "labels": r["_labels"], "properties": _given(r, ("_id", "_labels"))}

    def get_edge(self, id_: int) -> dict[str, Any] | None:
        r = self.graph.edge_table().filter(F.col("_id") == id_).first()
        return None if r is None else {"id": r["_id"], "type": r["_type"], "src": r["_src"], "dst": r["_dst"], "properties": _given(r, ("_id", "_type", "_src", "_dst"))}

    def match_nodes(self, label: str | None = None) -> DataFrame:
        """All nodes, or those with a label: _id, _labels and properties."""
        return self.graph.node_table([label] if label else [])

    def node_count(self) -> int:
        return self.graph.node_count()

    def edge_count(self) -> int:
        return self.graph.edge_count()

    def export_cypher(self) -> str:
        return export_cypher(self.graph)

    def nothing(self) -> DataFrame:
        return self.spark.range(0).select()

    def run(self, query: s.Query, graph: PropertyGraph, params: dict[str, Any]) -> tuple[PropertyGraph, DataFrame | None]:
        m = Matcher(graph, params, s.Names(), usage(query.clauses) or {}, self.unique)
        frame = Frame(graph.spark.range(1).select(), {}, True)
        if pinned(m, query.clauses):
            return m.graph, None
        if len(query.clauses) == 1 and isinstance(query.clauses[0], s.Create) and create_constants(m, query.clauses[0].paths, {}):
            return m.graph, None
        for k, c in enumerate(query.clauses):
            if isinstance(c, (s.Merge, s.SetClause, s.Remove)):
                m.later = usage(query.clauses[k + 1 :])
            if isinstance(c, s.Match):
                if c.kind == "optional":
                    frame = m.optional(frame, c.paths, c.where)
                elif c.kind == "mandatory":
                    frame = m.mandatory(frame, c.paths)
                    frame = frame if c.where is None else m.filter(frame, c.where)
                else:
                    frame = m.match(frame, c.paths, c.where)
                frame = Frame(frame.df, {n: b for n, b in frame.vars.items() if not n.startswith("__")})
            elif isinstance(c, s.Where):
                frame = m.filter(frame, c.value)
            elif isinstance(c, s.Projection):
                frame, names = project(m, frame, c)
                if c.final:
                    return m.graph, result(frame, names)
            elif isinstance(c, s.Unwind):
                frame = unwind(m, frame, c)
            elif isinstance(c, s.LoadCsv):
                frame = load_csv(m, frame, c)
            elif isinstance(c, s.Create):
                frame = write.create(m, frame, c.paths)
            elif isinstance(c, s.Merge):
                frame = write.merge(m, frame, c)
            elif isinstance(c, s.SetClause):
                frame = write.set_items(m, frame, c.items)
            elif isinstance(c, s.Remove):
                frame = write.remove_items(m, frame, c.items)
            elif isinstance(c, s.Delete):
                frame = write.delete(m, frame, c.values, c.detach)
            else:
                raise NotImplementedFeature(type(c).__name__)
        return m.graph, None


def _constants(properties: dict[str, Any] | None) -> tuple[tuple[str, s.Node], ...]:
    return tuple((k, s.Literal(v)) for k, v in (properties or {}).items())


def _given(row: Row, fixed: tuple[str, ...]) -> dict[str, Any]:
    return {k: v for k, v in row.asDict().items() if k not in fixed and v is not None}


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """By position, under the first one's names; void columns take the other's type."""
    names = [f"c{k}" for k in range(len(a.columns))]
    return a.toDF(*names).unionAll(b.toDF(*names)).toDF(*a.columns)


__all__ = ["GraphSession", "usage"]
