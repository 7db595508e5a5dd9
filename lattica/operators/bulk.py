"""Long statements of constants: nodes and relationships written as literals become tables at once, and many nodes
looked up by constants become one join. Plans then don't grow with the statement."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import MISSING, Typed, common, equal, is_null
from ..graph import Tables, label_set
from ..plans import syntax as s
from .expressions import Scope, lower
from .frame import col
from .match import Matcher
from .write import appended, storable

#: Lookups in one statement from which they are made by one join.
MANY = 16


def constants(m: Matcher, properties: tuple[tuple[str, s.Node], ...]) -> dict[str, Typed] | None:
    """The values of properties if all are constants; null ones are left out."""
    out: dict[str, Typed] = {}
    for key, e in properties:
        if any(isinstance(x, (s.Variable, s.Call, s.Exists, s.PatternComprehension)) for x in s.walk(e)):
            return None
        x = lower(e, Scope({}, m.params))
        if x.value is MISSING:
            return None
        if not is_null(x):
            out[key] = storable(x, key)
        else:
            out.pop(key, None)
    return out


def create_constants(m: Matcher, paths: tuple[s.PathPattern, ...], known: dict[str, int]) -> bool:
    """CREATE of constants between nodes whose ids are ``known``, or that it makes itself; false if it is another kind
    of CREATE. ``known`` gets the ids of what is made."""
    if any(p.shortest or p.name for p in paths):
        return False
    ids, nodes, edges = dict(known), {}, {}
    node_id, edge_id = m.graph.next_node, m.graph.next_edge
    for p in paths:
        ends = []
        for q in p.nodes:
            if q.name and q.name in ids:
                if q.labels or q.properties:
                    return False
                ends.append(ids[q.name])
                continue
            values = constants(m, q.properties)
            if values is None:
                return False
            nodes.setdefault(label_set(q.labels), []).append((node_id, values))
            if q.name:
                ids[q.name] = node_id
            ends.append(node_id)
            node_id += 1
        for k, r in enumerate(p.rels):
            values = constants(m, r.properties)
            if values is None or r.variable_length or len(r.types) != 1 or r.name:
                return False
            a, b = (ends[k + 1], ends[k]) if r.direction == "in" else (ends[k], ends[k + 1])
            edges.setdefault(r.types[0], []).append((edge_id, values, a, b))
            edge_id += 1
    node_tables, edge_tables = Tables.copied(m.graph.nodes), Tables.copied(m.graph.edges)
    for labels, rows in nodes.items():
        node_tables[labels] = appended(node_tables.get(labels), _table(m, rows, []))
    for kind, rows in edges.items():
        edge_tables[kind] = appended(edge_tables.get(kind), _table(m, rows, ["_src", "_dst"]))
    ends_ = {t: e for t, e in m.graph.ends.items() if t not in edges}
    graph = replace(m.graph, nodes=node_tables, edges=edge_tables, ends=ends_, carried={}, next_node=node_id, next_edge=edge_id)
    m.graph = graph.checked({x for k in nodes for x in k})
    known.update(ids)
    return True


def _table(m: Matcher, rows: list[tuple], ends: list[str]):
    kinds: dict[str, list[T.DataType]] = {}
    for _, values, *_ in rows:
        for k, x in values.items():
            kinds.setdefault(k, []).append(x.type)
    types = {k: common(v) for k, v in kinds.items()}
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_id", *ends)] + [T.StructField(k, t) for k, t in types.items()])

    def fit(v: Any, kind: T.DataType) -> Any:
        if v is None:
            return None
        return float(v) if isinstance(kind, T.DoubleType) else str(v) if isinstance(kind, T.StringType) and not isinstance(v, str) else v

    data = [(i, *more, *(fit(values[k].value if k in values else None, t) for k, t in types.items())) for i, values, *more in rows]
    return m.graph.spark.createDataFrame(data, schema)


def pinned(m: Matcher, clauses: tuple[s.Node, ...]) -> bool:
    """Runs a statement of many constant lookups followed by CREATEs of constants between what they find; false, and
    nothing done, if the statement is of another kind or a lookup finds several nodes."""
    looks: dict[str, s.NodePattern] = {}
    at = 0
    while at < len(clauses) and isinstance(c := clauses[at], s.Match) and c.kind == "plain" and c.where is None:
        for p in c.paths:
            q = p.nodes[0]
            if p.rels or p.name or not q.name or q.name in looks or not q.properties:
                return False
            looks[q.name] = q
        at += 1
    rest = clauses[at:]
    if len(looks) < MANY or not rest or not all(isinstance(c, s.Create) for c in rest):
        return False
    groups: dict[tuple, list[tuple[str, dict[str, Typed]]]] = {}
    for name, q in looks.items():
        values = constants(m, q.properties)
        if values is None or len(values) < len(dict(q.properties)):
            return False
        groups.setdefault((q.labels, tuple(sorted((k, x.type.simpleString()) for k, x in values.items()))), []).append((name, values))
    known: dict[str, int] = {}
    for (labels, keys), items in groups.items():
        names = [k for k, _ in keys]
        table = m.graph.node_table(labels)
        if any(k not in table.columns for k in names):
            return True  # nothing is found, so nothing is made
        schema = T.StructType([T.StructField("__name", T.StringType())] + [T.StructField(f"__{k}", items[0][1][k].type) for k in names])
        wanted = m.graph.spark.createDataFrame([(n, *(v[k].value for k in names)) for n, v in items], schema)
        test = F.lit(True)
        for k in names:  # equal as the language has it: text is never a number
            test = test & equal(Typed(table[f"`{k}`"], table.schema[k].dataType), Typed(wanted[f"`__{k}`"], wanted.schema[f"__{k}"].dataType))
        met = table.join(F.broadcast(wanted), test).groupBy("__name").agg(F.min("_id").alias("id"), F.count("*").alias("n"))
        found = {r["__name"]: (r["id"], r["n"]) for r in met.select("__name", col("id"), "n").collect()}  # a row per lookup of the statement
        if any(n not in found for n, _ in items):
            return True
        if any(n > 1 for _, n in found.values()):
            return False
        known |= {k: i for k, (i, _) in found.items()}
    before = m.graph
    for c in rest:
        if not create_constants(m, c.paths, known):
            m.graph = before
            return False
    return True
