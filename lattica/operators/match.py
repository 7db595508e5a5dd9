"""Pattern matching as joins.

A pattern starts at a node that is bound already, else at its most selective one, and grows by equi-joins with edge
and node tables. Variables that several patterns share become equalities, never re-scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotImplementedFeature, QueryRuntimeError, SemanticError
from ..functions.typed import Typed, is_rel, truth
from ..graph import PropertyGraph, Tables
from ..lineage import materialise
from ..plans import syntax as s
from .expressions import Scope, condition, lower, names_in
from .frame import Entity, Frame, Value, col, entity_frame, null_safe

#: Hops of a pattern without an upper bound: a frontier that is left after so many is an error.
MOST_HOPS = 100
#: Bounds up to this are unrolled into one plan; beyond it every level is written out.
UNROLLED = 3


@dataclass
class Matcher:
    """``used``: what is used of variables besides their ids, names of properties or None for everything; unknown
    ones count as used. ``unique``: relationships of one MATCH differ. ``later``: what the clauses after the one that
    runs use, None for everything."""

    graph: PropertyGraph
    params: dict[str, Any]
    names: s.Names
    used: dict[str, set[str] | None] = field(default_factory=dict)
    unique: bool = False
    later: dict[str, set[str] | None] | None = None
    _rels: list[str] = field(default_factory=list)
    _late: list[tuple[str, str, s.Node]] | None = None
    _where: s.Node | None = None

    def scope(self, frame: Frame, replaced: dict[s.Node, Typed] | None = None) -> Scope:
        return Scope(frame.vars, self.params, None, replaced)

    # -- MATCH ------------------------------------------------------------------------------------------------------

    def match(self, frame: Frame, paths: tuple[s.PathPattern, ...], where: s.Node | None = None) -> Frame:
        todo, self._rels, self._where = list(paths), [], where
        before, self._late = self._late, []
        while todo:
            at = next((k for k, p in enumerate(todo) if names_in(p) & set(frame.vars)), 0)
            frame = self.path(frame, todo.pop(at))
        late, self._late = self._late, before
        for name, key, value in late:  # properties that mention what was bound after them
            frame = self.with_properties(frame, name, ((key, value),))
        if self.unique:
            own = [frame.vars[n] for n in self._rels]
            for k, a in enumerate(own):
                for b in own[:k]:  # tables of different types may have been numbered apart
                    frame = frame.keep(frame.df.filter((col(a.id) != col(b.id)) | (col(a.column("_type")) != col(b.column("_type")))))
        return frame if where is None else self.filter(frame, where)

    def path(self, frame: Frame, p: s.PathPattern) -> Frame:
        if p.shortest:
            from .paths import shortest_path

            return shortest_path(self, frame, p)
        names = [n.name or self.names.fresh("n") for n in p.nodes]
        bound = [k for k, n in enumerate(names) if n in frame.vars]
        given = lambda k: bool(p.nodes[k].properties) and all(names_in(v) <= set(frame.vars) for _, v in p.nodes[k].properties)
        rank = lambda k: (given(k), self.held_from(p, k), bool(p.nodes[k].labels), -k)
        start = bound[0] if bound else max(range(len(names)), key=rank)
        frame = self.node(frame, p.nodes[start], names[start])
        segments: dict[int, str] = {}
        for k in range(start, len(p.rels)):
            frame, segments[k] = self.hop(frame, p.rels[k], names[k], p.nodes[k + 1], names[k + 1], False, bool(p.name))
        for k in range(start - 1, -1, -1):
            frame, segments[k] = self.hop(frame, p.rels[k], names[k + 1], p.nodes[k], names[k], True, bool(p.name))
        if p.name and p.rels:
            from .paths import build_path

            frame = build_path(self, frame, p, names, segments)
        return frame

    def held_from(self, p: s.PathPattern, start: int) -> int:
        """How many hops from there arrive at nodes that their edges' tables hold."""
        onward = sum(self.held(p.rels[k], p.nodes[k + 1], False) is not None for k in range(start, len(p.rels)))
        return onward + sum(self.held(p.rels[k], p.nodes[k], True) is not None for k in range(start))

    def node(self, frame: Frame, p: s.NodePattern, name: str) -> Frame:
        """Binds a node by a scan, or checks one that is bound."""
        if name in frame.vars:
            return self.check_node(frame, p, name)
        df, e = entity_frame(self.graph.node_table(p.labels), "node", f"{name}@{self.names.fresh('')}")
        out = Frame(df, {name: e}) if frame.unit else frame.bind(frame.df.crossJoin(df), **{name: e})
        return self.with_properties(out, name, p.properties)

    def check_node(self, frame: Frame, p: s.NodePattern, name: str) -> Frame:
        if p.labels:
            x = lower(s.Call("labels", (s.Variable(name),)), self.scope(frame))
            test = F.lit(True)
            for label in p.labels:
                test = test & F.array_contains(x.col, label)
            frame = frame.keep(frame.df.filter(test))
        return self.with_properties(frame, name, p.properties)

    def with_properties(self, frame: Frame, name: str, properties: tuple[tuple[str, s.Node], ...]) -> Frame:
        for key, value in properties:
            if self._late is not None and not names_in(value) <= set(frame.vars):
                self._late.append((name, key, value))
                continue
            test = condition(s.Binary("=", s.Property(s.Variable(name), key), value), self.scope(frame))
            frame = frame.keep(frame.df.filter(test))
        return frame

    # -- one relationship -------------------------------------------------------------------------------------------

    def oriented(self, p: s.RelPattern, backwards: bool, prefix: str) -> tuple[DataFrame, Entity, str, str]:
        """Edges with the columns they are entered and left by. A loop is met once in an undirected pattern."""
        df, e = entity_frame(self.graph.edge_table(p.types), "rel", prefix)
        enter, leave = f"{prefix}>", f"{prefix}<"
        out = df.withColumns({enter: col(e.column("_src")), leave: col(e.column("_dst"))})
        if p.direction == "both":
            back = df.filter(col(e.column("_src")) != col(e.column("_dst")))
            out = out.unionAll(back.withColumns({enter: col(e.column("_dst")), leave: col(e.column("_src"))}))
        elif (p.direction == "in") != backwards:
            out = df.withColumns({enter: col(e.column("_dst")), leave: col(e.column("_src"))})
        return out, e, enter, leave

    def end_sets(self, p: s.RelPattern, backwards: bool) -> list | None:
        """The label sets that the node behind such an edge can have, if that is known."""
        types = p.types or tuple(self.graph.edges)
        if not all(t in self.graph.ends for t in types if t in self.graph.edges):
            return None
        out = []
        for t in types:
            if t in self.graph.edges:
                src, dst = self.graph.ends[t]
                out += [src, dst] if p.direction == "both" else [src] if (p.direction == "in") != backwards else [dst]
        return list(dict.fromkeys(out))

    def hop(self, frame: Frame, p: s.RelPattern, near: str, q: s.NodePattern, far: str, backwards: bool, want_path: bool) -> tuple[Frame, str]:
        """From ``near`` over an edge to ``far``; and the name of what the edges are bound to."""
        name = p.name or self.names.fresh("r")
        if p.variable_length:
            from .paths import walk_edges

            return walk_edges(self, frame, p, near, q, far, backwards, want_path, name), name
        held = None if far in frame.vars or name in frame.vars else self.held(p, q, backwards)
        if held is not None:
            return self.hop_held(frame, held, p, near, q, far, backwards, name), name
        edges, e, enter, leave = self.oriented(p, backwards, f"{name}@{self.names.fresh('')}")
        test = col(self.id_of(frame, near)) == col(enter)
        if far in frame.vars:
            test = test & (col(self.id_of(frame, far)) == col(leave))
        if name in frame.vars:
            b = frame.vars[name]
            if not isinstance(b, Entity):
                raise SemanticError(f"{name} isn't a relationship")
            test = test & (col(b.id) == col(e.id))
        new = frame.bind(frame.df.join(edges, test), **({} if name in frame.vars else {name: e}))
        if name not in frame.vars:
            self._rels.append(name)
        new = self.with_properties(new, name, p.properties)
        return self.arrive(new, leave, p, q, far, backwards), name

    def held(self, p: s.RelPattern, q: s.NodePattern, backwards: bool) -> tuple | None:
        """The key of the table that holds the edges together with the nodes behind them, if there is one."""
        sets = self.graph.label_sets(q.labels)
        if len(p.types) != 1 or p.direction == "both" or p.variable_length:
            return None
        known = self.end_sets(p, backwards)
        sets = [x for x in sets if known is None or x in known]
        side = "src" if (p.direction == "in") != backwards else "dst"
        key = (p.types[0], side, sets[0]) if len(sets) == 1 else None
        return key if key in self.graph.carried else None

    def hop_held(self, frame: Frame, key: tuple, p: s.RelPattern, near: str, q: s.NodePattern, far: str, backwards: bool, name: str) -> Frame:
        _, side, labels = key
        held = self.graph.carried[key]
        own = [c for c in held.columns if "$" not in c]
        r, n = f"{name}@{self.names.fresh('')}", f"{far}@{self.names.fresh('')}"
        rel = Entity("rel", r, tuple((f, held.schema[f].dataType) for f in own) + (("_type", T.StringType()),))
        fields = [c for c in held.columns if c.startswith(f"{side}$")]
        node = Entity("node", n, (("_id", T.LongType()), ("_labels", T.ArrayType(T.StringType())), *((c.removeprefix(f"{side}$"), held.schema[c].dataType) for c in fields)))
        table = held.select(
            *[col(f).alias(rel.column(f)) for f in own],
            F.lit(p.types[0]).alias(rel.column("_type")),
            col(f"_{side}").alias(node.id),
            F.array(*map(F.lit, labels)).cast("array<string>").alias(node.column("_labels")),
            *[col(c).alias(node.column(c.removeprefix(f"{side}$"))) for c in fields],
        )
        enter = rel.column("_dst" if side == "src" else "_src")
        self._rels.append(name)
        new = frame.bind(frame.df.join(table, col(self.id_of(frame, near)) == col(enter)), **{name: rel, far: node})
        return self.with_properties(self.with_properties(new, name, p.properties), far, q.properties)

    def id_of(self, frame: Frame, name: str) -> str:
        b = frame.vars[name]
        if not isinstance(b, Entity) or b.kind != "node":
            raise SemanticError(f"{name} isn't a node")
        return b.id

    def arrive(self, frame: Frame, at: str, p: s.RelPattern, q: s.NodePattern, far: str, backwards: bool) -> Frame:
        """Binds the node whose id is in column ``at``, or checks it if it is bound (and met) already."""
        if far in frame.vars:
            return self.check_node(frame, q, far)
        sets = self.end_sets(p, backwards)
        if sets is not None and (far.startswith("__") or self.used.get(far) == set()) and not q.properties and all(set(q.labels) <= set(x) for x in sets):
            prefix = f"{far}@{self.names.fresh('')}"
            e = Entity("node", prefix, (("_id", T.LongType()),))
            return frame.bind(frame.df.withColumn(e.id, col(at)), **{far: e})
        graph = self.graph
        if sets is not None:
            graph = PropertyGraph(graph.spark, Tables({k: (lambda k=k: self.graph.nodes[k]) for k in graph.nodes if k in sets}))
        df, e = entity_frame(graph.node_table(q.labels), "node", f"{far}@{self.names.fresh('')}")
        out = frame.bind(frame.df.join(df, col(at) == col(e.id)), **{far: e})
        return self.with_properties(out, far, q.properties)

    def early(self, frame: Frame) -> Frame:
        """Already filtered by the conjuncts of the condition that need nothing else than is bound."""
        todo = [] if self._where is None else [self._where]
        while todo:
            e = todo.pop(0)
            if isinstance(e, s.Binary) and e.op == "AND":
                todo[:0] = [e.left, e.right]
            elif names_in(e) <= set(frame.vars) and not any(isinstance(x, (s.Exists, s.PatternComprehension, s.Call)) for x in s.walk(e)):
                frame = frame.keep(frame.df.filter(condition(e, self.scope(frame))))
        return frame

    # -- filters and subqueries -------------------------------------------------------------------------------------

    def filter(self, frame: Frame, where: s.Node) -> Frame:
        """Existential conjuncts become semi and anti joins."""
        rest: list[s.Node] = []
        todo = [where]
        while todo:
            e = todo.pop(0)
            if isinstance(e, s.Binary) and e.op == "AND":
                todo[:0] = [e.left, e.right]
            elif isinstance(e, s.Exists):
                frame = self.semi(frame, e.path, "left_semi")
            elif isinstance(e, s.Unary) and e.op == "NOT" and isinstance(e.value, s.Exists):
                frame = self.semi(frame, e.value.path, "left_anti")
            else:
                rest.append(e)
        if not rest:
            return frame
        vars_ = frame.vars
        frame, replaced = self.attach(frame, *rest)
        test = condition(rest[0], self.scope(frame, replaced))
        for e in rest[1:]:
            test = test & condition(e, self.scope(frame, replaced))
        return Frame(frame.df.filter(test), vars_)

    def shared(self, frame: Frame, *parts: s.Node) -> list[str]:
        mentioned = set().union(*[names_in(x) for x in parts])
        return [n for n in frame.vars if n in mentioned]

    def detached(self, frame: Frame, paths: tuple[s.PathPattern, ...], where: s.Node | None, extra: s.Node | None = None) -> tuple[Frame, list[str], list[str]]:
        """The matches of patterns by themselves: for every different set of shared variables, once. Gives also the
        key columns in the frame, and their names in the matches."""
        shared = self.shared(frame, *paths, *[x for x in (where, extra) if x is not None])
        keys = frame.key_columns(shared)
        if not shared:
            unit = Frame(self.graph.spark.range(1).select(), {}, True)
            return self.match(unit, paths, where), [], []
        base = frame.df.select(*[col(c) for c in frame.columns(shared)]).dropDuplicates([c for c in keys])
        found = self.match(Frame(base, {n: frame.vars[n] for n in shared}), paths, where)
        marks = [f"{c}~{self.names.fresh('k')}" for c in keys]
        return found.keep(found.df.withColumns({m: col(c) for m, c in zip(marks, keys, strict=True)})), keys, marks

    def one_hop(self, frame: Frame, paths: tuple[s.PathPattern, ...], where: s.Node | None) -> tuple[Frame, str, str] | None:
        """A single plain hop from a bound node to an unbound one that mentions nothing else of the frame is matched
        without the frame: (matches, id column in the frame, column of the matches)."""
        if len(paths) != 1 or len(paths[0].rels) != 1 or paths[0].shortest or paths[0].name or paths[0].rels[0].variable_length:
            return None
        p = paths[0]
        bound = [k for k in (0, 1) if p.nodes[k].name in frame.vars]
        if len(bound) != 1 or p.rels[0].name in frame.vars:
            return None
        near, far = p.nodes[bound[0]], p.nodes[1 - bound[0]]
        used = set().union(*[names_in(v) for _, v in (*p.rels[0].properties, *far.properties)], names_in(where) if where is not None else set())
        if near.labels or near.properties or used & set(frame.vars):
            return None
        if any(isinstance(x, (s.Exists, s.PatternComprehension)) for x in (s.walk(where) if where is not None else ())):
            return None
        name = p.rels[0].name or self.names.fresh("r")
        edges, e, enter, leave = self.oriented(p.rels[0], bool(bound[0]), f"{name}@{self.names.fresh('')}")
        found = self.with_properties(Frame(edges, {name: e}), name, p.rels[0].properties)
        found = self.arrive(found, leave, p.rels[0], far, far.name or self.names.fresh("n"), bool(bound[0]))
        return (found if where is None else self.filter(found, where)), self.id_of(frame, near.name), enter

    def semi(self, frame: Frame, path: s.PathPattern, how: str) -> Frame:
        for r in path.rels:
            if r.variable_length:
                raise NotImplementedFeature("EXISTS takes relationships of fixed length")
        quick = self.one_hop(frame, (path,), None)
        if quick:
            found, own, other = quick
            return frame.keep(frame.df.join(found.df.select(other), col(own) == col(other), how))
        found, keys, marks = self.detached(frame, (path,), None)
        if not keys:
            some = found.df.limit(1).select(F.lit(1).alias("__some"))
            return frame.keep(frame.df.join(some, F.lit(True), how))
        right = found.df.select(*map(col, marks))
        return frame.keep(frame.df.join(right, null_safe(list(map(col, keys)), list(map(col, marks))), how))

    def optional(self, frame: Frame, paths: tuple[s.PathPattern, ...], where: s.Node | None) -> Frame:
        """A left join: the condition belongs to its right side."""
        quick = self.one_hop(frame, paths, where)
        if quick:
            found, own, other = quick
            return frame.bind(frame.df.join(found.df, col(own) == col(other), "left"), **found.vars)
        found, keys, marks = self.detached(frame, paths, where)
        new = {n: b for n, b in found.vars.items() if n not in frame.vars}
        right = found.df.select(*[col(c) for c in (*marks, *Frame(found.df, new).columns())])
        if frame.unit:  # all matches, or one row of nulls
            one = self.graph.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema])
            none = one.join(right.limit(1).select(F.lit(1).alias("__some")), F.lit(True), "left_anti")
            return frame.bind(right.unionAll(none), **new)
        test = null_safe(list(map(col, keys)), list(map(col, marks))) if keys else F.lit(True)
        return frame.bind(frame.df.join(right, test, "left"), **new)

    def mandatory(self, frame: Frame, paths: tuple[s.PathPattern, ...]) -> Frame:
        out = self.match(frame, paths)
        if out.df.isEmpty():
            raise QueryRuntimeError("MANDATORY MATCH found nothing")
        return out

    def attach(self, frame: Frame, *exprs: s.Node) -> tuple[Frame, dict[s.Node, Typed]]:
        """Columns for what expressions need joins for: EXISTS, pattern comprehensions, startNode and endNode."""
        replaced: dict[s.Node, Typed] = {}
        for e in exprs:
            inner: set[int] = set()
            for x in s.walk(e):
                if id(x) in inner or x in replaced:
                    continue
                if isinstance(x, (s.Exists, s.PatternComprehension)):
                    inner |= {id(y) for y in s.walk(x)} - {id(x)}
                    frame, replaced[x] = self.flag(frame, x) if isinstance(x, s.Exists) else self.gathered(frame, x)
                elif isinstance(x, s.Call) and x.name in ("startnode", "endnode", "start_node", "end_node") and len(x.args) == 1:
                    frame, replaced[x] = self.end_of(frame, x)
        return frame, replaced

    def flag(self, frame: Frame, e: s.Exists) -> tuple[Frame, Typed]:
        found, keys, marks = self.detached(frame, (e.path,), None)
        mark = self.names.fresh("exists")
        right = found.df.select(*map(col, marks)).distinct() if keys else found.df.limit(1)
        right = right.select(*map(col, marks), F.lit(True).alias(mark))
        test = null_safe(list(map(col, keys)), list(map(col, marks))) if keys else F.lit(True)
        df = frame.df.join(right, test, "left").drop(*marks)
        return frame.keep(df), Typed(F.coalesce(col(mark), F.lit(False)), T.BooleanType())

    def gathered(self, frame: Frame, e: s.PatternComprehension) -> tuple[Frame, Typed]:
        if any(r.variable_length for r in e.path.rels):
            raise NotImplementedFeature("pattern comprehensions take relationships of fixed length")
        found, keys, marks = self.detached(frame, (e.path,), e.where, e.value)
        found, replaced = self.attach(found, e.value)
        x = lower(e.value, self.scope(found, replaced))
        name = self.names.fresh("list")
        kind = T.ArrayType(x.type)
        each = found.df.select(*map(col, marks), F.struct(x.col.alias("v")).alias("__v"))  # a struct keeps nulls
        right = each.groupBy(*map(col, marks)).agg(F.transform(F.collect_list("__v"), lambda v: v.getField("v")).alias(name))
        test = null_safe(list(map(col, keys)), list(map(col, marks))) if keys else F.lit(True)
        df = frame.df.join(right, test, "left").drop(*marks)
        return frame.keep(df), Typed(F.coalesce(col(name), F.array().cast(kind)), kind)

    def end_of(self, frame: Frame, e: s.Call) -> tuple[Frame, Typed]:
        r = lower(e.args[0], self.scope(frame))
        if not is_rel(r):
            return frame, Typed(F.lit(None), T.NullType())
        df, node = entity_frame(self.graph.node_table(), "node", f"end@{self.names.fresh('')}")
        value, name = node.value(), self.names.fresh("end")
        right = df.select(col(node.id).alias(f"{name}~"), value.col.alias(name))
        at = r.col.getField("_src" if e.name.startswith("start") else "_dst")
        return frame.keep(frame.df.join(right, at == col(f"{name}~"), "left").drop(f"{name}~")), Typed(col(name), value.type)


__all__ = ["MOST_HOPS", "UNROLLED", "Column", "Matcher", "Value", "materialise", "truth"]
