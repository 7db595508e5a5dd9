"""Relationships of variable length, shortest paths and path values."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import NotImplementedFeature, QueryRuntimeError, SemanticError
from ..graph import PropertyGraph, Tables
from ..lineage import materialise, materialise_some, together
from ..plans import syntax as s
from .expressions import names_in
from .frame import Entity, Frame, Value, col, entity_frame
from .match import MOST_HOPS, UNROLLED, Matcher


#: Ends up to which a search keeps count of those that each source has reached; tables of what it has seen, after which
#: they become one.
FEW_ENDS, SEEN_TABLES = 10_000, 16


def _identity(p: s.RelPattern, e: Entity) -> tuple[Column, str]:
    """What an edge of a path is told by, and its type: the id, and where edges may be of several types their type too,
    whose tables may have been numbered apart."""
    if len(p.types) == 1:
        return col(e.id), "bigint"
    return F.struct(col(e.id).alias("_id"), col(e.column("_type")).alias("_type")), "struct<_id:bigint,_type:string>"


def _levels(m: Matcher, start: DataFrame, p: s.RelPattern, vars_: dict, backwards: bool, own: str, want_nodes: bool, low: int, high: int | None):
    """Yields (depth, level): ``start`` with columns {own}cur, {own}ids, {own}rels, {own}nodes for every walk of so
    many edges, none twice. Levels of unbounded or long walks are written out, and end with an empty one; a bound that is
    given holds in full, without one paths that go on after MOST_HOPS are an error."""
    long_walk = high is None or high > UNROLLED
    rel_kind, node_kind = None, None
    edges, e, enter, leave = m.oriented(p, backwards, f"{own}e")
    known, known_kind = _identity(p, e)
    rel = F.struct(*[col(e.column(n)).alias(n) for n, _ in e.fields])
    rel_kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in e.fields]))
    nodes = node = None
    if want_nodes:
        nodes, node = entity_frame(m.graph.node_table(), "node", f"{own}n")
        node_kind = T.ArrayType(node.value().type)
    level = start.withColumns({f"{own}ids": F.array().cast(f"array<{known_kind}>"), f"{own}rels": F.array().cast(rel_kind)})
    if want_nodes:
        level = level.withColumn(f"{own}nodes", F.array().cast(node_kind))
    kept = level.columns
    yield 0, level
    for depth in count(1):
        if high is not None and depth > high:
            return
        step = level.join(edges, col(f"{own}cur") == col(enter)).filter(~F.array_contains(f"{own}ids", known))
        if p.properties:
            found = m.with_properties(Frame(step, vars_ | {"__edge": e}), "__edge", p.properties)
            step = found.df
        new = {f"{own}cur": col(leave), f"{own}ids": F.array_append(f"{own}ids", known), f"{own}rels": F.array_append(f"{own}rels", rel)}
        if want_nodes:
            step = step.join(nodes, col(leave) == col(node.id))
            new[f"{own}nodes"] = F.array_append(f"{own}nodes", node.value().col)
        level = step.withColumns(new).select(*map(col, kept))
        if long_walk:
            level, (some,) = materialise_some(level)
            if not some:
                return
        if high is None and depth > MOST_HOPS:
            raise QueryRuntimeError(f"paths go on after {MOST_HOPS} hops: give an upper bound")
        yield depth, level


def walk_edges(m: Matcher, frame: Frame, p: s.RelPattern, near: str, q: s.NodePattern, far: str, backwards: bool, want_path: bool, name: str) -> Frame:
    """From ``near`` over low to high edges, no edge twice; ``name`` is bound to the list of them."""
    low, high = 1 if p.low is None else p.low, p.high
    own = m.names.fresh("walk")
    at = m.id_of(frame, near)
    apart = high is None or high > UNROLLED
    if apart and not p.properties:  # long walks carry nothing of the frame but where they start
        start = frame.df.select(col(at).alias(f"{own}from")).distinct()
        vars_: dict = {}
    else:
        start, vars_ = frame.df.withColumn(f"{own}from", col(at)), frame.vars
    start = start.withColumn(f"{own}cur", col(f"{own}from"))
    levels = [level for depth, level in _levels(m, start, p, vars_, backwards, own, want_path, low, high) if depth >= low]
    out = levels[0] if levels else None
    if len(levels) > 1:
        out = out.unionAll(together(levels[1:]))
    if out is None:
        out = start.withColumns({f"{own}ids": F.array().cast("array<bigint>"), f"{own}rels": F.array().cast("array<struct<_id:bigint>>")}).filter(F.lit(False))
        if want_path:
            out = out.withColumn(f"{own}nodes", F.array().cast(T.ArrayType(entity_frame(m.graph.node_table(), "node", own)[1].value().type)))
    if not vars_ and frame.vars:
        out = frame.df.join(out, col(at) == col(f"{own}from"))
    rels = F.reverse(f"{own}rels") if backwards else col(f"{own}rels")
    list_column = f"{name}@{own}"
    out = out.withColumn(list_column, rels)
    new = frame.bind(out, **{name: Value(list_column, out.schema[list_column].dataType)})
    if want_path:
        passed, kind = f"{own}nodes", out.schema[f"{own}nodes"].dataType
        if backwards:  # what was passed ends with the node the pattern begins with
            new, near_node, _ = _full_node(m, new, near)
            turned = F.concat(F.reverse(F.slice(passed, 1, F.size(passed) - 1)), F.array(near_node).cast(kind))
            passed = f"{own}turned"
            new = new.keep(new.df.withColumn(passed, F.when(F.size(f"{own}nodes") > 0, turned).otherwise(col(f"{own}nodes"))))
        new = Frame(new.df, new.vars | {f"__nodes_{name}": Value(passed, kind)})
    if far in frame.vars:
        new = new.keep(new.df.filter(col(m.id_of(frame, far)) == col(f"{own}cur")))
        return m.check_node(new, q, far)
    if low == 0 or m.end_sets(p, backwards) is None:  # the end can be any node
        return _arrive_anywhere(m, new, f"{own}cur", q, far)
    return m.arrive(new, f"{own}cur", p, q, far, backwards)


def _arrive_anywhere(m: Matcher, frame: Frame, at: str, q: s.NodePattern, far: str) -> Frame:
    df, e = entity_frame(m.graph.node_table(q.labels), "node", f"{far}@{m.names.fresh('')}")
    return m.with_properties(frame.bind(frame.df.join(df, col(at) == col(e.id)), **{far: e}), far, q.properties)


def _full_node(m: Matcher, frame: Frame, name: str) -> tuple[Frame, Column, T.DataType]:
    """The node as a struct of all properties that any node has, so that nodes of a path have one type."""
    target = m.graph.node_table()
    have = frame.vars[name]
    if set(target.columns) == {n for n, _ in have.fields}:
        kinds = dict(have.fields)
        if all(kinds[f.name] == f.dataType for f in target.schema):
            value = F.struct(*[col(have.column(f.name)).alias(f.name) for f in target.schema])
            return frame, F.when(col(have.id).isNotNull(), value), target.schema
    df, e = entity_frame(target, "node", f"full@{m.names.fresh('')}")
    out = frame.keep(frame.df.join(df, col(have.id) == col(e.id), "left"))
    return out, e.value().col, e.value().type


def build_path(m: Matcher, frame: Frame, p: s.PathPattern, names: list[str], segments: dict[int, str]) -> Frame:
    """Binds a path variable: the nodes and relationships in order."""
    rel_table = m.graph.edge_table()
    rel_fields = [(f.name, f.dataType) for f in rel_table.schema]
    kind = T.StructType([T.StructField(n, t) for n, t in rel_fields])

    def shaped(x, have: dict[str, T.DataType]) -> Column:
        return F.struct(*[(x(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in rel_fields])

    frame, first, node_kind = _full_node(m, frame, names[0])
    nodes, rels, missing = [F.array(first)], [], first.isNull()
    for k in range(len(p.rels)):
        b = frame.vars[segments[k]]
        if isinstance(b, Entity):
            rels.append(F.array(shaped(_flat(b), dict(b.fields))))
            frame, node, _ = _full_node(m, frame, names[k + 1])
            nodes.append(F.array(node))
        else:
            have = {f.name: f.dataType for f in b.type.elementType}
            rels.append(F.transform(col(b.name), _reshaped(shaped, have)))
            inner = frame.vars[f"__nodes_{segments[k]}"]
            nodes.append(col(inner.name))
    column = f"{p.name}@{m.names.fresh('path')}"
    node_array = F.concat(*nodes).cast(T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in node_kind])))
    made = F.when(~missing, F.struct(node_array.alias("nodes"), F.concat(*rels).cast(T.ArrayType(kind)).alias("relationships")))
    df = frame.df.withColumn(column, made)
    return frame.bind(df, **{p.name: Value(column, df.schema[column].dataType)})


def _flat(b: Entity):
    return lambda name: col(b.column(name))


def _reshaped(shaped, have: dict):
    return lambda x: shaped(x.getField, have)


def shortest_path(m: Matcher, frame: Frame, p: s.PathPattern) -> Frame:
    """One breadth-first search from all sources at once, level by level; nodes seen by a source at a smaller depth are
    left out. Pairs get one path (the one with the smallest edge ids) or all of the first depth that reaches them. An
    end that isn't bound yet is joined on arrival: the product of both ends is never made."""
    if len(p.rels) != 1 or not p.rels[0].variable_length:
        raise SemanticError("a shortest path has one relationship of variable length")
    r, own = p.rels[0], m.names.fresh("short")
    if any(names_in(v) for _, v in r.properties):
        raise NotImplementedFeature("properties of a shortest path's relationships are constants")
    a, b = (n.name or m.names.fresh("n") for n in p.nodes)
    frame = m.early(m.node(frame, p.nodes[0], a))
    low, high = 1 if r.low is None else r.low, r.high
    pair = [f"{own}a", f"{own}b"]
    targets = None
    if b not in frame.vars and not any(names_in(v) for _, v in p.nodes[1].properties):
        unit = Frame(m.graph.spark.range(1).select(), {}, True)
        targets = m.early(m.node(unit, p.nodes[1], b))
        sources = materialise(frame.df.select(col(m.id_of(frame, a)).alias(pair[0])).distinct())
        ends = materialise(targets.df.select(col(m.id_of(targets, b)).alias(pair[1])).distinct())
        each = ends.count()
        on = [f"{own}cur"]
    else:
        frame = m.early(m.node(frame, p.nodes[1], b))  # fewer pairs to search for
        ends = materialise(frame.df.select(col(m.id_of(frame, a)).alias(pair[0]), col(m.id_of(frame, b)).alias(pair[1])).distinct())
        sources = ends.select(pair[0]).distinct()
        each = None
        on = [pair[0], f"{own}cur"]
    ends = ends.select(*([] if each is not None else [pair[0]]), col(pair[1]).alias(f"{own}cur"), F.lit(True).alias(f"{own}hit"))
    start = sources.withColumn(f"{own}cur", col(pair[0]))
    edges, e, enter, leave = m.oriented(r, False, f"{own}e")
    known, known_kind = _identity(r, e)
    if r.properties:
        edges = m.with_properties(Frame(edges, {"__edge": e}), "__edge", r.properties).df
    rel = F.struct(*[col(e.column(n)).alias(n) for n, _ in e.fields])
    rel_kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in e.fields]))
    kept = [f"{own}cur", f"{own}ids", f"{own}rels", f"{own}steps"]
    level = start.withColumns({f"{own}ids": F.array().cast(f"array<{known_kind}>"), f"{own}rels": F.array().cast(rel_kind), f"{own}steps": F.array().cast("array<bigint>")})
    seen = materialise(start.select(pair[0], f"{own}cur")) if low <= 1 else None
    recent: list[DataFrame] = []  # levels that ``seen`` doesn't hold yet
    hits: list[DataFrame] = []

    def passed() -> DataFrame:
        own_ = together(recent).select(pair[0], f"{own}cur") if recent else None
        return seen if own_ is None else own_ if seen is None else seen.unionAll(own_)

    def open_(level: DataFrame) -> DataFrame:
        """Without the sources that have reached all their ends."""
        if not hits:
            return level
        reached = together(hits).filter(col(f"{own}hit")).select(pair[0], f"{own}cur").distinct()
        if each is None:
            return level.join(ends.join(reached, on, "left_anti").select(pair[0]).distinct(), pair[0], "left_semi")
        done = reached.groupBy(pair[0]).agg(F.count(F.lit(1)).alias("__n")).filter(col("__n") == each)
        return level.join(done.select(pair[0]), pair[0], "left_anti")

    for depth in count():
        if high is not None and depth > high:
            break
        if depth:
            step = level.join(edges, col(f"{own}cur") == col(enter)).filter(~F.array_contains(f"{own}ids", known))
            step = step.withColumns({f"{own}cur": col(leave), f"{own}ids": F.array_append(f"{own}ids", known), f"{own}rels": F.array_append(f"{own}rels", rel), f"{own}steps": F.array_append(f"{own}steps", col(leave))})
            level = step.select(pair[0], *kept)
            pruned = seen is not None or bool(recent)
            if pruned:
                level = level.join(passed(), [pair[0], f"{own}cur"], "left_anti")
            if p.shortest == "single" and pruned:
                first = Window.partitionBy(pair[0], f"{own}cur").orderBy(f"{own}ids")
                level = level.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
        elif low > 0:
            continue
        # the level with a mark where it arrives at an end
        level, (some, arrived) = materialise_some(level.join(ends, on, "left").select(pair[0], *kept, f"{own}hit"), f"{own}hit")
        if not some:
            break
        if high is None and depth > MOST_HOPS:
            if open_(level).isEmpty():
                break
            raise QueryRuntimeError(f"shortest paths go on after {MOST_HOPS} hops: give an upper bound")
        if depth and (low <= 1 or depth >= low):
            recent.append(level)
            if len(recent) >= SEEN_TABLES:
                seen, recent = materialise(passed()), []
        if depth >= low and arrived:
            hits.append(level)
            if each is None or each <= FEW_ENDS:  # else sources that have reached all ends are only looked for at the limit
                level = open_(level)
    none = level.withColumn(f"{own}hit", F.lit(True)).filter(F.lit(False))
    out = (together(hits).filter(col(f"{own}hit")) if hits else none).select(pair[0], col(f"{own}cur").alias(pair[1]), *kept[1:])
    if p.shortest == "single":
        first = Window.partitionBy(*pair).orderBy(f"{own}ids")
        out = out.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
    new = frame.keep(frame.df.join(out, (col(m.id_of(frame, a)) == col(pair[0])) & (F.lit(True) if targets else col(m.id_of(frame, b)) == col(pair[1]))))
    if targets:
        new = new.bind(new.df.join(targets.df, col(pair[1]) == col(m.id_of(targets, b))), **{b: targets.vars[b]})
    if r.name:
        new = new.bind(new.df, **{r.name: Value(f"{own}rels", rel_kind)})
    if p.name:
        both = None if low == 0 else [m.end_sets(r, backwards) for backwards in (False, True)]
        sets = [x for side in both for x in side] if both and None not in both else None
        new = _hydrate(m, new, p.name, m.id_of(frame, a), f"{own}rels", f"{own}steps", f"{own}ids", sets)
    return new


def _hydrate(m: Matcher, frame: Frame, name: str, start: str, rels: str, steps: str, ids: str, sets: list | None) -> Frame:
    """A path value from node ids: nodes are looked up once for all paths, among those of the label sets if they are
    known."""
    graph = m.graph if sets is None else PropertyGraph(m.graph.spark, m.graph.nodes.only(sets.__contains__) if isinstance(m.graph.nodes, Tables) else {k: df for k, df in m.graph.nodes.items() if k in sets})
    paths = frame.df.select(col(start).alias("__a"), col(ids).alias("__i"), F.posexplode(F.concat(F.array(col(start)), col(steps))).alias("__k", "__n")).distinct()
    df, e = entity_frame(graph.node_table(), "node", f"hop@{m.names.fresh('')}")
    met = paths.join(df, col("__n") == col(e.id)).groupBy("__a", "__i").agg(F.sort_array(F.collect_list(F.struct(col("__k"), e.value().col.alias("v")))).alias("__v"))
    nodes = F.transform("__v", lambda x: x.getField("v"))
    column = f"{name}@{m.names.fresh('path')}"
    out = frame.df.join(met, (col(start) == col("__a")) & (col(ids) == col("__i"))).withColumn(column, F.struct(nodes.alias("nodes"), col(rels).alias("relationships"))).drop("__a", "__i", "__v")
    return frame.bind(out, **{name: Value(column, out.schema[column].dataType)})
