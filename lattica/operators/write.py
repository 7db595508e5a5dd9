"""CREATE, MERGE, SET, REMOVE and DELETE: set-based changes that make a new version of the graph.

Rows that feed a write are written out first, so that ids and random numbers are drawn once. Changed tables are
written out too; the session adopts the new version only if the whole statement succeeds.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryRuntimeError, SemanticError, TypeMismatchError
from ..functions.typed import Typed, common, is_list, is_node, is_null, is_rel, is_struct
from ..graph import LabelSet, PropertyGraph, Tables, label_set
from ..lineage import materialise, numbered
from ..plans import syntax as s
from .expressions import Scope, lower, names_in
from .frame import Entity, Frame, Value, col, entity_frame, null_safe
from .match import Matcher
from .project import leaves

ROW = "__row"


def storable(x: Typed, what: str) -> Typed:
    """Properties are strings, numbers, booleans, dates and moments."""
    if is_list(x) or is_struct(x) or isinstance(x.type, T.MapType):
        raise TypeMismatchError(f"{what} can't hold {x.type.simpleString()}")
    return x


def ordered(m: Matcher, frame: Frame) -> tuple[Frame, int]:
    """The frame with its rows numbered, which stands for their order."""
    if frame.unit:
        return frame.keep(frame.df.withColumn(ROW, F.lit(0).cast("long"))), 1
    df, n = numbered(frame.df.drop(ROW), ROW)
    return frame.keep(df), n


def appended(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is None:
        return new
    kinds = {f.name: f.dataType for f in old.schema}
    for f in new.schema:
        kinds[f.name] = common([kinds[f.name], f.dataType]) if f.name in kinds else f.dataType
    same = lambda df: df.select(*[(col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return same(old).unionAll(same(new))


# -- CREATE ---------------------------------------------------------------------------------------------------------


#: Functions that give something else each time.
CHANGING = frozenset(["rand", "randomuuid", "uuid", "random"])


def create(m: Matcher, frame: Frame, paths: tuple[s.PathPattern, ...], check: bool = True) -> Frame:
    """A node or relationship per row for every part of the patterns that isn't bound yet."""
    frame, n = ordered(m, frame)
    if not n:
        return _empty_create(m, frame, paths)
    made: list[tuple[str, str | LabelSet, Entity]] = []
    node_id, edge_id = m.graph.next_node, m.graph.next_edge

    def new_node(frame: Frame, p: s.NodePattern, name: str) -> Frame:
        nonlocal node_id
        e, columns = _columns(m, frame, "node", name, p.properties, {"_id": F.lit(node_id) + col(ROW), "_labels": F.array(*map(F.lit, p.labels)).cast("array<string>")})
        node_id += n
        made.append(("node", label_set(p.labels), e))
        return frame.bind(frame.df.withColumns(columns), **{name: e})

    for p in paths:
        if p.shortest:
            raise SemanticError("a shortest path can't be created")
        names = [x.name or m.names.fresh("n") for x in p.nodes]
        for q, name in zip(p.nodes, names, strict=True):
            if name not in frame.vars:
                frame = new_node(frame, q, name)
            elif q.labels or q.properties and len(p.nodes) == 1:
                raise SemanticError(f"{name} is bound already")
        segments = {}
        for k, r in enumerate(p.rels):
            if r.variable_length or not r.types:
                raise SemanticError("a relationship to be created has one type and one hop")
            name = r.name or m.names.fresh("r")
            if name in frame.vars:
                raise SemanticError(f"{name} is bound already")
            a, b = m.id_of(frame, names[k]), m.id_of(frame, names[k + 1])
            a, b = (b, a) if r.direction == "in" else (a, b)
            e, columns = _columns(m, frame, "rel", name, r.properties, {"_id": F.lit(edge_id) + col(ROW), "_type": F.lit(r.types[0]), "_src": col(a), "_dst": col(b)})
            edge_id += n
            made.append(("rel", r.types[0], e))
            segments[k] = name
            frame = frame.bind(frame.df.withColumns(columns), **{name: e})
        if p.name and p.rels:
            m_now = replace_graph(m, _with_new(m.graph, made, frame.df))
            from .paths import build_path

            frame = build_path(m_now, frame, p, names, segments)
    if any(isinstance(x, s.Call) and x.name in CHANGING for p in paths for x in s.walk(p)):
        frame = frame.keep(materialise(frame.df))  # else it follows from the numbered rows, which are written
    graph = replace(_with_new(m.graph, made, frame.df), next_node=node_id, next_edge=edge_id)
    types = {k for kind, k, _ in made if kind == "rel"}
    graph = replace(graph, ends={t: e for t, e in graph.ends.items() if t not in types})
    m.graph = graph.checked({x for kind, k, _ in made if kind == "node" for x in k}) if check else graph
    return frame


def replace_graph(m: Matcher, graph: PropertyGraph) -> Matcher:
    return Matcher(graph, m.params, m.names, m.used, m.unique)


def _with_new(graph: PropertyGraph, made: list, rows: DataFrame) -> PropertyGraph:
    nodes, edges = Tables.copied(graph.nodes), Tables.copied(graph.edges)
    for kind, key, e in made:
        have = rows.filter(col(e.id).isNotNull()) if kind == "node" else rows.filter(col(e.column("_src")).isNotNull() & col(e.column("_dst")).isNotNull())
        new = have.select(*[col(e.column(f)).alias(f) for f, _ in e.fields if f not in ("_labels", "_type")])
        table = nodes if kind == "node" else edges
        table[key] = appended(table.get(key), new)
    return replace(graph, nodes=nodes, edges=edges, carried={})


def _columns(m: Matcher, frame: Frame, kind: str, name: str, properties: tuple[tuple[str, s.Node], ...], fixed: dict[str, Column]) -> tuple[Entity, dict[str, Column]]:
    prefix = f"{name}@{m.names.fresh('')}"
    kinds = {"_id": T.LongType(), "_src": T.LongType(), "_dst": T.LongType(), "_type": T.StringType(), "_labels": T.ArrayType(T.StringType())}
    fields = [(k, kinds[k]) for k in fixed]
    columns = {f"{prefix}${k}": c.cast(kinds[k]) for k, c in fixed.items()}
    for key, value in dict(properties).items():
        x = storable(lower(value, m.scope(frame)), key)
        if not is_null(x):
            fields.append((key, x.type))
            columns[f"{prefix}${key}"] = x.col
    return Entity(kind, prefix, tuple(fields)), columns


def _empty_create(m: Matcher, frame: Frame, paths: tuple[s.PathPattern, ...]) -> Frame:
    """No rows, no effect; but the names are bound."""
    for p in paths:
        for x in (*p.nodes, *p.rels):
            if x.name and x.name not in frame.vars:
                kind = "node" if isinstance(x, s.NodePattern) else "rel"
                e, columns = _columns(m, frame, kind, x.name, x.properties, {"_id": F.lit(0)} | ({"_labels": F.array()} if kind == "node" else {"_type": F.lit(""), "_src": F.lit(0), "_dst": F.lit(0)}))
                frame = frame.bind(frame.df.withColumns(columns), **{x.name: e})
    return frame


# -- MERGE ----------------------------------------------------------------------------------------------------------


def merge(m: Matcher, frame: Frame, c: s.Merge) -> Frame:
    """Matches the whole pattern, or creates all of it that isn't bound: once for every different set of what it
    depends on. Of the rows that share a creation, the first takes ON CREATE and the others ON MATCH."""
    frame, n = ordered(m, frame)
    if not n:
        return _empty_create(m, frame, (c.path,))
    hidden: dict[str, Value] = {}

    def noted(properties: tuple[tuple[str, s.Node], ...]) -> tuple[tuple[str, s.Node], ...]:
        nonlocal frame
        out = []
        for key, value in properties:
            x = storable(lower(value, m.scope(frame)), key)
            name = m.names.fresh("m")
            frame = frame.value(name, Typed(x.col, x.type))
            hidden[name] = frame.vars[name]
            out.append((key, s.Variable(name)))
        return tuple(out)

    path = s.PathPattern(
        c.path.name,
        tuple(s.NodePattern(x.name or m.names.fresh("n"), x.labels, noted(x.properties)) for x in c.path.nodes),
        tuple(s.RelPattern(x.name or m.names.fresh("r"), x.types, x.direction, x.variable_length, x.low, x.high, noted(x.properties)) for x in c.path.rels),
    )
    if any(len(r.types) != 1 or r.variable_length for r in path.rels):
        raise SemanticError("a relationship to be merged has one type and one hop")
    mentioned = names_in(path)
    given = [x for x in frame.vars if x in mentioned]
    keys = frame.key_columns(given)
    least = [F.min(ROW).alias("__least"), *[F.first(col(c)).alias(c) for c in frame.columns(given) if c not in keys]]
    base = materialise(frame.df.groupBy(*map(col, keys)).agg(*least))  # the first row of each key
    vars_ = {x: frame.vars[x] for x in given}
    found = m.match(Frame(base, vars_), (path,))
    new = [x.name for x in (*path.nodes, *path.rels) if x.name not in frame.vars]
    new = list(dict.fromkeys(new))
    marks = {k: f"{k}~" for k in keys}
    ids = lambda f: [col(f.vars[x].id).alias(f"{x}~id") for x in new]
    hits = materialise(found.df.select(*[col(k).alias(v) for k, v in marks.items()], *ids(found), F.lit(None).cast("long").alias("__made")))
    test = null_safe([col(k) for k in keys], [col(v) for v in marks.values()]) if keys else F.lit(True)
    missing = base.join(hits.select(*map(col, marks.values())) if keys else hits.select("__made").limit(1), test, "left_anti")
    bound_nodes = tuple(s.NodePattern(x.name, (), ()) if x.name in frame.vars else x for x in path.nodes)
    created = create(m, Frame(missing, vars_), (s.PathPattern(None, bound_nodes, path.rels),), check=False)
    every = hits
    if ROW in created.df.columns:
        every = hits.unionAll(created.df.select(*[col(k).alias(v) for k, v in marks.items()], *ids(created), col("__least").alias("__made")))
    out = frame.df.join(every, test)
    out = out.withColumn("__first", F.coalesce(col("__made") == col(ROW), F.lit(False))).drop(*marks.values(), "__made")
    frame = Frame(out, {k: v for k, v in frame.vars.items() if k not in hidden})
    for x in (*path.nodes, *path.rels):
        if x.name in new:
            frame = looked_up(m, frame, x.name, x, f"{x.name}~id")
    frame = Frame(frame.df.drop(*hidden), frame.vars)
    later = m.later
    if c.on_create:
        m.later = _more(later, c.on_match)
        frame = set_items(m, frame, c.on_create, col("__first"), check=False)
        m.later = later
    if c.on_match:
        frame = set_items(m, frame, c.on_match, ~col("__first"), check=False)
    m.graph = m.graph.checked()
    return Frame(frame.df.drop("__first", ROW), {k: v for k, v in frame.vars.items() if not k.startswith("__")})


def _more(later: dict[str, set[str] | None] | None, items: tuple[s.SetItem, ...]) -> dict[str, set[str] | None] | None:
    """What is used later if these items are yet to come."""
    return None if later is None else later | dict.fromkeys({x.name for x in items}.union(*[names_in(x) for x in items]))


def looked_up(m: Matcher, frame: Frame, name: str, p: s.NodePattern | s.RelPattern, at: str) -> Frame:
    """Binds ``name`` to the node or relationship of a pattern whose id is in column ``at``, as the graph has it now; a
    node of which only the id is used isn't looked up."""
    prefix = f"{name}@{m.names.fresh('')}"
    node = isinstance(p, s.NodePattern)
    if node and (name.startswith("__") or m.used.get(name) == set()):
        e = Entity("node", prefix, (("_id", T.LongType()),))
        return frame.bind(frame.df.withColumn(e.id, col(at)), **{name: e})
    table = m.graph.node_table(p.labels) if node else m.graph.edge_table(p.types)
    df, e = entity_frame(table, "node" if node else "rel", prefix)
    return frame.bind(frame.df.join(df, col(at) == col(e.id), "left"), **{name: e})


def refreshed(m: Matcher, frame: Frame, changes: list[tuple[set[str], set[str]]] = ()) -> Frame:
    """The nodes and relationships of the frame that are used later as the graph has them now; only the tables that
    can hold them are read. ``changes``: labels that have been added and dropped since the frame was made."""
    for name, b in list(frame.vars.items()):
        if not isinstance(b, Entity) or m.later is not None and name not in m.later or len(b.fields) == 1:
            continue
        mark = b.column("_labels" if b.kind == "node" else "_type")
        sets = [r[0] for r in frame.df.select(mark).filter(col(mark).isNotNull()).distinct().collect()]  # a row for each set of labels or type
        if b.kind == "node":
            known = {label_set(x) for x in sets}
            for add, drop in changes:
                known |= {label_set((set(x) | add) - drop) for x in known}
            graph = replace(m.graph, nodes={k: m.graph.nodes[k] for k in m.graph.nodes if k in known})
            table = graph.node_table()
        else:
            table = m.graph.edge_table(sets) if sets else m.graph.edge_table(["__none"])
        df, e = entity_frame(table, b.kind, f"{name}@{m.names.fresh('')}")
        frame = frame.bind(frame.df.join(df, col(b.id) == col(e.id), "left"), **{name: e})
        frame = frame.keep(frame.df.drop(*b.columns))
    return frame


# -- SET and REMOVE -------------------------------------------------------------------------------------------------


def set_items(m: Matcher, frame: Frame, items: tuple[s.SetItem, ...], only: Column | None = None, check: bool = True) -> Frame:
    """Changes row by row in order; where rows change one entity differently, the last row counts, and a value that
    reads the property it sets takes all rows of its entity one after the other."""
    if ROW not in frame.df.columns:
        frame, _ = ordered(m, frame)
    if only is not None:
        frame = frame.keep(frame.df.withColumn("__only", only))
    on = col("__only") if only is not None else F.lit(True)
    changed: dict[str, dict[str, T.DataType]] = {}
    labelled: dict[str, tuple[set[str], set[str]]] = {}
    for i in items:
        b = frame.vars.get(i.name)
        if not isinstance(b, Entity):
            raise SemanticError(f"{i.name} isn't a node or relationship")
        if i.kind == "label":
            labelled.setdefault(i.name, (set(), set()))[0].update(i.labels)
            continue
        for key, x in _assigned(m, frame, i, b).items():
            if i.kind == "property" and i.value is not None and s.Property(s.Variable(i.name), key) in set(s.walk(i.value)):
                frame, x = _folded(m, frame, i, b, on)
            frame = _assign(frame, i.name, key, x, on)
            changed.setdefault(i.name, {})[key] = dict(frame.vars[i.name].fields)[key]
    frame = frame.keep(materialise(frame.df))
    for name in dict.fromkeys([*changed, *labelled]):
        m.graph = _apply(m.graph, frame, name, list(changed.get(name, {})), *labelled.get(name, (set(), set())), only)
    frame = refreshed(m, frame, list(labelled.values()))
    if check:
        m.graph = m.graph.checked()
    return frame.keep(frame.df.drop("__only"))


def _assigned(m: Matcher, frame: Frame, i: s.SetItem, b: Entity) -> dict[str, Typed]:
    """The new value of each property that an item sets."""
    own = [n for n, _ in b.fields if not n.startswith("_")]
    frame_scope = m.scope(frame)
    if i.kind == "property":
        return {i.key: storable(lower(i.value, frame_scope), i.key)}
    x = lower(i.value, frame_scope)
    if is_null(x):
        return {n: Typed(F.lit(None), T.NullType()) for n in own} if i.kind == "replace" else {}
    if not is_struct(x):
        raise TypeMismatchError("properties are set from a map, node or relationship")
    hidden = is_node(x) or is_rel(x)
    new = {n: storable(Typed(x.col.getField(n), x.type[n].dataType), n) for n in x.type.names if not (hidden and n.startswith("_"))}
    if i.kind == "merge" and not hidden and any(is_null(v) for v in new.values()):
        raise TypeMismatchError("+= takes no null values")
    return ({n: Typed(F.lit(None), T.NullType()) for n in own} if i.kind == "replace" else {}) | new


def _assign(frame: Frame, name: str, key: str, x: Typed, on: Column) -> Frame:
    b = frame.vars[name]
    kinds = dict(b.fields)
    kind = common([kinds[key], x.type]) if key in kinds else x.type
    if isinstance(kind, T.NullType):
        return frame if key in kinds else frame.bind(frame.df.withColumn(b.column(key), F.lit(None).cast("string")), **{name: Entity(b.kind, b.prefix, (*b.fields, (key, T.StringType())))})
    old = col(b.column(key)).cast(kind) if key in kinds else F.lit(None).cast(kind)
    kinds[key] = kind
    new = Entity(b.kind, b.prefix, tuple(kinds.items()))
    return frame.bind(frame.df.withColumn(b.column(key), F.when(on, x.col.cast(kind)).otherwise(old)), **{name: new})


def _folded(m: Matcher, frame: Frame, i: s.SetItem, b: Entity, on: Column) -> tuple[Frame, Typed]:
    """A value that reads its own property, over all rows of its entity: sums for + and -, else a fold in row order."""
    own, e = s.Property(s.Variable(i.name), i.key), i.value
    whole = lower(e, m.scope(frame))
    column = m.names.fresh("fold")
    rows = frame.df.filter(on & col(b.id).isNotNull())
    if isinstance(e, s.Binary) and e.op in "+-" and e.left == own and own not in set(s.walk(e.right)) and isinstance(whole.type, T.NumericType):
        x = lower(e.right, m.scope(frame))
        now = col(b.column(i.key)) if b.get(i.key) else F.lit(None)
        total = F.when(F.count(x.col) == F.count(F.lit(1)), F.sum(x.col))
        new = rows.groupBy(b.id).agg((F.first(now) + total if e.op == "+" else F.first(now) - total).cast(whole.type).alias(column))
    else:
        parts = [x for x in dict.fromkeys(leaves(e, {})) if x != own]
        typed = [lower(x, m.scope(frame)) for x in parts]
        one = F.struct(col(ROW).alias("r"), *[t.col.alias(f"f{k}") for k, t in enumerate(typed)])
        now = (col(b.column(i.key)) if b.get(i.key) else F.lit(None)).cast(whole.type)
        grouped = rows.groupBy(b.id).agg(F.sort_array(F.collect_list(one)).alias("__rows"), F.first(now).alias("__now"))

        def step(total: Column, row: Column) -> Column:
            known = {own: Typed(total, whole.type)} | {x: Typed(row.getField(f"f{k}"), t.type) for k, (x, t) in enumerate(zip(parts, typed, strict=True))}
            return lower(e, Scope({}, m.params, None, known)).col.cast(whole.type)

        new = grouped.select(b.id, F.aggregate("__rows", col("__now"), step).alias(column))
    marked = new.withColumnRenamed(b.id, f"{column}~")
    df = frame.df.join(marked, col(b.id) == col(f"{column}~"), "left").drop(f"{column}~")
    return frame.keep(df), Typed(col(column), whole.type)


def _apply(graph: PropertyGraph, frame: Frame, name: str, keys: list[str], add: set[str], drop: set[str], only: Column | None) -> PropertyGraph:
    """The tables with the frame's values of a variable, and its labels added or dropped."""
    b = frame.vars[name]
    rows = frame.df.filter(col(b.id).isNotNull() & (col("__only") if only is not None else F.lit(True)))
    values = F.struct(F.lit(1).alias("__hit"), *[col(b.column(k)).alias(k) for k in keys])
    new = rows.groupBy(col(b.id).alias("__id")).agg(F.max_by(values, col(ROW)).alias("__v"))
    kinds = dict(b.fields)
    if b.kind == "node":
        touched = [label_set(r[0]) for r in rows.select(b.column("_labels")).distinct().collect()]
        tables = Tables.copied(graph.nodes)
    else:
        touched = [r[0] for r in rows.select(b.column("_type")).distinct().collect()]
        tables = Tables.copied(graph.edges)
    new = materialise(new) if len(touched) > 1 else new
    for t in touched:
        old = tables[t]
        met = old.join(new, old["_id"] == new["__id"], "left")
        cols = []
        for c in dict.fromkeys([*old.columns, *keys]):
            if c in keys:
                kind = common([old.schema[c].dataType, kinds[c]]) if c in old.columns else kinds[c]
                before = col(c).cast(kind) if c in old.columns else F.lit(None).cast(kind)
                cols.append(F.when(col("__v").isNotNull(), col("__v").getField(c).cast(kind)).otherwise(before).alias(c))
            else:
                cols.append(col(c))
        table = materialise(met.select(*cols, col("__v").isNotNull().alias("__hit")))
        target = label_set((set(t) | add) - drop) if b.kind == "node" else t
        if target == t:
            tables[t] = table.drop("__hit")
        else:
            tables[t] = table.filter("not __hit").drop("__hit")
            tables[target] = appended(tables.get(target), table.filter("__hit").drop("__hit"))
    if b.kind == "node":
        return replace(graph, nodes=tables, ends={} if add or drop else graph.ends, carried={})
    return replace(graph, edges=tables, carried={})


def remove_items(m: Matcher, frame: Frame, items: tuple[s.SetItem, ...]) -> Frame:
    plain = tuple(s.SetItem("property", i.name, i.key, s.Literal(None)) for i in items if i.kind == "property")
    if plain:
        later = m.later
        m.later = _more(later, items)
        frame = set_items(m, frame, plain)
        m.later = later
    for i in items:
        if i.kind == "label":
            if ROW not in frame.df.columns:
                frame, _ = ordered(m, frame)
            if not isinstance(frame.vars.get(i.name), Entity):
                raise SemanticError(f"{i.name} isn't a node")
            m.graph = _apply(m.graph, frame, i.name, [], set(), set(i.labels), None)
            frame = refreshed(m, frame, [(set(), set(i.labels))])
    m.graph = m.graph.checked()
    return frame


# -- DELETE ---------------------------------------------------------------------------------------------------------


def delete(m: Matcher, frame: Frame, values: tuple[s.Node, ...], detach: bool) -> Frame:
    """Relationships first, then nodes; a node that keeps relationships can't go unless it is detached."""
    frame = frame.keep(materialise(frame.df)) if not frame.unit else frame
    nodes: list[DataFrame] = []
    rels: list[DataFrame] = []
    gone: list[str] = []
    for e in values:
        x = lower(e, m.scope(frame))
        if is_node(x) or is_rel(x):
            mark = "_labels" if is_node(x) else "_type"
            (nodes if is_node(x) else rels).append(frame.df.select(x.col.getField("_id").alias("__id"), x.col.getField(mark).alias("__mark")))
            if isinstance(e, s.Variable):
                gone.append(e.name)
        elif is_list(x) and isinstance(x.type.elementType, T.StructType) and "_src" in x.type.elementType.names:
            each = frame.df.select(F.explode(x.col).alias("__r"))
            marks = "__r._type" if "_type" in x.type.elementType.names else F.lit(None)
            rels.append(each.select(col("__r").getField("_id").alias("__id"), (F.col(marks) if isinstance(marks, str) else marks).alias("__mark")))
        elif not is_null(x) and not is_struct(x):
            raise TypeMismatchError("only nodes and relationships can be deleted")
    edges, tables = Tables.copied(m.graph.edges), Tables.copied(m.graph.nodes)
    if rels:
        ids, types = _distinct(rels)
        for t in edges if None in types else types & set(edges):
            edges[t] = materialise(edges[t].join(ids, edges[t]["_id"] == ids["__id"], "left_anti"))
    if nodes:
        ids, found = _distinct(nodes)
        sets = {label_set(x) for x in found}
        for t in list(edges):
            if t in m.graph.ends and not sets & set(m.graph.ends[t]):
                continue  # no edge of the type has such an end
            df = edges[t]
            if not detach and (not df.join(ids, df["_src"] == ids["__id"], "left_semi").isEmpty() or not df.join(ids, df["_dst"] == ids["__id"], "left_semi").isEmpty()):
                raise QueryRuntimeError("a node that has relationships can't be deleted: use DETACH DELETE")
            if detach:
                kept = df.join(ids, df["_src"] == ids["__id"], "left_anti")
                edges[t] = materialise(kept.join(ids, kept["_dst"] == ids["__id"], "left_anti"))
        for t in sets:
            tables[t] = materialise(tables[t].join(ids, tables[t]["_id"] == ids["__id"], "left_anti"))
    m.graph = replace(m.graph, nodes=tables, edges=edges, carried={})
    for name in gone:
        b = frame.vars[name]
        if isinstance(b, Entity):
            frame = frame.keep(frame.df.withColumns({b.column(n): F.lit(None).cast(t) for n, t in b.fields}))
    return frame


def _distinct(parts: list[DataFrame]) -> tuple[DataFrame, set]:
    """The ids that go, each once, and the different labels or types they are under."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    rows = materialise(rows.filter("__id is not null").distinct())
    return rows.select("__id"), {tuple(r[0]) if isinstance(r[0], list) else r[0] for r in rows.select("__mark").distinct().collect()}
