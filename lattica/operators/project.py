"""RETURN and WITH: projection, grouping, duplicates, order, skip and limit; UNWIND."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError, TypeMismatchError
from ..functions.aggregates import AGGREGATES, placed, share_of
from ..functions.typed import MISSING, Typed, is_list, is_null, is_number, is_whole
from ..plans import syntax as s
from .expressions import Scope, has_aggregate, lower
from .frame import Entity, Frame, Value, col, null_safe
from .match import Matcher


def display(item: s.Item) -> str:
    """The name of a result column."""
    e = item.value
    if item.alias:
        return item.alias
    if isinstance(e, s.Variable):
        return e.name
    if isinstance(e, s.Property) and isinstance(e.base, s.Variable):
        return f"{e.base.name}.{e.name}"
    if isinstance(e, s.Call):
        return f"{e.name}(..)"
    return "?column?"


def result(frame: Frame, names: list[str]) -> DataFrame:
    """The frame's variables as result columns; names may repeat."""
    return frame.df.select(*[b.value().col.alias(n) for n, b in zip(names, frame.vars.values(), strict=True)])


def project(m: Matcher, frame: Frame, p: s.Projection) -> tuple[Frame, list[str]]:
    items = list(p.items)
    if p.star:
        items = [s.Item(s.Variable(n), n) for n in frame.vars if not n.startswith("__")] + items
    names = [display(i) for i in items]
    if not p.final and len(set(names)) < len(names):
        raise SemanticError("WITH gives two columns one name")
    keys = list(dict.fromkeys(names)) if len(set(names)) == len(names) else [f"{n}#{k}" for k, n in enumerate(names)]
    exprs = [i.value for i in items]
    if any(map(has_aggregate, [*exprs, *[k.value for k in p.order]])):
        out, order = grouped(m, frame, exprs, keys, names, [k.value for k in p.order])
    else:
        out, order = plain(m, frame, exprs, keys, names, [k.value for k in p.order], p.distinct)
    if p.distinct:
        order = [o if o is None or o in _columns(out) else None for o in order]
        out = out.keep(out.df.dropDuplicates(out.key_columns(list(out.vars))))
    if p.where is not None:
        out = m.filter(out, p.where)
    if p.order:
        ways = [(col(o).desc_nulls_first() if k.descending else col(o).asc_nulls_last()) for o, k in zip(order, p.order, strict=True) if o is not None]
        out = out.keep(out.df.orderBy(*ways)) if ways else out
    if p.skip is not None:
        out = out.keep(out.df.offset(count_of(m, p.skip, "SKIP")))
    if p.limit is not None:
        out = out.keep(out.df.limit(count_of(m, p.limit, "LIMIT")))
    return out, names


def _columns(frame: Frame) -> set[str]:
    return set(frame.columns())


def count_of(m: Matcher, e: s.Node, what: str) -> int:
    x = lower(e, Scope({}, m.params))
    if x.value is MISSING or isinstance(x.value, bool) or not isinstance(x.value, int) or x.value < 0:
        raise TypeMismatchError(f"{what} takes a non-negative integer")
    return x.value


def bound(frame: Frame, e: s.Node, replaced: dict) -> Entity | None:
    b = frame.vars.get(e.name) if isinstance(e, s.Variable) and e not in replaced else None
    return b if isinstance(b, Entity) else None


def sort_place(e: s.Node, exprs: list[s.Node], keys: list[str], names: list[str]) -> str | None:
    """The output that a sort key names: by alias, else by being the same expression."""
    if isinstance(e, s.Variable) and e.name in names:
        return keys[names.index(e.name)]
    return keys[exprs.index(e)] if e in exprs else None


def plain(m: Matcher, frame: Frame, exprs: list[s.Node], keys: list[str], names: list[str], order: list[s.Node], distinct: bool) -> tuple[Frame, list[str | None]]:
    frame, replaced = m.attach(frame, *exprs, *order)
    scope = m.scope(frame, replaced)
    selected: dict[str, Column] = {}
    vars_: dict[str, Entity | Value] = {}
    aliases: dict[str, Typed] = {}
    for e, key, name in zip(exprs, keys, names, strict=True):
        if entity := bound(frame, e, replaced):
            selected |= {c: col(c) for c in entity.columns}
            vars_[key] = entity
        else:
            x = lower(e, scope)
            column = f"{key}@{m.names.fresh('')}"
            selected[column] = x.col
            vars_[key] = Value(column, x.type)
            aliases[name] = x
    places: list[str | None] = []
    for e in order:
        key = sort_place(e, exprs, keys, names)
        if key:
            b = vars_[key]
            places.append(b.id if isinstance(b, Entity) else b.name)
        else:
            x = lower(e, Scope(frame.vars, m.params, aliases, replaced))
            column = m.names.fresh("sort")
            selected[column] = x.col.getField("_id") if bound(frame, e, replaced) else x.col
            places.append(column)
    if not selected:
        return Frame(frame.df.select(), vars_), places
    return Frame(frame.df.select(*[c.alias(n) for n, c in selected.items()]), vars_), places


def leaves(e: s.Node, known: dict[s.Node, Typed], hidden: frozenset[str] = frozenset()) -> Iterator[s.Node]:
    """What an expression takes from the rows outside its aggregates: variables and their properties."""
    if e in known or isinstance(e, s.Call) and e.name in AGGREGATES:
        return
    if isinstance(e, s.Property) and isinstance(e.base, s.Variable) and e.base.name not in hidden:
        yield e
        return
    if isinstance(e, s.Variable):
        if e.name not in hidden:
            yield e
        return
    if isinstance(e, (s.Comprehension, s.Quantifier)):
        hidden |= {e.name}
    elif isinstance(e, s.Reduce):
        hidden |= {e.name, e.total}
    for x in e.children():
        yield from leaves(x, known, hidden)


def grouped(m: Matcher, frame: Frame, exprs: list[s.Node], keys: list[str], names: list[str], order: list[s.Node]) -> tuple[Frame, list[str | None]]:
    """Expressions without aggregates are the keys; what other expressions take from rows outside their aggregates
    are keys too. A node among the keys groups by its id."""
    extra = [e for e in order if sort_place(e, exprs, keys, names) is None]
    frame, replaced = m.attach(frame, *exprs, *order)
    scope = m.scope(frame, replaced)
    rows: dict[str, Column] = {}
    by: list[str] = []
    kept: list[Column] = []
    known: dict[s.Node, Typed] = {}
    vars_: dict[str, Entity | Value] = {}

    def key_of(e: s.Node) -> Entity | Value:
        if entity := bound(frame, e, replaced):
            wanted = m.used.get(e.name)
            if wanted is not None and e.name in m.used:  # few columns group along with the id they depend on
                entity = Entity(entity.kind, entity.prefix, tuple((n, t) for n, t in entity.fields if n in ("_id", "_labels", "_type") or n in wanted))
                by.extend(c for c in entity.columns if c not in by)
            elif entity.id not in by:
                by.append(entity.id)
                kept.extend(F.first(col(c)).alias(c) for c in entity.columns if c != entity.id)
            rows.update({c: col(c) for c in entity.columns})
            known[e] = entity.value()
            return entity
        x = lower(e, scope)
        column = m.names.fresh("key")
        rows[column] = x.col
        if not is_null(x):
            by.append(column)
        else:
            kept.append(F.first(col(column)).alias(column))
        known[e] = Typed(col(column), x.type)
        return Value(column, x.type)

    for e, key in zip(exprs, keys, strict=True):
        if not has_aggregate(e):
            vars_[key] = key_of(e)
    for e in [*exprs, *extra]:
        if has_aggregate(e):
            aliases = {n for n in names}
            for x in list(leaves(e, known)):
                if x not in known and not (isinstance(x, s.Variable) and x.name in aliases and x.name not in frame.vars):
                    key_of(x)
    aggregates: dict[s.Node, Column] = {}
    places_: list[tuple[str, bool, float, str]] = []
    for e in [*exprs, *extra]:
        for x in s.walk(e):
            if isinstance(x, s.Call) and x.name in AGGREGATES and x not in known:
                if any(map(has_aggregate, x.args)):
                    raise SemanticError("an aggregate can't hold another")
                column, argument = m.names.fresh("agg"), m.names.fresh("arg")
                if x.star:
                    made = Typed(F.count(F.lit(1)), lower(s.Literal(1), scope).type)
                else:
                    if not x.args:
                        raise SemanticError(f"{x.name}() takes an argument")
                    entity = bound(frame, x.args[0], replaced)
                    if entity and x.name == "count":
                        rows[argument] = col(entity.id)
                        value = entity.get("_id")
                    else:
                        value = lower(x.args[0], scope)
                        rows[argument] = value.col
                    share = lower(x.args[1], Scope({}, m.params)) if len(x.args) > 1 else None
                    made = AGGREGATES[x.name](value, argument, x.distinct, share)
                    if x.name == "percentiledisc" and share_of(share) is not None and is_number(value):
                        places_.append((argument, x.distinct, share_of(share), column))
                        known[x] = Typed(col(column), made.type)
                        continue
                aggregates[x] = made.col.alias(column)
                known[x] = Typed(col(column), made.type)
    source = frame.df.select(*[c.alias(n) for n, c in rows.items()]) if rows else frame.df
    made_ = [*aggregates.values(), *kept] or [F.count(F.lit(1)).alias(m.names.fresh("rows"))]
    df = source.groupBy(*map(col, by)).agg(*made_)
    for argument, distinct, share, column in places_:
        found = placed(source, by, argument, distinct, share, column)
        df = df.join(found, null_safe([col(c) for c in by], [col(f"{c}~") for c in by]), "left").drop(*[f"{c}~" for c in by])
    after: dict[str, Column] = {}
    results: dict[str, Typed] = {}
    for e, key, name in zip(exprs, keys, names, strict=True):
        if has_aggregate(e):
            x = lower(e, Scope({}, m.params, None, known))
            column = f"{key}@{m.names.fresh('')}"
            after[column] = x.col
            vars_[key] = Value(column, x.type)
            results[name] = x
        else:
            results[name] = vars_[key].value()
    places: list[str | None] = []
    for e in order:
        key = sort_place(e, exprs, keys, names)
        if key:
            b = vars_[key]
            places.append(b.id if isinstance(b, Entity) else b.name)
        else:
            column = m.names.fresh("sort")
            after[column] = lower(e, Scope({}, m.params, results, known)).col
            places.append(column)
    out = df.withColumns(after) if after else df
    return Frame(out, {k: vars_[k] for k in keys}), places


def unwind(m: Matcher, frame: Frame, e: s.Unwind) -> Frame:
    """A row for each element; none for null and for the empty list."""
    if isinstance(e.value, s.Parameter) and isinstance(table := m.params.get(e.value.name), DataFrame):
        column = f"{e.name}@{m.names.fresh('')}"  # a parameter can be a table: rows are maps
        rows = table.select(F.struct("*").alias(column))
        df = rows if frame.unit else frame.df.crossJoin(rows)
        return frame.bind(df, **{e.name: Value(column, rows.schema[column].dataType)})
    frame, replaced = m.attach(frame, e.value)
    x = lower(e.value, m.scope(frame, replaced))
    column = f"{e.name}@{m.names.fresh('')}"
    if is_null(x):
        return frame.bind(frame.df.withColumn(column, F.lit(None)).filter(F.lit(False)), **{e.name: Value(column, x.type)})
    if not is_list(x):
        raise TypeMismatchError(f"Type mismatch: expected List but was {x.type.simpleString()}")
    df = frame.df.select("*", F.explode(x.col).alias(column))
    return frame.bind(df, **{e.name: Value(column, x.type.elementType)})


__all__ = ["count_of", "display", "is_whole", "project", "result", "unwind"]
