"""Expressions to native columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SemanticError, TypeMismatchError
from ..functions import scalar
from ..functions.aggregates import AGGREGATES
from ..functions.typed import MISSING, Typed, cast, comparable, common, double, equal, field, is_list, is_node, is_null, is_number, is_rel, is_struct, is_text, is_whole, listed, literal, made, mapped, null, truth, unified, unordered, whole
from ..plans import syntax as s
from .frame import Entity, Value


class Scope:
    """Names in reach: variables of the frame, those of lambdas before them, and parameters."""

    def __init__(self, vars: dict[str, Any], params: dict[str, Any] | None = None, local: dict[str, Typed] | None = None, replaced: dict[s.Node, Typed] | None = None) -> None:
        self.vars, self.params, self.local, self.replaced = vars, params or {}, local or {}, replaced or {}

    def inside(self, **local: Typed) -> Scope:
        return Scope(self.vars, self.params, self.local | local, self.replaced)


def lower(e: s.Node, scope: Scope) -> Typed:
    if e in scope.replaced:
        return scope.replaced[e]
    build = LOWER.get(type(e))
    if build is None:
        raise SemanticError(f"{type(e).__name__} can't stand here")
    return build(e, scope)


def condition(e: s.Node, scope: Scope) -> Column:
    """A filter: rows stay where it is true. Conjuncts stay apart and comparisons bare, so that they can be pushed down."""
    parts: list[Column] = []
    todo = [e]
    while todo:
        x = todo.pop(0)
        if isinstance(x, s.Binary) and x.op == "AND":
            todo[:0] = [x.left, x.right]
        elif isinstance(x, s.Binary) and x.op in ORDER and x not in scope.replaced:
            a, b = lower(x.left, scope), lower(x.right, scope)
            if comparable(a, b):
                parts.append(ORDER[x.op](a.col, b.col))
                parts += [~F.isnan(y.col) for y in (a, b) if isinstance(y.type, (T.DoubleType, T.FloatType)) and y.value is MISSING]
            else:
                parts.append(truth(compare(x.op, a, b)))
        else:
            parts.append(truth(lower(x, scope)))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


ORDER = {
    "=": lambda a, b: a == b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Typed, b: Typed) -> Typed:
    kind = T.BooleanType()
    if op in ("=", "<>"):
        test = equal(a, b)
        return Typed(test if op == "=" else ~test, kind)
    if not comparable(a, b):
        return null(kind)
    return Typed(unordered(a, b, ORDER[op](a.col, b.col)), kind)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+" and is_text(a) and is_text(b):
        return made(F.concat, a, b)
    if op == "+" and is_list(a) and is_list(b):
        kind = common([a.type, b.type])
        return Typed(F.concat(cast(a, kind), cast(b, kind)), kind)
    if not (is_number(a) and is_number(b)):
        return null()
    if op == "^":
        return made(F.pow, double(a), double(b))
    if is_whole(a) and is_whole(b):
        a, b = whole(a), whole(b)
        build = {
            "+": F.try_add,
            "-": F.try_subtract,
            "*": F.try_multiply,
            "/": lambda x, y: F.call_function("div", x, y),
            "%": lambda x, y: x % y,
        }[op]
        return Typed(build(a.col, b.col), T.LongType())
    build = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide, "%": F.try_mod}[op]
    return Typed(build(double(a).col, double(b).col), T.DoubleType())


def _literal(e: s.Literal, scope: Scope) -> Typed:
    return literal(e.value)


def _parameter(e: s.Parameter, scope: Scope) -> Typed:
    return literal(scope.params.get(e.name))


def _variable(e: s.Variable, scope: Scope) -> Typed:
    if e.name in scope.local:
        return scope.local[e.name]
    if e.name not in scope.vars:
        raise SemanticError(f"{e.name} isn't defined")
    return scope.vars[e.name].value()


def _property(e: s.Property, scope: Scope) -> Typed:
    if isinstance(e.base, s.Variable) and e.base.name not in scope.local and e.base not in scope.replaced:
        b = scope.vars.get(e.base.name)
        if isinstance(b, Entity):
            return (None if e.name.startswith("_") else b.get(e.name)) or null()
    base = lower(e.base, scope)
    if e.name.startswith("_") and (is_node(base) or is_rel(base)):
        return null()
    return field(base, e.name)


def _index(e: s.Index, scope: Scope) -> Typed:
    base, at = lower(e.base, scope), lower(e.at, scope)
    if is_list(base) and is_whole(at):
        place = F.when(at.col >= 0, at.col + 1).otherwise(at.col).cast("int")
        return made(lambda a: F.try_element_at(a, F.lit(1)), base) if at.value == 0 else Typed(F.try_element_at(base.col, place), base.type.elementType)
    if is_struct(base) and is_text(at):
        if at.value is not MISSING:
            return null() if at.value.startswith("_") and (is_node(base) or is_rel(base)) else field(base, at.value)
        names = [n for n in base.type.names if not n.startswith("_")]
        kind = common([base.type[n].dataType for n in names])
        out = F.lit(None).cast(kind)
        for n in names:
            out = F.when(at.col == n, cast(field(base, n), kind)).otherwise(out)
        return Typed(out, kind)
    if isinstance(base.type, T.MapType):
        return made(F.try_element_at, base, at)
    return null()


def _slice(e: s.Slice, scope: Scope) -> Typed:
    base = lower(e.base, scope)
    if not (is_list(base) or is_text(base)):
        return null()
    n = (F.size(base.col) if is_list(base) else F.length(base.col)).cast("long")

    def bound(x: s.Node | None, default: Column) -> Column:
        if x is None:
            return default
        t = lower(x, scope)
        if not is_whole(t):
            return F.lit(None).cast("long")
        k = whole(t).col
        return F.greatest(F.least(F.when(k < 0, k + n).otherwise(k), n), F.lit(0))

    low, high = bound(e.low, F.lit(0).cast("long")), bound(e.high, n)
    count = F.greatest(high - low, F.lit(0)).cast("int")
    start = (low + 1).cast("int")
    got = F.slice(base.col, start, count) if is_list(base) else F.substring(base.col, start, count)
    return Typed(F.when(base.col.isNotNull() & low.isNotNull() & high.isNotNull(), got), base.type)


def _unary(e: s.Unary, scope: Scope) -> Typed:
    x = lower(e.value, scope)
    if e.op == "NOT":
        return Typed(~truth(x), T.BooleanType())
    if not is_number(x):
        return null()
    if e.op == "+":
        return x
    if x.value is not MISSING and x.value is not None:
        return literal(-x.value) if not is_whole(x) or x.value != -(1 << 63) else null(T.LongType())
    return arithmetic("-", literal(0), x) if is_whole(x) else Typed(-double(x).col, T.DoubleType())


def _binary(e: s.Binary, scope: Scope) -> Typed:
    op = e.op
    if op in ("AND", "OR") and isinstance(e.left, s.Binary) and e.left.op == op:  # long chains don't recurse
        parts, x = [], e
        while isinstance(x, s.Binary) and x.op == op and x not in scope.replaced:
            parts.append(x.right)
            x = x.left
        out = truth(lower(x, scope))
        for p in reversed(parts):
            out = out & truth(lower(p, scope)) if op == "AND" else out | truth(lower(p, scope))
        return Typed(out, T.BooleanType())
    a, b = lower(e.left, scope), lower(e.right, scope)
    kind = T.BooleanType()
    if op == "AND":
        return Typed(truth(a) & truth(b), kind)
    if op == "OR":
        return Typed(truth(a) | truth(b), kind)
    if op == "XOR":
        return Typed(truth(a) != truth(b), kind)
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return compare(op, a, b)
    if op in ("+", "-", "*", "/", "%", "^"):
        return arithmetic(op, a, b)
    if op == "IN":
        return _in(a, b)
    if op == "=~":
        return scalar.call("regexp_matches", [a, b])
    return scalar.call({"STARTS WITH": "starts_with", "ENDS WITH": "ends_with", "CONTAINS": "contains"}[op], [a, b])


def _in(x: Typed, items: Typed) -> Typed:
    """Null where x is, or where nothing is hit and some element is null."""
    kind = T.BooleanType()
    if not is_list(items) or is_null(x):
        return null(kind)
    if isinstance(items.value, list) and all(isinstance(v, (str, int, float)) and not isinstance(v, bool) for v in items.value):
        fits = [v for v in items.value if isinstance(v, str) == is_text(x)]
        if (is_text(x) or is_number(x)) and fits == items.value and fits:
            return Typed(x.col.isin(fits), kind)
    element = Typed(F.lit(None), items.type.elementType)
    if isinstance(items.type.elementType, T.NullType):
        return Typed(F.when(F.size(items.col) == 0, F.lit(False)), kind)
    if not (comparable(x, element) or is_list(x) or is_struct(x)):
        return Typed(F.when(F.size(items.col) == 0, F.lit(False)), kind)
    return Typed(F.exists(items.col, lambda e: equal(Typed(e, element.type), x)), kind)


def _is_null(e: s.IsNull, scope: Scope) -> Typed:
    if isinstance(e.value, s.Variable) and isinstance(b := scope.vars.get(e.value.name), Entity) and e.value.name not in scope.local:
        x = b.get("_id").col
    else:
        x = lower(e.value, scope).col
    return Typed(x.isNotNull() if e.negated else x.isNull(), T.BooleanType())


def _case(e: s.Case, scope: Scope) -> Typed:
    subject = None if e.subject is None else lower(e.subject, scope)
    tests = [truth(lower(w, scope)) if subject is None else equal(subject, lower(w, scope)) for w, _ in e.branches]
    values = [lower(v, scope) for _, v in e.branches] + [literal(None) if e.default is None else lower(e.default, scope)]
    cols, kind = unified(values)
    out = F.when(tests[0], cols[0])
    for t, c in zip(tests[1:], cols[1:-1], strict=True):
        out = out.when(t, c)
    return Typed(out.otherwise(cols[-1]), kind)


def _list(e: s.ListOf, scope: Scope) -> Typed:
    items = [lower(x, scope) for x in e.items]
    plain = all(i.value is not MISSING for i in items)
    return listed(items, [i.value for i in items] if plain else MISSING)


def _key(k: s.Node, scope: Scope) -> str:
    name = lower(k, scope).value
    if not isinstance(name, str):
        raise TypeMismatchError("the keys of a map are strings")
    return name


def _map(e: s.MapOf, scope: Scope) -> Typed:
    return mapped([(_key(k, scope), lower(v, scope)) for k, v in e.entries])


def _map_projection(e: s.MapProjection, scope: Scope) -> Typed:
    base = lower(e.base, scope)
    if not is_struct(base):
        return null()
    out: list[tuple[str, Typed]] = []
    hidden = is_node(base) or is_rel(base)
    own = [n for n in base.type.names if not (hidden and n.startswith("_"))]
    for item in e.items:
        if item[0] == "all":
            out += [(n, field(base, n)) for n in own]
        elif item[0] == "property":
            out.append((item[1], field(base, item[1]) if item[1] in own else null()))
        elif item[0] == "entry":
            out.append((item[1], lower(item[2], scope)))
        else:
            x = lower(s.Variable(item[1]), scope)
            if is_node(x) or is_rel(x):
                out += [(n, field(x, n)) for n in x.type.names if not n.startswith("_")]
            else:
                out.append((item[1], x))
    whole_ = mapped(out)
    return Typed(F.when(base.col.isNotNull(), whole_.col), whole_.type)


def _call(e: s.Call, scope: Scope) -> Typed:
    if e.name in AGGREGATES:
        raise SemanticError(f"{e.name}() can't stand here")
    if e.name not in scalar.FUNCTIONS:
        raise SemanticError(f"there is no function {e.name}()")
    if e.name in ("id", "type", "labels") and len(e.args) == 1 and isinstance(e.args[0], s.Variable) and e.args[0].name not in scope.local:
        b = scope.vars.get(e.args[0].name)
        if isinstance(b, Entity):
            got = b.get({"id": "_id", "type": "_type", "labels": "_labels"}[e.name])
            if got is not None:
                return got
    return scalar.call(e.name, [lower(a, scope) for a in e.args])


def _comprehension(e: s.Comprehension, scope: Scope) -> Typed:
    source = lower(e.source, scope)
    if not is_list(source):
        return null()
    element = source.type.elementType
    inside = lambda x: scope.inside(**{e.name: Typed(x, element)})
    out = source.col
    if e.where is not None:
        out = F.filter(out, lambda x: truth(lower(e.where, inside(x))))
    if e.value is None:
        return Typed(out, source.type)
    kinds: list[T.DataType] = []

    def value(x: Column) -> Column:
        got = lower(e.value, inside(x))
        kinds.append(got.type)
        return got.col

    out = F.transform(out, value)
    return Typed(out, T.ArrayType(kinds[0]))


def _quantifier(e: s.Quantifier, scope: Scope) -> Typed:
    source, kind = lower(e.source, scope), T.BooleanType()
    if not is_list(source):
        return null(kind)
    test = lambda x: truth(lower(e.where, scope.inside(**{e.name: Typed(x, source.type.elementType)})))
    if e.kind == "any":
        return Typed(F.exists(source.col, test), kind)
    if e.kind == "all":
        return Typed(F.forall(source.col, test), kind)
    if e.kind == "none":
        return Typed(~F.exists(source.col, test), kind)
    hits = F.size(F.filter(source.col, test))
    unknown = F.exists(source.col, lambda x: test(x).isNull())
    return Typed(F.when(hits > 1, F.lit(False)).when(unknown, F.lit(None)).when(source.col.isNotNull(), hits == 1), kind)


def _reduce(e: s.Reduce, scope: Scope) -> Typed:
    start, source = lower(e.start, scope), lower(e.source, scope)
    if not is_list(source):
        return null()
    element = source.type.elementType
    kind = start.type

    def body(total: Column, x: Column) -> Typed:
        return lower(e.body, scope.inside(**{e.total: Typed(total, kind), e.name: Typed(x, element)}))

    seen: list[T.DataType] = []
    F.aggregate(source.col, start.col, lambda a, x: (got := body(a, x), seen.append(got.type), got.col)[2])
    kind = common([start.type, seen[0]])
    return Typed(F.aggregate(source.col, cast(start, kind), lambda a, x: cast(body(a, x), kind)), kind)


LOWER = {
    s.Literal: _literal,
    s.Parameter: _parameter,
    s.Variable: _variable,
    s.Property: _property,
    s.Index: _index,
    s.Slice: _slice,
    s.Unary: _unary,
    s.Binary: _binary,
    s.IsNull: _is_null,
    s.Case: _case,
    s.ListOf: _list,
    s.MapOf: _map,
    s.MapProjection: _map_projection,
    s.Call: _call,
    s.Comprehension: _comprehension,
    s.Quantifier: _quantifier,
    s.Reduce: _reduce,
}


def has_aggregate(e: s.Node) -> bool:
    return any(isinstance(x, s.Call) and x.name in AGGREGATES for x in s.walk(e))


def names_in(e: s.Node) -> set[str]:
    """Names that an expression or pattern mentions, those of its lambdas among them."""
    out: set[str] = set()
    for x in s.walk(e):
        if isinstance(x, s.Variable):
            out.add(x.name)
        elif isinstance(x, (s.NodePattern, s.RelPattern, s.PathPattern)) and x.name:
            out.add(x.name)
        elif isinstance(x, s.MapProjection):
            out |= {i[1] for i in x.items if i[0] == "variable"}
    return out


__all__ = ["Scope", "Value", "condition", "has_aggregate", "lower", "names_in"]
