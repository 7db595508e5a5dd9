"""The scalar functions of the query language, each as a builder of native columns.

A builder gets typed arguments and gives a typed result. Where types or the number of arguments don't fit, the result
is null, as the language has it; unknown names are errors of the analyser.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .typed import MISSING, Typed, cast, common, comparable, double, equal, field, is_date, is_list, is_moment, is_node, is_null, is_number, is_path, is_rel, is_struct, is_text, is_truth, is_whole, listed, literal, made, null, whole

Builder = Callable[..., Typed]
FUNCTIONS: dict[str, tuple[Builder, int, int]] = {}
#: Arguments of functions that take any number of them.
MOST = sys.maxsize


def function(*names: str, least: int = 1, most: int | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        for name in names:
            FUNCTIONS[name] = (build, least, least if most is None else most)
        return build

    return register


def call(name: str, args: list[Typed]) -> Typed:
    build, least, most = FUNCTIONS[name]
    return build(*args) if least <= len(args) <= most else null()


# -- identity and graph ---------------------------------------------------------------------------------------------


@function("id")
def id_(x: Typed) -> Typed:
    return field(x, "_id") if is_node(x) or is_rel(x) else null(T.LongType())


@function("type")
def type_(x: Typed) -> Typed:
    return field(x, "_type") if is_rel(x) else null(T.StringType())


@function("labels")
def labels(x: Typed) -> Typed:
    return field(x, "_labels") if is_node(x) else null(T.ArrayType(T.StringType()))


def _property_names(x: Typed) -> list[str]:
    return sorted(n for n in x.type.names if not (n.startswith("_") and (is_node(x) or is_rel(x))))


@function("keys")
def keys(x: Typed) -> Typed:
    if isinstance(x.type, T.MapType):
        return made(lambda m: F.array_sort(F.map_keys(m)), x)
    if not is_struct(x):
        return null(T.ArrayType(T.StringType()))
    names = _property_names(x)
    if not (is_node(x) or is_rel(x)):  # a map has all its keys
        return made(lambda m: F.when(m.isNotNull(), F.array(*map(F.lit, names)).cast("array<string>")), x)
    present = F.array(*[F.when(x.col.getField(n).isNotNull(), F.lit(n)) for n in names]).cast("array<string>")
    return Typed(F.when(x.col.isNotNull(), F.array_compact(present)), T.ArrayType(T.StringType()))


@function("properties")
def properties(x: Typed) -> Typed:
    if not (is_node(x) or is_rel(x)):
        return x if is_struct(x) or isinstance(x.type, T.MapType) else null()
    names = _property_names(x)
    kind = T.StructType([T.StructField(n, x.type[n].dataType) for n in names])
    return Typed(F.when(x.col.isNotNull(), F.struct(*[x.col.getField(n).alias(n) for n in names])), kind)


@function("nodes")
def nodes(p: Typed) -> Typed:
    return field(p, "nodes") if is_path(p) else null()


@function("relationships", "rels")
def relationships(p: Typed) -> Typed:
    return field(p, "relationships") if is_path(p) else null()


@function("length")
def length(p: Typed) -> Typed:
    return Typed(_size(p.col.getField("relationships")), T.LongType()) if is_path(p) else null(T.LongType())


def _size(x: Column) -> Column:
    return F.when(x.isNotNull(), F.size(x).cast("long"))


@function("size")
def size(x: Typed) -> Typed:
    if is_text(x):
        return made(lambda a: F.length(a).cast("long"), x)
    return Typed(_size(x.col), T.LongType()) if is_list(x) else null(T.LongType())


@function("coalesce", least=1, most=MOST)
def coalesce(*args: Typed) -> Typed:
    some = [a for a in args if not is_null(a)]
    if not some:
        return null()
    kind = common([a.type for a in some])
    return Typed(F.coalesce(*[cast(a, kind) for a in some]), kind)


@function("exists")
def exists(x: Typed) -> Typed:
    return Typed(x.col.isNotNull(), T.BooleanType())


@function("show_functions", least=0)
def show_functions() -> Typed:
    from .aggregates import AGGREGATES

    return literal(sorted({*FUNCTIONS, *AGGREGATES}))


# -- conversion -----------------------------------------------------------------------------------------------------


def plain_digits(x: Column) -> Column:
    """A double as text, without exponents and with a fraction always."""
    short = x.cast("string")
    exact = F.regexp_replace(F.regexp_replace(short.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    large = F.concat(short.try_cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when(short.contains("E"), F.coalesce(exact, large, short)).otherwise(short)


@function("tostring", "string", "cast_to_string")
def to_string(x: Typed) -> Typed:
    if isinstance(x.type, (T.DoubleType, T.FloatType)):
        return made(plain_digits, double(x))
    ok = is_text(x) or is_truth(x) or is_number(x)
    return made(lambda a: a.cast("string"), x) if ok else null(T.StringType())


@function("tointeger", "toint", "int64", "cast_to_int64")
def to_integer(x: Typed) -> Typed:
    if is_whole(x):
        return whole(x)
    if is_number(x):
        inside = lambda a: ~F.isnan(a) & (a >= -9.223372036854775808e18) & (a < 9.223372036854775807e18)
        return made(lambda a: F.when(inside(a), a).try_cast("long"), double(x))
    if is_text(x):
        return made(lambda a: F.when(a.rlike(r"^[+-]?[0-9]+\z"), a).try_cast("long"), x)
    return null(T.LongType())


@function("tofloat", "double", "cast_to_double")
def to_float(x: Typed) -> Typed:
    if is_number(x):
        return double(x)
    if is_text(x):
        number = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z|^[+-]?(?i:inf|infinity|nan)\z"
        return made(lambda a: F.when(a.rlike(number), a).try_cast("double"), x)
    return null(T.DoubleType())


@function("toboolean")
def to_boolean(x: Typed) -> Typed:
    if is_truth(x):
        return x
    if is_text(x):
        return made(lambda a: F.when(F.lower(a) == "true", True).when(F.lower(a) == "false", False), x)
    return null(T.BooleanType())


@function("date", "cast_to_date")
def date(x: Typed) -> Typed:
    if is_date(x):
        return x
    if is_moment(x):
        return made(lambda a: a.cast("date"), x)
    if is_text(x):
        return made(lambda a: F.when(a.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), a).try_cast("date"), x)
    return null(T.DateType())


# -- strings --------------------------------------------------------------------------------------------------------


def _text(name: str, build: Callable[[Column], Column], *others: str) -> None:
    function(name, *others)(lambda x: made(build, x) if is_text(x) else null(T.StringType()))


SPACE = r"[\p{IsWhite_Space}]+"
_text("trim", lambda a: F.regexp_replace(F.regexp_replace(a, f"^{SPACE}", ""), rf"{SPACE}\z", ""))
_text("ltrim", lambda a: F.regexp_replace(a, f"^{SPACE}", ""))
_text("rtrim", lambda a: F.regexp_replace(a, rf"{SPACE}\z", ""))
_text("toupper", F.upper, "upper")
_text("tolower", F.lower, "lower")


@function("reverse")
def reverse(x: Typed) -> Typed:
    return made(F.reverse, x) if is_text(x) or is_list(x) else null()


@function("replace", least=3)
def replace(s: Typed, a: Typed, b: Typed) -> Typed:
    return made(F.replace, s, a, b) if all(map(is_text, (s, a, b))) else null(T.StringType())


@function("substring", least=2, most=3)
def substring(s: Typed, start: Typed, n: Typed | None = None) -> Typed:
    if not is_text(s) or not is_whole(start) or (n is not None and not is_whole(n)):
        return null(T.StringType())
    begin = F.greatest(start.col, F.lit(0)) + 1
    count = F.greatest(n.col, F.lit(0)) if n is not None else F.length(s.col)
    return Typed(F.when(s.col.isNotNull() & start.col.isNotNull(), F.substring(s.col, begin.cast("int"), count.cast("int"))), T.StringType())


@function("left", least=2)
def left(s: Typed, n: Typed) -> Typed:
    if not (is_text(s) and is_whole(n)):
        return null(T.StringType())
    return made(lambda a, k: F.when(k.isNotNull(), F.substring(a, F.lit(1), F.greatest(k, F.lit(0)).cast("int"))), s, n)


@function("right", least=2)
def right(s: Typed, n: Typed) -> Typed:
    return made(lambda a, k: F.right(a, F.greatest(k, F.lit(0)).cast("int")), s, n) if is_text(s) and is_whole(n) else null(T.StringType())


@function("split", least=2)
def split(s: Typed, by: Typed) -> Typed:
    if not (is_text(s) and is_text(by)):
        return null(T.ArrayType(T.StringType()))
    quoted = F.lit("\\Q" + by.value.replace("\\E", "\\E\\\\E\\Q") + "\\E") if isinstance(by.value, str) else F.concat(F.lit("\\Q"), by.col, F.lit("\\E"))
    return Typed(F.split(s.col, quoted, F.lit(-1)), T.ArrayType(T.StringType()))


@function("concat", least=1, most=MOST)
def concat(*args: Typed) -> Typed:
    return made(F.concat, *args) if all(map(is_text, args)) else null(T.StringType())


@function("contains", least=2)
def contains(a: Typed, b: Typed) -> Typed:
    return made(F.contains, a, b) if is_text(a) and is_text(b) else null(T.BooleanType())


@function("starts_with", least=2)
def starts_with(a: Typed, b: Typed) -> Typed:
    return made(F.startswith, a, b) if is_text(a) and is_text(b) else null(T.BooleanType())


@function("ends_with", least=2)
def ends_with(a: Typed, b: Typed) -> Typed:
    return made(F.endswith, a, b) if is_text(a) and is_text(b) else null(T.BooleanType())


@function("regexp_matches", least=2)
def regexp_matches(s: Typed, pattern: Typed) -> Typed:
    """Whether the whole text matches."""
    if not (is_text(s) and is_text(pattern)):
        return null(T.BooleanType())
    return made(lambda a, p: F.rlike(a, F.concat(F.lit("^(?:"), p, F.lit(r")\z"))), s, pattern)


@function("regexp_replace", least=3)
def regexp_replace(s: Typed, pattern: Typed, by: Typed) -> Typed:
    return made(F.regexp_replace, s, pattern, by) if all(map(is_text, (s, pattern, by))) else null(T.StringType())


@function("regexp_extract", least=2, most=3)
def regexp_extract(s: Typed, pattern: Typed, group: Typed | None = None) -> Typed:
    if not (is_text(s) and is_text(pattern)):
        return null(T.StringType())
    g = group if group is not None else literal(0)
    return made(lambda a, p, k: F.when(F.rlike(a, p), F.call_function("regexp_extract", a, p, k.cast("int"))), s, pattern, g)


# -- numbers --------------------------------------------------------------------------------------------------------


def _number(name: str, build: Callable[[Column], Column], *others: str) -> None:
    function(name, *others)(lambda x: made(build, double(x)) if is_number(x) else null(T.DoubleType()))


def _logarithm(build: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(build(x))


@function("abs")
def abs_(x: Typed) -> Typed:
    if is_whole(x):
        return made(lambda a: F.when(a >= 0, a).otherwise(F.try_subtract(F.lit(0).cast("long"), a)), whole(x))
    return made(F.abs, double(x)) if is_number(x) else null()


_number("ceil", lambda x: F.ceil(x).cast("double"))
_number("floor", lambda x: F.floor(x).cast("double"))
_number("round", lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))
_number("sqrt", F.sqrt)
_number("exp", F.exp)
_number("log", _logarithm(F.log), "ln")
_number("log10", _logarithm(F.log10))
for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "degrees", "radians", "cot"):
    _number(_name, getattr(F, _name))
_number("haversin", lambda x: (1 - F.cos(x)) / 2)


@function("sign")
def sign(x: Typed) -> Typed:
    return made(lambda a: F.signum(a).cast("long"), x) if is_number(x) else null(T.LongType())


@function("atan2", least=2)
def atan2(y: Typed, x: Typed) -> Typed:
    return made(F.atan2, double(y), double(x)) if is_number(x) and is_number(y) else null(T.DoubleType())


function("pi", least=0)(lambda: Typed(F.pi(), T.DoubleType()))
function("e", least=0)(lambda: Typed(F.e(), T.DoubleType()))
function("rand", least=0)(lambda: Typed(F.rand(), T.DoubleType()))
function("randomuuid", least=0)(lambda: Typed(F.uuid(), T.StringType()))


# -- lists ----------------------------------------------------------------------------------------------------------


@function("head")
def head(x: Typed) -> Typed:
    return made(lambda a: F.get(a, F.lit(0)), x) if is_list(x) else null()


@function("last")
def last(x: Typed) -> Typed:
    return made(lambda a: F.try_element_at(a, F.lit(-1)), x) if is_list(x) else null()


@function("tail")
def tail(x: Typed) -> Typed:
    return made(lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(0))), x) if is_list(x) else null()


#: Numbers of a range at most.
RANGE = 1_000_000


@function("range", least=2, most=3)
def range_(a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    """Both ends belong to it; the wrong direction gives none, a step of zero null; RANGE numbers at most."""
    kind = T.ArrayType(T.LongType())
    by = step if step is not None else literal(1)
    if not all(map(is_whole, (a, b, by))):
        return null(kind)
    a, b, by = whole(a), whole(b), whole(by)
    if by.value == 0:
        return null(kind)
    far = a.col + by.col * (RANGE - 1)
    up, down = F.sequence(a.col, F.least(b.col, far), by.col), F.sequence(a.col, F.greatest(b.col, far), by.col)
    none = F.array().cast("array<bigint>")
    if by.value is not MISSING:
        return Typed(F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).when(a.col <= b.col, up).otherwise(none) if by.value > 0 else F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).when(a.col >= b.col, down).otherwise(none), kind)
    col = F.when((by.col > 0) & (a.col <= b.col), up).when((by.col < 0) & (a.col >= b.col), down).when(by.col != 0, none)
    return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), col), kind)


def _with(a: Typed, x: Typed, build: Callable[[Column, Column], Column]) -> Typed:
    if not is_list(a):
        return null()
    kind = common([a.type.elementType, x.type])
    return Typed(build(cast(a, T.ArrayType(kind)), cast(x, kind)), T.ArrayType(kind))


function("list_append", "array_append", "list_push_back", least=2)(lambda a, x: _with(a, x, F.array_append))
function("list_prepend", "array_prepend", "list_push_front", least=2)(lambda a, x: _with(a, x, F.array_prepend))


@function("list_extract", "array_extract", least=2)
def list_extract(x: Typed, k: Typed) -> Typed:
    """Counted from 1, or from the end by negative numbers."""
    if not (is_list(x) and is_whole(k)):
        return null()
    return made(lambda a, i: F.try_element_at(a, F.when(i != 0, i).cast("int")), x, k)


@function("list_contains", "array_contains", "list_has", least=2)
def list_contains(x: Typed, y: Typed) -> Typed:
    if not is_list(x):
        return null(T.BooleanType())
    if is_null(y):
        return Typed(F.when(x.col.isNotNull(), F.exists(x.col, lambda e: e.isNull())), T.BooleanType())
    element = Typed(F.lit(None).cast(x.type.elementType), x.type.elementType)
    if not (comparable(element, y) or element.type == y.type):
        return Typed(F.when(x.col.isNotNull(), F.lit(False)), T.BooleanType())
    return Typed(F.when(x.col.isNotNull(), F.exists(x.col, lambda e: e.eqNullSafe(y.col))), T.BooleanType())


@function("list_sort", "array_sort")
def list_sort(x: Typed) -> Typed:
    return made(F.array_sort, x) if is_list(x) else null()


@function("list_distinct", "array_distinct")
def list_distinct(x: Typed) -> Typed:
    return made(F.array_distinct, x) if is_list(x) else null()


function("list_value", "make_list", "list_creation", least=0, most=MOST)(lambda *items: listed(list(items)))


# -- dates and moments ----------------------------------------------------------------------------------------------

function("current_date", least=0)(lambda: Typed(F.current_date(), T.DateType()))
function("current_timestamp", least=0)(lambda: Typed(F.current_timestamp(), T.TimestampType()))


def _moment(x: Typed) -> Column:
    return x.col.cast("timestamp")


@function("make_date", least=3)
def make_date(y: Typed, m: Typed, d: Typed) -> Typed:
    if not all(map(is_whole, (y, m, d))):
        return null(T.DateType())
    ok = (y.col >= 0) & (y.col <= 9999) & (m.col >= 1) & (m.col <= 12) & (d.col >= 1) & (d.col <= 31)
    text = F.format_string("%04d-%02d-%02d", y.col.cast("int"), m.col.cast("int"), d.col.cast("int"))
    return Typed(F.when(ok, text).try_cast("date"), T.DateType())


@function("to_timestamp")
def to_timestamp(x: Typed) -> Typed:
    return made(F.timestamp_seconds, x) if is_number(x) else null(T.TimestampType())


@function("epoch_ms")
def epoch_ms(x: Typed) -> Typed:
    return Typed(F.unix_millis(_moment(x)), T.LongType()) if is_moment(x) else null(T.LongType())


@function("date_part", least=2)
def date_part(part: Typed, x: Typed) -> Typed:
    none, name = null(T.LongType()), part.value.lower() if isinstance(part.value, str) else None
    if not (is_date(x) or is_moment(x)):
        return none
    parts = {"year": F.year, "month": F.month, "day": F.day}
    if is_moment(x):
        parts |= {"hour": F.hour, "minute": F.minute, "second": F.second, "epoch": lambda a: F.unix_seconds(a.cast("timestamp"))}
    if name is not None:
        return Typed(parts[name](x.col).cast("long"), T.LongType()) if name in parts else none
    out = F.lit(None).cast("long")
    for key, build in parts.items():
        out = F.when(F.lower(part.col) == key, build(x.col).cast("long")).otherwise(out)
    return Typed(out, T.LongType())


@function("date_trunc", least=2)
def date_trunc(part: Typed, x: Typed) -> Typed:
    name = part.value.lower() if isinstance(part.value, str) else None
    if is_date(x) and name in ("year", "month", "day"):
        return Typed(x.col if name == "day" else F.trunc(x.col, name), T.DateType())
    if is_moment(x) and name in ("year", "month", "day", "hour", "minute"):
        return Typed(F.date_trunc(name, x.col).cast(x.type), x.type)
    return null()


__all__ = ["FUNCTIONS", "call", "equal", "function"]
