"""Columns with known types, and the rules that decide what operations mean for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = object()


@dataclass(frozen=True)
class Typed:
    """``value``: the Python value of a literal, else MISSING."""

    col: Column
    type: T.DataType
    value: Any = MISSING


def literal(value: Any) -> Typed:
    """A Python value as a column; lists and dicts become arrays and structs."""
    if value is None:
        return Typed(F.lit(None), T.NullType(), None)
    if isinstance(value, bool):
        return Typed(F.lit(value), T.BooleanType(), value)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), T.LongType(), value)
    if isinstance(value, (list, tuple)):
        return listed([literal(v) for v in value], list(value))
    if isinstance(value, dict):
        return mapped([(str(k), literal(v)) for k, v in value.items()])
    col = F.lit(value)
    return Typed(col, probe(lambda: col), value)


def null(kind: T.DataType | None = None) -> Typed:
    return literal(None) if kind is None else Typed(F.lit(None).cast(kind), kind, None)


def probe(build: Callable[..., Column], *kinds: T.DataType) -> T.DataType:
    """The type of what ``build`` makes of columns of such types, found by analysing it over no rows."""
    spark = SparkSession.active()
    frame = spark.range(0).select(*[F.lit(None).cast(k).alias(f"a{i}") for i, k in enumerate(kinds)], F.lit(1).alias("one"))
    return frame.select(build(*[F.col(f"a{i}") for i in range(len(kinds))])).schema[0].dataType


#: Types that builders without free variables have been found to make.
_made: dict[tuple, T.DataType] = {}


def made(build: Callable[..., Column], *args: Typed) -> Typed:
    kinds = [a.type for a in args]
    if build.__module__.startswith("pyspark."):
        key = (build.__module__, build.__qualname__, *[k.json() for k in kinds])
    else:
        key = (build.__code__, *[k.json() for k in kinds]) if build.__closure__ is None else None
    kind = _made.get(key) if key else None
    if kind is None:
        kind = probe(build, *kinds)
        if key:
            _made[key] = kind
    return Typed(build(*[a.col for a in args]), kind)


def is_null(a: Typed) -> bool:
    return isinstance(a.type, T.NullType)


def is_number(a: Typed) -> bool:
    return isinstance(a.type, T.NumericType)


def is_whole(a: Typed) -> bool:
    return isinstance(a.type, T.IntegralType)


def is_text(a: Typed) -> bool:
    return isinstance(a.type, T.StringType)


def is_truth(a: Typed) -> bool:
    return isinstance(a.type, T.BooleanType)


def is_list(a: Typed) -> bool:
    return isinstance(a.type, T.ArrayType)


def is_struct(a: Typed) -> bool:
    return isinstance(a.type, T.StructType)


def is_date(a: Typed) -> bool:
    return isinstance(a.type, T.DateType)


def is_moment(a: Typed) -> bool:
    return isinstance(a.type, (T.TimestampType, T.TimestampNTZType))


def is_node(a: Typed) -> bool:
    return is_struct(a) and "_labels" in a.type.names


def is_rel(a: Typed) -> bool:
    return is_struct(a) and {"_type", "_src"} <= set(a.type.names)


def is_path(a: Typed) -> bool:
    return is_struct(a) and a.type.names == ["nodes", "relationships"]


def double(a: Typed) -> Typed:
    return a if isinstance(a.type, T.DoubleType) else Typed(a.col.cast("double"), T.DoubleType(), float(a.value) if isinstance(a.value, (int, float)) else MISSING)


def whole(a: Typed) -> Typed:
    return a if isinstance(a.type, T.LongType) else Typed(a.col.cast("long"), T.LongType(), a.value)


def truth(a: Typed) -> Column:
    """A three-valued truth: anything but a boolean is unknown."""
    return a.col if is_truth(a) else F.lit(None).cast("boolean")


def common(kinds: list[T.DataType]) -> T.DataType:
    """The type that can hold values of all these; text if nothing better can."""
    rest = list(dict.fromkeys(k.simpleString() for k in kinds if not isinstance(k, T.NullType)))
    some = [k for k in kinds if not isinstance(k, T.NullType)]
    if not some:
        return T.NullType()
    if len(rest) == 1:
        return some[0]
    if all(isinstance(k, T.IntegralType) for k in some):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in some):
        return T.DoubleType()
    if all(isinstance(k, T.ArrayType) for k in some):
        return T.ArrayType(common([k.elementType for k in some]))
    return T.StringType()


def cast(a: Typed, kind: T.DataType) -> Column:
    if a.type == kind or isinstance(kind, T.NullType):
        return a.col
    if isinstance(kind, T.StringType) and isinstance(a.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(a.col)
    return a.col.cast(kind)


def unified(items: list[Typed]) -> tuple[list[Column], T.DataType]:
    kind = common([i.type for i in items])
    return [cast(i, kind) for i in items], kind


def listed(items: list[Typed], value: Any = MISSING) -> Typed:
    cols, kind = unified(items)
    return Typed(F.array(*cols), T.ArrayType(kind), value)


def mapped(entries: list[tuple[str, Typed]]) -> Typed:
    """A map with known keys: a struct. Of equal keys the last counts."""
    last = dict(entries)
    kind = T.StructType([T.StructField(k, v.type) for k, v in last.items()])
    return Typed(F.struct(*[v.col.alias(k) for k, v in last.items()]), kind)


def field(a: Typed, name: str) -> Typed:
    """A property of a struct or map; null where there is none."""
    if is_struct(a):
        if name in a.type.names:
            return Typed(a.col.getField(name), a.type[name].dataType)
        return null()
    if isinstance(a.type, T.MapType):
        return made(lambda m: F.try_element_at(m, F.lit(name)), a)
    return null()


def comparable(a: Typed, b: Typed) -> bool:
    pairs = ((is_number, is_number), (is_text, is_text), (is_truth, is_truth), (is_date, is_date), (is_moment, is_moment))
    return any(p(a) and q(b) for p, q in pairs)


def equal(a: Typed, b: Typed) -> Column:
    """Equality in three values: null where the types can't be equal, ids for nodes and relationships."""
    if (is_node(a) and is_node(b)) or (is_rel(a) and is_rel(b)):
        return a.col.getField("_id") == b.col.getField("_id")
    if comparable(a, b) or (is_list(a) and is_list(b)) or (is_struct(a) and is_struct(b) and a.type == b.type):
        return unordered(a, b, a.col == b.col)
    return F.lit(None).cast("boolean")


def unordered(a: Typed, b: Typed, test: Column) -> Column:
    """``test``, but null where either side isn't a number."""
    odd = [F.isnan(x.col) for x in (a, b) if isinstance(x.type, (T.DoubleType, T.FloatType)) and x.value is MISSING]
    if not odd:
        return test
    return F.when(odd[0] if len(odd) == 1 else odd[0] | odd[1], F.lit(None).cast("boolean")).otherwise(test)
