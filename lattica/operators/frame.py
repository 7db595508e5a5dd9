"""What flows between operators: a DataFrame, and which of its columns hold which variable.

A node or relationship n lies flat in columns n$_id, n$<property> and so on, so that unused ones are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import Typed

NODE_FIELDS, REL_FIELDS = ("_id", "_labels"), ("_id", "_type", "_src", "_dst")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Entity:
    """A node or relationship: its columns start with ``prefix``. ``fields``: what they hold, with types."""

    kind: str
    prefix: str
    fields: tuple[tuple[str, T.DataType], ...]

    def column(self, name: str) -> str:
        return f"{self.prefix}${name}"

    @property
    def id(self) -> str:
        return self.column("_id")

    @property
    def columns(self) -> list[str]:
        return [self.column(n) for n, _ in self.fields]

    def get(self, name: str) -> Typed | None:
        kind = dict(self.fields).get(name)
        return None if kind is None else Typed(col(self.column(name)), kind)

    def value(self) -> Typed:
        """The whole as a struct, null for a null id."""
        made = F.struct(*[col(self.column(n)).alias(n) for n, _ in self.fields])
        return Typed(F.when(col(self.id).isNotNull(), made), T.StructType([T.StructField(n, t) for n, t in self.fields]))


@dataclass(frozen=True)
class Value:
    name: str
    type: T.DataType

    @property
    def columns(self) -> list[str]:
        return [self.name]

    def value(self) -> Typed:
        return Typed(col(self.name), self.type)


Binding = Entity | Value


@dataclass(frozen=True)
class Frame:
    """``unit``: exactly one row without columns that matter."""

    df: DataFrame
    vars: dict[str, Binding]
    unit: bool = False

    def bind(self, df: DataFrame, **new: Binding) -> Frame:
        return Frame(df, self.vars | new)

    def keep(self, df: DataFrame) -> Frame:
        return replace(self, df=df, unit=False)

    def value(self, name: str, made: Typed, column: str | None = None) -> Frame:
        """With one more value variable."""
        column = column or name
        return self.bind(self.df.withColumn(column, made.col), **{name: Value(column, made.type)})

    def key_columns(self, names: list[str]) -> list[str]:
        """Columns that tell rows apart by the variables: ids of entities."""
        out: list[str] = []
        for n in names:
            b = self.vars[n]
            out += [b.id] if isinstance(b, Entity) else b.columns
        return out

    def columns(self, names: list[str] | None = None) -> list[str]:
        out: list[str] = []
        for n in self.vars if names is None else names:
            out += [c for c in self.vars[n].columns if c not in out]
        return out


def entity_frame(table: DataFrame, kind: str, prefix: str) -> tuple[DataFrame, Entity]:
    """A node or edge table under fresh columns."""
    fixed = NODE_FIELDS if kind == "node" else REL_FIELDS
    rest = [f.name for f in table.schema if f.name not in fixed]
    fields = tuple((n, table.schema[n].dataType) for n in (*fixed, *rest))
    e = Entity(kind, prefix, fields)
    return table.select(*[col(n).alias(e.column(n)) for n, _ in fields]), e


def null_safe(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out
