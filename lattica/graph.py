"""The property graph: node tables by label set, edge tables by type, constraints. Graphs are values: a write makes a
new one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConstraintError
from .functions.typed import common

LabelSet = tuple[str, ...]


def label_set(labels: Iterable[str]) -> LabelSet:
    return tuple(sorted(set(labels)))


class Tables(Mapping):
    """Tables by key that are opened when they are first asked for."""

    def __init__(self, openers: Mapping[Any, Callable[[], DataFrame]]) -> None:
        self._openers, self._open = dict(openers), {}

    @classmethod
    def copied(cls, tables: Mapping[Any, DataFrame]) -> Tables:
        """A copy that can be changed, and that opens no table by itself."""
        return cls({k: (lambda k=k: tables[k]) for k in tables})

    def __setitem__(self, key: Any, table: DataFrame) -> None:
        self._openers[key], self._open[key] = (lambda: table), table

    def __getitem__(self, key: Any) -> DataFrame:
        if key not in self._open:
            self._open[key] = self._openers[key]()
        return self._open[key]

    def __iter__(self) -> Iterator:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)

    def __contains__(self, key: object) -> bool:
        return key in self._openers

    def only(self, keep: Callable[[Any], bool]) -> Tables:
        return Tables({k: (lambda k=k: self[k]) for k in self._openers if keep(k)})


@dataclass(frozen=True)
class Constraint:
    label: str
    properties: tuple[str, ...]
    kind: str
    type_name: str | None = None

    def __str__(self) -> str:
        return f"{self.kind} of {self.label}({', '.join(self.properties)})"


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes``: tables (_id, properties) of exactly such a set of labels. ``edges``: tables (_id, _src, _dst,
    properties). ``ends``: types whose edges are known to run between nodes of two label sets only, all of which
    exist; a match that needs nothing else of an end then spares the join with its nodes. ``carried``: for a type, a
    side (src or dst) and the label set there, a table of all such edges that holds the properties of the node on that
    side too, as src$<property> or dst$<property>; a hop that arrives there then needs no join either."""

    spark: SparkSession
    nodes: Mapping[LabelSet, DataFrame] = field(default_factory=dict)
    edges: Mapping[str, DataFrame] = field(default_factory=dict)
    ends: dict[str, tuple[LabelSet, LabelSet]] = field(default_factory=dict)
    carried: Mapping[tuple[str, str, LabelSet], DataFrame] = field(default_factory=dict)
    constraints: tuple[Constraint, ...] = ()
    next_node: int = 0
    next_edge: int = 0

    @classmethod
    def from_dataframes(
        cls, spark: SparkSession, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], ends: dict[str, tuple[str, str]] | None = None, next_node: int = 0, next_edge: int = 0,
        carried: dict[tuple[str, str, str], DataFrame] | None = None,
    ) -> PropertyGraph:
        """A graph over tables: labels as "A" or "A:B"."""
        tables = {label_set(k.split(":")): df for k, df in nodes.items()}
        known = {t: (label_set(a.split(":")), label_set(b.split(":"))) for t, (a, b) in (ends or {}).items()}
        held = {(t, side, label_set(labels.split(":"))): df for (t, side, labels), df in (carried or {}).items()}
        return cls(spark, tables, dict(edges), known, held, (), next_node, next_edge)

    # -- reading ----------------------------------------------------------------------------------------------------

    def label_sets(self, labels: Iterable[str] = ()) -> list[LabelSet]:
        """The sets that hold all the labels."""
        wanted = set(labels)
        return [k for k in self.nodes if wanted <= set(k)]

    def node_table(self, labels: Iterable[str] = ()) -> DataFrame:
        """(_id, _labels, properties) of all nodes with the labels, missing properties null."""
        parts = [(df, F.array(*map(F.lit, k)).cast("array<string>")) for k in self.label_sets(labels) for df in [self.nodes[k]]]
        return self._united(parts, "_labels", T.ArrayType(T.StringType()), ["_id"])

    def edge_table(self, types: Iterable[str] = ()) -> DataFrame:
        """(_id, _src, _dst, _type, properties) of all edges of the types, or of any type."""
        wanted = list(dict.fromkeys(types)) or list(self.edges)
        parts = [(self.edges[t], F.lit(t)) for t in wanted if t in self.edges]
        return self._united(parts, "_type", T.StringType(), ["_id", "_src", "_dst"])

    def _united(self, parts: list, mark: str, kind: T.DataType, own: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*(T.StructField(c, T.LongType()) for c in own), T.StructField(mark, kind)]))
        kinds: dict[str, list[T.DataType]] = {}
        for df, _ in parts:
            for f in df.schema:
                kinds.setdefault(f.name, []).append(f.dataType)
        target = {c: common(ks) for c, ks in kinds.items() if c not in own}
        out = None
        for df, value in parts:
            cols = [F.col(c).cast("long").alias(c) for c in own] + [value.alias(mark)]
            for c, t in target.items():
                cols.append((F.col(f"`{c}`").cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c))
            part = df.select(*cols)
            out = part if out is None else out.unionAll(part)
        return out

    def node_count(self) -> int:
        return sum(df.count() for df in self.nodes.values())

    def edge_count(self) -> int:
        return sum(df.count() for df in self.edges.values())

    # -- constraints ------------------------------------------------------------------------------------------------

    def violations(self, c: Constraint) -> DataFrame:
        """Rows that say what violates a constraint; none if it holds."""
        df = self.node_table([c.label])
        cols = [F.col(f"`{p}`") if p in df.columns else F.lit(None).cast("string") for p in c.properties]
        missing = cols[0].isNull()
        for x in cols[1:]:
            missing = missing | x.isNull()
        named = [x.alias(p) for x, p in zip(cols, c.properties, strict=True)]
        if c.kind == "not_null":
            return df.filter(missing).select("_id")
        if c.kind == "type":
            kind = df.schema[c.properties[0]].dataType if c.properties[0] in df.columns else T.NullType()
            fits = {"BOOLEAN": T.BooleanType, "STRING": T.StringType, "INTEGER": T.IntegralType, "FLOAT": (T.DoubleType, T.FloatType)}[c.type_name]
            return df.filter(F.lit(False)).select("_id") if isinstance(kind, (fits, T.NullType)) else df.filter(~missing).select("_id")
        repeated = df.filter(~missing).select(*named).groupBy(*[f"`{p}`" for p in c.properties]).count().filter("count > 1").select(F.lit(None).cast("long").alias("_id"))
        return repeated if c.kind == "unique" else repeated.unionAll(df.filter(missing).select("_id"))

    def checked(self, labels: Iterable[str] | None = None) -> PropertyGraph:
        """This graph, if it keeps its constraints (on the labels, if given)."""
        wanted = None if labels is None else set(labels)
        for c in self.constraints:
            if (wanted is None or c.label in wanted) and not self.violations(c).isEmpty():
                raise ConstraintError(f"violated: {c}")
        return self

    def with_constraint(self, c: Constraint) -> PropertyGraph:
        new = replace(self, constraints=(*(x for x in self.constraints if x != c), c))
        if not new.violations(c).isEmpty():
            raise ConstraintError(f"existing data violates: {c}")
        return new
