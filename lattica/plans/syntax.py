"""The abstract syntax of queries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any, Iterator


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))


def _nodes(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for x in value:
            yield from _nodes(x)


def walk(node: Node) -> Iterator[Node]:
    """The node and all below it, without recursion: statements can be long."""
    todo = [node]
    while todo:
        yield (n := todo.pop())
        todo.extend(n.children())


# -- expressions ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Literal(Node):
    value: Any


@dataclass(frozen=True)
class Parameter(Node):
    name: str


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Property(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    base: Node
    at: Node


@dataclass(frozen=True)
class Slice(Node):
    base: Node
    low: Node | None
    high: Node | None


@dataclass(frozen=True)
class Unary(Node):
    op: str
    value: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    value: Node
    negated: bool


@dataclass(frozen=True)
class Case(Node):
    subject: Node | None
    branches: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class MapOf(Node):
    entries: tuple[tuple[Node, Node], ...]


@dataclass(frozen=True)
class MapProjection(Node):
    """Items: ("all",), ("property", name), ("entry", name, expression), ("variable", name)."""

    base: Node
    items: tuple[tuple, ...]


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Comprehension(Node):
    name: str
    source: Node
    where: Node | None
    value: Node | None


@dataclass(frozen=True)
class Quantifier(Node):
    kind: str
    name: str
    source: Node
    where: Node


@dataclass(frozen=True)
class Reduce(Node):
    total: str
    start: Node
    name: str
    source: Node
    body: Node


@dataclass(frozen=True)
class Exists(Node):
    path: PathPattern


@dataclass(frozen=True)
class PatternComprehension(Node):
    path: PathPattern
    where: Node | None
    value: Node


# -- patterns -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NodePattern(Node):
    name: str | None
    labels: tuple[str, ...]
    properties: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class RelPattern(Node):
    """``direction``: out, in or both. ``low`` and ``high`` hold for variable lengths."""

    name: str | None
    types: tuple[str, ...]
    direction: str
    variable_length: bool
    low: int | None
    high: int | None
    properties: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class PathPattern(Node):
    """``shortest``: none, single or all."""

    name: str | None
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    shortest: str | None = None


# -- clauses --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Match(Node):
    """``kind``: plain, optional or mandatory."""

    paths: tuple[PathPattern, ...]
    kind: str
    where: Node | None = None


@dataclass(frozen=True)
class Where(Node):
    value: Node


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str | None


@dataclass(frozen=True)
class SortKey(Node):
    value: Node
    descending: bool


@dataclass(frozen=True)
class Projection(Node):
    """RETURN, or WITH where ``final`` is false. ``star``: items are added to all variables."""

    final: bool
    items: tuple[Item, ...]
    star: bool
    distinct: bool
    order: tuple[SortKey, ...] = ()
    skip: Node | None = None
    limit: Node | None = None
    where: Node | None = None


@dataclass(frozen=True)
class Unwind(Node):
    value: Node
    name: str


@dataclass(frozen=True)
class LoadCsv(Node):
    url: Node
    name: str
    headers: bool
    terminator: Node | None


@dataclass(frozen=True)
class Create(Node):
    paths: tuple[PathPattern, ...]


@dataclass(frozen=True)
class SetItem(Node):
    """``kind``: property, replace, merge or label."""

    kind: str
    name: str
    key: str | None = None
    value: Node | None = None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class SetClause(Node):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove(Node):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete(Node):
    values: tuple[Node, ...]
    detach: bool


@dataclass(frozen=True)
class Merge(Node):
    path: PathPattern
    on_create: tuple[SetItem, ...] = ()
    on_match: tuple[SetItem, ...] = ()


@dataclass(frozen=True)
class Query(Node):
    clauses: tuple[Node, ...]


@dataclass(frozen=True)
class Union(Node):
    """Queries and, between them, whether duplicates stay."""

    queries: tuple[Query, ...]
    keep: tuple[bool, ...]


@dataclass(frozen=True)
class CreateConstraint(Node):
    """``kind``: unique, not_null, node_key or type."""

    label: str
    properties: tuple[str, ...]
    kind: str
    type_name: str | None = None


@dataclass
class Names:
    """Fresh internal names."""

    n: int = 0
    prefix: str = "__"
    used: set[str] = field(default_factory=set)

    def fresh(self, kind: str) -> str:
        self.n += 1
        return f"{self.prefix}{kind}{self.n}"
