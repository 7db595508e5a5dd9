"""Tokens to abstract syntax: recursive descent, one function per level of precedence."""

from __future__ import annotations

from functools import lru_cache

from ..errors import ParseError
from . import syntax as s
from .lexer import Token, tokenise, unquoted

#: Words that name nothing.
RESERVED = frozenset(
    "match optional create return where order by skip limit and or not xor null true false as asc ascending desc descending distinct is in starts ends contains"
    " case when then else end with unwind set remove delete detach merge on mandatory reduce any all none single union constraint require unique".split()
)
COMPARISONS = frozenset(["=", "<>", "<", "<=", ">", ">=", "=~"])


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenise(text), 0

    # -- tokens -----------------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, ahead: int = 1) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def fail(self, wanted: str) -> ParseError:
        t = self.now
        return ParseError(f"expected {wanted}, found {t.text or 'the end'!r} at {t.at}")

    def op(self, *texts: str) -> str | None:
        if self.now.kind == "op" and self.now.text in texts:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def need(self, text: str) -> None:
        if not self.op(text):
            raise self.fail(repr(text))

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead) if ahead else self.now
        return t.kind == "name" and t.text.lower() in words

    def word(self, *words: str) -> bool:
        """Takes the words, one after the other, or none."""
        for k, w in enumerate(words):
            if not self.is_word(w, ahead=k):
                return False
        self.at += len(words)
        return True

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fail(" ".join(words).upper())

    def name(self, what: str = "a name", free: bool = False) -> str:
        t = self.now
        if t.kind != "name" or (not free and t.text.lower() in RESERVED):
            raise self.fail(what)
        if t.text.startswith("__"):
            raise ParseError(f"names don't start with two underscores: {t.text} at {t.at}")
        self.at += 1
        return t.text

    # -- statements -------------------------------------------------------------------------------------------------

    def statement(self) -> s.Union | s.CreateConstraint:
        if self.is_word("create") and self.is_word("constraint", ahead=1):
            out = self.constraint()
        else:
            queries, keep = [self.query()], []
            while self.word("union"):
                keep.append(self.word("all"))
                queries.append(self.query())
            out = s.Union(tuple(queries), tuple(keep))
        self.op(";")
        if self.now.kind != "end":
            raise self.fail("the end of the query")
        return out

    def constraint(self) -> s.CreateConstraint:
        self.need_word("create", "constraint")
        self.need_word("for")
        self.need("(")
        var = self.name()
        self.need(":")
        label = self.name()
        self.need(")")
        self.need_word("require")

        def one() -> str:
            if self.name() != var:
                raise ParseError("a constraint speaks of its own variable only")
            self.need(".")
            return self.name(free=True)

        if self.op("("):
            names = [one()]
            while self.op(","):
                names.append(one())
            self.need(")")
            self.need_word("is", "node", "key")
            return s.CreateConstraint(label, tuple(names), "node_key")
        name = one()
        self.need_word("is")
        if self.word("unique"):
            return s.CreateConstraint(label, (name,), "unique")
        if self.word("not", "null"):
            return s.CreateConstraint(label, (name,), "not_null")
        self.need("::")
        kind = self.name("a type").upper()
        if kind not in ("BOOLEAN", "STRING", "INTEGER", "FLOAT"):
            raise ParseError(f"unknown property type {kind}")
        return s.CreateConstraint(label, (name,), "type", kind)

    def query(self) -> s.Query:
        clauses: list[s.Node] = []
        while True:
            clause = self.clause()
            if clause is None:
                break
            if isinstance(clause, s.Where) and clauses and isinstance(clauses[-1], s.Match) and clauses[-1].where is None:
                m = clauses[-1]
                clauses[-1] = s.Match(m.paths, m.kind, clause.value)
            else:
                clauses.append(clause)
        if not clauses:
            raise self.fail("a clause")
        for k, c in enumerate(clauses):
            if isinstance(c, s.Projection) and c.final and k < len(clauses) - 1:
                raise ParseError("RETURN ends a query")
        return s.Query(tuple(clauses))

    def clause(self) -> s.Node | None:
        if self.word("optional", "match"):
            return s.Match(self.paths(), "optional")
        if self.word("mandatory", "match"):
            return s.Match(self.paths(), "mandatory")
        if self.word("match"):
            return s.Match(self.paths(), "plain")
        if self.word("where"):
            return s.Where(self.expression())
        if self.word("return"):
            return self.projection(True)
        if self.word("with"):
            return self.projection(False)
        if self.word("unwind"):
            value = self.expression()
            self.need_word("as")
            return s.Unwind(value, self.name())
        if self.is_word("load") and self.is_word("csv", ahead=1):
            self.at += 2
            headers = self.word("with", "headers")
            self.need_word("from")
            url = self.expression()
            self.need_word("as")
            name = self.name()
            return s.LoadCsv(url, name, headers, self.expression() if self.word("fieldterminator") else None)
        if self.word("create"):
            return s.Create(self.paths())
        if self.word("merge"):
            path, actions = self.plain_path(), {"create": (), "match": ()}
            while self.is_word("on") and self.is_word("create", "match", ahead=1):
                kind = self.peek().text.lower()
                self.at += 2
                self.need_word("set")
                actions[kind] = self.set_items()
            return s.Merge(path, actions["create"], actions["match"])
        if self.word("set"):
            return s.SetClause(self.set_items())
        if self.word("remove"):
            items = [self.remove_item()]
            while self.op(","):
                items.append(self.remove_item())
            return s.Remove(tuple(items))
        if self.is_word("delete") or self.is_word("detach") and self.is_word("delete", ahead=1):
            detach = self.word("detach")
            self.need_word("delete")
            return s.Delete(self.expressions(), detach)
        return None

    def projection(self, final: bool) -> s.Projection:
        distinct = self.word("distinct")
        items, star = [], bool(self.op("*"))
        if not star or self.op(","):
            while True:
                value = self.expression()
                items.append(s.Item(value, self.name("an alias") if self.word("as") else None))
                if not self.op(","):
                    break
        order: list[s.SortKey] = []
        if self.word("order", "by"):
            while True:
                value = self.expression()
                down = self.word("descending") or self.word("desc")
                if not down:
                    self.word("ascending") or self.word("asc")
                order.append(s.SortKey(value, down))
                if not self.op(","):
                    break
        skip = self.expression() if self.word("skip") else None
        limit = self.expression() if self.word("limit") else None
        where = self.expression() if not final and self.word("where") else None
        return s.Projection(final, tuple(items), star, distinct, tuple(order), skip, limit, where)

    def set_items(self) -> tuple[s.SetItem, ...]:
        out = []
        while True:
            name = self.name()
            if self.op("."):
                key = self.name(free=True)
                self.need("=")
                out.append(s.SetItem("property", name, key, self.expression()))
            elif self.op("+="):
                out.append(s.SetItem("merge", name, value=self.expression()))
            elif self.op("="):
                out.append(s.SetItem("replace", name, value=self.expression()))
            else:
                out.append(s.SetItem("label", name, labels=self.labels(True)))
            if not self.op(","):
                return tuple(out)

    def remove_item(self) -> s.SetItem:
        name = self.name()
        if self.op("."):
            return s.SetItem("property", name, self.name(free=True))
        return s.SetItem("label", name, labels=self.labels(True))

    # -- patterns ---------------------------------------------------------------------------------------------------

    def paths(self) -> tuple[s.PathPattern, ...]:
        out = [self.path()]
        while self.op(","):
            out.append(self.path())
        return tuple(out)

    def path(self) -> s.PathPattern:
        name = None
        if self.now.kind == "name" and self.peek().text == "=" and self.now.text.lower() not in RESERVED:
            name = self.name()
            self.need("=")
        kind = {"shortestpath": "single", "allshortestpaths": "all"}.get(self.now.text.lower()) if self.now.kind == "name" and self.peek().text == "(" else None
        if kind:
            self.at += 1
            self.need("(")
        got = self.plain_path()
        if kind:
            self.need(")")
        return s.PathPattern(name, got.nodes, got.rels, kind)

    def plain_path(self) -> s.PathPattern:
        nodes, rels = [self.node()], []
        while self.now.kind == "op" and (self.now.text == "-" or self.now.text == "<" and self.peek().text == "-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return s.PathPattern(None, tuple(nodes), tuple(rels))

    def node(self) -> s.NodePattern:
        self.need("(")
        name = self.name() if self.now.kind == "name" else None
        labels, properties = self.labels(), self.properties()
        self.need(")")
        return s.NodePattern(name, labels, properties)

    def labels(self, needed: bool = False) -> tuple[str, ...]:
        out = []
        while self.op(":"):
            out.append(self.name("a label", free=True))
        if needed and not out:
            raise self.fail("a label")
        return tuple(out)

    def properties(self) -> tuple[tuple[str, s.Node], ...]:
        out: list[tuple[str, s.Node]] = []
        if self.op("{") and not self.op("}"):
            while True:
                key = self.name("a property", free=True)
                self.need(":")
                out.append((key, self.expression()))
                if not self.op(","):
                    break
            self.need("}")
        return tuple(out)

    def rel(self) -> s.RelPattern:
        left = bool(self.op("<"))
        self.need("-")
        name, types, properties, variable, low, high = None, [], (), False, None, None
        if self.op("["):
            if self.now.kind == "name":
                name = self.name()
            if self.op(":"):
                types.append(self.name("a type", free=True))
                while self.op("|"):
                    self.op(":")
                    types.append(self.name("a type", free=True))
            if self.op("*"):
                variable = True
                low = self.whole()
                if self.op(".."):
                    high = self.whole()
                else:
                    high = low
            properties = self.properties()
            self.need("]")
        self.need("-")
        right = bool(self.op(">"))
        direction = "both" if left == right else "in" if left else "out"
        return s.RelPattern(name, tuple(types), direction, variable, low, high, properties)

    def whole(self) -> int | None:
        if self.now.kind == "int":
            self.at += 1
            return int(self.tokens[self.at - 1].text, 0)
        return None

    # -- expressions ------------------------------------------------------------------------------------------------

    def expressions(self) -> tuple[s.Node, ...]:
        out = [self.expression()]
        while self.op(","):
            out.append(self.expression())
        return tuple(out)

    def expression(self) -> s.Node:
        out = self.xor()
        while self.word("or"):
            out = s.Binary("OR", out, self.xor())
        return out

    def xor(self) -> s.Node:
        out = self.conjunction()
        while self.word("xor"):
            out = s.Binary("XOR", out, self.conjunction())
        return out

    def conjunction(self) -> s.Node:
        out = self.negation()
        while self.word("and"):
            out = s.Binary("AND", out, self.negation())
        return out

    def negation(self) -> s.Node:
        n = 0
        while self.word("not"):
            n += 1
        out = self.comparison()
        for _ in range(n):
            out = s.Unary("NOT", out)
        return out

    def comparison(self) -> s.Node:
        out = self.predicate()
        if self.now.kind == "op" and self.now.text in COMPARISONS:
            out = s.Binary(self.op(*COMPARISONS), out, self.predicate())
            if self.now.kind == "op" and self.now.text in COMPARISONS:
                raise ParseError(f"comparisons don't chain: put parentheses or AND, at {self.now.at}")
        return out

    def predicate(self) -> s.Node:
        out = self.sum()
        for words, op in ((("starts", "with"), "STARTS WITH"), (("ends", "with"), "ENDS WITH"), (("contains",), "CONTAINS"), (("in",), "IN")):
            if self.word(*words):
                return s.Binary(op, out, self.sum())
        return out

    def sum(self) -> s.Node:
        out = self.product()
        while op := self.op("+", "-"):
            out = s.Binary(op, out, self.product())
        return out

    def product(self) -> s.Node:
        out = self.power()
        while op := self.op("*", "/", "%"):
            out = s.Binary(op, out, self.power())
        return out

    def power(self) -> s.Node:
        out = self.signed()
        return s.Binary("^", out, self.power()) if self.op("^") else out

    def signed(self) -> s.Node:
        if self.op("-"):
            if self.now.kind in ("int", "float") and self.now.text != "end":
                if self.now.kind == "int" and int(self.now.text, 0) == 1 << 63:
                    self.at += 1
                    return s.Literal(-(1 << 63))
            return s.Unary("-", self.signed())
        if self.op("+"):
            return s.Unary("+", self.signed())
        return self.postfix()

    def postfix(self) -> s.Node:
        out = self.atom()
        while True:
            if self.op("."):
                out = s.Property(out, self.name("a property", free=True))
            elif self.op("["):
                if self.op(".."):
                    high = None if self.now.text == "]" else self.expression()
                    out = s.Slice(out, None, high)
                else:
                    at = self.expression()
                    if self.op(".."):
                        high = None if self.now.text == "]" else self.expression()
                        out = s.Slice(out, at, high)
                    else:
                        out = s.Index(out, at)
                self.need("]")
            elif self.now.text == "{" and isinstance(out, (s.Variable, s.Property, s.Index, s.Call)):
                out = self.map_projection(out)
            else:
                break
        if self.is_word("is") and (self.is_word("null", ahead=1) or self.is_word("not", ahead=1) and self.is_word("null", ahead=2)):
            self.at += 1
            negated = self.word("not")
            self.need_word("null")
            out = s.IsNull(out, negated)
        return out

    def map_projection(self, base: s.Node) -> s.Node:
        self.need("{")
        items: list[tuple] = []
        while not self.op("}"):
            if items:
                self.need(",")
            if self.op("."):
                items.append(("all",) if self.op("*") else ("property", self.name(free=True)))
            else:
                name = self.name(free=True)
                items.append(("entry", name, self.expression()) if self.op(":") else ("variable", name))
        return s.MapProjection(base, tuple(items))

    def atom(self) -> s.Node:
        t = self.now
        if t.kind == "int":
            self.at += 1
            value = int(t.text, 0) if t.text[:2] in ("0x", "0o") else int(t.text)
            if value >= 1 << 63:
                raise ParseError(f"the integer {t.text} is too large")
            return s.Literal(value)
        if t.kind == "float":
            self.at += 1
            return s.Literal(float(t.text))
        if t.kind == "string":
            self.at += 1
            return s.Literal(unquoted(t.text, t.at))
        if self.op("$"):
            return s.Parameter(self.name("a parameter", free=True))
        if self.op("("):
            out = self.expression()
            self.need(")")
            return out
        if self.now.text == "[":
            return self.list_atom()
        if self.op("{"):
            entries: list[tuple[s.Node, s.Node]] = []
            while not self.op("}"):
                if entries:
                    self.need(",")
                if self.now.kind == "string":
                    key: s.Node = s.Literal(unquoted(self.now.text, self.now.at))
                    self.at += 1
                elif self.op("$"):
                    key = s.Parameter(self.name(free=True))
                else:
                    key = s.Literal(self.name("a key", free=True))
                self.need(":")
                entries.append((key, self.expression()))
            return s.MapOf(tuple(entries))
        if t.kind != "name":
            raise self.fail("an expression")
        low, call = t.text.lower(), self.peek().text == "("
        for word, value in (("true", True), ("false", False), ("null", None)):
            if self.word(word):
                return s.Literal(value)
        if low == "case":
            return self.case()
        if low == "exists" and self.peek().text == "{":
            self.at += 2
            path = self.plain_path()
            self.need("}")
            return s.Exists(path)
        if low in ("any", "all", "none", "single") and call:
            self.at += 2
            name = self.name()
            self.need_word("in")
            source = self.expression()
            self.need_word("where")
            where = self.expression()
            self.need(")")
            return s.Quantifier(low, name, source, where)
        if low == "reduce" and call:
            self.at += 2
            total = self.name()
            self.need("=")
            start = self.expression()
            self.need(",")
            name = self.name()
            self.need_word("in")
            source = self.expression()
            self.need("|")
            body = self.expression()
            self.need(")")
            return s.Reduce(total, start, name, source, body)
        if call:
            name = self.name("a function", free=low == "contains")
            self.need("(")
            distinct = self.word("distinct")
            if self.op("*"):
                self.need(")")
                return s.Call(name.lower(), (), distinct, True)
            args = () if self.now.text == ")" else self.expressions()
            self.need(")")
            return s.Call(name.lower(), args, distinct, name.lower() == "count" and not args)
        return s.Variable(self.name("an expression"))

    def case(self) -> s.Node:
        self.need_word("case")
        subject = None if self.is_word("when") else self.expression()
        branches = []
        while self.word("when"):
            when = self.expression()
            self.need_word("then")
            branches.append((when, self.expression()))
        if not branches:
            raise self.fail("WHEN")
        default = self.expression() if self.word("else") else None
        self.need_word("end")
        return s.Case(subject, tuple(branches), default)

    def list_atom(self) -> s.Node:
        self.need("[")
        if self.op("]"):
            return s.ListOf(())
        if self.now.text == "(":
            mark = self.at
            try:
                path = self.plain_path()
                where = self.expression() if self.word("where") else None
                if not self.op("|"):
                    raise self.fail("'|'")
                value = self.expression()
                self.need("]")
                return s.PatternComprehension(path, where, value)
            except ParseError:
                self.at = mark
        if self.now.kind == "name" and self.is_word("in", ahead=1) and self.now.text.lower() not in RESERVED:
            name = self.name()
            self.need_word("in")
            source = self.expression()
            where = self.expression() if self.word("where") else None
            value = self.expression() if self.op("|") else None
            self.need("]")
            return s.Comprehension(name, source, where, value)
        items = self.expressions()
        self.need("]")
        return s.ListOf(items)


@lru_cache(maxsize=1024)
def parse(text: str) -> s.Union | s.CreateConstraint:
    """The statement of a text; texts seen lately aren't parsed again."""
    return Parser(text).statement()
