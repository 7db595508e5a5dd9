import pytest

from lattica.errors import ParseError
from lattica.plans import syntax as s
from lattica.plans.parser import parse


def expression(text):
    return parse(f"RETURN {text} AS x").queries[0].clauses[0].items[0].value


def test_precedence():
    assert expression("1 + 2 * 3 ^ 2") == s.Binary("+", s.Literal(1), s.Binary("*", s.Literal(2), s.Binary("^", s.Literal(3), s.Literal(2))))
    assert expression("NOT a OR b AND c XOR d") == s.Binary("OR", s.Unary("NOT", s.Variable("a")), s.Binary("XOR", s.Binary("AND", s.Variable("b"), s.Variable("c")), s.Variable("d")))
    assert expression("2 ^ 3 ^ 2").right == s.Binary("^", s.Literal(3), s.Literal(2))


def test_literals():
    assert expression("0x1F") == s.Literal(31) and expression("0o17") == s.Literal(15) and expression("1.5e3") == s.Literal(1500.0)
    assert expression(r"'a\'b\nA'") == s.Literal("a'b\nA") and expression('"x"') == s.Literal("x")
    assert expression("-9223372036854775808") == s.Literal(-(1 << 63))
    assert expression("{a: 1, 'b c': [1, null]}") == s.MapOf(((s.Literal("a"), s.Literal(1)), (s.Literal("b c"), s.ListOf((s.Literal(1), s.Literal(None))))))


def test_patterns():
    p = parse("MATCH p = (a:X:Y {k: 1})-[r:S|:T*2..5 {w: 2}]->(b)<--()--(c) RETURN p").queries[0].clauses[0].paths[0]
    assert p.name == "p" and p.nodes[0].labels == ("X", "Y") and [r.direction for r in p.rels] == ["out", "in", "both"]
    assert (p.rels[0].types, p.rels[0].low, p.rels[0].high, p.rels[0].variable_length) == (("S", "T"), 2, 5, True)
    ranges = {"*": (None, None), "*3": (3, 3), "*3..": (3, None), "*..3": (None, 3)}
    for text, (low, high) in ranges.items():
        r = parse(f"MATCH (a)-[{text}]->(b) RETURN a").queries[0].clauses[0].paths[0].rels[0]
        assert (r.low, r.high) == (low, high)
    assert parse("MATCH (a)<-->(b) RETURN a").queries[0].clauses[0].paths[0].rels[0].direction == "both"


def test_lists():
    assert isinstance(expression("[x IN xs WHERE x > 1 | x]"), s.Comprehension)
    assert isinstance(expression("[(a)-->(b) WHERE b.x = 1 | b.x]"), s.PatternComprehension)
    assert expression("[(1), 2]") == s.ListOf((s.Literal(1), s.Literal(2)))
    assert expression("xs[1..]") == s.Slice(s.Variable("xs"), s.Literal(1), None)


def test_comments_and_case():
    q = parse("match (a) // one\n /* two\n three */ return a.x as x order by x desc skip 1 limit 2;")
    assert q.queries[0].clauses[1].order[0].descending and len(q.queries) == 1


@pytest.mark.parametrize("text", ["", "MATCH (a", "RETURN", "RETURN 1 AS", "MATCH (a) RETURN a MATCH (b) RETURN b", "RETURN 1 < 2 < 3", "RETURN __x", "RETURN 'a", "CREATE CONSTRAINT FOR (n:L) REQUIRE n.a IS NODE KEY", "RETURN 99999999999999999999", "RETURN match", r"RETURN '\q'"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_long_statements_parse():
    text = "MATCH " + ", ".join(f"(a{k}:X {{k: {k}}})" for k in range(1000)) + " RETURN a0"
    assert len(parse(text).queries[0].clauses[0].paths) == 1000
    chain = " AND ".join(f"x <> {k}" for k in range(300))
    assert isinstance(expression(chain), s.Binary)
