import math

import pytest

from lattica.errors import SemanticError, TypeMismatchError
from lattica.graph import PropertyGraph
from lattica.session import GraphSession


@pytest.fixture(scope="module")
def g(spark):
    return GraphSession(PropertyGraph(spark))


VALUES = [
    ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("1.0 / 0", None), ("-7 % 3", -1), ("7.5 % 2", 1.5), ("2 ^ 3", 8.0), ("-2 + 1", -1), ("+3", 3),
    ("9223372036854775807 + 1", None), ("9223372036854775807 * 2", None), ("'a' + 'b'", "ab"), ("'a' + 1", None), ("[1] + [2, 3]", [1, 2, 3]), ("1 + null", None),
    ("1 = 1.0", True), ("1 = 'a'", None), ("1 <> 2", True), ("null = null", None), ("'b' > 'a'", True), ("true < 1", None), ("[1, 2] = [1, 2]", True),
    ("true AND null", None), ("false AND null", False), ("true OR null", True), ("true XOR false", True), ("true XOR null", None), ("NOT null", None), ("1 AND true", None),
    ("1 IN [1, 2]", True), ("3 IN [1, null]", None), ("1 IN [1, null]", True), ("null IN [1]", None), ("1 IN []", False),
    ("'abc' STARTS WITH 'ab'", True), ("'abc' ENDS WITH 'b'", False), ("'abc' CONTAINS 'b'", True), ("1 CONTAINS 'b'", None),
    ("'abc' =~ 'a.c'", True), ("'abcd' =~ 'a.c'", False), ("'a\\n' =~ 'a'", False), ("1 IS NULL", False), ("null IS NULL", True), ("1 IS NOT NULL", True),
    ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE WHEN false THEN 1 ELSE 2.5 END", 2.5), ("CASE null WHEN null THEN 1 ELSE 2 END", 2),
    ("[1, 2, 3][0]", 1), ("[1, 2, 3][-1]", 3), ("[1, 2, 3][9]", None), ("[1, 2, 3][1..]", [2, 3]), ("[1, 2, 3][..-1]", [1, 2]), ("[1, 2, 3][5..9]", []), ("'hello'[1..3]", "el"), ("'hello'[-3..]", "llo"),
    ("[x IN range(1, 5) WHERE x % 2 = 1 | x * 10]", [10, 30, 50]), ("[x IN [1, 2]]", [1, 2]), ("[x IN [[1], [2, 3]] | [y IN x | y + 1]]", [[2], [3, 4]]),
    ("any(x IN [1, 2] WHERE x = 2)", True), ("all(x IN [] WHERE x = 2)", True), ("none(x IN [1, null] WHERE x = 2)", None), ("single(x IN [1, 2, 2] WHERE x = 2)", False), ("single(x IN [1, 2] WHERE x = 2)", True),
    ("reduce(a = 0, x IN [1, 2, 3] | a + x)", 6), ("reduce(a = 0, x IN [1.5, 2] | a + x)", 3.5), ("reduce(a = '', x IN ['p', 'q'] | a + x)", "pq"),
    ("{a: 1, b: {c: 'x'}}.b.c", "x"), ("{a: 1}['a']", 1), ("{a: 1}.zzz", None), ("keys({b: 1, a: 2})", ["a", "b"]), ("$p", 5), ("$nothing", None), ("$m.k", "v"), ("$l[1]", 2),
    ("toString(1.0)", "1.0"), ("toString(100000000.0)", "100000000.0"), ("toString(0.00001)", "0.00001"), ("toString(12)", "12"), ("toString(true)", "true"), ("toString([1])", None),
    ("toInteger('42')", 42), ("toInteger('4.5')", None), ("toInteger(' 42 ')", None), ("toInteger(4.9)", 4), ("toInteger(-4.9)", -4), ("toInteger(true)", None), ("toFloat('1.5')", 1.5), ("toFloat('x')", None), ("toBoolean('TRUE')", True), ("toBoolean('yes')", None),
    ("trim('  \\u2003x \\t')", "x"), ("ltrim(' x ')", "x "), ("rtrim(' x ')", " x"), ("toUpper('ß')", "SS"), ("reverse('abc')", "cba"), ("replace('a.b', '.', '-')", "a-b"), ("substring('hello', 1)", "ello"), ("substring('hello', -2, 2)", "he"),
    ("left('abc', 9)", "abc"), ("right('abc', 2)", "bc"), ("left('abc', -1)", ""), ("split('a||b|', '|')", ["a", "", "b", ""]), ("concat('a', 'b', null)", None), ("size('é😀')", 2), ("size([1, 2])", 2), ("size({a: 1})", None),
    ("regexp_matches('abc', 'b')", False), ("regexp_replace('a1b2', '[0-9]', '#')", "a#b#"), ("regexp_extract('ab12', '[0-9]+')", "12"), ("regexp_extract('ab', '[0-9]+')", None),
    ("abs(-3)", 3), ("abs(-2.5)", 2.5), ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("sign(-4)", -1), ("sqrt(16)", 4.0), ("log(0)", -math.inf), ("exp(0)", 1.0), ("atan2(0, 1)", 0.0), ("haversin(0.0)", 0.0), ("pi()", math.pi), ("e()", math.e),
    ("head([])", None), ("last([1, 2])", 2), ("tail([1, 2])", [2]), ("range(1, 3)", [1, 2, 3]), ("range(3, 1)", []), ("range(3, 1, -1)", [3, 2, 1]), ("range(1, 3, 0)", None),
    ("list_append([1], 2)", [1, 2]), ("list_prepend([1], 0)", [0, 1]), ("list_extract([1, 2], 1)", 1), ("list_extract([1, 2], 0)", None), ("list_contains([1, null], 2)", False), ("list_contains([1, null], null)", True), ("list_sort([2, 1])", [1, 2]), ("list_distinct([1, 1, 2])", [1, 2]), ("list_value(1, 2)", [1, 2]),
    ("toString(date_part('year', date('2024-02-29')))", "2024"), ("date('2024-02-30') IS NULL", True), ("make_date(2024, 13, 1) IS NULL", True), ("date_part('hour', date('2024-01-01'))", None), ("epoch_ms(to_timestamp(1.5))", 1500), ("date_part('second', to_timestamp(61))", 1), ("date_part('epoch', to_timestamp(61))", 61),
    ("date_trunc('month', date('2024-05-17')) = date('2024-05-01')", True), ("coalesce(null, 2, 3)", 2), ("exists(null)", False), ("abs('x')", None), ("size(1, 2)", None), ("contains('abc', 'c')", True), ("starts_with('abc', 'a')", True),
]


@pytest.mark.parametrize("start", range(0, len(VALUES), 30))
def test_values(g, start):
    part = VALUES[start : start + 30]
    text = "RETURN " + ", ".join(f"{e} AS c{k}" for k, (e, _) in enumerate(part))
    row = g.cypher(text, {"p": 5, "m": {"k": "v"}, "l": [1, 2]}).collect()[0]
    for (e, want), got in zip(part, row, strict=True):
        assert got == want and type(got) is type(want), (e, got, want)


def test_map_projection_and_nested_values(g):
    row = g.cypher("WITH {a: 1, b: 'x'} AS m, 7 AS v RETURN m{.a, .zzz, v, w: m.b} AS p, m{.*} AS q").collect()[0]
    assert row.p.asDict() == {"a": 1, "zzz": None, "v": 7, "w": "x"} and row.q.asDict() == {"a": 1, "b": "x"}


def test_errors(g):
    for text, error in [("RETURN nope(1)", SemanticError), ("RETURN x", SemanticError), ("UNWIND 5 AS x RETURN x", TypeMismatchError), ("RETURN 1 AS x LIMIT -1", TypeMismatchError), ("RETURN 1 AS x SKIP 'a'", TypeMismatchError), ("WITH 1 AS a, 2 AS a RETURN a", SemanticError), ("RETURN sum(count(1)) AS x", SemanticError), ("RETURN 1 AS a UNION RETURN 1, 2", SemanticError)]:
        with pytest.raises(error):
            g.cypher(text).collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        g.cypher("UNWIND [0] AS x RETURN 1 / x AS y").collect()


def test_random_values(g):
    rows = g.cypher("UNWIND range(1, 20) AS i RETURN rand() AS r, randomUUID() AS u").collect()
    assert all(0 <= r.r < 1 for r in rows) and len({r.u for r in rows}) == 20


def test_unwind_and_rows_in_order(g):
    assert [r.x for r in g.cypher("UNWIND [3, 1, null, 2] AS x RETURN x ORDER BY x").collect()] == [1, 2, 3, None]
    assert [r.x for r in g.cypher("UNWIND [3, 1, null, 2] AS x RETURN x ORDER BY x DESC LIMIT 2").collect()] == [None, 3]
    assert g.cypher("UNWIND null AS x RETURN x").collect() == [] and g.cypher("UNWIND [] AS x RETURN x").collect() == []
    assert [tuple(r) for r in g.cypher("UNWIND [1, 2] AS a UNWIND ['x', 'y'] AS b RETURN a, b ORDER BY a DESC, b").collect()] == [(2, "x"), (2, "y"), (1, "x"), (1, "y")]


def test_grouping(g):
    rows = g.cypher("UNWIND [1, 2, 2, null] AS x RETURN count(*) AS n, count(x) AS c, count(DISTINCT x) AS d, sum(x) AS s, avg(x) AS a, min(x) AS lo, max(x) AS hi, collect(x) AS l, stdev(x) AS sd, percentileDisc(x, 0.5) AS pd, percentileCont(x, 0.25) AS pc").collect()
    assert tuple(rows[0])[:7] == (4, 3, 2, 5, 5 / 3, 1, 2) and sorted(rows[0].l) == [1, 2, 2] and rows[0].pd == 2 and rows[0].pc == 1.5 and abs(rows[0].sd - 3**-0.5) < 1e-9
    empty = g.cypher("UNWIND [] AS x RETURN count(*) AS n, sum(x) AS s, avg(x) AS a, collect(x) AS l").collect()
    assert tuple(empty[0]) == (0, 0, None, [])
    assert [tuple(r) for r in g.cypher("UNWIND [1, 2, 3] AS x WITH x % 2 AS odd, sum(x) AS s WHERE s > 2 RETURN odd, s * 2 AS t, odd + s AS u ORDER BY odd").collect()] == [(1, 8, 5)]


def test_column_names(g):
    assert g.cypher("WITH {a: 1} AS m RETURN m, m.a, size([1]), size([2]), 1 + 1").columns == ["m", "m.a", "size(..)", "size(..)", "?column?"]
