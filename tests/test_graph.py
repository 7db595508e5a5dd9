import pytest

from lattica.errors import ConstraintError, NotImplementedFeature, QueryRuntimeError, SemanticError, TypeMismatchError
from lattica.graph import PropertyGraph
from lattica.session import GraphSession


def rows(df):
    return [tuple(r) for r in df.collect()]


def graph(spark, nodes, edges):
    """nodes: label -> [(id, props)]; edges: type -> [(src, dst, props)]."""
    tables = {}
    for label, items in nodes.items():
        names = sorted({k for _, p in items for k in p})
        kinds = {k: next(type(p[k]) for _, p in items if p.get(k) is not None) for k in names}
        ddl = ", ".join(["_id long", *(f"`{k}` { {int: 'long', str: 'string', bool: 'boolean', float: 'double'}[kinds[k]]}" for k in names)])
        tables[label] = spark.createDataFrame([(i, *(p.get(k) for k in names)) for i, p in items], ddl)
    links, n = {}, 0
    for kind, items in edges.items():
        names = sorted({k for *_, p in items for k in p})
        ddl = ", ".join(["_id long, _src long, _dst long", *(f"`{k}` { {int: 'long', str: 'string', bool: 'boolean'}[type(items[0][2][k])]}" for k in names)])
        links[kind] = spark.createDataFrame([(n + k, a, b, *(p.get(x) for x in names)) for k, (a, b, p) in enumerate(items)], ddl)
        n += len(items)
    return GraphSession(PropertyGraph.from_dataframes(spark, tables, links, next_node=1000, next_edge=1000))


@pytest.fixture(scope="module")
def people(spark):
    return graph(
        spark,
        {"Person": [(0, {"name": "Alice", "age": 30}), (1, {"name": "Bob", "age": 25}), (2, {"name": "Carol"})], "Car": [(3, {"model": "Tesla", "year": 2020})]},
        {"KNOWS": [(0, 1, {"since": 1}), (1, 2, {"since": 2})], "OWNS": [(1, 3, {"primary": True})]},
    )


def test_directions_types_and_labels(people):
    q = people.cypher
    assert rows(q("MATCH (a {name: 'Bob'})-->(b) RETURN labels(b)[0] AS l ORDER BY l")) == [("Car",), ("Person",)]
    assert rows(q("MATCH (a {name: 'Bob'})<--(b) RETURN b.name AS n")) == [("Alice",)]
    assert rows(q("MATCH (a {name: 'Bob'})--(b:Person) RETURN b.name AS n ORDER BY n")) == [("Alice",), ("Carol",)]
    assert rows(q("MATCH (a)-[r:KNOWS|OWNS]->(b) RETURN type(r) AS t, count(*) AS c ORDER BY t")) == [("KNOWS", 2), ("OWNS", 1)]
    assert rows(q("MATCH (a)-[r {since: 2}]->(b) RETURN a.name AS n")) == [("Bob",)]
    assert rows(q("MATCH (n:Nobody) RETURN n")) == [] and rows(q("MATCH (a)-[:NOTHING]->(b) RETURN a")) == []


def test_shared_variables_join(people):
    q = people.cypher
    assert rows(q("MATCH (a:Person)-[:KNOWS]->(b), (b)-[:OWNS]->(c) RETURN a.name AS a, c.model AS c")) == [("Alice", "Tesla")]
    assert rows(q("MATCH (a:Person {name: 'Alice'}) MATCH (a)-[:KNOWS]->(b) RETURN b.name AS b")) == [("Bob",)]
    assert rows(q("MATCH (a)-[r:KNOWS]->(b) MATCH (x)-[r]->(y) RETURN count(*) AS c")) == [(2,)]
    assert rows(q("MATCH (a:Person)-->(b)-->(a) RETURN a")) == []
    assert rows(q("MATCH (a:Person), (b:Person) WHERE a.age > b.age RETURN a.name AS a, b.name AS b")) == [("Alice", "Bob")]


def test_optional_and_mandatory(people):
    q = people.cypher
    assert rows(q("MATCH (a:Person) OPTIONAL MATCH (a)-[:OWNS]->(c:Car) WHERE c.year > 2000 RETURN a.name AS n, c.model AS m ORDER BY n")) == [("Alice", None), ("Bob", "Tesla"), ("Carol", None)]
    assert rows(q("MATCH (a:Person) OPTIONAL MATCH (a)-[:OWNS]->(c:Car) WHERE c.year > a.age + 2000 RETURN a.name AS n, c IS NULL AS m ORDER BY n")) == [("Alice", True), ("Bob", True), ("Carol", True)]
    assert rows(q("OPTIONAL MATCH (x:Nobody) RETURN x")) == [(None,)]
    assert rows(q("OPTIONAL MATCH (x:Nobody) OPTIONAL MATCH (x)-->(y) RETURN x, y")) == [(None, None)]
    with pytest.raises(QueryRuntimeError):
        q("MANDATORY MATCH (x:Nobody) RETURN x")
    assert rows(q("MANDATORY MATCH (x:Car) WHERE x.year = 1 RETURN x")) == []


def test_exists_and_comprehensions(people):
    q = people.cypher
    assert rows(q("MATCH (a:Person) WHERE EXISTS { (a)-[:OWNS {primary: true}]->(:Car) } RETURN a.name AS n")) == [("Bob",)]
    assert rows(q("MATCH (a:Person) WHERE NOT EXISTS { (a)-[:KNOWS]->(b)-[:KNOWS]->(c) } RETURN a.name AS n ORDER BY n")) == [("Bob",), ("Carol",)]
    assert rows(q("MATCH (a:Person) WHERE a.age = 30 OR EXISTS { (a)-[:OWNS]->() } RETURN a.name AS n ORDER BY n")) == [("Alice",), ("Bob",)]
    assert rows(q("MATCH (a:Person) RETURN a.name AS n, [(a)-[r]->(b) | type(r)] AS ts ORDER BY n"))[0] == ("Alice", ["KNOWS"])
    assert rows(q("MATCH (a:Person) RETURN a.name AS n, [(a)-->(b:Car) WHERE b.year > a.age | b.model + a.name] AS ts ORDER BY n")) == [("Alice", []), ("Bob", ["TeslaBob"]), ("Carol", [])]
    with pytest.raises(NotImplementedFeature):
        q("MATCH (a) WHERE EXISTS { (a)-[*]->(b) } RETURN a")


def test_paths(people):
    q = people.cypher
    assert rows(q("MATCH p = (a:Person)-[:KNOWS*]->(b) RETURN a.name AS a, length(p) AS l, [n IN nodes(p) | n.name] AS ns ORDER BY a, l")) == [("Alice", 1, ["Alice", "Bob"]), ("Alice", 2, ["Alice", "Bob", "Carol"]), ("Bob", 1, ["Bob", "Carol"])]
    assert rows(q("MATCH p = (a)<-[:KNOWS*]-(b {name: 'Alice'}) RETURN [n IN nodes(p) | n.name] AS ns, [r IN relationships(p) | r.since] AS s ORDER BY size(ns)")) == [(["Bob", "Alice"], [1]), (["Carol", "Bob", "Alice"], [2, 1])]
    assert rows(q("MATCH (a {name: 'Alice'})-[r:KNOWS*0..]->(b) RETURN b.name AS b, size(r) AS n ORDER BY n")) == [("Alice", 0), ("Bob", 1), ("Carol", 2)]
    assert rows(q("MATCH (a {name: 'Alice'})-[:KNOWS*2]-(b) RETURN b.name AS b")) == [("Carol",)]
    assert rows(q("MATCH (a {name: 'Carol'})-[:KNOWS*1..4 {since: 2}]-(b) RETURN b.name AS b")) == [("Bob",)]
    assert rows(q("MATCH p = (a:Person)-[:KNOWS]->(b)-[:OWNS]->(c) RETURN length(p) AS l, size(nodes(p)) AS n, [r IN rels(p) | type(r)] AS t")) == [(2, 3, ["KNOWS", "OWNS"])]
    assert rows(q("MATCH ()-[r:OWNS]->() RETURN startNode(r).name AS s, endNode(r).model AS e, id(r) >= 0 AS i")) == [("Bob", "Tesla", True)]


def test_shortest_paths(spark):
    g = graph(spark, {"D": [(k, {"n": x}) for k, x in enumerate("ABCDE")]}, {"E": [(0, 1, {"w": 1}), (1, 3, {"w": 1}), (0, 2, {"w": 1}), (2, 3, {"w": 1}), (3, 3, {"w": 1})]})
    q = g.cypher
    assert rows(q("MATCH p = shortestPath((a {n: 'A'})-[:E*]->(b {n: 'D'})) RETURN length(p) AS l, nodes(p)[0].n AS f, nodes(p)[-1].n AS t")) == [(2, "A", "D")]
    assert sorted(rows(q("MATCH p = allShortestPaths((a {n: 'A'})-[:E*..5]->(b {n: 'D'})) RETURN nodes(p)[1].n AS m, size(relationships(p)) AS l"))) == [("B", 2), ("C", 2)]
    assert rows(q("MATCH p = shortestPath((a {n: 'A'})-[:E*]->(b {n: 'E'})) RETURN p")) == []
    assert rows(q("MATCH p = shortestPath((a {n: 'A'})-[:E*0..]->(b {n: 'A'})) RETURN length(p) AS l")) == [(0,)]
    assert rows(q("MATCH (a {n: 'D'}), (b {n: 'A'}) MATCH p = shortestPath((a)-[:E*]-(b)) RETURN length(p) AS l")) == [(2,)]
    assert rows(q("MATCH (a {n: 'D'})-[:E]-(b) RETURN b.n AS n ORDER BY n")) == [("B",), ("C",), ("D",)]
    with pytest.raises(SemanticError):
        q("MATCH p = shortestPath((a)-[:E]->(b)) RETURN p")


def test_paths_tell_relationships_of_different_types_apart(spark):
    tables = {"D": spark.createDataFrame([(k,) for k in range(3)], "_id long")}
    links = {t: spark.createDataFrame([(7, a, a + 1)], "_id long, _src long, _dst long") for a, t in enumerate("EF")}  # one id, two types
    q = GraphSession(PropertyGraph.from_dataframes(spark, tables, links), relationship_uniqueness=True).cypher
    for kind in ("shortestPath", "allShortestPaths"):
        for types in (":E|F", ""):
            assert rows(q(f"MATCH p = {kind}((a)-[{types}*..2]->(b)) WHERE id(a) = 0 AND id(b) = 2 RETURN length(p) AS l, [r IN relationships(p) | type(r)] AS t")) == [(2, ["E", "F"])]
    assert rows(q("MATCH p = (a)-[:E|F*2]->(b) RETURN id(a) AS a, id(b) AS b, length(p) AS l")) == [(0, 2, 2)]
    assert rows(q("MATCH (a)-[r*5..]-(b) RETURN id(a) AS a")) == []
    assert rows(q("MATCH (a)-[:E]->()-[:F]->(b) RETURN id(a) AS a, id(b) AS b")) == [(0, 2)]


def test_all_shortest_paths_to_open_ends_over_types_numbered_alike(spark):
    """Both directions and ends that aren't bound, as all_shortest_paths has them; every F edge has its E edge's number."""
    tables = {"R": spark.createDataFrame([(0,)], "_id long"), "N": spark.createDataFrame([(10,), (11,)], "_id long"), "S": spark.createDataFrame([(k,) for k in range(20, 24)], "_id long")}
    links = {"E": spark.createDataFrame([(1, 10, 0), (2, 11, 0)], "_id long, _src long, _dst long"), "F": spark.createDataFrame([(1, 20, 10), (2, 21, 11), (3, 22, 10), (4, 22, 11)], "_id long, _src long, _dst long")}
    q = GraphSession(PropertyGraph.from_dataframes(spark, tables, links)).cypher
    got = rows(q("MATCH p = allShortestPaths((a:R)-[:E|F*..3]-(b:S)) RETURN id(b) AS b, [n IN nodes(p) | id(n)] AS n, length(p) AS l"))
    assert sorted(got) == [(20, [0, 10, 20], 2), (21, [0, 11, 21], 2), (22, [0, 10, 22], 2), (22, [0, 11, 22], 2)]


def test_shortest_paths_beyond_the_default_bound(spark, monkeypatch):
    from lattica.operators import paths

    monkeypatch.setattr(paths, "MOST_HOPS", 3)
    q = graph(spark, {"D": [(k, {"n": k}) for k in range(7)]}, {"E": [(k, k + 1, {"w": 1}) for k in range(6)]}).cypher
    for kind in ("shortestPath", "allShortestPaths"):
        assert rows(q(f"MATCH p = {kind}((a {{n: 0}})-[:E*..5]->(b {{n: 5}})) RETURN length(p) AS l")) == [(5,)]
        assert rows(q(f"MATCH p = {kind}((a {{n: 0}})-[:E*..5]->(b {{n: 6}})) RETURN length(p) AS l")) == []
        assert rows(q(f"MATCH p = {kind}((a {{n: 0}})-[:E*]->(b {{n: 3}})) RETURN length(p) AS l")) == [(3,)]
        with pytest.raises(QueryRuntimeError):
            q(f"MATCH p = {kind}((a {{n: 0}})-[:E*]->(b {{n: 4}})) RETURN length(p) AS l")


def test_relationship_uniqueness_is_an_option(spark):
    g = graph(spark, {"D": [(0, {"n": "A"}), (1, {"n": "B"})]}, {"E": [(0, 1, {"w": 1})]})
    assert rows(g.cypher("MATCH (a)-[:E]-(b)-[:E]-(c) RETURN count(*) AS c")) == [(2,)]
    assert rows(GraphSession(g.graph, relationship_uniqueness=True).cypher("MATCH (a)-[:E]-(b)-[:E]-(c) RETURN count(*) AS c")) == [(0,)]


def test_unbounded_walks_end_with_an_error(spark):
    g = graph(spark, {"D": [(k, {"n": k}) for k in range(105)]}, {"E": [(k, k + 1, {"w": 1}) for k in range(104)]})
    from lattica.operators import match, paths

    keep = paths.MOST_HOPS
    try:
        match.MOST_HOPS = paths.MOST_HOPS = 6
        with pytest.raises(QueryRuntimeError):
            g.cypher("MATCH (a {n: 0})-[:E*]->(b) RETURN b").collect()
    finally:
        match.MOST_HOPS = paths.MOST_HOPS = keep


def test_create_and_read_back(spark):
    g = GraphSession(PropertyGraph(spark))
    g.cypher("CREATE (a:A:B {name: 'x', k: 1})-[:R {w: 1.5}]->(b:B {name: 'y'}), (b)<-[:S]-(c:C {of: a.name})")
    assert rows(g.cypher("MATCH (n:B) RETURN n.name AS n, labels(n) AS l ORDER BY n")) == [("x", ["A", "B"]), ("y", ["B"])]
    assert rows(g.cypher("MATCH (c:C)-[:S]->(b)<-[r:R]-(a) RETURN c.of AS o, r.w AS w, a.k AS k")) == [("x", 1.5, 1)]
    out = g.cypher("UNWIND range(1, 3) AS i CREATE (n:N {i: i, s: 'n' + toString(i)}) RETURN n.i AS i, n.s AS s")
    assert sorted(rows(out)) == [(1, "n1"), (2, "n2"), (3, "n3")]
    assert g.graph.node_count() == 6 and g.graph.edge_count() == 2
    g.cypher("MATCH (n:Nobody) CREATE (:Never)")
    assert g.graph.node_count() == 6
    for text, error in [("CREATE (n {l: [1]})", TypeMismatchError), ("CREATE (a)-[:X*2]->(b)", SemanticError), ("CREATE (a)-[]->(b)", SemanticError)]:
        with pytest.raises(error):
            g.cypher(text)


def test_merge(spark):
    g = GraphSession(PropertyGraph(spark))
    assert rows(g.cypher("MERGE (a:P {name: 'A'}) ON CREATE SET a.n = 1 ON MATCH SET a.n = a.n + 1 RETURN a.n AS n")) == [(1,)]
    assert rows(g.cypher("MERGE (a:P {name: 'A'}) ON CREATE SET a.n = 1 ON MATCH SET a.n = a.n + 1 RETURN a.n AS n")) == [(2,)]
    g.cypher("UNWIND ['A', 'B', 'B', 'B'] AS x MERGE (a:P {name: x}) ON CREATE SET a.n = 10 ON MATCH SET a.n = a.n + 1")
    assert rows(g.cypher("MATCH (a:P) RETURN a.name AS a, a.n AS n ORDER BY a")) == [("A", 3), ("B", 12)]
    for _ in range(2):
        g.cypher("MATCH (a:P {name: 'A'}), (b:P {name: 'B'}) MERGE (a)-[r:KNOWS {w: 1}]->(b) ON CREATE SET r.c = 1 ON MATCH SET r.c = r.c * 2")
    assert rows(g.cypher("MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, b.name AS b, r.c AS c")) == [("A", "B", 2)]
    g.cypher("MERGE (a:P {name: 'A'})-[:LIVES]->(c:City {name: 'X'})")  # no such chain: all of it is made
    assert rows(g.cypher("MATCH (a:P {name: 'A'}) RETURN count(a) AS c")) == [(2,)]
    g.cypher("MATCH (a:P {name: 'B'}) MERGE (a)-[:LIVES]->(c:City {name: 'X'})")
    assert rows(g.cypher("MATCH (c:City) RETURN count(c) AS c")) == [(2,)]


def test_set_and_remove(spark):
    g = GraphSession(PropertyGraph(spark))
    g.cypher("CREATE (:P {name: 'A', x: 1}), (:P {name: 'B'})")
    assert rows(g.cypher("MATCH (p:P {name: 'A'}) SET p.y = p.x + 1, p.z = p.y * 10, p:Q RETURN p.y AS y, p.z AS z, labels(p) AS l")) == [(2, 20, ["P", "Q"])]
    assert rows(g.cypher("MATCH (p:P {name: 'B'}) SET p += {x: 5, name: 'C'} RETURN p.name AS n, p.x AS x")) == [("C", 5)]
    assert rows(g.cypher("MATCH (p:Q) SET p = {name: 'D'} RETURN keys(p) AS k")) == [(["name"],)]
    assert rows(g.cypher("MATCH (p:Q) REMOVE p:Q, p.name RETURN labels(p) AS l, keys(p) AS k")) == [(["P"], [])]
    assert rows(g.cypher("MATCH (a:P {name: 'C'}) SET a.x = null RETURN keys(a) AS k")) == [(["name"],)]
    assert rows(g.cypher("MATCH (a:P {name: 'C'}), (b:P) WHERE b.name IS NULL SET b = a RETURN b.name AS n")) == [("C",)]
    g.cypher("UNWIND [1, 2, 3] AS i MATCH (a:P) SET a.t = coalesce(a.t, 0) * 10 + i")
    assert {r[0] for r in rows(g.cypher("MATCH (a:P) RETURN a.t AS t"))} <= {123, 132, 213, 231, 312, 321}
    with pytest.raises(TypeMismatchError):
        g.cypher("MATCH (a:P) SET a.l = [1, 2]")
    with pytest.raises(TypeMismatchError):
        g.cypher("MATCH (a:P) SET a += {q: null}")


def test_delete(spark):
    g = GraphSession(PropertyGraph(spark))
    g.cypher("CREATE (a:P {n: 1})-[:R]->(b:P {n: 2})-[:R]->(c:P {n: 3}), (:P {n: 4})")
    with pytest.raises(QueryRuntimeError):
        g.cypher("MATCH (a:P {n: 1}) DELETE a")
    assert g.graph.node_count() == 4
    g.cypher("MATCH (a:P {n: 4}) DELETE a")
    g.cypher("MATCH (a:P {n: 1})-[r]->() DELETE r, a")
    assert (g.graph.node_count(), g.graph.edge_count()) == (2, 1)
    assert rows(g.cypher("MATCH (a:P {n: 3}) DETACH DELETE a RETURN a.n AS n")) == [(None,)]
    assert (g.graph.node_count(), g.graph.edge_count()) == (1, 0)


def test_constraints(spark):
    g = GraphSession(PropertyGraph(spark))
    g.cypher("CREATE (:P {name: 'A', age: 1}), (:P {name: 'B', age: 2})")
    for body in ("p.name IS UNIQUE", "p.name IS NOT NULL", "(p.name, p.age) IS NODE KEY", "p.age IS :: INTEGER"):
        g.cypher(f"CREATE CONSTRAINT FOR (p:P) REQUIRE {body}")
    for text in ("CREATE (:P {name: 'A', age: 5})", "CREATE (:P {age: 5})", "MERGE (p:P {name: 'Z'})", "MATCH (p:P {name: 'A'}) SET p.name = 'B'", "MATCH (p:P {name: 'A'}) REMOVE p.name"):
        with pytest.raises(ConstraintError):
            g.cypher(text)
    assert rows(g.cypher("MATCH (p:P) RETURN p.name AS n ORDER BY n")) == [("A",), ("B",)]
    with pytest.raises(ConstraintError):
        g.cypher("CREATE CONSTRAINT FOR (p:P) REQUIRE p.zip IS NOT NULL")
    with pytest.raises(ConstraintError):
        g.cypher("CREATE CONSTRAINT FOR (p:P) REQUIRE p.age IS :: STRING")


def test_union_shares_the_graph(spark):
    g = GraphSession(PropertyGraph(spark))
    assert sorted(rows(g.cypher("CREATE (a:X {k: 1}) RETURN a.k AS k UNION ALL MATCH (a:X) RETURN a.k + 1"))) == [(1,), (2,)]


def test_results_of_whole_nodes(people):
    row = people.cypher("MATCH (c:Car)<-[r:OWNS]-() RETURN c, r").collect()[0]
    assert row.c.asDict() == {"_id": 3, "_labels": ["Car"], "model": "Tesla", "year": 2020} and row.r["_type"] == "OWNS"
    assert rows(people.cypher("MATCH (a:Person) WITH a ORDER BY a.name LIMIT 2 RETURN collect(a.name) AS l")) == [(["Alice", "Bob"],)]
    assert rows(people.cypher("MATCH (a:Person)-[:KNOWS]->(b) WITH b, count(*) AS n RETURN b.name AS n ORDER BY n")) == [("Bob",), ("Carol",)]
    assert rows(people.cypher("MATCH (a:Person) RETURN DISTINCT a IS NULL AS x")) == [(False,)]
    assert rows(people.cypher("MATCH (a:Person), (b:Person) WHERE a = b RETURN count(*) AS c")) == [(3,)]


def test_long_statements(spark):
    g = GraphSession(PropertyGraph(spark))
    g.cypher("CREATE " + ", ".join(f"(:Person {{gnId: 'node-{k}', name: 'Person {k}'}})" for k in range(1, 21)))
    pairs = [(i, i % 20 + 1, (i * 3 + 1) % 20 + 1) for i in range(1, 1001)]
    pairs = [p for p in pairs if p[1] != p[2]]
    text = "\n".join(f"MATCH (_a{i}:Person {{gnId: 'node-{a}'}}), (_b{i}:Person {{gnId: 'node-{b}'}})" for i, a, b in pairs)
    g.cypher(text + "\nCREATE " + ", ".join(f"(_a{i})-[:KNOWS {{weight: {i % 10}}}]->(_b{i})" for i, *_ in pairs))
    assert (g.graph.node_count(), g.graph.edge_count()) == (20, len(pairs))
    i, a, b = pairs[7]
    assert rows(g.cypher("MATCH (a {gnId: $a})-[r:KNOWS]->(b {gnId: $b}) RETURN count(r) AS c, min(r.weight) >= 0 AS w", {"a": f"node-{a}", "b": f"node-{b}"})) == [(sum((x, y) == (a, b) for _, x, y in pairs), True)]
    lost = text.replace("node-3'", "node-99'") + "\nCREATE " + ", ".join(f"(_a{i})-[:LOST]->(_b{i})" for i, *_ in pairs)
    g.cypher(lost)
    assert g.graph.edge_count() == len(pairs)
    g.cypher("CREATE (:Person {gnId: 'node-1', n: 1.5}), (:Person {gnId: 5, n: null})")
    assert rows(g.cypher("MATCH (p:Person) WHERE p.n IS NOT NULL RETURN p.gnId AS g, p.n AS n")) == [("node-1", 1.5)]


def test_bounds_at_and_beyond_the_default(spark, monkeypatch):
    """A chain that ends at the bound, explicit bounds beyond it, and paths that go on."""
    from lattica.operators import paths

    monkeypatch.setattr(paths, "MOST_HOPS", 4)
    q = graph(spark, {"D": [(k, {"n": k}) for k in range(7)]}, {"E": [(k, k + 1, {"w": 1}) for k in range(6)]}).cypher
    assert rows(q("MATCH (a {n: 2})-[r:E*]->(b) RETURN size(r) AS l ORDER BY l")) == [(1,), (2,), (3,), (4,)]
    assert rows(q("MATCH (a {n: 0})-[r:E*6..6]->(b) RETURN size(r) AS l")) == [(6,)]
    assert rows(q("MATCH (a {n: 0})-[r:E*5..9]->(b) RETURN size(r) AS l ORDER BY l")) == [(5,), (6,)]
    with pytest.raises(QueryRuntimeError):
        q("MATCH (a {n: 1})-[r:E*]->(b) RETURN b").collect()


def test_shortest_paths_over_some_relationships(spark):
    q = graph(spark, {"D": [(k, {"n": k}) for k in range(4)]}, {"E": [(0, 3, {"w": 9}), (0, 1, {"w": 1}), (1, 2, {"w": 1}), (2, 3, {"w": 1})]}).cypher
    assert rows(q("MATCH p = shortestPath((a {n: 0})-[:E* {w: 1}]->(b {n: 3})) RETURN length(p) AS l")) == [(3,)]
    assert rows(q("MATCH p = shortestPath((a {n: 0})-[:E*]->(b)) RETURN b.n AS n, length(p) AS l ORDER BY n")) == [(1, 1), (2, 2), (3, 1)]
    assert rows(q("MATCH (x {n: 3}) MATCH p = shortestPath((a {n: 0})-[:E*2..]->(x)) RETURN length(p) AS l")) == [(3,)]


def test_properties_that_mention_what_is_bound_later(spark):
    g = graph(spark, {"A": [(0, {"k": 1}), (1, {"k": 2})], "B": [(2, {"k": 1}), (3, {"k": 1})]}, {"E": [(0, 2, {"w": 1}), (1, 3, {"w": 1})]})
    assert rows(g.cypher("MATCH (b:B {k: a.k})<-[:E]-(a:A) RETURN a.k AS k")) == [(1,)]
    with pytest.raises(SemanticError):
        g.cypher("MATCH (b:B {k: nothing.k}) RETURN b")
