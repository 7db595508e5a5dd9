import pytest

from lattica.errors import TypeMismatchError
from lattica.graph import PropertyGraph
from lattica.session import GraphSession
from lattica.sources.export import export_cypher, json_rows
from lattica.sources.store import load_graph, save_graph


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def g(spark):
    return GraphSession(PropertyGraph(spark))


def written(tmp_path, text):
    path = tmp_path / "x.csv"
    path.write_text(text)
    return str(path)


def test_csv_forms(g, tmp_path):
    p = written(tmp_path, "name,age\nAlice,30\nBob,\n")
    assert rows(g.cypher("LOAD CSV WITH HEADERS FROM $p AS row RETURN row.name AS n, toInteger(row.age) AS a ORDER BY n", {"p": p})) == [("Alice", 30), ("Bob", None)]
    assert rows(g.cypher(f"LOAD CSV FROM 'file://{p}' AS row RETURN row[0] AS n, size(row) AS s ORDER BY n"))[0] == ("Alice", 2)
    assert rows(g.cypher("LOAD CSV WITH HEADERS FROM $p AS row WITH row WHERE row.age IS NULL RETURN row['name'] AS n", {"p": p})) == [("Bob",)]
    q = written(tmp_path, "a;b\n1;\"x;y\"\n")
    assert rows(g.cypher("LOAD CSV WITH HEADERS FROM $p AS r FIELDTERMINATOR ';' RETURN r.a AS a, r.b AS b", {"p": q})) == [("1", "x;y")]
    for text, params in [("LOAD CSV FROM 5 AS r RETURN r", {}), ("LOAD CSV FROM $p AS r FIELDTERMINATOR '' RETURN r", {"p": q}), ("LOAD CSV FROM $p AS r FIELDTERMINATOR 'é' RETURN r", {"p": q})]:
        with pytest.raises(TypeMismatchError):
            g.cypher(text, params)
    with pytest.raises(Exception):
        g.cypher("LOAD CSV FROM '/no/such/file.csv' AS r RETURN r").collect()


def test_csv_ingest(g, tmp_path):
    nodes = written(tmp_path, "name,age\nAlice,30\nBob,25\n")
    g.cypher("LOAD CSV WITH HEADERS FROM $p AS row CREATE (:Person {name: row.name, age: toInteger(row.age)})", {"p": nodes})
    edges = tmp_path / "e.csv"
    edges.write_text("src,dst,weight\nAlice,Bob,2\n")
    g.cypher("LOAD CSV WITH HEADERS FROM $p AS row MATCH (a:Person {name: row.src}), (b:Person {name: row.dst}) CREATE (a)-[:KNOWS {w: toInteger(row.weight)}]->(b)", {"p": str(edges)})
    assert rows(g.cypher("MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, r.w AS w, b.age AS b")) == [("Alice", 2, 25)]


FRONTEND = "timestamp,request_id,client_ip,method,path,status\n" + "".join(f"t{k},req-{k},10.0.0.{k % 2},GET,/p{k},{200 if k % 3 else 500}\n" for k in range(6))
GATEWAY = "timestamp,request_id,route,status\n" + "".join(f"u{k},req-{k},r,{200}\n" for k in range(4))


def test_log_scenario(g, tmp_path):
    a, b = tmp_path / "f.csv", tmp_path / "g.csv"
    a.write_text(FRONTEND)
    b.write_text(GATEWAY)
    front = """LOAD CSV WITH HEADERS FROM $p AS row
    MERGE (c:Client {ip: row.client_ip})
    MERGE (log:LogEntry {request_id: row.request_id, layer: 'frontend'})
    SET log.timestamp = row.timestamp, log.status = toInteger(row.status)
    MERGE (c)-[:INITIATED]->(log)"""
    gate = """LOAD CSV WITH HEADERS FROM $p AS row
    MERGE (prev:LogEntry {request_id: row.request_id, layer: 'frontend'})
    MERGE (log:LogEntry {request_id: row.request_id, layer: 'gateway'})
    SET log.timestamp = row.timestamp, log.route = row.route
    MERGE (prev)-[:FORWARDED_TO]->(log)"""
    for _ in range(2):  # ingest again: nothing is added
        g.cypher(front, {"p": str(a)})
        g.cypher(gate, {"p": str(b)})
    assert rows(g.cypher("MATCH (n:LogEntry) RETURN n.layer AS l, count(*) AS c ORDER BY l")) == [("frontend", 6), ("gateway", 4)]
    assert rows(g.cypher("MATCH (c:Client)-[:INITIATED]->(e:LogEntry) RETURN c.ip AS ip, count(e) AS n, count(CASE WHEN e.status >= 500 THEN 1 END) AS bad ORDER BY ip")) == [("10.0.0.0", 3, 1), ("10.0.0.1", 3, 1)]
    assert rows(g.cypher("MATCH (c:Client)-[:INITIATED]->(a)-[h:FORWARDED_TO*1..3]->(b) RETURN max(size(h)) AS hops, count(b) AS n")) == [(1, 4)]


def test_export_and_store(g, spark, tmp_path):
    g.cypher("CREATE (a:A:B {s: 'it\\'s \\\\ \\n', f: 2.0, i: 3, t: true})-[:R {w: 1}]->(b:B), (b)-[:S]->(a)")
    text = export_cypher(g.graph)
    assert text.startswith("CREATE (_0:A:B {f: 2.0, i: 3, s: 'it\\'s \\\\ \\n', t: true})") and "-[:R {w: 1}]->" in text
    again = GraphSession(PropertyGraph(spark))
    again.cypher(text)
    assert export_cypher(again.graph) == text
    g.cypher("CREATE CONSTRAINT FOR (n:A) REQUIRE n.i IS UNIQUE")
    save_graph(g.graph, str(tmp_path / "store"))
    loaded = load_graph(spark, str(tmp_path / "store"))
    assert export_cypher(loaded) == text and loaded.constraints == g.graph.constraints and loaded.next_node == g.graph.next_node
    assert export_cypher(PropertyGraph(spark)) == ""
    value = json_rows(g.cypher("MATCH (a:A)-[r:R]->(b) RETURN a, r, 1 AS x")).collect()[0][0]
    assert '"_properties":{"f":2.0' in value and '"_type":"R"' in value and value.endswith('"x":1}')


def test_stream_into_a_store_survives_restarts(spark, tmp_path):
    from lattica.streaming.ingest import merge_stream

    folder, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    text = "UNWIND $rows AS row WITH row MERGE (k:Kind {name: row.kind}) ON CREATE SET k.n = 1 ON MATCH SET k.n = k.n + 1"

    def ingest():
        stream = spark.readStream.schema("kind string").parquet(folder)
        session = GraphSession.stored(spark, store)  # each time the session of a driver that has just started
        merge_stream(session, stream, text, checkpoint).awaitTermination()
        return session

    spark.createDataFrame([("a",), ("a",), ("b",)], "kind string").write.parquet(folder)
    ingest()
    spark.createDataFrame([("a",), ("c",)], "kind string").write.mode("append").parquet(folder)
    ingest()
    want = [("a", 3), ("b", 1), ("c", 1)]
    assert rows(GraphSession.stored(spark, store).cypher("MATCH (k:Kind) RETURN k.name AS k, k.n AS n ORDER BY k")) == want
    (tmp_path / "checkpoint" / "commits" / "1").unlink()  # lost after the graph was committed: the batch runs again
    for f in (tmp_path / "checkpoint" / "commits").glob(".1*"):
        f.unlink()
    ingest()
    assert rows(GraphSession.stored(spark, store).cypher("MATCH (k:Kind) RETURN k.name AS k, k.n AS n ORDER BY k")) == want


def test_store_keeps_what_has_not_changed(spark, tmp_path):
    path = str(tmp_path / "store")
    g = GraphSession.stored(spark, path)
    g.cypher("CREATE (:A {x: 1}), (:B {x: 2})")
    before = {x.name for x in (tmp_path / "store" / "tables").iterdir()}
    g.cypher("MATCH (a:A) SET a.x = 5")
    after = {x.name for x in (tmp_path / "store" / "tables").iterdir()}
    assert len(before) == 2 and len(after - before) == 1
    g.cypher("CREATE CONSTRAINT FOR (n:A) REQUIRE n.x IS UNIQUE")
    again = GraphSession.stored(spark, path)
    assert rows(again.cypher("MATCH (n) RETURN n.x AS x ORDER BY x")) == [(2,), (5,)] and again.graph.constraints == g.graph.constraints
    assert again.create_node(["A"], {"x": 6}) == 2 and GraphSession.stored(spark, path).get_node(2)["properties"] == {"x": 6}
