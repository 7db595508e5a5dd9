"""Every registered query of the graph engine against its SQL, and what its plans must look like."""

import math

import duckdb
import pytest

from lattica import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    got = duckdb.connect()
    for t in TABLES:
        got.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return got


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.12g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, data, db, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = db.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def numbered_alike(data, folder):
    """Tables whose customers 1, 6 and 11 and suppliers 3 and 8 have such nations that numbers of their relationships
    are those of the nations' own."""
    con = duckdb.connect()
    nations = {"customer": "case c_custkey when 1 then 2 when 6 then 12 when 11 then 22 else c_nationkey end as c_nationkey", "supplier": "case s_suppkey when 3 then 7 when 8 then 17 else s_nationkey end as s_nationkey"}
    for t in TABLES:
        if t in nations:
            con.execute(f"copy (select * replace ({nations[t]}) from '{data}/{t}.parquet') to '{folder}/{t}.parquet' (format parquet)")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{data}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["shortest_path_by_property", "all_shortest_paths"])
def test_paths_over_types_that_are_numbered_alike(spark, data, tmp_path, name):
    con = numbered_alike(data, tmp_path)
    assert [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()] == con.execute(catalogue.ORACLE[name]).fetchall()


def plan(spark, data, name):
    return catalogue.QUERIES[name](spark, data)._jdf.queryExecution().toString()


def test_plans(spark, data):
    flagship = plan(spark, data, "flagship").split("== Physical Plan ==")[1]
    assert flagship.count("FileScan parquet") == 2 and "GreaterThan(o_totalprice,1000.0)" in flagship and "c_name" not in flagship
    for name in ("comma_natural_join", "successive_matches", "cycle_pattern", "optional_match", "exists_semi", "varlen_bounded", "pattern_comprehension"):
        text = plan(spark, data, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text and "Arrow" not in text, name
    assert "LeftSemi" in plan(spark, data, "exists_semi") and "LeftAnti" in plan(spark, data, "not_exists_anti")
    assert "TakeOrderedAndProject" in plan(spark, data, "top_k")


def scanned(spark, data, monkeypatch, text):
    """The tables of the test graph that a statement reads or writes."""
    from lattica import testgraph
    from lattica.graph import Tables
    from lattica.session import GraphSession

    opened = []
    real = Tables.__getitem__
    monkeypatch.setattr(Tables, "__getitem__", lambda self, key: (opened.append(key[0] if isinstance(key, tuple) and len(key) == 1 else key), real(self, key))[1])
    GraphSession(testgraph.load(spark, data)).cypher(text)
    return set(opened)


def test_writes_touch_only_the_tables_concerned(spark, data, monkeypatch):
    run = lambda text: scanned(spark, data, monkeypatch, text)
    every = {"Part", "Order", "Event", "Turn", "Document", "Label", "CONTAINS", "SUPPLIED_BY", "SUPPLIES", "FOLLOWED_BY", "LABELLED"}
    assert not run("MATCH (n:Nation) WHERE n.n_nationkey < 5 SET n.x = 1") & (every | {"Customer"})
    assert not run("MATCH (n:Nation)-[f:IN_REGION]->(:Region) DELETE f") & (every | {"Customer", "PLACED", "NEXT"})
    assert not run("MATCH (l:Label) WHERE l.quality = 0 DETACH DELETE l") & {"Part", "Order", "Event", "Turn", "Customer", "CONTAINS", "PLACED", "NEXT", "FOLLOWED_BY"}


def test_merge_ranks_nothing(spark, data):
    """The first row of a key is found by an aggregation: no window, nothing in one task."""
    from lattica.session import GraphSession
    from lattica import testgraph

    df = GraphSession(testgraph.load(spark, data)).cypher("MATCH (c:Customer) MERGE (s:Segment {name: c.c_mktsegment}) RETURN c.c_name AS c, s.name AS s")
    text = df._jdf.queryExecution().toString()
    assert "Window" not in text and "SinglePartition" not in text and len(df.collect()) == spark.read.parquet(f"{data}/customer.parquet").count()


def test_shortest_paths_make_no_product(spark, data):
    text = plan(spark, data, "shortest_path")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_every_event_gets_its_client(spark, data, db):
    ids = [r.id for r in catalogue.QUERIES["access_log_clients"](spark, data).collect()]
    assert sorted(ids) == [x for (x,) in db.execute("select event_id from events join customer on c_custkey = user_id order by 1").fetchall()]
