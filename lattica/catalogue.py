"""The registered queries: query text over the test graph, with the SQL that gives the same rows.

Money is summed in whole cents, so that results don't depend on the order of additions.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testgraph
from .errors import ConstraintError, QueryRuntimeError
from .graph import PropertyGraph
from .lineage import shared_dir
from .session import GraphSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


_graphs: dict[tuple[str, str], PropertyGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The test graph of a folder, opened once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = testgraph.load(spark, sf_dir)
    return _graphs[key]


def session(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(graph(spark, sf_dir))


def reads(name: str, text: str, sql: str | None = None, **params) -> None:
    """Registers a query that reads."""
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).cypher(text, params)
    if sql:
        ORACLE[name] = sql


def runs(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of several statements."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# -- scans, filters, expansion --------------------------------------------------------------------------------------

FLAGSHIP = """MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000
RETURN c.c_mktsegment AS seg, count(*) AS orders, sum(toInteger(round(o.o_totalprice * 100))) AS cents ORDER BY seg"""
reads(
    "flagship",
    FLAGSHIP,
    """select c_mktsegment as seg, count(*) as orders, sum(cast(floor(o_totalprice * 100 + 0.5) as bigint))::bigint as cents
    from customer join orders on o_custkey = c_custkey where o_totalprice > 1000 group by 1""",
)
reads("scan_label", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "select n_nationkey as k, n_name as name from nation")
reads(
    "scan_all_labels",
    "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS c",
    " union all ".join(
        f"select '{label}' as label, count(*) as c from {table}"
        for label, table in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"), ("Turn", "conversations"), ("Document", "documents"), ("Label", "labels"))
    ),
)
reads("inline_props", "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN count(*) AS c", "select count(*) as c from customer where c_mktsegment = 'BUILDING'")
reads(
    "filter_logic",
    """MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {o_orderstatus: 'P'})
    WITH c, o.o_totalprice AS p, c.c_acctbal AS b
    RETURN count(CASE WHEN p > 50000 AND b > 0 THEN 1 END) AS both, count(CASE WHEN p > 50000 OR b > 0 THEN 1 END) AS either,
      count(CASE WHEN (p > 50000) XOR (b > 0) THEN 1 END) AS one, count(CASE WHEN NOT (p > 50000) THEN 1 END) AS no""",
    """select count(case when p > 50000 and b > 0 then 1 end) as both, count(case when p > 50000 or b > 0 then 1 end) as either,
      count(case when (p > 50000) <> (b > 0) then 1 end) as one, count(case when not (p > 50000) then 1 end) as no
    from (select o_totalprice as p, c_acctbal as b from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P')""",
)
_BY_CUSTOMER = "select c_custkey as c, count(*) as n from customer join orders on o_custkey = c_custkey group by 1"
reads("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, count(o) AS n", _BY_CUSTOMER)
reads("expand_in", "MATCH (o:Order)<-[:PLACED]-(c:Customer) RETURN c.c_custkey AS c, count(o) AS n", _BY_CUSTOMER)
reads("expand_undirected", "MATCH (c:Customer)-[:PLACED]-(x) RETURN c.c_custkey AS c, count(x) AS n", _BY_CUSTOMER)
reads(
    "expand_multi_type",
    "MATCH (a)-[r:FROM_NATION|IN_REGION]->(b) RETURN type(r) AS t, labels(b)[0] AS l, count(*) AS c",
    """select 'FROM_NATION' as t, 'Nation' as l, (select count(*) from customer) + (select count(*) from supplier) as c
    union all select 'IN_REGION', 'Region', count(*) from nation""",
)
reads(
    "expand_edge_props",
    "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 40 RETURN p.p_brand AS brand, count(*) AS c, sum(toInteger(l.quantity)) AS q",
    "select p_brand as brand, count(*) as c, sum(cast(l_quantity as bigint))::bigint as q from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where l_quantity > 40 group by 1",
)
reads(
    "two_hop",
    "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:FROM_NATION]-(c:Customer) RETURN r.r_name AS region, n.n_name AS nation, count(c) AS c",
    "select r_name as region, n_name as nation, count(*) as c from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1, 2",
)
reads(
    "three_hop",
    "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:FROM_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, o.o_orderstatus AS status, count(*) AS c",
    "select r_name as region, o_orderstatus as status, count(*) as c from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1, 2",
)
reads(
    "comma_natural_join",
    "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation), (s:Supplier)-[:FROM_NATION]->(n) RETURN n.n_name AS nation, count(*) AS pairs",
    "select n_name as nation, count(*) as pairs from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey group by 1",
)
reads(
    "successive_matches",
    "MATCH (c:Customer) WHERE c.c_acctbal > 5000 MATCH (c)-[:PLACED]->(o:Order) MATCH (c)-[:FROM_NATION]->(n:Nation) RETURN n.n_name AS nation, count(o) AS c",
    "select n_name as nation, count(*) as c from customer join orders on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where c_acctbal > 5000 group by 1",
)
reads(
    "cycle_pattern",
    "MATCH (n:Nation)<-[:FROM_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s:Supplier)-[:FROM_NATION]->(n) RETURN n.n_name AS nation, count(*) AS c",
    """select n_name as nation, count(*) as c from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey
    join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = n_nationkey group by 1""",
)
reads("cross_product", "MATCH (a:Region), (b:Region) RETURN a.r_name AS a, b.r_name AS b", "select x.r_name as a, y.r_name as b from region x, region y")
reads(
    "correlated_props",
    "UNWIND ['BUILDING', 'MACHINERY'] AS seg MATCH (c:Customer {c_mktsegment: seg}) RETURN seg, count(c) AS c",
    "select c_mktsegment as seg, count(*) as c from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1",
)
reads(
    "optional_match",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN count(*) AS n, count(o) AS orders, count(DISTINCT c) AS customers",
    "select count(*) as n, count(o_orderkey) as orders, count(distinct c_custkey) as customers from customer left join orders on o_custkey = c_custkey",
)
reads(
    "optional_match_where",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_custkey AS c, count(o) AS n",
    "select c_custkey as c, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_totalprice > 100000 group by 1",
)
reads(
    "optional_two_hops",
    "MATCH (s:Supplier) OPTIONAL MATCH (s)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region {r_name: 'ASIA'}) RETURN r.r_name AS region, count(s) AS c",
    "select case when r_name = 'ASIA' then r_name end as region, count(*) as c from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
)
reads("mandatory_match", "MANDATORY MATCH (r:Region) RETURN r.r_name AS r", "select r_name as r from region")
reads("exists_semi", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(:Order {o_orderstatus: 'F'}) } RETURN c.c_custkey AS c", "select c_custkey as c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
reads("not_exists_anti", "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->() } RETURN c.c_custkey AS c", "select c_custkey as c from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
reads(
    "exists_in_projection",
    "MATCH (c:Customer) RETURN EXISTS { (c)-[:PLACED]->(:Order) } AS buys, count(*) AS n",
    "select exists (select 1 from orders where o_custkey = c_custkey) as buys, count(*) as n from customer group by 1",
)
reads(
    "pattern_comprehension",
    "MATCH (c:Customer) WITH c, [(c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'O' | o.o_orderkey] AS ks RETURN c.c_custkey AS c, size(ks) AS n, reduce(t = 0, k IN ks | t + k) AS total",
    "select c_custkey as c, count(o_orderkey) as n, coalesce(sum(o_orderkey), 0)::bigint as total from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'O' group by 1",
)

# -- paths ----------------------------------------------------------------------------------------------------------

_EVENTS = "with recursive nx as (select event_id as a, lead(event_id) over (partition by user_id order by ts, event_id) as b from events), "
_TURNS = "with recursive nx as (select conv_id, turn as a, lead(turn) over (partition by conv_id order by turn) as b from conversations), "
reads(
    "varlen_bounded",
    "MATCH (e:Event {event_type: 'signup'})-[r:NEXT*1..3]->(f:Event) RETURN size(r) AS hops, f.event_type AS kind, count(*) AS c",
    _EVENTS
    + """w as (select e.event_id as s, nx.b as f, 1 as hops from events e join nx on nx.a = e.event_id where event_type = 'signup' and nx.b is not null
      union all select w.s, nx.b, hops + 1 from w join nx on nx.a = w.f where hops < 3 and nx.b is not null)
    select hops, event_type as kind, count(*) as c from w join events on event_id = f group by 1, 2""",
)
reads(
    "varlen_exact",
    "MATCH (e:Event)-[:NEXT*2]->(f:Event) WHERE e.event_type = 'error' RETURN f.event_type AS kind, count(*) AS c",
    _EVENTS + "w as (select 1) select event_type as kind, count(*) as c from events e0 join nx x on x.a = e0.event_id join nx y on y.a = x.b join events f on f.event_id = y.b where e0.event_type = 'error' group by 1".replace("select event_type", "select f.event_type"),
)
reads(
    "varlen_zero",
    "MATCH (t:Turn {turn: 0})-[r:FOLLOWED_BY*0..2]->(u) RETURN size(r) AS hops, count(u) AS c",
    _TURNS
    + """w as (select conv_id, turn as f, 0 as hops from conversations where turn = 0
      union all select w.conv_id, nx.b, hops + 1 from w join nx on nx.conv_id = w.conv_id and nx.a = w.f where hops < 2 and nx.b is not null)
    select hops, count(*) as c from w group by 1""",
)
_ALL_TURNS = (
    _TURNS
    + """w as (select conv_id, a as s, b as f, 1 as hops from nx where b is not null
      union all select w.conv_id, w.s, nx.b, hops + 1 from w join nx on nx.conv_id = w.conv_id and nx.a = w.f where nx.b is not null)
    """
)
reads("varlen_unbounded", "MATCH (a:Turn)-[r:FOLLOWED_BY*]->(b) RETURN size(r) AS hops, count(*) AS c", _ALL_TURNS + "select hops, count(*) as c from w group by 1")
reads(
    "path_nodes_length",
    "MATCH p = (a:Turn)-[:FOLLOWED_BY*1..3]->(b:Turn) WHERE a.turn = 0 RETURN length(p) AS hops, size(nodes(p)) AS ns, sum(reduce(t = 0, n IN nodes(p) | t + n.turn)) AS turns",
    _ALL_TURNS + "select hops, hops + 1 as ns, sum((hops * (hops + 1)) / 2)::bigint as turns from w where s = 0 and hops <= 3 group by 1",
)
reads(
    "path_relationships",
    "MATCH p = (o:Order)<-[:PLACED]-(c:Customer)-[:FROM_NATION]->(n:Nation) RETURN [r IN relationships(p) | type(r)][1] AS t, length(p) AS l, count(*) AS c",
    "select 'FROM_NATION' as t, 2 as l, count(*) as c from orders",
)
reads(
    "undirected_varlen",
    "MATCH (a:Nation)-[:IN_REGION*2]-(b:Nation) RETURN a.n_name AS n, count(b) AS c",
    "select a.n_name as n, count(*) as c from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey group by 1",
)
reads(
    "shortest_path",
    "MATCH p = shortestPath((a:Turn {turn: 0})-[:FOLLOWED_BY*]->(b:Turn {role: 'assistant'})) WHERE a.conv_id = b.conv_id RETURN length(p) AS hops, count(*) AS c",
    _ALL_TURNS + "select hops, count(*) as c from w join conversations c on c.conv_id = w.conv_id and c.turn = w.f where s = 0 and role = 'assistant' group by 1",
)
reads(
    "all_shortest_paths",
    "MATCH p = allShortestPaths((a:Region {r_name: 'ASIA'})-[:IN_REGION|FROM_NATION*..3]-(s:Supplier)) RETURN length(p) AS hops, count(*) AS c",
    "select 2 as hops, count(*) as c from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
)
reads(
    "shortest_path_by_property",
    "MATCH p = shortestPath((a:Customer)-[:FROM_NATION|IN_REGION*..2]->(r:Region {r_name: 'ASIA'})) RETURN length(p) AS hops, count(*) AS c",
    "select 2 as hops, count(*) as c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
)
reads(
    "theta_pattern",
    "MATCH (a:Nation), (b:Region) WHERE a.n_nationkey < b.r_regionkey * 6 RETURN b.r_name AS r, count(a) AS c",
    "select r_name as r, count(*) as c from nation join region on n_nationkey < r_regionkey * 6 group by 1",
)
reads(
    "inline_rel_props",
    "MATCH (o:Order)-[l:CONTAINS {linenumber: 2, returnflag: 'R'}]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p",
    "select l_orderkey as o, l_partkey as p from lineitem where l_linenumber = 2 and l_returnflag = 'R'",
)
reads(
    "start_and_end_node",
    "MATCH ()-[r:IN_REGION]->() RETURN startNode(r).n_name AS n, endNode(r).r_name AS r",
    "select n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey",
)

# -- projection, grouping, order ------------------------------------------------------------------------------------

reads(
    "with_having",
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 12 RETURN c.c_name AS name, n",
    "select c_name as name, count(*) as n from customer join orders on o_custkey = c_custkey group by c_custkey, c_name having count(*) > 12",
)
reads(
    "group_count_sum_avg_min_max",
    "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, sum(c.c_nationkey) AS s, avg(c.c_nationkey) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi",
    "select c_mktsegment as seg, count(*) as n, sum(c_nationkey)::bigint as s, avg(c_nationkey) as a, min(c_acctbal) as lo, max(c_acctbal) as hi from customer group by 1",
)
reads("count_distinct", "MATCH (o:Order) RETURN count(DISTINCT o.o_custkey) AS c, sum(DISTINCT o.o_custkey) AS s, avg(DISTINCT o.o_custkey) AS a", "select count(distinct o_custkey) as c, sum(distinct o_custkey)::bigint as s, avg(distinct o_custkey) as a from orders")
reads(
    "collect_distinct",
    "MATCH (e:Event) WITH e.user_id AS u, list_sort(collect(DISTINCT e.event_type)) AS ts RETURN u, size(ts) AS n, ts[0] AS first, last(ts) AS last",
    "select user_id as u, count(distinct event_type) as n, min(event_type) as first, max(event_type) as last from events group by 1",
)
reads(
    "stdev_percentile",
    "MATCH (p:Part) RETURN toInteger(round(stdev(p.p_size) * 1000000)) AS sd, toInteger(round(stdevp(p.p_size) * 1000000)) AS sp, percentileCont(p.p_size, 0.4) AS pc, percentileDisc(p.p_size, 0.8) AS pd",
    """select cast(floor(stddev_samp(p_size) * 1000000 + 0.5) as bigint) as sd, cast(floor(stddev_pop(p_size) * 1000000 + 0.5) as bigint) as sp, quantile_cont(p_size, 0.4)::double as pc,
      list_sort(list(p_size))[cast(floor(0.8 * (count(*) - 1)) as bigint) + 1] as pd from part""",
)
reads("empty_aggregate", "MATCH (o:Order) WHERE o.o_totalprice < 0 RETURN sum(o.o_orderkey) AS s, avg(o.o_totalprice) AS a, count(*) AS c, size(collect(o.o_orderkey)) AS n", "select 0::bigint as s, null::double as a, 0::bigint as c, 0::bigint as n")
reads(
    "nested_aggregate",
    "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) + 1 AS n, size(collect(DISTINCT c.c_nationkey)) AS k, toFloat(sum(c.c_nationkey)) / count(*) AS m",
    "select c_mktsegment as seg, count(*) + 1 as n, count(distinct c_nationkey) as k, sum(c_nationkey)::double / count(*) as m from customer group by 1",
)
reads(
    "order_nulls",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {o_orderstatus: 'P'}) WITH c.c_custkey AS k, min(o.o_orderkey) AS m ORDER BY m DESC, k SKIP 5 LIMIT 20 RETURN k, m",
    "select c_custkey as k, min(o_orderkey) as m from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' group by 1 order by m desc nulls first, k limit 20 offset 5",
)
reads("top_k", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10", "select o_orderkey as k, o_totalprice as p from orders order by p desc, k limit 10")
reads("skip_limit", "MATCH (n:Nation) RETURN n.n_name AS n ORDER BY n SKIP $a LIMIT $b", "select n_name as n from nation order by 1 limit 5 offset 3", a=3, b=5)
reads("order_by_aggregate", "MATCH (o:Order) RETURN o.o_orderpriority AS p ORDER BY count(*) DESC, p LIMIT 2", "select o_orderpriority as p from orders group by 1 order by count(*) desc, 1 limit 2")
reads("distinct_rows", "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "select distinct o_orderstatus as s, o_orderpriority as p from orders")
reads("with_star", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH *, n.n_nationkey % 2 AS odd RETURN r.r_name AS r, odd, count(n) AS c", "select r_name as r, (n_nationkey % 2)::bigint as odd, count(*) as c from nation join region on n_regionkey = r_regionkey group by 1, 2")
reads("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey", "select c_nationkey as k from customer union select s_nationkey from supplier")
reads("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS other", "select c_nationkey as k from customer union all select s_nationkey from supplier")
reads("unwind_list", "UNWIND ['a', 'b', null, 'a'] AS x RETURN x, count(*) AS c", "select x, count(*) as c from (values ('a'), ('b'), (null), ('a')) t(x) group by 1")
reads("unwind_range", "MATCH (n:Nation) UNWIND range(0, n.n_nationkey, 5) AS i RETURN n.n_name AS n, sum(i) AS s, count(*) AS c", "select n_name as n, sum(i)::bigint as s, count(*) as c from nation, unnest(range(0, n_nationkey + 1, 5)) t(i) group by 1")

# -- expressions ----------------------------------------------------------------------------------------------------

reads(
    "case_simple",
    "MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS c",
    "select case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as s, count(*) as c from orders group by 1",
)
reads(
    "case_searched",
    "MATCH (o:Order) RETURN CASE WHEN o.o_totalprice < 20000 THEN 'low' WHEN o.o_totalprice < 60000 THEN 'mid' END AS b, count(*) AS c",
    "select case when o_totalprice < 20000 then 'low' when o_totalprice < 60000 then 'mid' end as b, count(*) as c from orders group by 1",
)
reads(
    "string_functions",
    """MATCH (c:Customer) RETURN c.c_custkey AS k, toUpper(c.c_name) AS up, toLower(c.c_mktsegment) AS low, trim('  ' + c.c_name + ' ') AS t, ltrim(' x') AS lt, rtrim('x ') AS rt, reverse(c.c_name) AS rev,
      replace(c.c_name, '0', 'o') AS rep, substring(c.c_name, 3, 4) AS sub, left(c.c_name, 3) AS l, right(c.c_name, 3) AS r, split(c.c_name, '#')[0] AS sp, concat(c.c_mktsegment, '-', c.c_name) AS cc, size(c.c_name) AS n""",
    """select c_custkey as k, upper(c_name) as up, lower(c_mktsegment) as low, c_name as t, 'x' as lt, 'x' as rt, reverse(c_name) as rev, replace(c_name, '0', 'o') as rep, substring(c_name, 4, 4) as sub,
      left(c_name, 3) as l, right(c_name, 3) as r, string_split(c_name, '#')[1] as sp, c_mktsegment || '-' || c_name as cc, length(c_name) as n from customer""",
)
reads(
    "regex_functions",
    """MATCH (c:Customer) RETURN c.c_custkey AS k, regexp_matches(c.c_name, '.*[02468]') AS even, c.c_name =~ '.*7.*' AS seven, regexp_replace(c.c_name, '[0-9]+', '<$0>') AS rep,
      regexp_extract(c.c_name, '([0-9])([0-9]*)', 2) AS ex, regexp_extract(c.c_name, 'zzz') AS no""",
    """select c_custkey as k, regexp_full_match(c_name, '.*[02468]') as even, regexp_full_match(c_name, '.*7.*') as seven, regexp_replace(c_name, '([0-9]+)', '<\\1>', 'g') as rep,
      regexp_extract(c_name, '([0-9])([0-9]*)', 2) as ex, null::varchar as no from customer""",
)
reads(
    "math_functions",
    """MATCH (p:Part) RETURN p.p_partkey AS k, abs(p.p_size - 25) AS a, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, round(p.p_retailprice) AS r, sign(p.p_size - 25) AS s, toInteger(round(sqrt(p.p_size) * 1000000)) AS q,
      toInteger(round((sin(p.p_size) + cos(p.p_size) + atan2(p.p_size, 2) + log(p.p_size) + log10(p.p_size) + exp(p.p_size / 50.0) + degrees(0.5) + radians(p.p_size)) * 100000)) AS t, p.p_size % 7 AS m, p.p_size / 7 AS d, p.p_size ^ 2 AS w, pi() > e() AS pe""",
    """select p_partkey as k, abs(p_size - 25)::bigint as a, ceil(p_retailprice) as c, floor(p_retailprice) as f, floor(p_retailprice + 0.5) as r, sign(p_size - 25)::bigint as s, cast(floor(sqrt(p_size) * 1000000 + 0.5) as bigint) as q,
      cast(floor((sin(p_size) + cos(p_size) + atan2(p_size, 2) + ln(p_size) + log10(p_size) + exp(p_size / 50.0) + degrees(0.5) + radians(p_size)) * 100000 + 0.5) as bigint) as t, (p_size % 7)::bigint as m, (p_size // 7)::bigint as d, pow(p_size, 2) as w, true as pe from part""",
)
reads(
    "list_functions",
    """MATCH (n:Nation) WITH n, range(0, n.n_nationkey % 5) AS l RETURN n.n_name AS n, head(l) AS h, last(l) AS la, size(tail(l)) AS t, list_contains(l, 3) AS has, list_extract(l, -1) AS ex, size(list_append(l, 9)) AS ap,
      head(list_prepend(l, 7)) AS pre, head(list_sort(reverse(l))) AS so, size(list_distinct(l + l)) AS di, size(list_value(1, 2, 3)) AS v""",
    """select n_name as n, 0::bigint as h, (n_nationkey % 5)::bigint as la, (n_nationkey % 5)::bigint as t, n_nationkey % 5 >= 3 as has, (n_nationkey % 5)::bigint as ex, (n_nationkey % 5 + 2)::bigint as ap,
      7::bigint as pre, 0::bigint as so, (n_nationkey % 5 + 1)::bigint as di, 3::bigint as v from nation""",
)
reads(
    "cast_functions",
    """MATCH (p:Part) RETURN p.p_partkey AS k, toString(p.p_size) AS s, toInteger('12') + p.p_size AS i, toInteger(p.p_retailprice) AS ti, toFloat(toString(p.p_size)) AS f, toBoolean('TRUE') AS b, toInteger('4.5') AS no, toInteger(' 4') AS no2, toString(1.0) AS one""",
    "select p_partkey as k, p_size::varchar as s, (12 + p_size)::bigint as i, trunc(p_retailprice)::bigint as ti, p_size::double as f, true as b, null::bigint as no, null::bigint as no2, '1.0' as one from part",
)
reads(
    "date_functions",
    """MATCH (o:Order) RETURN o.o_orderkey AS k, date_part('year', o.o_orderdate) AS y, date_part('month', o.o_orderdate) AS m, date_part('day', o.o_orderdate) AS d, epoch_ms(o.o_orderdate) AS e, date_trunc('month', o.o_orderdate) AS tm,
      toString(date_part('year', date('2024-02-29'))) AS dy, make_date(2024, 2, 30) IS NULL AS bad, date('2024-2-9') IS NULL AS odd, date_part('year', date_trunc('year', make_date(2024, 5, 6))) AS my, epoch_ms(to_timestamp(86400)) AS day""",
    """select o_orderkey as k, year(o_orderdate)::bigint as y, month(o_orderdate)::bigint as m, day(o_orderdate)::bigint as d, epoch_ms(o_orderdate::timestamp) as e, date_trunc('month', o_orderdate)::timestamp as tm,
      '2024' as dy, true as bad, true as odd, 2024::bigint as my, 86400000::bigint as day from orders""",
)
reads(
    "string_predicates",
    "MATCH (p:Part) RETURN count(CASE WHEN p.p_name STARTS WITH 'p' THEN 1 END) AS a, count(CASE WHEN p.p_type ENDS WITH 'L' THEN 1 END) AS b, count(CASE WHEN p.p_brand CONTAINS '1' THEN 1 END) AS c, count(CASE WHEN contains(p.p_brand, '2') AND NOT starts_with(p.p_brand, 'x') AND NOT ends_with(p.p_brand, '9') THEN 1 END) AS d",
    "select count(*) filter (starts_with(p_name, 'p')) as a, count(*) filter (ends_with(p_type, 'L')) as b, count(*) filter (contains(p_brand, '1')) as c, count(*) filter (contains(p_brand, '2') and not ends_with(p_brand, '9')) as d from part",
)
reads("in_list", "MATCH (e:Event) WHERE e.event_type IN ['click', 'view'] AND NOT e.user_id IN [1, 2, 3] RETURN e.event_type AS t, count(*) AS c", "select event_type as t, count(*) as c from events where event_type in ('click', 'view') and user_id not in (1, 2, 3) group by 1")
reads(
    "null_predicates",
    "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) RETURN count(CASE WHEN l IS NULL THEN 1 END) AS without, count(CASE WHEN l.quality IS NOT NULL THEN 1 END) AS with_, count(coalesce(l.quality, -1)) AS n, count(CASE WHEN exists(l.toxic) THEN 1 END) AS e",
    "select count(*) filter (l.doc_id is null) as without, count(l.quality) as with_, count(*) as n, count(l.toxic) as e from documents d left join labels l on l.doc_id = d.doc_id",
)
reads(
    "list_comprehension",
    "MATCH (n:Nation) RETURN n.n_name AS n, reduce(s = 0, x IN [i IN range(1, n.n_nationkey) WHERE i % 3 = 0 | i * n.n_nationkey] | s + x) AS s",
    "select n_name as n, coalesce((select sum(i * n_nationkey) from unnest(range(1, n_nationkey + 1)) t(i) where i % 3 = 0), 0)::bigint as s from nation",
)
reads(
    "quantifiers",
    "MATCH (n:Nation) WITH n, range(1, n.n_nationkey) AS l RETURN n.n_name AS n, any(x IN l WHERE x > 10) AS a, all(x IN l WHERE x < 20) AS b, none(x IN l WHERE x = 5) AS c, single(x IN l WHERE x = 7) AS d",
    "select n_name as n, n_nationkey > 10 as a, n_nationkey < 20 as b, n_nationkey < 5 as c, n_nationkey >= 7 as d from nation",
)
reads("reduce_fold", "MATCH (e:Event) WITH e.user_id AS u, collect(e.event_id) AS ids RETURN u, reduce(t = 0, i IN ids | t + i) AS s, reduce(t = '', i IN [1, 2] | t + toString(i)) AS x", "select user_id as u, sum(event_id)::bigint as s, '12' as x from events group by 1")
reads(
    "index_and_slice",
    "MATCH (n:Nation) RETURN n.n_name[0..3] AS a, n.n_name[-2..] AS b, [1, 2, 3][n.n_nationkey] AS c, [1, 2, 3][-1] AS d, size(range(0, n.n_nationkey)[2..-1]) AS e, n['n_name'] AS f",
    "select left(n_name, 3) as a, right(n_name, 2) as b, case n_nationkey when 0 then 1 when 1 then 2 when 2 then 3 end::bigint as c, 3::bigint as d, greatest(0, n_nationkey - 2)::bigint as e, n_name as f from nation",
)
reads(
    "map_projection",
    "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH n{.n_name, region: r.r_name, key: n.n_nationkey + 1, r} AS m RETURN m.n_name AS n, m.region AS r, m.key AS k, m.r_regionkey AS rk, size(keys(m)) AS s",
    "select n_name as n, r_name as r, (n_nationkey + 1)::bigint as k, r_regionkey as rk, 5::bigint as s from nation join region on n_regionkey = r_regionkey",
)
reads("map_literals", "MATCH (n:Nation) WITH {a: n.n_nationkey, 'b': {c: n.n_name}} AS m RETURN m.a AS a, m.b.c AS c, m['a'] + 1 AS d, m.zzz IS NULL AS z", "select n_nationkey as a, n_name as c, (n_nationkey + 1)::bigint as d, true as z from nation")
reads("parameters", "MATCH (c:Customer) WHERE c.c_acctbal >= $min AND c.c_mktsegment IN $segs AND $missing IS NULL RETURN count(*) AS c", "select count(*) as c from customer where c_acctbal >= 1000 and c_mktsegment in ('BUILDING', 'MACHINERY')", min=1000, segs=["BUILDING", "MACHINERY"])
reads(
    "graph_functions",
    "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n.n_name AS n, labels(n)[0] AS l, type(r) AS t, id(x) AS i, size(keys(n)) AS k, properties(n).n_name AS p",
    "select n_name as n, 'Nation' as l, 'IN_REGION' as t, n_regionkey::bigint as i, 3::bigint as k, n_name as p from nation",
)
reads(
    "null_arithmetic",
    "UNWIND [1, 2, null] AS x RETURN x, x + 1 AS a, x = null AS b, null AND false AS c, null OR true AS d, NOT null AS e, 'a' < 1 AS f, 1.5 / 0 AS g, 9223372036854775807 + x AS h",
    "select x::bigint as x, (x + 1)::bigint as a, null::boolean as b, false as c, true as d, null::boolean as e, null::boolean as f, null::double as g, null::bigint as h from (values (1), (2), (null)) t(x)",
)
reads(
    "percentile_groups",
    "MATCH (p:Part) RETURN p.p_brand AS brand, percentileDisc(p.p_size, 0.3) AS d, percentileDisc(DISTINCT p.p_size, 0.5) AS m, count(*) AS n",
    "select p_brand as brand, list_sort(list(p_size))[1 + floor(0.3 * (count(*) - 1))::int] as d, list_sort(list(distinct p_size))[1 + floor(0.5 * (count(distinct p_size) - 1))::int] as m, count(*) as n from part group by 1",
)
_ANGLES = {f: f"toInteger(round({f}(x) * 1000000)) AS {f}" for f in ("tan", "asin", "acos", "atan", "cot", "haversin", "sin", "cos")}
reads(
    "trigonometry",
    "MATCH (n:Nation) WITH toFloat(n.n_nationkey + 1) / 26 AS x RETURN " + ", ".join(_ANGLES.values()),
    "select " + ", ".join(f"round({'(1 - cos(x)) / 2' if f == 'haversin' else f'{f}(x)'} * 1000000)::bigint as {f}" for f in _ANGLES) + " from (select (n_nationkey + 1)::double / 26 as x from nation)",
)
reads(
    "function_aliases",
    "UNWIND [1] AS one RETURN string(1) AS a, cast_to_string(2) AS b, toInt('3') AS c, int64('4') AS d, cast_to_int64('5') AS e, double('1.5') AS f, cast_to_double('2.5') AS g, cast_to_date('2024-01-02') = date('2024-01-02') AS h,"
    " size(array_append([1], 2)) AS i, list_push_back([1], 2)[1] AS j, array_prepend([1], 0)[0] AS k, list_push_front([1], 0)[0] AS l, array_extract([7, 8], 1) = list_extract([7, 8], 1) AS m, array_contains([1], 1) AS n,"
    " list_has([1], 2) AS o, array_sort([2, 1])[0] AS p, size(array_distinct([1, 1])) AS q, size(make_list(1, 2, 3)) AS r, size(list_creation(1)) AS s, ln(1.0) AS t",
    "select '1' as a, '2' as b, 3::bigint as c, 4::bigint as d, 5::bigint as e, 1.5::double as f, 2.5::double as g, true as h, 2::bigint as i, 2::bigint as j, 0::bigint as k, 0::bigint as l, true as m, true as n, false as o, 1::bigint as p, 1::bigint as q, 3::bigint as r, 1::bigint as s, 0::double as t",
)
reads(
    "many_arguments",
    "UNWIND [1] AS one RETURN size(concat(" + ", ".join(["'x'"] * 150) + ")) AS a, coalesce(" + "null, " * 120 + "7) AS b, size(list_value(" + ", ".join(map(str, range(130))) + ")) AS c",
    "select 150::bigint as a, 7::bigint as b, 130::bigint as c",
)
reads("show_functions", "UNWIND show_functions() AS f WITH f WHERE f STARTS WITH 'percentile' RETURN f", "select unnest(['percentilecont', 'percentiledisc']) as f")
reads("rand_uuid_now", "MATCH (r:Region) RETURN r.r_name AS r, rand() < 1 AS a, size(randomUUID()) AS b, current_date() IS NOT NULL AS c, current_timestamp() IS NOT NULL AS d", "select r_name as r, true as a, 36::bigint as b, true as c, true as d from region")

# -- CSV ------------------------------------------------------------------------------------------------------------


def csv_copy(spark: SparkSession, df: DataFrame, header: bool, sep: str = ",") -> str:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=header, sep=sep)
    return path


@runs("load_csv_headers", "select n_name as name, n_regionkey::bigint as region from nation where n_nationkey > 3")
def _csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = csv_copy(spark, spark.read.parquet(f"{sf_dir}/nation.parquet"), True)
    return session(spark, sf_dir).cypher("LOAD CSV WITH HEADERS FROM $p AS row WITH row WHERE toInteger(row.n_nationkey) > 3 RETURN row.n_name AS name, toInteger(row.n_regionkey) AS region", {"p": path})


@runs("load_csv_list", "select n_name as name, 3::bigint as n from nation")
def _csv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = csv_copy(spark, spark.read.parquet(f"{sf_dir}/nation.parquet"), False)
    return session(spark, sf_dir).cypher("LOAD CSV FROM $p AS row RETURN row[1] AS name, size(row) AS n", {"p": path})


@runs("load_csv_delim", "select r_name as name, case when r_regionkey % 2 = 1 then r_regionkey::varchar end as k from region")
def _csv_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name", F.when(F.col("r_regionkey") % 2 == 1, F.col("r_regionkey")).alias("k"))
    return session(spark, sf_dir).cypher("LOAD CSV WITH HEADERS FROM $p AS row FIELDTERMINATOR ';' RETURN row.r_name AS name, row.k AS k", {"p": csv_copy(spark, df, True, ";")})


@runs("load_csv_correlated_match", "select r_name as region, count(*) as c from region join nation on n_regionkey = r_regionkey group by 1")
def _csv_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = csv_copy(spark, spark.read.parquet(f"{sf_dir}/region.parquet"), True)
    return session(spark, sf_dir).cypher("LOAD CSV WITH HEADERS FROM $p AS row MATCH (r:Region {r_name: row.r_name})<-[:IN_REGION]-(n:Nation) RETURN row.r_name AS region, count(n) AS c", {"p": path})


# -- writes ---------------------------------------------------------------------------------------------------------


def small(spark: SparkSession, sf_dir: str) -> GraphSession:
    """The whole test graph, to be written to: a statement touches only the tables it concerns."""
    return session(spark, sf_dir)


@runs("create_nodes", "select n_name as name, n_nationkey::bigint as k from nation union all select 'extra', null")
def _create_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (n:Nation) CREATE (:Copy {name: n.n_name, k: n.n_nationkey + 0})")
    g.cypher("CREATE (:Copy:Other {name: 'extra'})")
    return g.cypher("MATCH (c:Copy) RETURN c.name AS name, c.k AS k")


@runs("create_path", "select r_name as region, count(*) as c from nation join region on n_regionkey = r_regionkey group by 1")
def _create_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:HAS {w: 2}]->(x:Office {of: n.n_name})<-[:RUNS]-(r)")
    return g.cypher("MATCH (r:Region)-[:RUNS]->(x:Office)<-[h:HAS]-(n:Nation) WHERE h.w = 2 AND x.of = n.n_name RETURN r.r_name AS region, count(*) AS c")


@runs("merge_nodes", "select c_mktsegment as seg, count(*) - 1 as again, 1::bigint as made from customer group by 1")
def _merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (c:Customer) MERGE (s:Segment {name: c.c_mktsegment}) ON CREATE SET s.made = 1, s.again = 0 ON MATCH SET s.again = s.again + 1")
    return g.cypher("MATCH (s:Segment) RETURN s.name AS seg, s.again AS again, s.made AS made")


@runs("merge_edges", "select c_mktsegment as seg, n_name as nation from customer join nation on c_nationkey = n_nationkey group by 1, 2")
def _merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) MERGE (s:Segment {name: c.c_mktsegment}) MERGE (s)-[:SEEN_IN]->(n)")
    g.cypher("MATCH (s:Segment)-[:SEEN_IN]->(n) MERGE (s)-[r:SEEN_IN]->(n)")
    return g.cypher("MATCH (s:Segment)-[:SEEN_IN]->(n:Nation) RETURN s.name AS seg, n.n_name AS nation")


@runs("set_props", "select n_name || case when n_regionkey = 0 then '!' else '' end as name, case when n_regionkey = 0 then n_nationkey * 2 end::bigint as twice, n_regionkey = 0 as marked from nation")
def _set_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region {r_regionkey: 0}) SET n.n_name = n.n_name + '!', n.twice = n.n_nationkey * 2, n:Marked")
    return g.cypher("MATCH (n:Nation) RETURN n.n_name AS name, n.twice AS twice, 'Marked' IN labels(n) AS marked")


@runs("set_maps", "select r_name as name, case when r_regionkey = 1 then null else r_regionkey end as k, case when r_regionkey = 2 then 5 when r_regionkey = 1 then 7 end::bigint as x from region")
def _set_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (r:Region {r_regionkey: 2}) SET r += {x: 5}")
    g.cypher("MATCH (r:Region {r_regionkey: 1}) SET r = {x: 7, r_name: r.r_name}")
    return g.cypher("MATCH (r:Region) RETURN r.r_name AS name, r.r_regionkey AS k, r.x AS x")


@runs("remove_props", "select case when n_nationkey >= 5 then n_name end as name, 1::bigint as labels from nation")
def _remove_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (n:Nation) WHERE n.n_nationkey < 5 SET n:Small REMOVE n.n_name, n:Small")
    return g.cypher("MATCH (n:Nation) RETURN n.n_name AS name, size(labels(n)) AS labels")


@runs("detach_delete", "select (select count(*) from nation) - 3 as nations, (select count(*) from customer where c_nationkey >= 3) + (select count(*) from supplier where s_nationkey >= 3) as rest")
def _detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (n:Nation) WHERE n.n_nationkey < 3 DETACH DELETE n")
    return g.cypher("MATCH (n:Nation) WITH count(n) AS nations MATCH ()-[f:FROM_NATION]->() RETURN nations, count(f) AS rest")


@runs("delete_edges", "select 0::bigint as c, (select count(*) from nation) as n")
def _delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH ()-[f:IN_REGION]->() DELETE f")
    return g.cypher("MATCH (n:Nation) OPTIONAL MATCH (n)-[f:IN_REGION]->() RETURN count(f) AS c, count(n) AS n")


@runs("write_and_return", "select o_orderkey as k, o_totalprice > 100000 as big, o_orderstatus as status from orders where o_totalprice > 100000")
def _write_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).cypher("MATCH (o:Order) WHERE o.o_totalprice > 100000 SET o.big = true RETURN o.o_orderkey AS k, o.big AS big, o.o_orderstatus AS status")


@runs("create_and_return", "select n_name as name, n_nationkey * 2::bigint as twice, r_name as region from nation join region on n_regionkey = r_regionkey")
def _create_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:HAS]->(x:Office {twice: n.n_nationkey * 2}) RETURN n.n_name AS name, x.twice AS twice, r.r_name AS region")


@runs("merge_chain", "select r_name as region, 1::bigint as made, count(*) - 1 as seen from region join nation on n_regionkey = r_regionkey group by 1")
def _merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (r)-[h:HAS]->(o:Office {of: r.r_name}) ON CREATE SET o.made = 1, h.seen = 0 ON MATCH SET h.seen = h.seen + 1")
    return g.cypher("MATCH (r:Region)-[h:HAS]->(o:Office {of: r.r_name}) RETURN r.r_name AS region, o.made AS made, h.seen AS seen")


@runs("merge_orders", "select o_orderstatus as status, count(*) as n from orders group by 1")
def _merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hot keys: a node for each, and a relationship to it from every order."""
    g = small(spark, sf_dir)
    g.cypher("MATCH (o:Order) MERGE (s:Status {name: o.o_orderstatus}) MERGE (o)-[:IS]->(s)")
    return g.cypher("MATCH (o:Order)-[:IS]->(s:Status) RETURN s.name AS status, count(o) AS n")


@runs("delete_events", "select event_type as t, count(*) as n from events where event_type <> 'error' group by 1 union all select 'PERFORMED', count(*) from events where event_type <> 'error'")
def _delete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    g.cypher("MATCH (e:Event {event_type: 'error'}) DETACH DELETE e")
    return g.cypher("MATCH (e:Event) RETURN e.event_type AS t, count(*) AS n UNION ALL MATCH (c:Customer)-[r:PERFORMED]->(e) RETURN type(r), count(*)")


_REJECTED = ("CREATE (:Customer {c_custkey: 1, c_name: 'x'})", "MATCH (c:Customer {c_custkey: 1}) SET c.c_custkey = 2", "MATCH (c:Customer {c_custkey: 1}) REMOVE c.c_name", "CREATE (:Customer {c_custkey: -1, c_name: 'x', c_acctbal: 'text'})", "CREATE (:Customer {c_custkey: -1, c_name: 'new', c_acctbal: 1.0})")


@runs("constraint_rejects", "select i, i < 4 as rejected, (select count(*) from customer) + (i = 4)::int as customers from range(5) t(i)")
def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    for body in ("c.c_custkey IS UNIQUE", "c.c_name IS NOT NULL", "c.c_acctbal IS :: FLOAT"):
        g.cypher(f"CREATE CONSTRAINT FOR (c:Customer) REQUIRE {body}")
    out = []
    for i, text in enumerate(_REJECTED):
        rejected = False
        try:
            g.cypher(text)
        except ConstraintError:
            rejected = True
        out.append((i, rejected, g.cypher("MATCH (c:Customer) RETURN count(c) AS n").first().n))
    return spark.createDataFrame(out, "i long, rejected boolean, customers long")


@runs("bulk_lookups", "select n::bigint as n, kind, (kind in ('int', 'float'))::bigint as made from range(15, 18) t(n), (values ('int'), ('float'), ('text'), ('missing')) k(kind)")
def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of 15, 16 and 17 lookups by constants of an int property, by values of several types."""
    g = GraphSession(PropertyGraph(spark))
    g.cypher("UNWIND range(0, 20) AS i CREATE (:P {k: i})")
    values = {"int": str, "float": lambda i: f"{i}.0", "text": lambda i: f"'{i}'", "missing": lambda i: str(i or 99)}
    out = []
    for n in (15, 16, 17):
        for kind, value in values.items():
            now = GraphSession(g.graph)
            now.cypher(" ".join(f"MATCH (a{i}:P {{k: {value(i)}}})" for i in range(n)) + " CREATE (a0)-[:R]->(a1)")
            out.append((n, kind, now.cypher("MATCH ()-[r:R]->() RETURN count(r) AS n").first().n))
    return spark.createDataFrame(out, "n long, kind string, made long")


def _chain(spark: SparkSession) -> GraphSession:
    g = GraphSession(PropertyGraph(spark))
    g.cypher("UNWIND range(0, 150) AS i CREATE (:Hop {k: i})")
    g.cypher("MATCH (a:Hop), (b:Hop) WHERE b.k = a.k + 1 CREATE (a)-[:TO]->(b)")
    return g


@runs("long_walks", "select unnest([100, 101, 150])::bigint as hops")
def _long_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark).cypher("MATCH (a:Hop {k: 0})-[r:TO*99..150]->(b:Hop) WHERE b.k IN [100, 101, 150] RETURN size(r) AS hops")


@runs("long_shortest_paths", "select unnest([100, 101])::bigint as hops")
def _long_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark).cypher("MATCH p = shortestPath((a:Hop {k: 0})-[:TO*..101]->(b:Hop)) WHERE b.k IN [100, 101, 150] RETURN length(p) AS hops")


@runs("mandatory_match_fails", "select 'raised' as outcome")
def _mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        session(spark, sf_dir).cypher("MANDATORY MATCH (r:Region {r_name: 'NOWHERE'}) RETURN r")
        outcome = "none"
    except QueryRuntimeError:
        outcome = "raised"
    return spark.createDataFrame([(outcome,)], "outcome string")


@runs(
    "constraint_checks",
    "select * from (values ('not_null', 0::bigint), ('node_key', 0::bigint), ('type', 0::bigint), ('unique', 0::bigint), ('unique segment', (select count(*) from (select c_mktsegment from customer group by 1 having count(*) > 1)))) t(kind, c)",
)
def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph import Constraint

    g = small(spark, sf_dir)
    for body in ("c.c_custkey IS UNIQUE", "c.c_name IS NOT NULL", "(c.c_custkey, c.c_name) IS NODE KEY", "c.c_acctbal IS :: FLOAT"):
        g.cypher(f"CREATE CONSTRAINT FOR (c:Customer) REQUIRE {body}")
    checks = [(c.kind, c) for c in g.graph.constraints] + [("unique segment", Constraint("Customer", ("c_mktsegment",), "unique"))]
    out = None
    for kind, c in checks:
        df = g.graph.violations(c).agg(F.count("*").alias("c")).select(F.lit(kind).alias("kind"), "c")
        out = df if out is None else out.unionAll(df)
    return out


@runs("export_roundtrip", "select n_name as nation, n_nationkey::bigint as k, r_name as region, r_regionkey::bigint as rk from nation join region on n_regionkey = r_regionkey")
def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.export import export_cypher

    g = graph(spark, sf_dir)
    part = PropertyGraph(spark, g.nodes.only(lambda k: k[0] in ("Region", "Nation")), {"IN_REGION": g.edges["IN_REGION"]})
    again = GraphSession(PropertyGraph(spark))
    again.cypher(export_cypher(part))
    return again.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS nation, n.n_nationkey AS k, r.r_name AS region, r.r_regionkey AS rk")


@runs("store_roundtrip", "select c_name as client, c_mktsegment as seg, o_orderkey as k, o_totalprice as price, o_orderpriority as priority from customer join orders on o_custkey = c_custkey")
def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.store import load_graph, save_graph

    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    save_graph(graph(spark, sf_dir), path)
    return GraphSession(load_graph(spark, path)).cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_name AS client, c.c_mktsegment AS seg, o.o_orderkey AS k, o.o_totalprice AS price, o.o_orderpriority AS priority")


@runs("store_versions", "select i, i * i as sq, i = 3 as marked from range(1, 41) t(i)")
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement is committed; each session reads what the one before has left."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for text in ("UNWIND range(1, 50) AS i CREATE (:N {i: i})", "MATCH (n:N) WHERE n.i > 40 DELETE n", "MATCH (n:N) SET n.sq = n.i * n.i", "MATCH (n:N {i: 3}) SET n:Marked"):
        GraphSession.stored(spark, path).cypher(text)
    return GraphSession.stored(spark, path).cypher("MATCH (n:N) RETURN n.i AS i, n.sq AS sq, 'Marked' IN labels(n) AS marked")


@runs("host_api", "select * from (values ('node', 'A B', 'x'), ('edge', 'R', '2.5'), ('none', '-', '-'), ('counts', '3', '1'), ('matched', 'B', '2'), ('raised', 'no', 'end')) t(kind, a, b)")
def _host(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(PropertyGraph(spark))
    a, b, c = g.create_node(["A", "B"], {"name": "x", "k": 1}), g.create_node(["B"]), g.create_node(["C"], {"f": 1.5})
    r = g.create_edge("R", a, c, {"w": 2.5})
    node, edge = g.get_node(a), g.get_edge(r)
    rows = [("node", " ".join(node["labels"]), node["properties"]["name"]), ("edge", edge["type"], str(edge["properties"]["w"]))]
    rows += [("none", "-" if g.get_node(99) is None else "", "-" if g.get_edge(99) is None else ""), ("counts", str(g.node_count()), str(g.edge_count())), ("matched", "B", str(g.match_nodes("B").count()))]
    try:
        g.create_edge("R", b, 99)
    except QueryRuntimeError:
        rows.append(("raised", "no", "end"))
    return spark.createDataFrame(rows, "kind string, a string, b string")


#: Rows of every label and type of the test graph.
_ALL_PARTS = (
    " union all ".join(f"select '{x}' as label, count(*) as c from {t}" for x, t in [("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"), ("Turn", "conversations"), ("Document", "documents"), ("Label", "labels"), ("IN_REGION", "nation"), ("PLACED", "orders"), ("CONTAINS", "lineitem"), ("SUPPLIED_BY", "lineitem"), ("SUPPLIES", "lineitem"), ("PERFORMED", "events"), ("LABELLED", "labels")])
    + " union all select 'FROM_NATION', (select count(*) from customer) + (select count(*) from supplier)"
    + " union all select 'NEXT', sum(n - 1)::bigint from (select count(*) as n from events group by user_id)"
    + " union all select 'FOLLOWED_BY', sum(n - 1)::bigint from (select count(*) as n from conversations group by conv_id)"
)


@runs("store_roundtrip_all", _ALL_PARTS)
def _store_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.store import load_graph, save_graph

    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    save_graph(graph(spark, sf_dir), path)
    again, out = load_graph(spark, path), None
    for label, df in [*((k[0], df) for k, df in again.nodes.items()), *again.edges.items()]:
        counted = df.agg(F.count("*").alias("c")).select(F.lit(label).alias("label"), "c")
        out = counted if out is None else out.unionAll(counted)
    return out


@runs("export_parts", _ALL_PARTS)
def _export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.export import cypher_parts

    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    cypher_parts(graph(spark, sf_dir)).write.parquet(path)
    label = F.regexp_extract("part", r"^\(_\d+(?:\)-\[)?:(\w+)", 1)
    return spark.read.parquet(path).groupBy(label.alias("label")).agg(F.count("*").alias("c"))


@runs("json_rows", "select '{\"n\":{\"_id\":' || r_regionkey || ',\"_labels\":[\"Region\"],\"_properties\":{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}}}' as value from region")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.export import json_rows

    return json_rows(session(spark, sf_dir).cypher("MATCH (n:Region) RETURN n"))


@runs("json_values", "select '{\"l\":[1,2],\"d\":\"2024-01-02\",\"n\":1,\"m\":{\"a\":\"ALGERIA\"}}' as value")
def _json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.export import json_rows

    return json_rows(session(spark, sf_dir).cypher("MATCH p = (n:Nation {n_nationkey: 0})-[:IN_REGION]->(r:Region) RETURN [1, 2] AS l, date('2024-01-02') AS d, length(p) AS n, {a: 'ALGERIA'} AS m"))


# -- the log scenario on events -------------------------------------------------------------------------------------


def logs(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Clients, and their requests as chains of log entries: each event is an entry, chained to the user's next."""
    g = graph(spark, sf_dir)
    kinds = ("PERFORMED", "NEXT")
    ends = {t: g.ends[t] for t in kinds}
    return GraphSession(PropertyGraph(spark, g.nodes.only(lambda k: k[0] in ("Customer", "Event")), g.edges.only(kinds.__contains__), ends, g.carried.only(lambda k: k[0] == "PERFORMED")))


def logged(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: logs(spark, sf_dir).cypher(text)
    ORACLE[name] = sql


logged("access_log_request", "MATCH (e:Event {user_id: 7}) RETURN e.event_id AS id, e.event_type AS layer ORDER BY id", "select event_id as id, event_type as layer from events where user_id = 7")
logged("access_log_clients", "MATCH (c:Customer)-[:PERFORMED]->(e:Event) RETURN c.c_name AS client, e.event_id AS id", "select c_name as client, event_id as id from events join customer on c_custkey = user_id")
logged(
    "access_log_hops",
    "MATCH (c:Customer)-[:PERFORMED]->(a:Event {event_type: 'error'})-[:NEXT*1..2]->(b:Event) RETURN c.c_custkey AS c, count(b) AS hops",
    _EVENTS + "w as (select 1) select c, count(*) as hops from (select user_id as c, x.b from events join nx x on x.a = event_id where event_type = 'error' and x.b is not null union all select user_id, y.b from events join nx x on x.a = event_id join nx y on y.a = x.b where event_type = 'error' and y.b is not null) group by 1",
)
logged("access_log_requests", "MATCH (c:Customer)-[:PERFORMED]->(e:Event) RETURN c.c_mktsegment AS seg, count(DISTINCT c) AS clients, count(e) AS requests", "select c_mktsegment as seg, count(distinct c_custkey) as clients, count(*) as requests from events join customer on c_custkey = user_id group by 1")
logged(
    "access_log_stuffing",
    "MATCH (c:Customer)-[:PERFORMED]->(e:Event {event_type: 'error'}) WITH c, count(e) AS attempts WHERE attempts >= 3 RETURN c.c_custkey AS c, attempts",
    "select user_id as c, count(*) as attempts from events where event_type = 'error' group by 1 having count(*) >= 3",
)
logged(
    "access_log_error_ratio",
    "MATCH (c:Customer)-[:PERFORMED]->(e:Event) WITH c, count(*) AS total, count(CASE WHEN e.event_type = 'error' THEN 1 END) AS errors WHERE errors > 0 RETURN c.c_custkey AS c, toFloat(errors) / total AS ratio",
    "select user_id as c, (count(*) filter (event_type = 'error'))::double / count(*) as ratio from events group by 1 having count(*) filter (event_type = 'error') > 0",
)
logged(
    "access_log_followed",
    "MATCH (a:Event {event_type: 'signup'})-[:NEXT]->(b:Event) WHERE NOT EXISTS { (b)-[:NEXT]->(:Event {event_type: 'error'}) } RETURN b.event_type AS t, count(*) AS c",
    _EVENTS + "w as (select 1) select e2.event_type as t, count(*) as c from events e1 join nx x on x.a = e1.event_id join events e2 on e2.event_id = x.b left join nx y on y.a = x.b left join events e3 on e3.event_id = y.b where e1.event_type = 'signup' and (e3.event_type is null or e3.event_type <> 'error') group by 1",
)

# -- streaming ------------------------------------------------------------------------------------------------------


@runs("streaming_merge", "select event_type as kind, count(*) as n from events group by 1")
def _streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.ingest import merge_stream

    source = os.path.dirname(f"{sf_dir}/x") + "/events.parquet"
    schema = spark.read.parquet(source).schema
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source.removesuffix("events.parquet"), pathGlobFilter="events.parquet")
    g = GraphSession(PropertyGraph(spark))
    merge_stream(g, stream, "UNWIND $rows AS row WITH row MERGE (k:Kind {name: row.event_type}) ON CREATE SET k.n = 1 ON MATCH SET k.n = k.n + 1", path).awaitTermination()
    return g.cypher("MATCH (k:Kind) RETURN k.name AS kind, k.n AS n")
