"""Graph queries against SQL on the smallest tables, and traversals and algorithms on small graphs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import queries as Q
from graphloom.graph import Graph, Rel
from graphloom.operators import algorithms as A
from graphloom.operators import traversal as P
from graphloom.plans import run_query
from graphloom.sources import load_csv, load_jsonl
from graphloom.streaming import ingest, read_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, sql, name):
    got = Q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    made = sql.execute(Q.SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in made.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect()) == want


@pytest.fixture(scope="module")
def bfs_graph(spark):
    """Six vertices, nine edges, one self-loop."""
    rows = [(0, 1), (1, 2), (2, 4), (2, 5), (4, 1), (4, 5), (5, 3), (5, 4), (5, 5)]
    e = spark.createDataFrame([(i, a, b, 1.0 + i) for i, (a, b) in enumerate(rows)], "id bigint, src bigint, dst bigint, weight double")
    return spark.range(6).select("id"), e


def test_open_length_gives_every_trail(spark):
    # 0 -> 1 -> 2 -> 0 and 0 -> 2: two ways to 2, and trails back to the start
    edges = spark.createDataFrame([(10, 0, 1), (11, 1, 2), (12, 2, 0), (13, 0, 2)], "id bigint, src bigint, dst bigint")
    got = sorted((r.node, r.rels) for r in P.trails(edges, spark.createDataFrame([(0,)], "id bigint"), 1, None).collect())
    ends, todo, want = {i: (a, b) for i, a, b in edges.collect()}, [(0, [])], []
    while todo:
        node, rels = todo.pop()
        more = [(b, [*rels, i]) for i, (a, b) in ends.items() if a == node and i not in rels]
        want, todo = want + more, todo + more
    assert got == sorted(want) and sum(n == 2 for n, _ in got) > 1 and any(n == 0 for n, _ in got)
    nodes = spark.createDataFrame([(i,) for i in range(3)], "id bigint")
    graph = Graph(spark, {"N": nodes}, (Rel("E", "N", "N", edges),))
    for low in (1, 2):
        rows = run_query(graph, f"MATCH (a:N)-[e*{low}..]->(b:N) WHERE a.id = 0 RETURN b.id AS b, [x IN e | id(x)] AS e").collect()
        assert sorted((r.b, r.e) for r in rows) == sorted((n, r) for n, r in want if len(r) >= low)


def test_reach_and_trails(spark, bfs_graph):
    _, e = bfs_graph
    start = spark.createDataFrame([(0,)], "id bigint")
    assert {r.node: r.depth for r in P.reach(e, start).collect()} == {0: 0, 1: 1, 2: 2, 4: 3, 5: 3, 3: 4}
    assert sorted((r.node, len(r.rels)) for r in P.trails(e, start, 0, 2).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert P.both_ways(e).count() == 17
    ranked = P.k_shortest(e, 0, 4, 5, 6).collect()
    assert [r.nodes for r in ranked] == [[0, 1, 2, 4], [0, 1, 2, 5, 4]]
    every = P.all_shortest(e, start).where("node = 5").collect()
    assert len(every) == 1 and every[0].rels == [0, 1, 3]


def test_weighted(spark, bfs_graph):
    _, e = bfs_graph
    found = {r.node: (r.weight, r.path) for r in P.weighted_shortest(e, spark.createDataFrame([(0,)], "id bigint")).collect()}
    assert found[4] == (6.0, [0, 1, 2, 4]) and found[3] == (14.0, [0, 1, 2, 5, 3])
    bad = e.withColumn("weight", -F.col("weight"))
    with pytest.raises(Exception, match="weights"):
        P.weighted_shortest(bad, spark.createDataFrame([(0,)], "id bigint")).collect()


def test_pagerank_chain(spark):
    v, e = spark.range(5), spark.createDataFrame([(i, i + 1) for i in range(4)], "src bigint, dst bigint")
    got = {r.node: round(r["rank"], 3) for r in A.pagerank(v, e, stop=1e-6).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.081, 0.15, 0.209, 0.259, 0.301], abs=0.002)


def test_small_algorithms(spark, bfs_graph):
    v, e = bfs_graph
    assert {r.component_id for r in A.weakly_connected_components(v, e).collect()} == {0}
    assert A.weakly_connected_components(v.limit(0), e.limit(0)).count() == 0
    assert {r.node: r.core for r in A.core_number(v, e).collect()} == {0: 1, 3: 1, 1: 2, 2: 2, 4: 2, 5: 2}
    assert A.triangles(e).count() == 2
    dag = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "src bigint, dst bigint")
    assert [r.node for r in A.topological_sort(spark.range(4), dag).orderBy("place").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        A.topological_sort(v, e)
    assert A.minimum_spanning_forest(e.select("src", "dst", "weight")).count() == 5
    assert [r.id for r in A.isolates(spark.range(5), dag).collect()] == [4]


def test_language(spark):
    people = spark.createDataFrame([(1, "Ann", 30), (2, "Bob", None), (3, "Eve", 25)], "id bigint, name string, age int")
    knows = spark.createDataFrame([(10, 1, 2), (11, 2, 3), (12, 3, 3)], "id bigint, src bigint, dst bigint")
    g = Graph(spark, {"Person": people}, (Rel("KNOWS", "Person", "Person", knows),))
    run = lambda q, **p: [tuple(r) for r in run_query(g, q, **p).collect()]
    assert run("MATCH (p:Person) RETURN p.name AS n ORDER BY p.age") == [("Eve",), ("Ann",), ("Bob",)]
    assert sorted(run("MATCH (a:Person)-[:KNOWS]-(b:Person) RETURN a.name AS a, b.name AS b")) == [("Ann", "Bob"), ("Bob", "Ann"), ("Bob", "Eve"), ("Eve", "Bob"), ("Eve", "Eve")]
    assert run("MATCH (p:Person {name: $n}) RETURN p.age + 1 AS x", n="Ann") == [(31,)]
    assert run("MATCH (p:Person) WHERE p.age < 0 RETURN p.name AS n, sum(p.age) AS s") == []
    assert run("RETURN 3 / 2 <> 7.5 / 5 AS x, null = null AS y, [1, 2, 3][0] AS z") == [(True, None, 1)]
    assert run("MATCH (p:Person) OPTIONAL MATCH (p)-[:KNOWS]->(q:Person {name: 'Eve'}) RETURN p.name AS p, q.name AS q ORDER BY p.name") == [("Ann", None), ("Bob", "Eve"), ("Eve", "Eve")]
    with pytest.raises(SyntaxError):
        run("MATCH (p:Person) RETURN 1 AS a UNION MATCH (p:Person) RETURN 1 AS b")
    with pytest.raises(Exception, match="still has"):
        g.delete_nodes("Person", F.col("id") == 1).rel_table().collect()
    assert g.delete_nodes("Person", F.col("id") == 1, detach=True).rel_table().count() == 2
    more = g.merge_nodes("Person", spark.createDataFrame([("Ann",), ("Zed",), ("Zed",)], "name string"), ["name"])
    assert more.nodes["Person"].count() == 4
    assert g.violations("Person", exists="age").count() == 1
    assert g.schema_info().count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,\n2,x\n")
    assert [tuple(r) for r in load_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", ""), ("2", "x")]
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    assert load_jsonl(spark, str(tmp_path / "a.json")).count() == 2
    spark.range(10).write.parquet(str(tmp_path / "in"))
    ingest(read_files(spark, str(tmp_path / "in"), "id bigint"), lambda b: b.where("id > 4"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
