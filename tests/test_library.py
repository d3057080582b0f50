"""Library functions, procedures, updates as text, and structure algorithms against brute force on small random graphs."""

import itertools
import random

import pytest

from graphloom.graph import Graph, Rel
from graphloom.operators import structure as S
from graphloom.plans import run_query, run_update


def one(spark, text, **params):
    return run_query(Graph(spark), text, **params).first()[0]


CASES = [
    ("collections.sum([1, 2, 3])", 6.0), ("collections.sum_longs([1, 2])", 3), ("collections.avg([1, 3])", 2.0), ("collections.max([1, 3])", 3),
    ("collections.contains_all([1, 2, 3], [1, 3])", True), ("collections.intersection([1, 2], [2, 3])", [2]), ("collections.disjunction([1, 2], [2, 3])", [1, 3]),
    ("collections.partition([1, 2, 3], 2)", [[1, 2], [3]]), ("collections.pairs([1, 2])", [[1, 2], [2, None]]), ("collections.duplicates([1, 1, 2])", [1]),
    ("collections.frequencies_as_map([1, 1, 2])", {1: 2, 2: 1}), ("collections.split([1, 0, 2, 3], 0)", [[1], [2, 3]]), ("collections.remove_all([1, 2, 1], [1])", [2]),
    ("map.from_lists(['a', 'b'], [1, 2])", {"a": 1, "b": 2}), ("map.set_key(map.from_lists(['a'], [1]), 'a', 2)", {"a": 2}), ("map.from_pairs([['a', 'b']])", {"a": "b"}),
    ("map.merge(map.from_lists(['a', 'b'], [1, 2]), map.from_lists(['a'], [3]))", {"b": 2, "a": 3}), ("map.from_values(['a', 'b', 'c', 'd'])", {"a": "b", "c": "d"}),
    ("text.join(['a', 'b'], '-')", "a-b"), ("text.distance('abc', 'abd')", 1), ("text.indexOf('hello', 'l')", 2), ("text.format('{}-{}', 'a', 'b')", "a-b"),
    ("text.regreplace('a1b2', '[0-9]+', '#')", "a#b#"), ("text.compare_cleaned('A-b', 'ab')", True), ("math.round(1.257, 2)", 1.26),
    ("util.md5(['a', 'b'])", "187ef4436122d1cc2f40dc2b92f0eba0"), ("keys({a: 1, b: null})", ["a"]),
    ("point.distance(point({x: 0.0, y: 0.0}), point({x: 3.0, y: 4.0}))", 5.0), ("point.withinbbox({x: 1, y: 1}, {x: 0, y: 0}, {x: 2, y: 2})", True),
    ("vector_search.cosine_similarity([1.0, 0.0], [1.0, 0.0])", 1.0), ("date.parse('1970-01-02 00:00:00', 'yyyy-MM-dd HH:mm:ss')", 86400000), ("replace('a{b', '{', '}')", "a}b"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_functions(spark, text, want):
    assert one(spark, f"RETURN {text} AS x") == want


def people(spark):
    v = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 3)], "id bigint, name string, age int")
    e = spark.createDataFrame([(0, 0, 1, 5.0), (1, 1, 2, 1.0), (2, 0, 2, 9.0)], "id bigint, src bigint, dst bigint, weight double")
    return Graph(spark, {"Person": v}, (Rel("KNOWS", "Person", "Person", e),))


def names(graph, text="MATCH (n:Person) RETURN n.name AS x"):
    return sorted(map(str, (r[0] for r in run_query(graph, text).collect())))


def test_updates(spark):
    g = people(spark)
    made = run_update(g, "MATCH (a:Person {name: 'a'}) CREATE (a)-[:LIKES {since: 3}]->(b:Pet {name: 'rex'})")
    assert run_query(made, "MATCH (a:Person)-[e:LIKES]->(p:Pet) RETURN a.name AS a, e.since AS s, p.name AS p").collect() == [("a", 3, "rex")]
    assert names(run_update(g, "MERGE (n:Person {name: 'a'})")) == ["a", "b", "c"]
    assert names(run_update(g, "MERGE (n:Person {name: 'z'})")) == ["a", "b", "c", "z"]
    assert names(run_update(g, "MATCH (n:Person) WHERE n.age > 1 SET n.name = toUpper(n.name)")) == ["B", "C", "a"]
    assert names(run_update(g, "MATCH (n:Person {name: 'a'}) SET n += {name: 'q', age: 9}"), "MATCH (n:Person) RETURN n.age AS x") == ["2", "3", "9"]
    assert names(run_update(g, "MATCH (n:Person {name: 'a'}) REMOVE n.name")) == ["None", "b", "c"]
    cut_off = run_update(g, "MATCH (n:Person {name: 'b'}) DETACH DELETE n")
    assert names(cut_off) == ["a", "c"] and names(cut_off, "MATCH (:Person)-[e:KNOWS]->(:Person) RETURN e.weight AS x") == ["9.0"]
    with pytest.raises(ValueError):
        run_update(g, "MATCH (n:Person {name: 'b'}) DELETE n")
    assert names(run_update(g, "MATCH (:Person)-[e:KNOWS]->(:Person) WHERE e.weight > 4 DELETE e"), "MATCH (:Person)-[e:KNOWS]->(:Person) RETURN e.weight AS x") == ["1.0"]
    assert names(run_update(g, "FOREACH (i IN ['x', 'y'] | CREATE (n:Person {name: i}))")) == ["a", "b", "c", "x", "y"]


def test_clauses(spark, tmp_path):
    g = people(spark)
    (tmp_path / "f.csv").write_text("k,v\n1,one\n2,\n")
    assert run_query(g, f"LOAD CSV FROM '{tmp_path}/f.csv' WITH HEADER AS row RETURN row.k AS k, row.v AS v").collect() == [("1", "one"), ("2", "")]
    assert run_query(g, f"LOAD CSV FROM '{tmp_path}/f.csv' NO HEADER AS row RETURN row[0] AS k").count() == 3
    got = run_query(g, "MATCH (a:Person {name: 'a'})-[p *WSHORTEST (e, n | e.weight) total]->(b:Person) RETURN b.name AS b, total, size(p) AS n ORDER BY b").collect()
    assert got == [("b", 5.0, 1), ("c", 6.0, 2)]
    assert run_query(g, "MATCH (a:Person {name: 'a'})-[p *WSHORTEST 1 (e, n | e.weight) total]->(b:Person {name: 'c'}) RETURN total").first()[0] == 9.0
    assert run_query(g, "CALL pagerank.get() YIELD node, rank RETURN node.name AS name ORDER BY rank DESC LIMIT 1").first()[0] == "c"
    assert run_query(g, "CALL neighbors.at_hop(0, ['KNOWS'], 1) YIELD node RETURN count(*) AS n").first()[0] == 2
    assert run_query(g, "CALL { MATCH (n:Person) RETURN max(n.age) AS top } MATCH (m:Person) WHERE m.age = top RETURN m.name AS x").first()[0] == "c"
    assert run_query(g, "USING HOPS LIMIT 5 MATCH (n:Person) RETURN count(*) AS n").first()[0] == 3
    assert "Physical Plan" in run_query(g, "EXPLAIN MATCH (n:Person) RETURN n.name AS x").first()[0]
    with pytest.raises(SyntaxError):
        run_query(g, "CALL no.such() YIELD x RETURN x")


def closure(n, pairs):
    to = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b in pairs:
            for v in to:
                if a in to[v]:
                    to[v].add(b)
    return to


@pytest.mark.parametrize("seed", [2])
def test_structure(spark, seed):
    rnd, n = random.Random(seed), 9
    pairs = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(11)})
    v, e = spark.range(n).select("id"), spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id bigint, src bigint, dst bigint")
    to = closure(n, pairs)
    assert {r.node: r.component_id for r in S.strongly_connected_components(v, e).collect()} == {a: min(b for b in to[a] if a in to[b]) for a in to}
    plain = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    both = plain + [(b, a) for a, b in plain]
    weak = {p for p in plain if p[1] not in closure(n, [q for q in both if q not in (p, p[::-1])])[p[0]]}
    assert {(r.node_from, r.node_to) for r in S.bridges(v, e).collect()} == weak
    colours = {r.node: r.color for r in S.colouring(v, e).collect()}
    assert len(colours) == n and all(colours[a] != colours[b] for a, b in plain)
    match = [(r.src, r.dst) for r in S.maximal_matching(e).collect()]
    ends = set(itertools.chain(*match))
    assert len(ends) == 2 * len(match) and all(a in ends or b in ends for a, b in plain)
    odd = not any(all(s >> a & 1 != s >> b & 1 for a, b in pairs) for s in range(2**n))
    assert S.is_bipartite(v, e).first()[0] == (not odd)
    want = dict.fromkeys(range(n), 0.0)
    steps = {a: {b for x, b in pairs if x == a and b != a} for a in range(n)}
    for s in range(n):
        level, seen, routes = [(s,)], {s: 0}, []
        while level:
            level = [(*p, b) for p in level for b in steps[p[-1]] if seen.setdefault(b, len(p)) == len(p)]
            routes += level
        for t in {p[-1] for p in routes}:
            own = [p for p in routes if p[-1] == t]
            for p in own:
                for x in p[1:-1]:
                    want[x] += 1 / len(own)
    got = {r.node: round(r.betweenness_centrality, 6) for r in S.betweenness_centrality(v, e, True, False).collect()}
    assert got == {k: round(x, 6) for k, x in want.items()}


def test_communities_and_cover(spark):
    groups = [(a, b) for g in (0, 5) for a, b in itertools.combinations(range(g, g + 5), 2)] + [(4, 5)]
    v, e = spark.range(10).select("id"), spark.createDataFrame(groups, "src bigint, dst bigint")
    found = S.louvain(v, e)
    parts = {r.node: r.community_id for r in found.collect()}
    assert {frozenset(k for k in parts if parts[k] == c) for c in parts.values()} == {frozenset(range(5)), frozenset(range(5, 10))}
    assert abs(S.modularity(e, found).first()[0] - (20 / 21 - 0.5)) < 1e-9
    cover = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (3, 8), (4, 8), (4, 9)], "element bigint, containing_set bigint")
    assert sorted(r[0] for r in S.set_cover(cover).collect()) == [7, 8]
    loop = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 2, 0), (3, 1, 0)], "id bigint, src bigint, dst bigint")
    assert sorted(r.nodes for r in S.cycles(loop).collect()) == [[0, 1], [0, 1, 2]]
    assert {r.node: r.center for r in S.voronoi_cells(loop, spark.createDataFrame([(2,)], "id bigint")).collect()} == {0: 2, 1: 2, 2: 2}
    assert S.bridges(v.limit(0), e.limit(0)).count() == 0 and S.strongly_connected_components(v.limit(0), e.limit(0)).count() == 0


def test_cycles_of_any_length(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(2, 0), (6, 5)], "src bigint, dst bigint")
    assert sorted(r.nodes for r in S.cycles(ring).collect()) == [[0, 1, 2], [0, 1, 2, 3, 4, 5]]
    assert sorted(r.nodes for r in S.cycles(ring, directed=False).collect()) == [[0, 1, 2], [0, 1, 2, 3, 4, 5], [0, 2, 3, 4, 5]]
