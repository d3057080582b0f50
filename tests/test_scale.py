"""Work that must not grow with pairs, paths or rounds, and the results beside it."""

import random
from collections import defaultdict

from graphloom.operators import analysis as N
from graphloom.operators import structure as S
from graphloom.operators import traversal as T


def test_vector_groups_are_exact_and_ties_hold(spark):
    rnd = random.Random(5)
    vectors = {i: [rnd.gauss(0, 1) for _ in range(6)] for i in range(70)}
    vectors |= {i + 100: vectors[i] for i in range(0, 70, 3)}  # exact copies: ties by the id
    rows = spark.createDataFrame(list(vectors.items()), "id bigint, v array<double>").repartition(5)
    want = {}
    for i, a in vectors.items():
        ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, j) for j, b in vectors.items() if j != i)
        want[i] = [(j, round(-s, 9)) for s, j in sorted((round(s, 12), j) for s, j in ranked)[:3]]
    found = N.nearest_vectors(rows, "v", 3, -1.0, block=8, group=20)
    got = {}
    for r in found.collect():
        got.setdefault(r.node, []).append((r.neighbour, round(r.similarity, 9)))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # vectors are not sent about


def _tree(spark):
    """A root with 5 children of 40 leaves each, some of which have a leaf, and a ring of 4 beside it."""
    up = [(i, 0) for i in range(1, 6)] + [(10 + i, 1 + i % 5) for i in range(200)] + [(500 + i, 10 + i) for i in range(7)] + [(900, 901), (901, 902), (902, 903), (903, 900), (904, 900)]
    return sorted({x for e in up for x in e}), up, spark.createDataFrame(up, "src bigint, dst bigint")


def _hops(near, start):
    depth, todo = {start: 0}, [start]
    for u in todo:
        for v in near[u]:
            if v not in depth:
                depth[v] = depth[u] + 1
                todo.append(v)
    return depth


def _starts(monkeypatch):
    """The number of nodes that each all-pairs search starts from."""
    seen, plain = [], S.reach
    monkeypatch.setattr(S, "reach", lambda edges, sources, *a: (seen.append(sources.count()), plain(edges, sources, *a))[1])
    return seen


def test_betweenness_folds_trees(spark, monkeypatch):
    nodes, pairs, edges = _tree(spark)
    near, seen = defaultdict(set), _starts(monkeypatch)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want, far = defaultdict(float), {s: _hops(near, s) for s in nodes}
    ways = {}
    for s in nodes:
        n = defaultdict(int, {s: 1})
        for u in sorted(far[s], key=far[s].get):
            for v in near[u]:
                n[v] += n[u] * (far[s][v] == far[s][u] + 1)
        ways[s] = n
    for s in nodes:
        for t in far[s]:
            for u in far[s]:
                if u not in (s, t) and far[s][u] + far[u][t] == far[s][t]:
                    want[u] += ways[s][u] * ways[u][t] / ways[s][t] / 2
    got = S.betweenness_centrality(spark.createDataFrame([(x,) for x in nodes], "id bigint"), edges, False, False).collect()
    assert {r.node: round(r.betweenness_centrality, 6) for r in got} == {x: round(want[x], 6) for x in nodes}
    assert seen == [5]  # the ring and what is left of the tree, not each node


def test_distances_fold_trees(spark, monkeypatch):
    nodes, pairs, edges = _tree(spark)
    edges = edges.union(edges.where("src != 904").selectExpr("dst", "src"))  # 904 is reached from nowhere, so it cannot be folded
    near, seen = defaultdict(set), _starts(monkeypatch)
    for a, b in edges.collect():
        near[a].add(b)
    got = {r.node: r for r in S.distances(spark.createDataFrame([(x,) for x in nodes], "id bigint"), edges).collect()}
    for s in nodes:
        far = [d for d in _hops(near, s).values() if d]
        assert (got[s].eccentricity, got[s].total) == (max(far), sum(far)) and abs(got[s].harmonic - sum(1 / d for d in far)) < 1e-9 and abs(got[s].closeness - len(far) / sum(far)) < 1e-9
    assert seen == [6]


def test_set_cover_takes_no_round_for_each_set(spark, monkeypatch):
    rnd, written = random.Random(2), []
    pairs = sorted({(rnd.randrange(80), rnd.randrange(30)) for _ in range(200)} | {(1000 + i, 2000 + i) for i in range(20)})
    left, want = set(pairs), set()
    while left:
        count = defaultdict(int)
        for _, b in left:
            count[b] += 1
        want.add(top := min(count, key=lambda k: (-count[k], k)))
        closed = {a for a, b in left if b == top}
        left = {x for x in left if x[0] not in closed}
    plain = S.cut
    monkeypatch.setattr(S, "cut", lambda df: (written.append(1), plain(df))[1])
    got = S.set_cover(spark.createDataFrame(pairs, "element bigint, containing_set bigint")).collect()
    assert {r.containing_set for r in got} == want and len(got) == len(want) > 30 and len(written) < 12


def test_reach_walks_an_edge_once_for_many_sources(spark, monkeypatch):
    edges = spark.createDataFrame([(i, 1000) for i in range(70)] + [(1000, 2000 + i) for i in range(50)], "src bigint, dst bigint")
    sizes, plain = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    got = T.reach(edges, spark.range(70))
    assert max(sizes) < 300  # not a row for each of 70 sources and 50 ends
    want = {(i, i, 0) for i in range(70)} | {(i, 1000, 1) for i in range(70)} | {(i, 2000 + j, 2) for i in range(70) for j in range(50)}
    assert sorted(map(tuple, got.select("source", "node", "depth").collect())) == sorted(want)


def test_voronoi_cells_hold_one_center_for_each_node(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("searched from each center by itself")

    monkeypatch.setattr(S, "reach", refuse)
    rnd = random.Random(4)
    pairs, centers, near = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(110)], [5, 17, 40], defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    far = {c: _hops(near, c) for c in centers}
    want = {n: min((far[c][n], c) for c in centers if n in far[c])[1] for n in range(60) if any(n in far[c] for c in centers)}
    got = S.voronoi_cells(spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.createDataFrame([(c,) for c in centers], "id bigint")).collect()
    assert {r.node: r.center for r in got} == want and len(got) == len(want)


def test_weights_without_paths(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randrange(30), rnd.randrange(30), rnd.randrange(1, 9)) for _ in range(120)]
    edges, starts = spark.createDataFrame(pairs, "src bigint, dst bigint, weight bigint"), spark.createDataFrame([(0,), (7,)], "id bigint")
    bare = T.weighted_shortest(edges, starts, paths=False)
    assert bare.columns == ["source", "node", "weight"]
    want = {}
    for s in (0, 7):
        best = {s: 0.0}
        for _ in range(30):
            for a, b, w in pairs:
                if a in best and best[a] + w < best.get(b, float("inf")):
                    best[b] = best[a] + w
        want |= {(s, n): w for n, w in best.items()}
    assert {(r.source, r.node): r.weight for r in bare.collect()} == want == {(r.source, r.node): r.weight for r in T.weighted_shortest(edges, starts).collect()}


def test_bipartite_needs_no_double_cover(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("components of the double cover")

    monkeypatch.setattr(S, "weakly_connected_components", refuse)
    nodes = spark.range(12)
    ring = [(i, (i + 1) % 8) for i in range(8)]
    for pairs, even in ((ring, True), ([*ring, (0, 2)], False), ([*ring, (0, 3), (9, 10)], True), ([*ring, (9, 9)], False), ([(8, 9), (9, 10), (10, 8)], False)):
        assert S.is_bipartite(nodes, spark.createDataFrame(pairs, "src bigint, dst bigint")).first()[0] == even
