"""Graph algorithms that are sequential by nature, as plain functions over one component's nodes and edges.

run() deals the components over tasks: one component is one group, so memory is bounded by the largest component. What Spark can do in rounds is in
algorithms.py and structure.py; these kernels are for backtracking, depth-first orders, flows and spectra.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algorithms import weakly_connected_components

Edge = tuple
Kernel = Callable[[list, list], Iterable[tuple]]


def run(vertices: DataFrame, edges: DataFrame, kernel: Kernel, schema: str, whole: bool = False) -> DataFrame:
    """kernel(nodes, edges) for each weak component, or once for the whole graph. Edges are (src, dst, weight); nodes and edges are sorted."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    own = edges.select("src", "dst", weight.alias("weight"))
    if whole:
        near = vertices.select(F.lit(0).cast("bigint").alias("c"), F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(None).cast("double").alias("weight"))
        rows = near.unionByName(own.withColumn("c", F.lit(0).cast("bigint")))
    else:
        parts = weakly_connected_components(vertices, own)
        near = parts.select(F.col("component_id").alias("c"), F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(None).cast("double").alias("weight"))
        rows = near.unionByName(own.join(parts.select(F.col("node").alias("src"), F.col("component_id").alias("c")), "src"))
    names = [p.strip().split(" ")[0] for p in _fields(schema)]

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        ends = frame[frame["dst"].notna()]
        nodes = sorted({int(x) for x in frame.loc[frame["dst"].isna(), "src"]})
        found = kernel(nodes, sorted((int(a), int(b), float(w)) for a, b, w in zip(ends["src"], ends["dst"], ends["weight"], strict=True)))
        return pd.DataFrame(list(found), columns=names)

    return rows.groupBy("c").applyInPandas(apply, schema)


def _fields(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def plain(edges: list[Edge]) -> dict[int, set[int]]:
    """Undirected neighbours without self-loops."""
    near: dict[int, set[int]] = {}
    for a, b, *_ in edges:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def forward(edges: list[Edge]) -> dict[int, list[int]]:
    out: dict[int, set[int]] = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)
    return {a: sorted(s) for a, s in out.items()}


# depth-first orders

def depth_first(near: dict[int, list[int]], source: int, limit: int | None = None) -> tuple[list[int], list[int], dict[int, int]]:
    """(preorder, postorder, parent of each node but the source), neighbours in order."""
    before, after, parent = [source], [], {}
    seen, stack = {source}, [(source, iter(near.get(source, ())), 0)]
    while stack:
        node, todo, depth = stack[-1]
        for n in todo:
            if n not in seen and (limit is None or depth < limit):
                seen.add(n)
                parent[n] = node
                before.append(n)
                stack.append((n, iter(near.get(n, ())), depth + 1))
                break
        else:
            stack.pop()
            after.append(node)
    return before, after, parent


def edges_depth_first(near: dict[int, list[int]], source: int) -> list[tuple[int, int]]:
    """Every edge that is reached, in the order of a depth-first walk over edges."""
    out, used, stack = [], set(), [(source, iter(near.get(source, ())))]
    while stack:
        node, todo = stack[-1]
        for n in todo:
            if (node, n) not in used:
                used.add((node, n))
                out.append((node, n))
                stack.append((n, iter(near.get(n, ()))))
                break
        else:
            stack.pop()
    return out


def a_cycle(nodes: list[int], near: dict[int, list[int]]) -> list[tuple[int, int]]:
    """The first directed cycle that a depth-first search meets, as its edges."""
    done: set[int] = set()
    for root in nodes:
        if root in done:
            continue
        path, on, todo = [root], {root}, [iter(near.get(root, ()))]
        while todo:
            for n in todo[-1]:
                if n in on:
                    ring = [*path[path.index(n):], n]
                    return list(itertools.pairwise(ring))
                if n not in done:
                    path.append(n)
                    on.add(n)
                    todo.append(iter(near.get(n, ())))
                    break
            else:
                todo.pop()
                on.discard(path[-1])
                done.add(path.pop())
    return []


def biconnected(near: dict[int, set[int]]) -> list[list[tuple[int, int]]]:
    """The edges of each biconnected component, by low points."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    out = []
    for root in sorted(near):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack, edges = [(root, None, iter(sorted(near[root])))], []
        while stack:
            node, parent, todo = stack[-1]
            for n in todo:
                if n == parent:
                    continue
                if n not in number:
                    number[n] = low[n] = len(number)
                    edges.append((node, n))
                    stack.append((n, node, iter(sorted(near[n]))))
                    break
                if number[n] < number[node]:
                    edges.append((node, n))
                    low[node] = min(low[node], number[n])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if low[node] >= number[parent]:
                        cut = edges.index((parent, node))
                        out.append(edges[cut:])
                        del edges[cut:]
    return out


def chains(near: dict[int, set[int]], root: int | None = None) -> list[list[tuple[int, int]]]:
    """Chain decomposition: each back edge, then tree edges up to what is covered."""
    out = []
    seen_roots: set[int] = set()
    for start in [root] if root is not None else sorted(near):
        if start in seen_roots:
            continue
        before, _, parent = depth_first({k: sorted(v) for k, v in near.items()}, start)
        seen_roots |= set(before)
        place = {n: i for i, n in enumerate(before)}
        covered: set[int] = set()
        for node in before:
            covered.add(node)
            for n in sorted(near[node], key=lambda x: place[x]):
                if place[n] > place[node] and parent.get(n) != node:
                    chain, at, here = [(node, n)], n, node
                    while at not in covered:
                        covered.add(at)
                        chain.append((at, parent[at]))
                        at = parent[at]
                    if here != at or len(chain) > 1:
                        out.append(chain)
    return out


# cliques and structure

def cliques(near: dict[int, set[int]]) -> list[list[int]]:
    """All maximal cliques, by backtracking with a pivot."""
    out, stack = [], [([], set(near), set())]
    while stack:
        clique, maybe, done = stack.pop()
        if not maybe:
            if not done and clique:
                out.append(sorted(clique))
            continue
        pivot = max(maybe | done, key=lambda x: (len(near[x] & maybe), -x))
        for v in sorted(maybe - near[pivot]):
            stack.append(([*clique, v], maybe & near[v], done & near[v]))
            maybe = maybe - {v}
            done = done | {v}
    return sorted(out)


def clique_communities(found: list[list[int]], k: int) -> list[list[int]]:
    """Unions of cliques of k nodes or more that are linked by k - 1 common nodes."""
    own = [set(c) for c in found if len(c) >= k]
    root = list(range(len(own)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at: dict[int, list[int]] = {}
    for i, c in enumerate(own):
        for v in c:
            at.setdefault(v, []).append(i)
    for i, c in enumerate(own):
        for j in {j for v in c for j in at[v] if j > i}:
            if len(c & own[j]) >= k - 1:
                root[find(j)] = find(i)
    groups: dict[int, set[int]] = {}
    for i, c in enumerate(own):
        groups.setdefault(find(i), set()).update(c)
    return sorted(sorted(g) for g in groups.values())


def chordal(near: dict[int, set[int]]) -> bool:
    """Whether maximum-cardinality search gives a perfect elimination order."""
    weight, order = dict.fromkeys(near, 0), []
    left = set(near)
    while left:
        v = max(left, key=lambda x: (weight[x], -x))
        left.discard(v)
        earlier = [u for u in order if u in near[v]]
        if earlier and not (set(earlier[:-1]) <= near[earlier[-1]]):
            return False
        order.append(v)
        for u in near[v] & left:
            weight[u] += 1
    return True


def at_free(near: dict[int, set[int]]) -> bool:
    """No three nodes are pairwise linked by paths that avoid the third's neighbourhood."""
    part: dict[int, dict[int, int]] = {}
    for v in near:
        label: dict[int, int] = {}
        for s in set(near) - near[v] - {v}:
            if s in label:
                continue
            label[s] = s
            todo = [s]
            while todo:
                for n in near[todo.pop()] - near[v] - {v}:
                    if n not in label:
                        label[n] = s
                        todo.append(n)
        part[v] = label
    for a, b, c in itertools.combinations(sorted(near), 3):
        if b in near[a] or c in near[a] or c in near[b]:
            continue
        if part[a].get(b) == part[a].get(c) and part[b].get(a) == part[b].get(c) and part[c].get(a) == part[c].get(b):
            return False
    return True


def planar(near: dict[int, set[int]]) -> bool:
    """Whether every biconnected component can be drawn without crossings: faces are split by paths of the pieces that are left (Demoucron)."""
    return all(_planar_block(block) for block in biconnected(near))


def _planar_block(block: list[tuple[int, int]]) -> bool:
    near = plain(block)
    n, m = len(near), sum(map(len, near.values())) // 2
    if n < 5:
        return True
    if m > 3 * n - 6:
        return False
    # a first cycle
    start = min(near)
    _, _, parent = depth_first({k: sorted(v) for k, v in near.items()}, start)
    depth = {start: 0}
    for v in depth_first({k: sorted(v) for k, v in near.items()}, start)[0][1:]:
        depth[v] = depth[parent[v]] + 1
    ring = None
    for a in sorted(near):
        for b in near[a]:
            if depth[b] < depth[a] and parent.get(a) != b:
                ring, at = [a], a
                while at != b:
                    at = parent[at]
                    ring.append(at)
                break
        if ring:
            break
    if ring is None:
        return True
    drawn = set(ring)
    lines = {frozenset(e) for e in zip(ring, ring[1:] + ring[:1], strict=True)}
    faces = [list(ring), list(ring)]
    every = {frozenset((a, b)) for a in near for b in near[a]}
    while lines != every:
        pieces = []
        for e in every - lines:
            if e <= drawn:
                pieces.append((set(e), [sorted(e)]))
        seen: set[int] = set()
        for v in sorted(set(near) - drawn):
            if v in seen:
                continue
            inner, todo, ends = {v}, [v], set()
            while todo:
                for u in near[todo.pop()]:
                    if u in drawn:
                        ends.add(u)
                    elif u not in inner:
                        inner.add(u)
                        todo.append(u)
            seen |= inner
            a = min(ends)
            goal = ends - {a}
            back, queue, last = {a: None}, deque([a]), None
            while queue and last is None:
                x = queue.popleft()
                for y in sorted(near[x]):
                    if y in back or (x == a and y not in inner):
                        continue
                    if y in inner:
                        back[y] = x
                        queue.append(y)
                    elif y in goal and x in inner:
                        back[y] = x
                        last = y
                        break
            path = []
            while last is not None:
                path.append(last)
                last = back[last]
            pieces.append((ends, [path]))
        best = None
        for ends, path in pieces:
            fits = [i for i, f in enumerate(faces) if ends <= set(f)]
            if not fits:
                return False
            if best is None or len(fits) < len(best[1]):
                best = (path[0], fits)
        path, fits = best
        face = faces.pop(fits[0])
        i, j = face.index(path[0]), face.index(path[-1])
        if i > j:
            i, j, path = j, i, path[::-1]
        inside = path[1:-1]
        faces.append(face[i : j + 1] + inside[::-1])
        faces.append(face[j:] + face[: i + 1] + inside)
        drawn |= set(path)
        lines |= {frozenset(e) for e in itertools.pairwise(path)}
    return True


def isomorphic(first: dict[int, set[int]], second: dict[int, set[int]]) -> bool:
    """Whether a one-to-one map keeps all edges: colours are refined by neighbours, then matched with backtracking."""
    if sorted(map(len, first.values())) != sorted(map(len, second.values())):
        return False
    colour = {(0, v): len(n) for v, n in first.items()} | {(1, v): len(n) for v, n in second.items()}
    near = {(0, v): {(0, u) for u in n} for v, n in first.items()} | {(1, v): {(1, u) for u in n} for v, n in second.items()}
    for _ in range(len(first)):
        signs = {v: (c, tuple(sorted(colour[u] for u in near[v]))) for v, c in colour.items()}
        names = {s: i for i, s in enumerate(sorted(set(signs.values())))}
        new = {v: names[s] for v, s in signs.items()}
        if len(names) == len(set(colour.values())):
            colour = new
            break
        colour = new
    if sorted(colour[v] for v in near if v[0] == 0) != sorted(colour[v] for v in near if v[0] == 1):
        return False
    count: dict[int, int] = {}
    for v in near:
        count[colour[v]] = count.get(colour[v], 0) + 1
    order = sorted((v for v in near if v[0] == 0), key=lambda v: (count[colour[v]], v))
    mapped: dict = {}

    def place(i: int) -> bool:
        if i == len(order):
            return True
        v = order[i]
        for w in near:
            if w[0] == 1 and w not in mapped.values() and colour[w] == colour[v] and all((mapped[u] in near[w]) == (u in near[v]) for u in mapped):
                mapped[v] = w
                if place(i + 1):
                    return True
                del mapped[v]
        return False

    return place(0)


# flows and cuts

def max_flow(edges: list[Edge], source: int, target: int) -> tuple[float, dict[tuple[int, int], float], set[int]]:
    """(value, flow of each edge, the source's side of a least cut), by shortest augmenting paths."""
    room: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        room.setdefault(a, {})[b] = room.get(a, {}).get(b, 0.0) + w
        room.setdefault(b, {}).setdefault(a, 0.0)
    begun = {a: dict(n) for a, n in room.items()}
    total = 0.0
    while True:
        back, queue = {source: source}, deque([source])
        while queue and target not in back:
            x = queue.popleft()
            for y, r in room.get(x, {}).items():
                if r > 1e-12 and y not in back:
                    back[y] = x
                    queue.append(y)
        if target not in back or source == target:
            break
        path, at = [], target
        while at != source:
            path.append((back[at], at))
            at = back[at]
        by = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= by
            room[b][a] += by
        total += by
    flows = {(a, b): begun[a][b] - room[a][b] for a in begun for b in begun[a] if begun[a][b] - room[a][b] > 1e-12}
    return total, flows, set(back)


def flow_paths(edges: list[Edge], source: int, target: int) -> list[tuple[list[int], float]]:
    """The greatest flow as paths with amounts."""
    _, flows, _ = max_flow(edges, source, target)
    out = []
    while True:
        back, queue = {source: source}, deque([source])
        while queue and target not in back:
            x = queue.popleft()
            for (a, b), f in flows.items():
                if a == x and f > 1e-12 and b not in back:
                    back[b] = x
                    queue.append(b)
        if target not in back:
            return out
        path = [target]
        while path[-1] != source:
            path.append(back[path[-1]])
        path.reverse()
        by = min(flows[e] for e in itertools.pairwise(path))
        for e in itertools.pairwise(path):
            flows[e] -= by
        out.append((path, by))


def _split(near: dict[int, set[int]], source: int, target: int) -> list[Edge]:
    """Nodes as edges of capacity 1, so that flows count paths without common inner nodes."""
    big = float(len(near) + 1)
    out = [((v, 0), (v, 1), big if v in (source, target) else 1.0) for v in near]
    return out + [((a, 1), (b, 0), big) for a in near for b in near[a]]


def node_cut(near: dict[int, set[int]], source: int, target: int) -> set[int]:
    """Least set of other nodes without which no path leads from source to target; they are not neighbours."""
    _, _, side = max_flow(_split(near, source, target), (source, 1), (target, 0))
    return {v for v in near if (v, 0) in side and (v, 1) not in side}


def least_node_cut(near: dict[int, set[int]]) -> set[int] | None:
    """A least set of nodes whose loss parts an undirected graph; None if it is complete."""
    if not near:
        return None
    v = min(near, key=lambda x: (len(near[x]), x))
    best: set[int] | None = None
    pairs = [(v, u) for u in sorted(set(near) - near[v] - {v})] + [(a, b) for a, b in itertools.combinations(sorted(near[v]), 2) if b not in near[a]]
    for a, b in pairs:
        cut = node_cut(near, a, b)
        if best is None or len(cut) < len(best):
            best = cut
    return best


def parts_of(near: dict[int, set[int]]) -> list[set[int]]:
    out, seen = [], set()
    for v in sorted(near):
        if v not in seen:
            part, todo = {v}, [v]
            while todo:
                for u in near[todo.pop()]:
                    if u not in part:
                        part.add(u)
                        todo.append(u)
            seen |= part
            out.append(part)
    return out


def within(near: dict[int, set[int]], nodes: set[int]) -> dict[int, set[int]]:
    return {v: near[v] & nodes for v in nodes}


def k_components(near: dict[int, set[int]]) -> list[tuple[int, list[int]]]:
    """(k, nodes): maximal subgraphs that no loss of fewer than k nodes parts."""
    out: list[tuple[int, list[int]]] = []
    todo = [(1, p) for p in parts_of(near) if len(p) > 1]
    found: set[tuple[int, tuple[int, ...]]] = set()
    while todo:
        k, nodes = todo.pop()
        own = within(near, nodes)
        cut = least_node_cut(own)
        strength = len(nodes) - 1 if cut is None else len(cut)
        for j in range(k, strength + 1):
            key = (j, tuple(sorted(nodes)))
            if key not in found:
                found.add(key)
        if cut is not None:
            for p in parts_of(within(near, nodes - cut)):
                inner = p | cut
                if len(inner) > strength and len(inner) < len(nodes):
                    todo.append((strength + 1, inner))
    for k, nodes in sorted(found):  # one inside another of the same k is not maximal
        if not any(j == k and set(nodes) < set(o) for j, o in found):
            out.append((k, list(nodes)))
    return out


def k_edge_parts(near: dict[int, set[int]], k: int) -> list[list[int]]:
    """Sets of nodes that no loss of fewer than k edges of the graph parts."""
    edges = [(a, b, 1.0) for a in near for b in near[a]]
    groups = [sorted(near)]
    out = []
    while groups:
        own = groups.pop()
        for other in own[1:]:
            value, _, side = max_flow(edges, own[0], other)
            if value < k:
                groups += [[v for v in own if v in side], [v for v in own if v not in side]]
                break
        else:
            out.append(own)
    return sorted(out)


def bipartite_matching(nodes: list[int], near: dict[int, set[int]]) -> int | None:
    """Size of a largest matching; None if the component has an odd cycle."""
    side: dict[int, int] = {}
    for root in nodes:
        if root in side:
            continue
        side[root], todo = 0, [root]
        while todo:
            v = todo.pop()
            for u in near.get(v, ()):
                if u not in side:
                    side[u] = 1 - side[v]
                    todo.append(u)
                elif side[u] == side[v]:
                    return None
    mate: dict[int, int] = {}
    for v in nodes:
        if side[v] or v not in near:
            continue
        back, queue, end = {v: None}, deque([v]), None
        while queue and end is None:
            x = queue.popleft()
            for u in sorted(near[x]):
                if u not in back:
                    back[u] = x
                    if u not in mate:
                        end = u
                        break
                    back[mate[u]] = u
                    queue.append(mate[u])
        while end is not None:
            x = back[end]
            after = mate.get(x)
            mate[x], mate[end] = end, x
            end = after
    return len(mate) // 2


# dominators

def dominators(near: dict[int, list[int]], start: int) -> dict[int, int]:
    """The immediate dominator of each node that start reaches; start's is itself."""
    _, after, _ = depth_first(near, start)
    number = {v: i for i, v in enumerate(after)}
    before: dict[int, list[int]] = {}
    for v in after:
        for u in near.get(v, ()):
            before.setdefault(u, []).append(v)
    over = {start: start}
    changed = True
    while changed:
        changed = False
        for v in reversed(after[:-1]):
            known = [p for p in before.get(v, ()) if p in over]
            new = known[0]
            for p in known[1:]:
                a, b = new, p
                while a != b:
                    while number[a] < number[b]:
                        a = over[a]
                    while number[b] < number[a]:
                        b = over[b]
                new = a
            if over.get(v) != new:
                over[v] = new
                changed = True
    return over


def frontiers(near: dict[int, list[int]], start: int) -> dict[int, set[int]]:
    over = dominators(near, start)
    out: dict[int, set[int]] = {v: set() for v in over}
    before: dict[int, set[int]] = {}
    for v in over:
        for u in near.get(v, ()):
            before.setdefault(u, set()).add(v)
    for v, ps in before.items():
        if len(ps) > 1:
            for p in ps:
                while p != over[v]:
                    out[p].add(v)
                    p = over[p]
    return out


# spectra

def matrix(nodes: list[int], near: dict[int, set[int]]) -> np.ndarray:
    place = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for v, n in near.items():
        for u in n:
            a[place[v], place[u]] = 1.0
    return a


def communicability(nodes: list[int], near: dict[int, set[int]]) -> np.ndarray:
    """exp of the adjacency matrix."""
    values, vectors = np.linalg.eigh(matrix(nodes, near))
    return (vectors * np.exp(values)) @ vectors.T


def spectral_parts(nodes: list[int], near: dict[int, set[int]], k: int, seed: int = 7) -> np.ndarray:
    """k groups of nodes: k-means on the rows of the first eigenvectors of the normalised Laplacian."""
    a = matrix(nodes, near)
    d = np.sqrt(np.maximum(a.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(np.eye(len(nodes)) - a / d[:, None] / d[None, :])
    x = vectors[:, :k]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):  # the farthest next
        far = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.concatenate([centres, x[[int(far.argmax())]]])
    for _ in range(100):
        own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.stack([x[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return own


# tours

def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Great-circle distance of (latitude, longitude)."""
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return float(2 * 6371000 * np.arcsin(np.sqrt(min(1.0, h))))


def tour(points: list[tuple[float, float]]) -> list[int]:
    """A round trip: nearest neighbours, then exchanges of two legs until none makes it shorter."""
    n = len(points)
    if n < 3:
        return list(range(n))
    d = np.array([[metres(a, b) for b in points] for a in points])
    order, left = [0], set(range(1, n))
    while left:
        at = min(left, key=lambda j: (d[order[-1], j], j))
        order.append(at)
        left.discard(at)
    better = True
    while better:
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                a, b, c, e = order[i - 1], order[i], order[j], order[(j + 1) % n]
                if d[a, c] + d[b, e] < d[a, b] + d[c, e] - 1e-9:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
    return order


def routes(points: list[tuple[float, float]], depot: int, vehicles: int) -> list[tuple[int, int]]:
    """Legs of round trips from the depot: the others by their direction from it, dealt evenly over the vehicles, each trip a tour."""
    others = [i for i in range(len(points)) if i != depot]
    others.sort(key=lambda i: (np.arctan2(points[i][0] - points[depot][0], points[i][1] - points[depot][1]), i))
    legs = []
    for own in np.array_split(np.array(others, dtype=int), max(1, min(vehicles, len(others) or 1))):
        stops = [depot, *own.tolist()]
        order = [stops[i] for i in tour([points[s] for s in stops])]
        legs += [(a, b) for a, b in zip(order, order[1:] + order[:1], strict=True) if a != b]
    return legs


#: The sixteen kinds of three nodes by mutual, one-way and absent links.
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def triad(to: dict[int, set[int]], a: int, b: int, c: int) -> str:
    """The kind of three nodes."""
    def has(x: int, y: int) -> bool:
        return y in to.get(x, ())

    pairs = [(a, b), (a, c), (b, c)]
    mutual = sum(has(x, y) and has(y, x) for x, y in pairs)
    single = [(x, y) if has(x, y) else (y, x) for x, y in pairs if has(x, y) != has(y, x)]
    kind = f"{mutual}{len(single)}{3 - mutual - len(single)}"
    if kind == "021":
        (p, q), (r, s) = single
        return "021D" if p == r else "021U" if q == s else "021C"
    if kind == "111":
        (p, q), = single
        third = ({a, b, c} - {p, q}).pop()
        return "111U" if has(p, third) and has(third, p) else "111D"
    if kind == "030":
        return "030C" if len({p for p, _ in single}) == 3 else "030T"
    if kind == "120":
        (p, q), (r, s) = single
        return "120D" if p == r else "120U" if q == s else "120C"
    return kind
