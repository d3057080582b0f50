"""Procedures for CALL: a function of the graph and its arguments that gives rows, under its qualified name."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from . import algorithms as A
from . import analysis as N
from . import kernels as K
from . import rewrite as R
from . import structure as S
from .traversal import Walker, both_ways, cut, reach


def _parts(graph: Graph) -> tuple[DataFrame, DataFrame]:
    return graph.node_table().select("id"), graph.rel_table().select("src", "dst", *(["weight"] if "weight" in graph.rel_table().columns else []))


def _ids(graph: Graph, ids: object) -> DataFrame:
    return graph.spark.createDataFrame([(i,) for i in (ids if isinstance(ids, list) else [ids])], "id bigint")


def _whole(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda graph, *args: f(*_parts(graph), *args)


def _edges(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda graph, *args: f(_parts(graph)[1], *args)


def _flag(name: str, f: Callable[[DataFrame, DataFrame], bool]) -> Callable[..., DataFrame]:
    return lambda graph: graph.spark.createDataFrame([(f(*_parts(graph)),)], f"{name} boolean")


def _is_forest(v: DataFrame, e: DataFrame) -> bool:
    plain = S._plain(e)
    return plain.count() == v.count() - A.weakly_connected_components(v, plain).select("component_id").distinct().count()


def _is_tree(v: DataFrame, e: DataFrame) -> bool:
    return S._plain(e).count() == v.count() - 1 and _is_forest(v, e)


def _is_eulerian(v: DataFrame, e: DataFrame) -> bool:
    """Every node is left as often as it is entered, and all edges lie in one component."""
    turns = e.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("d")), F.struct(F.col("dst").alias("v"), F.lit(-1).alias("d")))).alias("t")).groupBy("t.v").agg(F.sum("t.d").alias("d"))
    used = turns.select(F.col("v").alias("id"))
    return turns.where("d != 0").isEmpty() and A.weakly_connected_components(used, e).select("component_id").distinct().count() <= 1


def _hops(graph: Graph, node: int, types: list[str], distance: int) -> DataFrame:
    return reach(both_ways(graph.rel_table(set(types) or None).select("src", "dst")), _ids(graph, node), distance).where("depth > 0")


def _stats(graph: Graph) -> DataFrame:
    info = graph.schema_info()
    return info.agg(
        F.count_distinct(F.when(F.col("kind") == "node", F.col("name"))).alias("labelCount"),
        F.coalesce(F.sum(F.when(F.col("kind") == "node", F.col("n"))), F.lit(0)).alias("nodeCount"),
        F.coalesce(F.sum(F.when(F.col("kind") != "node", F.col("n"))), F.lit(0)).alias("relationshipCount"),
    ).withColumn("relationshipTypeCount", F.lit(len({r.type for r in graph.rels})))


def _connected(graph: Graph, first: list[int], second: list[int]) -> DataFrame:
    parts = A.weakly_connected_components(*_parts(graph))
    asked = graph.spark.createDataFrame(list(zip(first, second, strict=True)), "node1 bigint, node2 bigint")
    return asked.join(parts.toDF("node1", "a"), "node1").join(parts.toDF("node2", "b"), "node2").select("node1", "node2", (F.col("a") == F.col("b")).alias("connected"))


def _path_length(graph: Graph, source: int, target: int) -> DataFrame:
    return reach(_parts(graph)[1], _ids(graph, source)).where(F.col("node") == target).select(F.col("depth").alias("length"))


def _degree_of(graph: Graph, node: int, type: str | None, side: str) -> DataFrame:
    return graph.rel_table({type} if type else None).where(F.col(side) == node).agg(F.count(F.lit(1)).alias("value"))


def _text(graph: Graph, label: str, column: str, query: str, k: int = 1000) -> DataFrame:
    return A.text_search(graph.nodes[label], query.split(), k, "id", column).withColumnRenamed("id", "node")


#: Procedures that take nodes or relationships: the places of these arguments. They get a table of ids(source[, target]) and rows say by these columns to
#: which ids they belong.
TAKES: dict[str, tuple[int, ...]] = {}
#: Procedures that give a new graph and rows.
WRITES: set[str] = set()
#: Fields that hold ids of nodes or of relationships.
NODE_FIELDS = {"node", "node1", "node2", "neighbour", "node_from", "node_to", "from_vertex", "to_vertex", "center", "ancestor", "predecessor", "dominator", "target"}
REL_FIELDS = {"relationship", "rel", "edge"}


def _nodes(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("source").alias("id")).distinct()


def _sub(graph: Graph, nodes: list[int], rels: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The vertices and edges of a subgraph given by ids."""
    v = _ids(graph, [int(n) for n in nodes])
    e = graph.rel_table()
    if rels is not None:
        e = e.join(_ids(graph, [int(r) for r in rels] or [-1]).select("id"), "id", "left_semi")
    return v, N.chosen(e.select("src", "dst", *(["weight"] if "weight" in e.columns else [])), v)


def _hop_rows(graph: Graph, ids: DataFrame, types: list[str] | None, distance: int) -> DataFrame:
    return reach(both_ways(graph.rel_table(set(types or []) or None).select("src", "dst")), _nodes(ids), distance).where("depth > 0")


def _steps(graph: Graph, ids: DataFrame, config: dict | None, path: bool) -> DataFrame:
    """path.expand and subgraph: walks by relationship filters (`T`, `T>`, `<T`, `>`, `<`) and label filters (`-L` never, `>L` or `/L` end, `+L` or `L` allowed)."""
    config = {k.lower(): v for k, v in (config or {}).items()}
    names = config.get("relationshipfilter", config.get("relationships", []))
    names = names.split("|") if isinstance(names, str) else names or []
    e = graph.rel_table()
    parts = []
    for name in names or [""]:
        back, on, kind = name.startswith("<"), name.endswith(">"), name.strip("<>")
        own = e.where(F.col("type") == kind) if kind else e
        rows = own.select(F.col("id").alias("e"), "src", "dst")
        turned = own.select(F.col("id").alias("e"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        parts += [rows] if on and not back else [turned] if back and not on else [rows, turned.where("src != dst")]
    steps = parts[0]
    for p in parts[1:]:
        steps = steps.unionByName(p)
    labels = config.get("labelfilter", config.get("labels", []))
    labels = labels.split("|") if isinstance(labels, str) else labels or []
    never = {x[1:] for x in labels if x.startswith("-")}
    ends = {x[1:] for x in labels if x[:1] in (">", "/")}
    stops = {x[1:] for x in labels if x.startswith("/")}
    allowed = {x.lstrip("+") for x in labels if x and x[0] not in "->/"}
    table = graph.node_table().select("id", "labels")

    def has(some: set[str]) -> Column:
        return F.arrays_overlap("labels", F.array(*[F.lit(x) for x in sorted(some)]))

    if never:
        table = table.where(~has(never))
    if allowed:
        table = table.where(has(allowed | ends))
    steps = steps.join(table.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
    low, high = int(config.get("minlevel", config.get("min_hops", 0))), int(config.get("maxlevel", config.get("max_hops", -1)))
    high = None if high < 0 else high
    if stops:  # nothing goes on from these
        steps = steps.join(graph.node_table().where(has(stops)).select(F.col("id").alias("src")), "src", "left_anti")
    if not path:
        found = reach(steps.select("src", "dst"), _nodes(ids), high).where(F.col("depth") >= low).select("source", "node")
    else:
        found = Walker(steps).every(_nodes(ids), low, high)
    if ends:
        found = found.join(graph.node_table().where(has(ends)).select(F.col("id").alias("node")), "node", "left_semi")
    return found


def _paths_of(graph: Graph, found: DataFrame) -> DataFrame:
    """(source, result): walks (source, ids of relationships) as path values."""
    e = graph.rel_table()
    rel = e.select("id", F.struct("id", "src", "dst", "type", *[c for c in e.columns if c not in ("id", "src", "dst", "type")]).alias("r"))
    nodes = graph.node_table().select(F.col("id").alias("n_id"), F.struct("*").alias("n"))
    walks = cut(found.select("source", "ids").withColumn("walk", F.xxhash64("source", "ids")))
    each = walks.select("source", "walk", F.posexplode_outer("ids").alias("i", "id"))
    got = each.join(rel, "id", "left")
    order = got.groupBy("source", "walk").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("i", F.col("r.id").alias("k"), "r")))), lambda s: s["r"]).alias("rels"))
    # the nodes along a walk, whichever way each relationship was taken
    along = order.withColumn("at", F.aggregate("rels", F.array("source"), lambda s, r: F.concat(s, F.array(F.when(r["src"] == F.element_at(s, -1), r["dst"]).otherwise(r["src"])))))
    placed = along.select("source", "walk", F.posexplode("at").alias("j", "n_id")).join(nodes, "n_id")
    listed = placed.groupBy("walk").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "n_id", "n"))), lambda s: s["n"]).alias("nodes"))
    return along.join(listed, "walk").select("source", F.struct("nodes", "rels").alias("result"))


def _exists(graph: Graph, ids: DataFrame, wanted: list[str] | str) -> DataFrame:
    """(source, result map): whether each node has a relationship of a type, with < or > for its direction."""
    names = wanted if isinstance(wanted, list) else [wanted]
    own = _nodes(ids)
    e = graph.rel_table().select("type", "src", "dst")
    ends = e.select(F.col("src").alias("id"), "type", F.lit(">").alias("way")).unionByName(e.select(F.col("dst").alias("id"), "type", F.lit("<").alias("way")))
    tests = []
    for name in names:
        kind, way = name.strip("<>"), ">" if name.endswith(">") else "<" if name.startswith("<") else None
        tests.append(F.coalesce(F.bool_or((F.col("type") == kind) & (F.col("way") == way if way else F.lit(True))), F.lit(False)))
    grouped = own.join(ends, "id", "left").groupBy("id").agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)])
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"t{i}"))]
    return grouped.select(F.col("id").alias("source"), F.create_map(*pairs).alias("result"))


def _types(graph: Graph, ids: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(source, relationship_types)."""
    e = graph.rel_table().select("type", "src", "dst")
    outs, ins = [], []
    for name in wanted or []:
        if not name.startswith("<"):
            outs.append(name.strip("<>"))
        if not name.endswith(">"):
            ins.append(name.strip("<>"))
    a, b = e.select(F.col("src").alias("id"), "type"), e.select(F.col("dst").alias("id"), "type")
    if wanted:
        a, b = a.where(F.col("type").isin(outs)), b.where(F.col("type").isin(ins))
    found = _nodes(ids).join(a.unionByName(b).distinct(), "id", "left").groupBy("id").agg(F.sort_array(F.collect_set("type")).alias("relationship_types"))
    return found.withColumnRenamed("id", "source")


def _compare(column: Column, operator: str, value: object) -> Column:
    x = column.cast("string")
    v = F.lit(value)
    return {
        "exact": column == v, "=": column == v, "<>": column != v, "<": column < v, "<=": column <= v, ">": column > v, ">=": column >= v,
        "contains": x.contains(F.lit(str(value))), "starts with": x.startswith(str(value)), "ends with": x.endswith(str(value)), "=~": x.rlike(f"^(?:{value})\\z"),
    }[operator.lower()]


def _search(graph: Graph, wanted: dict | str, operator: str, value: object, distinct: bool) -> DataFrame:
    """search.node: nodes of labels by their properties; all matches, or each node once."""
    wanted = json.loads(wanted) if isinstance(wanted, str) else wanted
    out = None
    for label, props in wanted.items():
        table = graph.node_table({label})
        for prop in props if isinstance(props, list) else [props]:
            if prop in table.columns:
                hit = table.where(_compare(F.col(f"`{prop}`"), operator, value)).select(F.col("id").alias("node"))
                out = hit if out is None else out.unionByName(hit)
    out = graph.spark.createDataFrame([], "node bigint") if out is None else out
    return out.distinct() if distinct else out


def _text_rows(graph: Graph, name: str, edges: bool) -> DataFrame:
    return graph.rel_table({name}).drop("src", "dst") if edges else graph.node_table({name}).drop("labels")


def _strings(rows: DataFrame) -> list[str]:
    return [c for c, t in rows.dtypes if t == "string" and c not in ("type",)]


def _wanted(rows: DataFrame, query: str) -> tuple[list[str], list[str], bool]:
    """(columns, words, whether all are needed) of `data.title:word AND data.body:word` or plain words."""
    parts = [p for p in query.replace("(", " ").replace(")", " ").split() if p.upper() not in ("AND", "OR")]
    columns = [p.split(":")[0].removeprefix("data.") for p in parts if ":" in p]
    words = [w for p in parts for w in p.split(":")[-1].strip('"').lower().split()]
    return (columns or _strings(rows)), words, " AND " in query.upper()


def _text_search(graph: Graph, name: str, query: str, config: dict | int | None = None, edges: bool = False) -> DataFrame:
    """BM25 over the text properties of a label or type; limit, default 1000, is the reference's own top-k."""
    rows = _text_rows(graph, name, edges)
    columns, words, every = _wanted(rows, query)
    limit = int((config or {}).get("limit", 1000)) if isinstance(config, dict) or config is None else int(config)
    text = rows.select("id", F.concat_ws(" ", *[F.col(f"`{c}`") for c in columns]).alias("text"))
    if every:
        text = text.where(F.size(F.array_intersect(N.tokens("text"), F.array(*[F.lit(w) for w in set(words)]))) == len(set(words)))
    return A.text_search(text, words, limit, "id", "text").withColumnRenamed("id", "edge" if edges else "node")


def _text_regex(graph: Graph, name: str, pattern: str, config: dict | None = None, edges: bool = False) -> DataFrame:
    """Rows with a word that the pattern matches whole."""
    rows = _text_rows(graph, name, edges)
    words = F.flatten(F.array(*[N.tokens(c) for c in _strings(rows)]))
    return rows.where(F.exists(words, lambda w: w.rlike(f"^(?:{pattern.lower()})\\z"))).select(F.col("id").alias("edge" if edges else "node"), F.lit(1.0).alias("score"))


def _text_fuzzy(graph: Graph, name: str, query: str, config: dict | None = None, edges: bool = False) -> DataFrame:
    rows = _text_rows(graph, name, edges)
    columns, words, _ = _wanted(rows, query)
    return N.phrase_search(rows, columns, words, int((config or {}).get("distance", 1))).withColumnRenamed("id", "edge" if edges else "node")


def _text_aggregate(graph: Graph, name: str, query: str, asked: str | dict, edges: bool = False) -> DataFrame:
    """value_count, min, max, sum and avg of fields over the rows that a search finds, as one map in JSON."""
    asked = json.loads(asked) if isinstance(asked, str) else asked
    rows = _text_rows(graph, name, edges)
    columns, words, _ = _wanted(rows, query)
    hit = rows.where(F.arrays_overlap(F.flatten(F.array(*[N.tokens(c) for c in columns])), F.array(*[F.lit(w) for w in words]))) if words else rows
    out = []
    for label, spec in asked.items():
        kind, field = next((k, v.get("field", "").split(".")[-1]) for k, v in spec.items() if isinstance(v, dict))
        x = F.col(f"`{field}`") if field in rows.columns else F.lit(None)
        out.append({"value_count": F.count(x), "min": F.min(x), "max": F.max(x), "sum": F.sum(x), "avg": F.avg(x), "count": F.count(x)}[kind].cast("double").alias(label))
    found = hit.agg(*out)
    return found.select(F.to_json(F.struct(*[F.struct(F.col(c).alias("value")).alias(c) for c in found.columns])).alias("aggregation"))


def _vector(graph: Graph, name: str, column: str, k: int, query: list[float], edges: bool = False) -> DataFrame:
    rows = _text_rows(graph, name, edges)
    rows = graph.rel_table({name}) if edges else graph.node_table({name})
    found = A.vector_search(rows.where(F.col(f"`{column}`").isNotNull()), query, k, column)
    return found.select(F.col("id").alias("edge" if edges else "node"), (1 - F.col("similarity")).alias("distance"), "similarity")


def _vector_info(graph: Graph) -> DataFrame:
    """Array properties that can be searched; the search reads the tables, there is no index of its own."""
    rows = []
    for k, t in graph.nodes.items():
        for c, kind in t.dtypes:
            if kind in ("array<float>", "array<double>"):
                n, d = t.agg(F.count(f"`{c}`"), F.max(F.size(f"`{c}`"))).first()
                rows.append((f"{k}.{c}", k, c, "cos", int(d or 0), int(n), int(n), "f32" if kind == "array<float>" else "f64", "label+property"))
    return graph.spark.createDataFrame(rows, "index_name string, label string, property string, metric string, dimension bigint, capacity bigint, size bigint, scalar_kind string, index_type string")


def _analyze(v: DataFrame, e: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(name, value) of a graph's figures."""
    spark, plain = v.sparkSession, S._plain(e)
    figures = {
        "nodes": lambda: v.count(), "edges": lambda: e.count(), "bridges": lambda: S.bridges(v, e).count(), "articulation_points": lambda: K.run(v, e, _articulation, "node bigint").count(),
        "avg_degree": lambda: 2 * e.count() / max(1, v.count()), "sorted_nodes_degree": lambda: [r["d"] for r in both_ways(e.select("src", "dst")).groupBy("src").agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d")).limit(100).collect()],
        "self_loops": lambda: e.where("src = dst").count(), "is_bipartite": lambda: S.is_bipartite(v, e).first()[0], "is_planar": lambda: N.kernel_flag("x", lambda n, x: K.planar(K.plain(x)))(v, e).first()[0],
        "is_biconnected": lambda: v.count() == A.weakly_connected_components(v, e).where("component_id = node").count() or K.run(v, e, lambda n, x: [(len(K.biconnected(K.plain(x))),)], "n bigint").agg(F.sum("n")).first()[0] == 1,
        "is_weakly_connected": lambda: A.weakly_connected_components(v, e).select("component_id").distinct().count() == 1, "number_of_weakly_components": lambda: A.weakly_connected_components(v, e).select("component_id").distinct().count(),
        "is_strongly_connected": lambda: S.strongly_connected_components(v, e).select("component_id").distinct().count() == 1, "strongly_components": lambda: S.strongly_connected_components(v, e).select("component_id").distinct().count(),
        "is_dag": lambda: S.strongly_connected_components(v, e).select("component_id").distinct().count() == v.count() and e.where("src = dst").isEmpty(), "is_eulerian": lambda: N.eulerian(v, e),
        "is_forest": lambda: _is_forest(v, e), "is_tree": lambda: _is_tree(v, e), "undirected_edges": lambda: plain.count(),
    }
    return spark.createDataFrame([(k, str(f())) for k, f in figures.items() if wanted is None or k in wanted], "name string, value string")


def _articulation(nodes: list[int], edges: list) -> list[tuple[int]]:
    seen: dict[int, int] = {}
    for block in K.biconnected(K.plain(edges)):
        for n in {x for pair in block for x in pair}:
            seen[n] = seen.get(n, 0) + 1
    return [(n,) for n, k in seen.items() if k > 1]


def _lists(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name)).select(name)


def _whole_kernel(f: Callable, schema: str) -> Callable[..., DataFrame]:
    """A kernel over the whole graph, with the procedure's arguments."""
    return lambda g, *args: K.run(*_parts(g), lambda nodes, edges: f(nodes, edges, *args), schema, whole=True)


def _part_kernel(f: Callable, schema: str) -> Callable[..., DataFrame]:
    """A kernel for each component, with the procedure's arguments."""
    return lambda g, *args: K.run(*_parts(g), lambda nodes, edges: f(nodes, edges, *args), schema)


def _flow_edges(graph: Graph, column: str) -> DataFrame:
    e = graph.rel_table()
    return e.select("src", "dst", (F.coalesce(F.col(f"`{column}`").cast("double"), F.lit(0.0)) if column in e.columns else F.lit(1.0)).alias("weight"))


def _flow(graph: Graph, source: int, target: int, column: str, f: Callable, schema: str) -> DataFrame:
    """A kernel over what lies between two nodes: edges on some way from the source to the target."""
    e = _flow_edges(graph, column)
    down = reach(e, _ids(graph, int(source))).select(F.col("node").alias("id"))
    up = reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), _ids(graph, int(target))).select(F.col("node").alias("id"))
    between = cut(down.join(up, "id", "left_semi").unionByName(_ids(graph, [int(source), int(target)])).distinct())
    return K.run(between, N.chosen(e, between), f, schema, whole=True)


def _frontier_rows(nodes: list, edges: list, start: int) -> list[tuple]:
    return [(n, sorted(s)) for n, s in K.frontiers(K.forward(edges), int(start)).items()]


def _kcore_rows(nodes: list, edges: list, density: float = 0.95) -> list[tuple]:
    return [(k, c) for k, c in K.k_components(K.plain(edges))]


def _communicable(nodes: list, edges: list) -> list[tuple]:
    near = {n: set() for n in nodes} | K.plain(edges)
    c = K.communicability(nodes, near)
    return [(a, b, float(c[i, j])) for i, a in enumerate(nodes) for j, b in enumerate(nodes)]


def _randomness(nodes: list, edges: list, k: int | None = None) -> list[tuple]:
    import numpy as np

    near = {n: set() for n in nodes} | K.plain(edges)
    n, m = len(nodes), sum(map(len, near.values())) / 2
    if k is None:
        parts = K.parts_of(near)
        k = len(parts)
    top = np.sort(np.linalg.eigvalsh(K.matrix(nodes, near)))[::-1][: int(k)]
    found = float(top.real.sum())
    p = 2 * k * m / (n * (n - k)) if n > k else 0.0
    mean = (n - 2 * k) * p + k
    spread = (2 * k * p * (1 - p)) ** 0.5
    return [(found, float((found - mean) / spread) if spread else 0.0)]


def _census(nodes: list, edges: list) -> list[tuple]:
    """Counts of the sixteen kinds of triads: those with links one by one, the empty ones by what is left."""
    to: dict[int, set[int]] = {}
    for a, b, *_ in edges:
        if a != b:
            to.setdefault(a, set()).add(b)
    near = K.plain(edges)
    counts, seen = dict.fromkeys(K.TRIADS, 0), set()
    n = len(nodes)
    for a in near:
        for b in near[a]:
            if a < b:
                third = (near[a] | near[b]) - {a, b}
                counts["102" if b in to.get(a, ()) and a in to.get(b, ()) else "012"] += n - len(third) - 2
                for c in third:
                    key = frozenset((a, b, c))
                    if key not in seen:
                        seen.add(key)
                        counts[K.triad(to, a, b, c)] += 1
    counts["003"] = n * (n - 1) * (n - 2) // 6 - sum(counts.values())
    return list(counts.items())


def _points(graph: Graph, ids: list[int]) -> tuple[list[int], list[tuple[float, float]]]:
    rows = graph.node_table().where(F.col("id").isin([int(i) for i in ids])).select("id", F.col("lat").cast("double"), F.col("lng").cast("double")).collect()  # the nodes that were given
    return [r["id"] for r in rows], [(r["lat"], r["lng"]) for r in rows]


def _tsp(graph: Graph, ids: list[int], method: str = "1.5_approx") -> DataFrame:
    own, points = _points(graph, ids)
    order = [own[i] for i in K.tour(points)]
    return graph.spark.createDataFrame([(order, order[1:] + order[:1])], "sources array<bigint>, destinations array<bigint>")


def _vrp(graph: Graph, depot: int, vehicles: int = 1) -> DataFrame:
    own, points = _points(graph, [r["id"] for r in graph.node_table().where("lat IS NOT NULL").select("id").collect()])
    legs = K.routes(points, own.index(int(depot)), int(vehicles))
    return graph.spark.createDataFrame([(own[a], own[b]) for a, b in legs], "from_vertex bigint, to_vertex bigint")


def _csv(graph: Graph, path: str, content: list | str, append: bool = False) -> DataFrame:
    rows = content if isinstance(content, list) else content.splitlines()
    lines = [r if isinstance(r, str) else ",".join("" if x is None else str(x) for x in r) for r in rows]
    graph.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append" if append else "overwrite").text(path)
    return graph.spark.createDataFrame([(path,)], "filepath string")


def _delete_file(graph: Graph, path: str) -> DataFrame:
    jvm = graph.spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    done = where.getFileSystem(graph.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return graph.spark.createDataFrame([(bool(done),)], "value boolean")


def _import_statements(graph: Graph, path: str) -> R.Result:
    """A file of statements, one after the other, each ended by a semicolon."""
    from ..plans import run_update

    text = "\n".join(r["value"] for r in graph.spark.read.text(path).collect())  # statements are replayed in their order
    done = 0
    for statement in filter(None, (s.strip() for s in text.split(";\n"))):
        graph = run_update(graph, statement)
        done += 1
    return graph, graph.spark.createDataFrame([(done,)], "statements bigint")


def _import_json(graph: Graph, path: str) -> R.Result:
    """JSON lines of nodes {type: node, id, labels, properties} and relationships {type: relationship, id, label, start, end, properties}."""
    rows = cut(graph.spark.read.json(path))
    first = R._top(graph.node_table())
    nodes = rows.where("type = 'node'")
    for r in nodes.select("labels").distinct().collect():  # as many rows as sets of labels
        key = ":".join(sorted(r["labels"]))
        own = nodes.where(F.col("labels") == F.array(*[F.lit(x) for x in r["labels"]])).select((F.col("id").cast("bigint") + first).alias("id"), "properties.*")
        old = graph.nodes.get(key)
        from ..graph import _stacked

        graph = graph.with_nodes(key, own if old is None else _stacked([old, own]))
    rels, top = rows.where("type = 'relationship'"), R._top(graph.rel_table())
    if "start" in rows.columns:
        every = "|".join(graph.nodes)
        for r in rels.select("label").distinct().collect():  # as many rows as types
            own = rels.where(F.col("label") == r["label"]).select((F.col("id").cast("bigint") + top).alias("id"), (F.col("start").cast("bigint") + first).alias("src"), (F.col("end").cast("bigint") + first).alias("dst"), "properties.*")
            graph = graph.create_rels(r["label"], every, every, own)
    return graph, graph.spark.createDataFrame([("success",)], "status string")


def _import_graphml(graph: Graph, path: str, config: dict | None = None) -> R.Result:
    """Nodes (labels attribute `:A:B`) and edges (label attribute) of a GraphML file, read by Spark's XML source; values stay strings."""
    from ..graph import _stacked

    spark, first, top = graph.spark, R._top(graph.node_table()), R._top(graph.rel_table())
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _labels string, data array<struct<_key:string,_VALUE:string>>").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, _label string, data array<struct<_key:string,_VALUE:string>>").load(path)
    from .traversal import numbered

    made = cut(numbered(nodes.withColumn("labels", F.filter(F.split(F.coalesce("_labels", F.lit("")), ":"), lambda x: x != "")), "id", first))
    keys = [r[0] for r in made.select(F.explode_outer("data._key")).distinct().collect() if r[0]]  # as many rows as properties
    for r in made.select("labels").distinct().collect():
        key = ":".join(sorted(r["labels"]))
        value = [F.try_element_at(F.transform(F.filter("data", _keyed(k)), lambda d: d["_VALUE"]), F.lit(1)).alias(k) for k in keys if k not in ("labels", "id")]
        own = made.where(F.col("labels") == F.array(*[F.lit(x) for x in r["labels"]]).cast("array<string>")).select("id", *value)
        graph = graph.with_nodes(key, own if key not in graph.nodes else _stacked([graph.nodes[key], own]))
    ids = made.select(F.col("_id").alias("name"), F.col("id").alias("node"))
    linked = edges.join(ids.toDF("_source", "src"), "_source").join(ids.toDF("_target", "dst"), "_target")
    rels = cut(numbered(linked, "id", top))
    every = "|".join(graph.nodes)
    for r in rels.select(F.coalesce("_label", F.lit("RELATED")).alias("t")).distinct().collect():
        graph = graph.create_rels(r["t"], every, every, rels.where(F.coalesce("_label", F.lit("RELATED")) == r["t"]).select("id", "src", "dst"))
    return graph, spark.createDataFrame([("success",)], "status string")


def _keyed(key: str) -> Callable[[Column], Column]:
    return lambda d: d["_key"] == key


def _export_tensors(graph: Graph, node_props: list[str] | None = None, edge_props: list[str] | None = None, label: str | None = None) -> DataFrame:
    """The graph as one JSON text: edge_index, numeric node features and labels. For graphs that fit into one value."""
    from .traversal import numbered

    nodes = cut(numbered(graph.node_table(), "i", 0))
    props = node_props or sorted(c for c, t in nodes.dtypes if t in ("int", "bigint", "double", "float") and c not in ("id", "i"))
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in props]) if props else F.array().cast("array<double>")
    e = graph.rel_table().join(nodes.select(F.col("id").alias("src"), F.col("i").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("i").alias("b")), "dst")
    head = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", x.alias("x"), *([F.col(f"`{label}`").cast("string").alias("y")] if label else [F.lit(None).cast("string").alias("y")])))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("nodes"))
    tail = e.agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("edge_index"))
    return head.crossJoin(tail).select(F.to_json(F.struct(F.lit(props).alias("node_property_names") if props else F.array().cast("array<string>").alias("node_property_names"), F.col("nodes.x").alias("x"), F.col("nodes.y").alias("y"), "edge_index")).alias("json_data"))


def _import_tensors(graph: Graph, data: str, node_label: str = "PyGNode", type: str = "CONNECTS", names: list[str] | None = None) -> R.Result:
    from ..graph import _stacked

    spark, d = graph.spark, json.loads(data)
    names = names or d.get("node_property_names") or [f"x{i}" for i in range(len(d["x"][0]) if d["x"] else 0)]
    first = R._top(graph.node_table())
    rows = [(first + i, *map(float, x)) for i, x in enumerate(d["x"])]
    made = spark.createDataFrame(rows, "id bigint" + "".join(f", `{n}` double" for n in names))
    graph = graph.with_nodes(node_label, made if node_label not in graph.nodes else _stacked([graph.nodes[node_label], made]))
    pairs = spark.createDataFrame([(first + a, first + b) for a, b in d["edge_index"]], "source bigint, target bigint")
    graph, _ = R.create_relationships(graph, pairs, type)
    return graph, spark.createDataFrame([(len(rows), len(d["edge_index"]), 0)], "nodes_created bigint, edges_created bigint, nodes_updated bigint")


#: Names and patterns of date formats.
DATE_FORMATS = [("ISO_DATE", "yyyy-MM-dd"), ("ISO_LOCAL_TIME", "HH:mm:ss"), ("ISO_LOCAL_DATE_TIME", "yyyy-MM-dd'T'HH:mm:ss"), ("ISO_OFFSET_DATE_TIME", "yyyy-MM-dd'T'HH:mm:ssXXX"), ("BASIC_ISO_DATE", "yyyyMMdd"), ("ISO_WEEK_DATE", "YYYY-'W'ww-e"), ("ISO_ORDINAL_DATE", "yyyy-DDD")]



PROCEDURES: dict[str, Callable[..., DataFrame]] = {
    "pagerank.get": _whole(lambda v, e, rounds=100, damping=0.85, stop=1e-5: A.pagerank(v, e, damping, rounds, stop)),
    "degree_centrality.get": _whole(lambda v, e, kind="undirected": A.degree_centrality(v, e, kind)),
    "betweenness_centrality.get": _whole(lambda v, e, directed=True, normalized=True: S.betweenness_centrality(v, e, directed, normalized)),
    "weakly_connected_components.get": _whole(A.weakly_connected_components), "wcc.get_components": _whole(A.weakly_connected_components),
    "community_detection.get": _whole(lambda v, e: S.louvain(v, e)), "bridges.get": _whole(S.bridges), "cycles.get": _edges(lambda e: S.cycles(e, directed=False)),
    "graph_coloring.color_graph": _whole(S.colouring), "union_find.connected": _connected,
    "node_similarity.jaccard": _edges(lambda e: A.neighbour_similarity(e, "jaccard")), "node_similarity.overlap": _edges(lambda e: A.neighbour_similarity(e, "overlap")),
    "graph_util.topological_sort": _whole(A.topological_sort), "igraphalg.topological_sort": _whole(A.topological_sort),
    "meta.stats_offline": _stats, "meta_util.schema": lambda g: g.schema_info(), "llm_util.schema": lambda g: g.schema_info(),
    "kmeans.get_clusters": lambda g, label, clusters, column="embedding": S.kmeans(g.nodes[label], clusters, column),
    "nxalg.strongly_connected_components": _whole(S.strongly_connected_components), "nxalg.bridges": _whole(S.bridges), "nxalg.pagerank": _whole(A.pagerank),
    "nxalg.k_edge_components": _whole(S.two_edge_components), "nxalg.core_number": _whole(A.core_number), "nxalg.clustering": _whole(A.clustering),
    "nxalg.greedy_color": _whole(S.colouring), "nxalg.maximal_matching": _edges(S.maximal_matching), "nxalg.dominating_set": _whole(S.independent_set),
    "nxalg.isolates": _whole(A.isolates), "nxalg.reciprocity": _edges(A.reciprocity), "nxalg.is_bipartite": _whole(S.is_bipartite),
    "nxalg.minimum_spanning_tree": _edges(A.minimum_spanning_forest), "igraphalg.spanning_tree": _edges(A.minimum_spanning_forest),
    "nxalg.diameter": _whole(lambda v, e: S.distances(v, e).agg(F.max("eccentricity").alias("diameter"))),
    "nxalg.wiener_index": _whole(lambda v, e: S.distances(v, both_ways(S._plain(e))).agg((F.sum("total") / 2).alias("wiener_index"))),
    "nxalg.global_efficiency": _whole(lambda v, e: S.distances(v, both_ways(S._plain(e))).agg((F.sum("harmonic") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))).alias("global_efficiency"))),
    "nxalg.is_tree": _flag("is_tree", _is_tree), "nxalg.is_forest": _flag("is_forest", _is_forest), "nxalg.is_eulerian": _flag("is_eulerian", _is_eulerian),
}


def _takes(*places: int, writes: bool = False, **named: Callable) -> None:
    """Registers procedures under names with __ for the dot."""
    for name, body in named.items():
        key = name.replace("__", ".")
        PROCEDURES[key] = body
        if places:
            TAKES[key] = places
        if writes:
            WRITES.add(key)


def _path_value(found: DataFrame) -> DataFrame:
    """(source, target, path) of node ids."""
    return found.select("source", "target", "path")


def _pairs(ids: DataFrame) -> DataFrame:
    return ids.select("source", "target").distinct()


def _compared(edges: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    return N.pairwise_similarity(edges, kind, ids.toDF("node1", "node2")).select("*", F.col("node1").alias("source"), F.col("node2").alias("target"))


def _lengths(g: Graph, ids: DataFrame, weights: str | None = None, directed: bool = True) -> DataFrame:
    e = _flow_edges(g, weights) if weights else g.rel_table().select("src", "dst")
    e = e if directed else both_ways(e)
    found = N.shortest_paths(e, _nodes(ids), weights is not None)
    own = ids.where("source = target").select("source", "target", F.lit(0.0).alias("length"))
    return found.select("source", "target", "length").join(_pairs(ids), ["source", "target"], "left_semi").unionByName(own)


_takes(  # what starts from nodes
    0,
    graph_util__ancestors=lambda g, ids: A.ancestors(_parts(g)[1], _nodes(ids)).select("source", "node", "depth"),
    graph_util__descendants=lambda g, ids: A.descendants(_parts(g)[1], _nodes(ids)).select("source", "node", "depth"),
    nxalg__ancestors=lambda g, ids: A.ancestors(_parts(g)[1], _nodes(ids)).select("source", "node"),
    nxalg__descendants=lambda g, ids: A.descendants(_parts(g)[1], _nodes(ids)).select("source", "node"),
    neighbors__at_hop=lambda g, ids, types, distance: _hop_rows(g, ids, types, distance).where(F.col("depth") == distance).select("source", "node"),
    neighbors__by_hop=lambda g, ids, types, distance: _hop_rows(g, ids, types, distance).select("source", "node", "depth"),
    path__subgraph_nodes=lambda g, ids, config=None: _steps(g, ids, config if isinstance(config, dict) else {"maxLevel": config if config is not None else -1, "relationshipFilter": [">"]}, False),
    path__expand_config=lambda g, ids, config=None: _paths_of(g, _steps(g, ids, config, True)),
    path__expand=lambda g, ids, rels, labels, low, high: _paths_of(g, _steps(g, ids, {"relationshipFilter": rels, "labelFilter": labels, "minLevel": low, "maxLevel": high}, True)),
    node__degree_in=lambda g, ids, type=None: _degrees(g, ids, type, "dst"), node__degree_out=lambda g, ids, type=None: _degrees(g, ids, type, "src"),
    node__relationship_exists=lambda g, ids, wanted: _exists(g, ids, wanted).select("source", F.exists(F.map_values("result"), lambda x: x).alias("exists")),
    node__relationships_exist=_exists, nodes__relationships_exist=_exists, node__relationship_types=_types, nodes__relationship_types=_types,
    nxalg__bfs_edges=lambda g, ids, backwards=False, limit=None: N.breadth_first(_parts(g)[1], _nodes(ids), limit, backwards).select("source", F.col("predecessor").alias("node_from"), F.col("node").alias("node_to"), "depth"),
    nxalg__bfs_tree=lambda g, ids, backwards=False, limit=None: N.breadth_first(_parts(g)[1], _nodes(ids), limit, backwards).select("source", F.col("predecessor").alias("node_from"), F.col("node").alias("node_to")),
    nxalg__bfs_predecessors=lambda g, ids, limit=None: N.breadth_first(_parts(g)[1], _nodes(ids), limit).select("source", "node", "predecessor"),
    nxalg__bfs_successors=lambda g, ids, limit=None: N.breadth_first(_parts(g)[1], _nodes(ids), limit).groupBy("source", "predecessor").agg(F.sort_array(F.collect_list("node")).alias("successors")).withColumnRenamed("predecessor", "node"),
    nxalg__edge_bfs=lambda g, ids: N.breadth_first(_parts(g)[1], _nodes(ids)).select("source", F.col("node").alias("at"), "depth").unionByName(_nodes(ids).select(F.col("id").alias("source"), F.col("id").alias("at"), F.lit(0).alias("depth")), allowMissingColumns=True).join(_parts(g)[1].select("src", "dst"), F.col("at") == F.col("src")).select("source", F.col("src").alias("node_from"), F.col("dst").alias("node_to"), "depth"),
    nxalg__multi_source_dijkstra_path=lambda g, ids, cutoff=None, weight="weight": _nearest_source(g, ids, cutoff, weight).select("target", "path"),
    nxalg__multi_source_dijkstra_path_length=lambda g, ids, cutoff=None, weight="weight": _nearest_source(g, ids, cutoff, weight).select("target", "length"),
    nxalg__voronoi_cells=lambda g, ids, weight=None: S.voronoi_cells(_parts(g)[1], _nodes(ids)) if weight is None else _nearest_source(g, ids, None, weight).select(F.col("target").alias("node"), F.col("first").alias("center")),
    nxalg__is_isolate=lambda g, ids: _nodes(ids).join(A.isolates(*_parts(g)).withColumn("_i", F.lit(True)), "id", "left").select(F.col("id").alias("source"), F.coalesce("_i", F.lit(False)).alias("is_isolate")),
    nxalg__node_boundary=lambda g, ids: both_ways(_parts(g)[1].select("src", "dst")).join(_nodes(ids).toDF("src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(_nodes(ids), "id", "left_anti").select(F.col("id").alias("node")),
    nxalg__node_expansion=lambda g, ids: _parts(g)[1].select("src", "dst").where("src != dst").transform(both_ways).join(_nodes(ids).toDF("src"), "src", "left_semi").select("dst").distinct().join(_nodes(ids).toDF("dst"), "dst", "left_anti").agg(F.count(F.lit(1)).alias("n")).crossJoin(_nodes(ids).agg(F.count(F.lit(1)).alias("k"))).select((F.col("n") / F.col("k")).alias("node_expansion")),
    algo__cover=lambda g, ids: N.chosen(g.rel_table(), _nodes(ids)).select(F.col("id").alias("rel")),
    degree_centrality__get_subgraph=lambda g, ids, kind="undirected": A.degree_centrality(_nodes(ids), N.chosen(_parts(g)[1], _nodes(ids)), kind),
    community_detection__get_subgraph=lambda g, ids: S.louvain(_nodes(ids), N.chosen(_parts(g)[1], _nodes(ids))),
    leiden_community_detection__get_subgraph=lambda g, ids: N.leiden(_nodes(ids), N.chosen(_parts(g)[1], _nodes(ids))),
    graph_coloring__color_subgraph=lambda g, ids: S.colouring(_nodes(ids), N.chosen(_parts(g)[1], _nodes(ids))),
    nxalg__weakly_connected_components_subgraph=lambda g, ids: A.weakly_connected_components(_nodes(ids), N.chosen(_parts(g)[1], _nodes(ids))),
    graph_analyzer__analyze_subgraph=lambda g, ids, wanted=None: _analyze(_nodes(ids), N.chosen(_parts(g)[1], _nodes(ids)), wanted),
)


def _degrees(graph: Graph, ids: DataFrame, type: str | None, side: str) -> DataFrame:
    own = graph.rel_table({type} if type else None).groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("value"))
    return _nodes(ids).join(own, "id", "left").select(F.col("id").alias("source"), F.coalesce("value", F.lit(0)).alias("value"))


def _nearest_source(graph: Graph, ids: DataFrame, cutoff: float | None, weight: str) -> DataFrame:
    """(target, length, path, first): from the nearest of the sources; ties by the least."""
    found = N.shortest_paths(_flow_edges(graph, weight), _nodes(ids), True)
    own = _nodes(ids).select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("length"), F.array("id").alias("path"))
    best = found.unionByName(own).groupBy("target").agg(F.min(F.struct("length", "path")).alias("m")).select("target", "m.length", "m.path", F.element_at("m.path", 1).alias("first"))
    return best if cutoff is None else best.where(F.col("length") <= cutoff)


_takes(  # what goes from node to node
    0, 1,
    algo__all_simple_paths=lambda g, ids, types=None, longest=None: N.simple_paths(g.rel_table(set(types or []) or None), _pairs(ids), longest),
    nxalg__all_simple_paths=lambda g, ids, cutoff=None: N.simple_paths(g.rel_table(), _pairs(ids), cutoff),
    igraphalg__get_all_simple_paths=lambda g, ids, cutoff=-1: N.simple_paths(g.rel_table(), _pairs(ids), None if cutoff < 0 else cutoff),
    algo__astar=lambda g, ids, config=None: N.shortest_paths(_flow_edges(g, (config or {}).get("distance_prop", "weight")), _nodes(ids), True).join(_pairs(ids), ["source", "target"], "left_semi").select("source", "target", "path", F.col("length").alias("weight")),
    nxalg__shortest_path=lambda g, ids, weight=None: _path_value(N.shortest_paths(_flow_edges(g, weight) if weight else g.rel_table().select("src", "dst"), _nodes(ids), weight is not None).join(_pairs(ids), ["source", "target"], "left_semi")),
    nxalg__all_shortest_paths=lambda g, ids, weight=None: _path_value(N.shortest_paths(_flow_edges(g, weight) if weight else g.rel_table().select("src", "dst"), _nodes(ids), weight is not None, True).join(_pairs(ids), ["source", "target"], "left_semi")),
    igraphalg__get_shortest_path=lambda g, ids, weights=None, directed=True: _path_value(N.shortest_paths(_flow_edges(g, weights) if weights else g.rel_table().select("src", "dst") if directed else both_ways(g.rel_table().select("src", "dst")), _nodes(ids), weights is not None).join(_pairs(ids), ["source", "target"], "left_semi")),
    nxalg__shortest_path_length=_lengths, igraphalg__shortest_path_length=_lengths,
    nxalg__has_path=lambda g, ids: _pairs(ids).join(reach(_parts(g)[1], _nodes(ids)).select("source", F.col("node").alias("target"), F.lit(True).alias("_y")), ["source", "target"], "left").select("source", "target", F.coalesce("_y", F.lit(False)).alias("has_path")),
    nxalg__lowest_common_ancestor=lambda g, ids: _each_pair(g, ids, lambda a, b: N.lowest_common_ancestors(_parts(g)[1], a, b)),
    node_similarity__jaccard_pairwise=lambda g, ids: _compared(_parts(g)[1], "jaccard", ids),
    node_similarity__overlap_pairwise=lambda g, ids: _compared(_parts(g)[1], "overlap", ids),
    nxalg__jaccard_coefficient=lambda g, ids: _compared(both_ways(S._plain(_parts(g)[1])), "jaccard", ids).withColumnsRenamed({"node1": "u", "node2": "v", "similarity": "coef"}),
)


def _each_pair(graph: Graph, ids: DataFrame, f: Callable[[int, int], DataFrame]) -> DataFrame:
    """f for one given pair after the other."""
    out = None
    for r in _pairs(ids).collect():  # the pairs that the call names
        got = f(r["source"], r["target"]).select(F.lit(r["source"]).alias("source"), F.lit(r["target"]).alias("target"), "*")
        out = got if out is None else out.unionByName(got)
    return out


_takes(  # changes of given nodes
    0, writes=True,
    create__set_property=lambda g, ids, key, value: R.set_properties(g, ids, key, value), create__set_properties=R.set_properties, create__remove_properties=R.remove_properties, create__remove_labels=R.remove_labels,
    create__set_rel_property=lambda g, ids, key, value: R.set_properties(g, ids, key, value, nodes=False), create__set_rel_properties=lambda g, ids, keys, values: R.set_properties(g, ids, keys, values, nodes=False),
    create__remove_rel_properties=lambda g, ids, keys: R.remove_properties(g, ids, keys, nodes=False), nodes__delete=R.delete_nodes,
    refactor__clone_nodes=R.clone_nodes, refactor__invert=R.invert, refactor__collapse_node=R.collapse_node, refactor__extract_node=R.extract_node,
)
_takes(0, 3, writes=True, create__relationship=lambda g, pairs, type, props=None: R.create_relationships(g, pairs, type, props))
_takes(0, 4, writes=True, merge__relationship=R.merge_relationship)
_takes(0, 1, writes=True, refactor__from=lambda g, pairs: R.move_end(g, pairs, "from"), refactor__to=lambda g, pairs: R.move_end(g, pairs, "to"))


def _listed(values: object) -> list[int]:
    return [int(x) for x in (values if isinstance(values, list) else [values])]


def _link(graph: Graph, ids: DataFrame, type: str) -> R.Result:
    return R.chain(graph, sorted(r["source"] for r in ids.select("source").distinct().collect()), type)  # the nodes that the call names


_takes(
    writes=True,
    create__node=R.create_nodes, create__nodes=R.create_nodes, merge__node=R.merge_node, graph_util__chain_nodes=lambda g, nodes, type: R.chain(g, _listed(nodes), type),
    nodes__link=lambda g, nodes, type: R.chain(g, _listed(nodes), type),
    refactor__rename_label=lambda g, old, new, nodes=None: R.rename_label(g, old, new, _given(g, nodes)), refactor__rename_node_property=lambda g, old, new, nodes=None: R.rename_property(g, old, new, _given(g, nodes)),
    refactor__rename_type=lambda g, old, new, rels=None: R.rename_type(g, old, new, _given(g, rels)), refactor__rename_type_property=lambda g, old, new, rels=None: R.rename_property(g, old, new, _given(g, rels), nodes=False),
    refactor__categorize=R.categorize, refactor__clone_subgraph=lambda g, nodes, rels=None, config=None: R.clone_subgraph(g, _listed(nodes), rels, config),
    refactor__clone_subgraph_from_paths=lambda g, paths, config=None: R.clone_subgraph(g, sorted({int(n) for p in paths for n in (p if isinstance(p, list) else [p])}), None, config),
    refactor__merge_nodes=lambda g, nodes, config=None: R.merge_nodes(g, _listed(nodes), config), refactor__delete_and_reconnect=lambda g, path, nodes, config=None: R.delete_and_reconnect(g, _listed(path), _listed(nodes), config),
    refactor__normalize_as_boolean=lambda g, key, true_values, false_values: _normalized(g, key, true_values, false_values),
    periodic__iterate=R.iterate, periodic__delete=R.delete_all, do__when=R.do_when, do__case=R.do_case,
    import_util__cypher=_import_statements, import_util__json=_import_json, import_util__graphml=_import_graphml, gnn__pyg_import=_import_tensors, gnn__tf_import=lambda g, data, label="TfGnnNode", type="CONNECTS": _import_tensors(g, data, label, type),
    node2vec__set_embeddings=lambda g, dimensions=16, name="embedding": _attached(g, N.node2vec(*_parts(g), dimensions=dimensions), "embedding", name),
    kmeans__set_clusters=lambda g, label, clusters, column="embedding", name="cluster_id": _attached(g, S.kmeans(g.node_table({label}), clusters, column), "cluster_id", name),
)


def _given(graph: Graph, ids: list[int] | None) -> DataFrame | None:
    return None if ids is None else _ids(graph, _listed(ids)).withColumnRenamed("id", "source")


def _normalized(graph: Graph, key: str, true_values: list, false_values: list) -> R.Result:
    yes, no = [str(v) for v in true_values], [str(v) for v in false_values]

    def change(t: DataFrame) -> DataFrame:
        x = F.col(f"`{key}`").cast("string")
        return t.withColumn(key, F.when(x.isin(yes), True).when(x.isin(no), False)) if key in t.columns else t

    return R._each(graph, change), graph.spark.createDataFrame([("success",)], "value string")


def _attached(graph: Graph, rows: DataFrame, column: str, name: str) -> R.Result:
    """Rows (node, column) as a property of the nodes."""
    new = cut(rows.select(F.col("node").alias("id"), F.col(column).alias("_new")))
    out = R._each(graph, lambda t: t.drop(name).join(new, "id", "left").withColumnRenamed("_new", name))
    return out, new.select(F.col("id").alias("node"), F.col("_new").alias(column))


def _vectors(graph: Graph, column: str) -> DataFrame:
    return graph.node_table().select("id", F.col(f"`{column}`"))


def _knn(graph: Graph, config: dict) -> DataFrame:
    """Cosine over one vector property; the exact neighbours, so the search's sampling options change nothing."""
    names = config.get("nodeProperties", "embedding")
    name = names if isinstance(names, str) else names[0]
    return N.nearest_vectors(_vectors(graph, name), name, int(config.get("topK", 1)), float(config.get("similarityCutoff", 0.0)))


def _all_pairs(graph: Graph, column: str) -> DataFrame:
    v = _vectors(graph, column)
    found = N.nearest_vectors(v, column, 2**31 - 1, -1.0)
    return found.where("node < neighbour").toDF("node1", "node2", "similarity")


PROCEDURES |= {
    "katz_centrality.get": _whole(A.katz_centrality), "leiden_community_detection.get": _whole(lambda v, e, *_: N.leiden(v, e)), "igraphalg.community_leiden": _whole(lambda v, e, *_: N.leiden(v, e)),
    "knn.get": _knn, "node_similarity.cosine": _all_pairs, "node_similarity.cosine_pairwise": lambda g, column, a, b: N.cosine_pairs(_vectors(g, column), column, g.spark.createDataFrame(list(zip(_listed(a), _listed(b), strict=True)), "node1 bigint, node2 bigint")),
    "biconnected_components.get": _part_kernel(lambda n, e: [(min(min(x) for x in block), a, b) for block in K.biconnected(K.plain(e)) for a, b in block], "bcc_id bigint, node_from bigint, node_to bigint"),
    "nxalg.biconnected_components": _part_kernel(lambda n, e: [(sorted({x for pair in block for x in pair}),) for block in K.biconnected(K.plain(e))], "components array<bigint>"),
    "bipartite_matching.max": lambda g: K.run(*_parts(g), lambda n, e: [(K.bipartite_matching(n, K.plain(e)),)], "m bigint").agg(F.when(F.count_if(F.col("m").isNull()) > 0, 0).otherwise(F.coalesce(F.sum("m"), F.lit(0))).alias("maximum_bipartite_matching")),
    "nxalg.chain_decomposition": _part_kernel(lambda n, e, root=None: [([{"src": a, "dst": b} for a, b in c],) for c in (K.chains(K.plain(e), root) if root is None or root in n else [])], f"chains {N.EDGES}"),
    "nxalg.find_cliques": _part_kernel(lambda n, e: [(c,) for c in K.cliques({x: set() for x in n} | K.plain(e))], "cliques array<bigint>"),
    "nxalg.k_clique_communities": _part_kernel(lambda n, e, k: [(c,) for c in K.clique_communities(K.cliques(K.plain(e)), int(k))], "communities array<bigint>"),
    "nxalg.k_components": _part_kernel(_kcore_rows, "k bigint, components array<bigint>"),
    "nxalg.k_edge_components": _part_kernel(lambda n, e, k=2: [(c,) for c in K.k_edge_parts({x: set() for x in n} | K.plain(e), int(k))], "components array<bigint>"),
    "nxalg.communicability": _part_kernel(_communicable, "node1 bigint, node2 bigint, communicability double"),
    "nxalg.is_chordal": _whole(N.kernel_flag("is_chordal", lambda n, e: K.chordal(K.plain(e)))), "nxalg.is_at_free": _whole(N.kernel_flag("is_at_free", lambda n, e: K.at_free(K.plain(e)))),
    "nxalg.check_planarity": _whole(N.kernel_flag("is_planar", lambda n, e: K.planar(K.plain(e)))),
    "nxalg.dominance_frontiers": _whole_kernel(_frontier_rows, "node bigint, frontier array<bigint>"),
    "nxalg.immediate_dominators": _whole_kernel(lambda n, e, start: list(K.dominators(K.forward(e), int(start)).items()), "node bigint, dominator bigint"),
    "nxalg.dfs_tree": _whole_kernel(lambda n, e, source, limit=None: [(p, c) for c, p in K.depth_first(K.forward(e), int(source), limit)[2].items()], "node_from bigint, node_to bigint"),
    "nxalg.dfs_predecessors": _whole_kernel(lambda n, e, source, limit=None: list(K.depth_first(K.forward(e), int(source), limit)[2].items()), "node bigint, predecessor bigint"),
    "nxalg.dfs_successors": lambda g, source, limit=None: K.run(*_parts(g), lambda n, e: [(p, c) for c, p in K.depth_first(K.forward(e), int(source), limit)[2].items()], "node bigint, c bigint", True).groupBy("node").agg(F.collect_list("c").alias("successors")),
    "nxalg.dfs_preorder_nodes": _whole_kernel(lambda n, e, source, limit=None: [(K.depth_first(K.forward(e), int(source), limit)[0],)], "nodes array<bigint>"),
    "nxalg.dfs_postorder_nodes": _whole_kernel(lambda n, e, source, limit=None: [(K.depth_first(K.forward(e), int(source), limit)[1],)], "nodes array<bigint>"),
    "nxalg.edge_dfs": _whole_kernel(lambda n, e, source: [([{"src": a, "dst": b} for a, b in K.edges_depth_first(K.forward(e), int(source))],)], f"edges {N.EDGES}"),
    "nxalg.find_cycle": _whole_kernel(lambda n, e: [([{"src": a, "dst": b} for a, b in K.a_cycle(n, K.forward(e))],)], f"cycle {N.EDGES}"),
    "nxalg.triadic_census": _whole_kernel(_census, "triad string, count bigint"), "nxalg.non_randomness": _whole_kernel(_randomness, "non_randomness double, relative_non_randomness double"),
    "nxalg.node_connectivity": lambda g, source=None, target=None: K.run(*_parts(g), lambda n, e: [(_connectivity(n, e, source, target),)], "connectivity bigint", True),
    "nxalg.is_isomorphic": lambda g, nodes1, edges1, nodes2, edges2: g.spark.createDataFrame([(_isomorphic(g, nodes1, edges1, nodes2, edges2),)], "is_isomorphic boolean"),
    "nxalg.degree_assortativity_coefficient": _edges(N.assortativity), "nxalg.flow_hierarchy": _whole(N.flow_hierarchy), "nxalg.local_efficiency": _whole(N.local_efficiency),
    "nxalg.center": _whole(lambda v, e: _centre(v, both_ways(S._plain(e)))), "nxalg.reciprocity": lambda g, nodes=None: A.reciprocity(_parts(g)[1]) if nodes is None else _node_reciprocity(g, nodes),
    "nxalg.is_distance_regular": _flag("is_distance_regular", N.distance_regular), "nxalg.is_strongly_regular": _flag("is_strongly_regular", N.strongly_regular),
    "nxalg.is_semieulerian": _flag("is_semieulerian", lambda v, e: N.eulerian(v, e, True) and not N.eulerian(v, e)), "nxalg.has_eulerian_path": _flag("has_eulerian_path", lambda v, e: N.eulerian(v, e, True)),
    "nxalg.is_eulerian": _flag("is_eulerian", N.eulerian),
    "nxalg.is_arborescence": _flag("is_arborescence", lambda v, e: _is_tree(v, e) and _most_into(e) <= 1), "nxalg.is_branching": _flag("is_branching", lambda v, e: _is_forest(v, e) and _most_into(e) <= 1),
    "nxalg.is_tournament": _flag("is_tournament", lambda v, e: e.where("src = dst").isEmpty() and S._plain(e).count() == e.select("src", "dst").distinct().count() == v.count() * (v.count() - 1) // 2),
    "nxalg.is_edge_cover": lambda g, cover: _covered(g, cover), "nxalg.is_simple_path": lambda g, nodes: _simple(g, _listed(nodes)),
    "nxalg.simple_cycles": _edges(S.cycles), "nxalg.topological_sort": _whole(A.topological_sort), "nxalg.betweenness_centrality": _whole(lambda v, e, k=None, normalized=True: S.betweenness_centrality(v, e, True, normalized).withColumnRenamed("betweenness_centrality", "betweenness")),
    "igraphalg.pagerank": _whole(lambda v, e, damping=0.85, weights=None, directed=True: A.pagerank(v, e if directed else both_ways(e), damping, 1000, 1e-10)),
    "igraphalg.all_shortest_path_lengths": _whole(lambda v, e, weights=None, directed=False: reach(e if directed else both_ways(e.select("src", "dst")), v).select(F.col("source").alias("src_node"), F.col("node").alias("dest_node"), F.col("depth").cast("double").alias("length"))),
    "igraphalg.maxflow": lambda g, source, target, capacity="weight": _flow(g, source, target, capacity, lambda n, e: [(K.max_flow(e, int(source), int(target))[0],)], "max_flow double"),
    "max_flow.get_flow": lambda g, source, target, capacity="weight": _flow(g, source, target, capacity, lambda n, e: [(K.max_flow(e, int(source), int(target))[0],)], "max_flow double"),
    "max_flow.get_paths": lambda g, source, target, capacity="weight": _flow(g, source, target, capacity, lambda n, e: K.flow_paths(e, int(source), int(target)), "path array<bigint>, flow double"),
    "igraphalg.mincut": lambda g, source, target, capacity="weight", directed=True: K.run(g.node_table().select("id"), _flow_edges(g, capacity) if directed else both_ways(_flow_edges(g, capacity)), lambda n, e: [(x, 0 if x in K.max_flow(e, int(source), int(target))[2] else 1) for x in n], "node bigint, partition_id bigint", True),
    "set_cover.greedy": lambda g, elements, sets: S.set_cover(g.spark.createDataFrame(list(zip(_listed(elements), _listed(sets), strict=True)), "element bigint, containing_set bigint")),
    "set_cover.cp_solve": lambda g, elements, sets: _least_cover(g, _listed(elements), _listed(sets)),
    "tsp.solve": _tsp, "vrp.route": _vrp, "search.node": lambda g, wanted, operator, value: _search(g, wanted, operator, value, True), "search.node_all": lambda g, wanted, operator, value: _search(g, wanted, operator, value, False),
    "text_search.search": _text_search, "text_search.search_all": _text_search, "text_search.regex_search": _text_regex, "text_search.fuzzy_phrase_search": _text_fuzzy, "text_search.aggregate": _text_aggregate,
    "text_search.search_edges": lambda g, *a: _text_search(g, *(list(a) + [None])[:3], edges=True), "text_search.search_all_edges": lambda g, *a: _text_search(g, *(list(a) + [None])[:3], edges=True), "text_search.regex_search_edges": lambda g, *a: _text_regex(g, *(list(a) + [None])[:3], edges=True),
    "text_search.fuzzy_phrase_search_edges": lambda g, *a: _text_fuzzy(g, *(list(a) + [None])[:3], edges=True), "text_search.aggregate_edges": lambda g, *a: _text_aggregate(g, *a, edges=True),
    "vector_search.search": _vector, "vector_search.search_edges": lambda g, *a: _vector(g, *a, edges=True), "vector_search.show_index_info": _vector_info,
    "node2vec.get_embeddings": _whole(lambda v, e, dimensions=16: N.node2vec(v, e, dimensions)), "node2vec.help": lambda g: g.spark.createDataFrame([("get_embeddings", "node, embedding of random walks"), ("set_embeddings", "writes the embeddings as a property")], "name string, value string"),
    "node2vec_online.help": lambda g: g.spark.createDataFrame([("update", "walks and vectors of the graph as it is"), ("get", "the vectors of the last update")], "name string, value string"),
    "node2vec_online.set_streamwalk_updater": lambda g, *_: g.spark.createDataFrame([("walks are drawn anew at each update",)], "message string"), "node2vec_online.set_word2vec_learner": lambda g, dimensions=16, *_: g.spark.createDataFrame([("vectors are learnt anew at each update",)], "message string"),
    "graph_analyzer.help": lambda g: g.spark.createDataFrame([("analyze", "figures of the graph"), ("analyze_subgraph", "figures of a part of it")], "name string, value string"), "graph_analyzer.analyze": lambda g, wanted=None: _analyze(*_parts(g), wanted),
    "csv_utils.create_csv_file": _csv, "csv_utils.delete_csv_file": _delete_file, "json_util.load_from_path": lambda g, path: g.spark.read.option("multiLine", True).json(path).select(F.struct("*").alias("objects")),
    "xml_module.load": lambda g, path, tag="row": g.spark.read.format("xml").option("rowTag", tag).load(path).select(F.struct("*").alias("output_map")), "gnn.pyg_export": _export_tensors, "gnn.tf_export": lambda g, *a: _export_tensors(g, *a[:2]),
    "date.get_date_formats": lambda g: g.spark.createDataFrame(DATE_FORMATS, "name string, pattern string"), "meta.stats_online": _stats, "meta.update": _stats, "meta.reset": lambda g: g.spark.createDataFrame([("success",)], "value string"),
    "mgps.components": lambda g: g.spark.createDataFrame([(["1.0"], "community", "graphloom")], "versions array<string>, edition string, name string"), "mgps.await_indexes": lambda g, seconds=0: g.spark.createDataFrame([], "value string"),
    "mgps.validate": lambda g, predicate, message, params=None: _validated(g, predicate, message, params), "map.from_nodes": lambda g, label, prop: g.node_table({label}).where(F.col(f"`{prop}`").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct(F.col(f"`{prop}`").cast("string"), F.struct(*[c for c in g.node_table({label}).columns if c not in ("id", "labels")])))).alias("map")),
    "cugraph.pagerank": _whole(lambda v, e, rounds=100, damping=0.85, stop=1e-5: A.pagerank(v, e, damping, rounds, stop)), "cugraph.personalized_pagerank": lambda g, nodes, damping=0.85, rounds=100, stop=1e-5: A.pagerank(*_parts(g), damping, rounds, stop, _ids(g, _listed(nodes))),
    "cugraph.katz_centrality": _whole(A.katz_centrality), "cugraph.hits": _whole(A.hits), "cugraph.louvain": _whole(lambda v, e: S.louvain(v, e)), "cugraph.leiden": _whole(lambda v, e: N.leiden(v, e)), "hits.get": _whole(A.hits),
    "cugraph.betweenness_centrality": _whole(lambda v, e, directed=True, normalized=True: S.betweenness_centrality(v, e, directed, normalized)),
    "cugraph.spectral_clustering": lambda g, clusters: K.run(*_parts(g), lambda n, e: _spectral(n, e, int(clusters)), "node bigint, cluster bigint", True), "cugraph.balanced_cut_clustering": lambda g, clusters: K.run(*_parts(g), lambda n, e: _spectral(n, e, int(clusters)), "node bigint, cluster bigint", True),
    "cugraph.graph_generator": lambda g, scale, count, seed=0: N.generated(g.spark, int(scale), int(count), int(seed)),
    "distance_calculator.multiple": lambda g, starts, ends, metres="m": g.spark.createDataFrame([([K.metres((float(a["lat"]), float(a["lng"])), (float(b["lat"]), float(b["lng"]))) / (1000 if metres == "km" else 1) for a, b in zip(starts, ends, strict=True)],)], "distances array<double>"),
    **N.online("pagerank_online", "rank", lambda g: A.pagerank(*_parts(g))), **N.online("katz_centrality_online", "rank", lambda g: A.katz_centrality(*_parts(g))),
    **N.online("betweenness_centrality_online", "betweenness_centrality", lambda g: S.betweenness_centrality(*_parts(g))), **N.online("community_detection_online", "community_id", lambda g: A.label_propagation(*_parts(g))),
    **{k: f for k, f in N.online("node2vec_online", "embedding", lambda g: N.node2vec(*_parts(g))).items() if not k.endswith(".set")},
}
for _old in ("igraphalg.topological_sort", "graph_util.topological_sort"):
    PROCEDURES.setdefault(_old, PROCEDURES["nxalg.topological_sort"])


def _connectivity(nodes: list[int], edges: list, source: int | None, target: int | None) -> int:
    near = {n: set() for n in nodes} | K.plain(edges)
    if source is not None and target is not None:
        if int(target) in near[int(source)]:
            return 1 + len(K.node_cut({k: v - ({int(target)} if k == int(source) else {int(source)} if k == int(target) else set()) for k, v in near.items()}, int(source), int(target)))
        return len(K.node_cut(near, int(source), int(target)))
    cut_ = K.least_node_cut(near)
    return len(near) - 1 if cut_ is None else len(cut_)


def _isomorphic(graph: Graph, nodes1: list, edges1: list, nodes2: list, edges2: list) -> bool:
    """Subgraphs given by ids of nodes and relationships; both are small enough for a call."""
    sides = []
    for nodes, rels in ((nodes1, edges1), (nodes2, edges2)):
        v, e = _sub(graph, nodes, rels)
        sides.append({int(n): set() for n in nodes} | K.plain([(r["src"], r["dst"]) for r in e.collect()]))
    return K.isomorphic(*sides)


def _centre(v: DataFrame, e: DataFrame) -> DataFrame:
    far = cut(S.distances(v, e))
    least = far.agg(F.min("eccentricity").alias("least"))
    return far.crossJoin(F.broadcast(least)).where("eccentricity = least").select(F.col("node").alias("center"))


def _node_reciprocity(graph: Graph, nodes: list) -> DataFrame:
    e = _parts(graph)[1].select("src", "dst").where("src != dst").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    both = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").groupBy(F.col("src").alias("node")).agg((F.count(F.lit(1)) * 2).alias("k"))
    return _ids(graph, _listed(nodes)).withColumnRenamed("id", "node").join(ends, "node", "left").join(both, "node", "left").select("node", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("reciprocity"))


def _most_into(e: DataFrame) -> int:
    return e.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _covered(graph: Graph, cover: list) -> DataFrame:
    used = graph.rel_table().join(_ids(graph, _listed(cover)), "id", "left_semi").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.node_table().select("id").join(used, "id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("is_edge_cover"))


def _simple(graph: Graph, nodes: list[int]) -> DataFrame:
    e = graph.rel_table().select("src", "dst").distinct()
    wanted = graph.spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)) or [(-1, -1)], "src bigint, dst bigint")
    fits = len(set(nodes)) == len(nodes) and bool(nodes)
    missing = wanted.join(e, ["src", "dst"], "left_anti") if len(nodes) > 1 else graph.node_table().select("id").join(_ids(graph, nodes), "id", "left_semi").agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return missing.agg(((F.count(F.lit(1)) == 0) & F.lit(fits)).alias("is_simple_path"))


def _least_cover(graph: Graph, elements: list[int], sets: list[int]) -> DataFrame:
    """The fewest sets that hold all elements, by growing combinations; the call names all of them."""
    import itertools

    own: dict[int, set[int]] = {}
    for e, s in zip(elements, sets, strict=True):
        own.setdefault(s, set()).add(e)
    every = set(elements)
    for n in range(len(own) + 1):
        for some in itertools.combinations(sorted(own), n):
            if set().union(*(own[s] for s in some)) >= every:
                return graph.spark.createDataFrame([(s,) for s in some], "containing_set bigint")
    return graph.spark.createDataFrame([], "containing_set bigint")


def _validated(graph: Graph, predicate: bool, message: str, params: list | None) -> DataFrame:
    if predicate:
        raise ValueError(message % tuple(params or ()))
    return graph.spark.createDataFrame([(None,)], "value string")


def _spectral(nodes: list[int], edges: list, clusters: int) -> list[tuple[int, int]]:
    near = {n: set() for n in nodes} | K.plain(edges)
    return [(n, int(c)) for n, c in zip(nodes, K.spectral_parts(nodes, near, clusters), strict=True)]
