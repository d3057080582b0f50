"""Graph algorithms over edges(src, dst[, weight]) and vertices(id) as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .traversal import both_ways, cut, numbered, reach


def degree_centrality(vertices: DataFrame, edges: DataFrame, kind: str = "undirected") -> DataFrame:
    """(node, degree): degree over n - 1."""
    side = {"out": ["src"], "in": ["dst"], "undirected": ["src", "dst"]}[kind]
    ends = edges.select(F.explode(F.array(*side)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    return vertices.select(F.col("id").alias("node")).join(ends, "node", "left").crossJoin(F.broadcast(n)).select(
        "node", F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, stop: float = 1e-5, personal: DataFrame | None = None) -> DataFrame:
    """(node, rank) of sum 1; the mass of nodes without out-edges is dealt over the start distribution."""
    n = vertices.count()
    if not n:
        return vertices.select(F.col("id").alias("node"), F.lit(0.0).alias("rank"))
    start = vertices.select(F.col("id").alias("node"), F.lit(1.0 / n).alias("base"))
    if personal is not None:
        share = 1.0 / max(1, personal.count())
        start = vertices.select(F.col("id").alias("node")).join(personal.select(F.col("id").alias("node"), F.lit(share).alias("p")), "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("base"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    steps = cut(edges.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("d")).alias("share")))
    start = cut(start)
    ranks = start.select("node", F.col("base").alias("rank"))
    for _ in range(max_iterations):
        moved = ranks.join(steps, ranks["node"] == steps["src"])
        got = moved.groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        sent = moved.agg(F.coalesce(F.sum(F.col("rank") * F.col("share")), F.lit(0.0)).alias("sent"))
        new = start.join(got, start["node"] == got["dst"], "left").crossJoin(F.broadcast(sent)).select(
            "node", (F.col("base") * (1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + (1 - F.col("sent")) * F.col("base"))).alias("rank"))
        new = cut(new)
        change = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new
        if change < stop:
            break
    return ranks


def katz_centrality(vertices: DataFrame, edges: DataFrame, alpha: float = 0.2, epsilon: float = 1e-2, beta: float = 1.0) -> DataFrame:
    """(node, rank): alpha * sum over in-neighbours + beta, in rounds until no rank moves by epsilon. An alpha for which it does not settle raises."""
    ranks = cut(vertices.select(F.col("id").alias("node"), F.lit(float(beta)).alias("rank")))
    least, worse = None, 0
    while True:
        got = ranks.join(edges, ranks["node"] == edges["src"]).groupBy("dst").agg(F.sum("rank").alias("got"))
        new = cut(ranks.withColumnRenamed("rank", "old").join(got, F.col("node") == F.col("dst"), "left").select("node", "old", (F.coalesce("got", F.lit(0.0)) * alpha + beta).alias("rank")))
        change = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("node", "rank")
        if change is None or change < epsilon:
            return ranks
        worse = worse + 1 if least is not None and change >= least else 0
        least = change if least is None else min(least, change)
        if worse >= 20:
            raise ValueError("the ranks do not settle: alpha has to be less than 1 over the greatest eigenvalue")


def hits(vertices: DataFrame, edges: DataFrame, rounds: int = 1000, stop: float = 1e-8) -> DataFrame:
    """(node, hub, authority), each of sum 1; rounds end when no hub moves by stop."""
    hub = vertices.select(F.col("id").alias("node"), F.lit(1.0).alias("hub"))
    steps = cut(edges.select("src", "dst"))
    for _ in range(rounds):
        authority = hub.join(steps, hub["node"] == steps["src"]).groupBy("dst").agg(F.sum("hub").alias("a"))
        total = authority.agg(F.sum("a").alias("t"))
        authority = authority.crossJoin(F.broadcast(total)).select(F.col("dst").alias("at"), (F.col("a") / F.col("t")).alias("authority"))
        back = authority.join(steps, authority["at"] == steps["dst"]).groupBy("src").agg(F.sum("authority").alias("h"))
        total = back.agg(F.sum("h").alias("t"))
        new = cut(back.crossJoin(F.broadcast(total)).select(F.col("src").alias("node"), (F.col("h") / F.col("t")).alias("hub")))
        change = new.join(hub.withColumnRenamed("hub", "old"), "node", "full").agg(F.max(F.abs(F.coalesce("hub", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        hub = new
        if change is None or change < stop:
            break
    authority = cut(authority)
    both = vertices.select(F.col("id").alias("node")).join(hub, "node", "left").join(authority.withColumnRenamed("at", "node"), "node", "left")
    return both.select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def weakly_connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id): the least id that is reachable ignoring directions; labels fall by neighbours and by pointer jumps."""
    near = cut(both_ways(edges.select("src", "dst")).where("src != dst").distinct())
    labels = cut(vertices.select(F.col("id").alias("node"), F.col("id").alias("root")))
    while True:
        low = labels.join(near, labels["node"] == near["dst"]).groupBy("src").agg(F.min("root").alias("low"))
        step = labels.join(low, labels["node"] == low["src"], "left").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        step = cut(step)
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = cut(step.join(jump, step["root"] == jump["at"]).select("node", "old", F.least("root", "far").alias("root")))
        labels = new.select("node", "root")
        if new.where("root != old").isEmpty():
            return labels.withColumnRenamed("root", "component_id")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each undirected triangle once; edges point from the smaller degree to the larger, so hubs stay cheap."""
    pairs = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    x, y = degree.select(F.col("v").alias("a"), F.col("d").alias("da")), degree.select(F.col("v").alias("b"), F.col("d").alias("db"))
    first = F.struct("da", "a") < F.struct("db", "b")
    one = cut(pairs.join(x, "a").join(y, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")))
    two = one.select(F.col("u").alias("u"), F.col("v").alias("w"))
    wedge = one.join(two, "u").where("v < w")
    closed = one.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    return wedge.join(closed, (wedge["v"] == closed["p"]) & (wedge["w"] == closed["q"])).select(
        F.sort_array(F.array("u", "v", "w")).alias("t")).select(*[F.col("t")[i].alias(n) for i, n in enumerate("abc")])


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, clustering)."""
    pairs = both_ways(edges.where("src != dst").select("src", "dst")).distinct()
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    per = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    return vertices.select(F.col("id").alias("node")).join(degree, F.col("node") == F.col("src"), "left").join(per, "node", "left").select(
        "node", F.when(F.col("d") > 1, F.coalesce("t", F.lit(0)) * 2 / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def core_number(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, core): from its degree on, each node's value falls to the largest h such that h neighbours have at least h; the values at rest are the cores.

    It rests after far fewer rounds than there are shells to peel. Neighbours are ranked in sorted order, not gathered, so a hub needs no large row.
    """
    pairs = cut(both_ways(edges.where("src != dst").select("src", "dst")).distinct())
    values = cut(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("h")))
    while True:
        near = pairs.join(values.select(F.col("src").alias("dst"), "h"), "dst")
        ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("h"))))
        held = ranked.groupBy("src").agg(F.max(F.least("k", "h")).alias("new"))
        moved = cut(values.join(held, "src").select("src", F.col("h").alias("old"), F.least("h", "new").alias("h")))
        values = moved.select("src", "h")
        if moved.where("old != h").isEmpty():
            return vertices.select(F.col("id").alias("node")).join(values, F.col("node") == F.col("src"), "left").select("node", F.coalesce("h", F.lit(0)).cast("int").alias("core"))


def neighbour_similarity(edges: DataFrame, kind: str = "jaccard") -> DataFrame:
    """(node1, node2, similarity) for pairs with a common out-neighbour: jaccard or overlap."""
    own = edges.select("src", "dst").distinct()
    size = own.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    a, b = own.select(F.col("src").alias("node1"), "dst"), own.select(F.col("src").alias("node2"), "dst")
    common = a.join(b, "dst").where("node1 < node2").groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("c"))
    sized = common.join(size.select(F.col("src").alias("node1"), F.col("n").alias("n1")), "node1").join(size.select(F.col("src").alias("node2"), F.col("n").alias("n2")), "node2")
    below = F.col("n1") + F.col("n2") - F.col("c") if kind == "jaccard" else F.least("n1", "n2")
    return sized.select("node1", "node2", (F.col("c") / below).alias("similarity"))


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, community_id): a node takes the label that most neighbours have; ties go to its own label, then to the least. Rounds until nothing changes.

    Each pair of rounds deals the nodes into two halves anew, and one half moves in each, so that neighbours do not swap for ever; it ends when neither half
    of one deal moves.
    """
    near = cut(both_ways(edges.select("src", "dst")).where("src != dst"))
    labels, turn, idle = cut(vertices.select(F.col("id").alias("node"), F.col("id").alias("label"))), 0, 0
    while (idle < 2 or turn % 2) and (rounds is None or turn < rounds):
        mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        votes = labels.join(near, labels["node"] == near["src"]).groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        own = labels.select(F.col("node").alias("dst"), F.col("label").alias("own"))
        best = votes.join(own, "dst").groupBy("dst").agg(F.max(F.struct("n", (F.col("label") == F.col("own")).alias("stay"), (-F.col("label")).alias("m"))).alias("b")).select("dst", (-F.col("b.m")).alias("new"))
        moved = cut(labels.join(best, labels["node"] == best["dst"], "left").select("node", F.col("label").alias("old"), F.when(mine, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label")))
        idle = idle + 1 if moved.where("old != label").isEmpty() else 0
        labels, turn = moved.select("node", "label"), turn + 1
    return labels.withColumnRenamed("label", "community_id")


def topological_sort(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, place): Kahn's rounds; a cycle raises."""
    left, steps, out, level = cut(vertices.select("id")), edges.select("src", "dst").distinct(), None, 0
    while not left.isEmpty():
        free = cut(left.join(steps.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        one = free.select(F.col("id").alias("node"), F.lit(level).alias("level"))
        out = one if out is None else out.unionByName(one)
        left, steps, level = cut(left.join(free, "id", "left_anti")), cut(steps.join(free.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")), level + 1
    if out is None:
        return vertices.select(F.col("id").alias("node"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("place"))
    sorted_ = out.repartitionByRange("level", "node").sortWithinPartitions("level", "node")
    return numbered(sorted_, "place", 1)


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) by Boruvka's rounds; ties by the ends."""
    own = cut(edges.where("src != dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight")))
    comp = cut(own.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
    out = None
    while True:
        joined = own.join(comp.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(comp.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs != cd")
        each = joined.select(F.explode(F.array("cs", "cd")).alias("c"), F.struct("weight", "src", "dst").alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        picked = cut(each.select("e.src", "e.dst", "e.weight").distinct())
        if picked.isEmpty():
            return out if out is not None else own.limit(0)
        out = picked if out is None else cut(out.unionByName(picked))
        nodes = comp.select("id")
        comp = weakly_connected_components(nodes, out).select(F.col("node").alias("id"), F.col("component_id").alias("c"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """(reciprocity): share of distinct edges that have their reverse."""
    own = edges.where("src != dst").select("src", "dst").distinct()
    back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    return own.join(back, ["src", "dst"], "left").agg((F.count("back") / F.count(F.lit(1))).alias("reciprocity"))


def isolates(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.select("id").join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def ancestors(edges: DataFrame, node: DataFrame) -> DataFrame:
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), node).where("depth > 0")


def descendants(edges: DataFrame, node: DataFrame) -> DataFrame:
    return reach(edges, node).where("depth > 0")


def vector_search(rows: DataFrame, query: list[float], k: int, column: str = "embedding", metric: str = "cos") -> DataFrame:
    """rows with similarity, the k nearest first: cos, l2sq or ip; exact."""
    q = F.array(*[F.lit(float(x)) for x in query])
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(column, q, lambda x, y: x.cast("double") * y))
    if metric == "cos":
        score = dot / (F.sqrt(total(F.transform(column, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(q, lambda x: x * x))))
    elif metric == "ip":
        score = dot
    else:
        score = -total(F.zip_with(column, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))
    return rows.withColumn("similarity", score).orderBy(F.desc("similarity"), rows.columns[0]).limit(k)


def text_search(docs: DataFrame, words: list[str], k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): BM25 over the words of all documents, the k best.

    One pass over the texts gives each document's length and its counts of the query's words; only documents with one are kept, the others count for the mean
    length and the number of documents by a partial aggregate.
    """
    wanted = list(dict.fromkeys(x.lower() for x in words))
    low = F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+")
    terms = docs.select(F.col(id_col), F.filter(low, lambda w: w != "").alias("w"))
    counts = terms.select(id_col, F.size("w").alias("n"), F.filter("w", lambda w: w.isin(wanted)).alias("hit"))
    counted = cut(counts.select(id_col, "n", F.when(F.size("hit") > 0, F.transform(F.array(*[F.lit(x) for x in wanted]), lambda x: F.size(F.filter("hit", lambda h: h == x)))).alias("tf")))
    facts = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    part = F.lit(0.0)
    for i in range(len(wanted)):
        tf = F.get("tf", F.lit(i))
        idf = F.log(1 + (F.lit(facts["docs"]) - facts[f"df{i}"] + 0.5) / (F.lit(facts[f"df{i}"]) + 0.5))
        part = part + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("n") / F.lit(facts["mean"] or 1.0)))
    return counted.where("tf IS NOT NULL").select(id_col, part.alias("score")).orderBy(F.desc("score"), id_col).limit(k)
