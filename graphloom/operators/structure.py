"""Structure of graphs: strong components, bridges, distances, betweenness, colours, matchings, communities, covers. Rounds over edges(src, dst[, weight])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algorithms import weakly_connected_components
from .traversal import both_ways, cut, drop, reach


def _plain(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, without self-loops."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def strongly_connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id): the least id of the strong component.

    Rounds of colouring: least ids flow forwards until they rest; what reaches a colour's root backwards inside the colour is its component.
    """
    left, steps, out = cut(vertices.select("id")), cut(edges.where("src != dst").select("src", "dst").distinct()), None
    while not left.isEmpty():
        colour = left.select(F.col("id").alias("node"), F.col("id").alias("colour"))
        while True:
            low = steps.join(colour, steps["src"] == colour["node"]).groupBy("dst").agg(F.min("colour").alias("low"))
            new = cut(colour.join(low, colour["node"] == low["dst"], "left").select("node", F.col("colour").alias("old"), F.least("colour", "low").alias("colour")))
            colour = new.select("node", "colour")
            if new.where("old != colour").isEmpty():
                break
        a, b = colour.toDF("src", "ca"), colour.toDF("dst", "cb")
        inside = cut(steps.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
        roots = colour.where("node = colour").select(F.col("node").alias("id"))
        found = cut(reach(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots).select("node", F.col("source").alias("component_id")))
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found.select(F.col("node").alias("id")), "id", "left_anti"))
        steps = cut(inside.join(left.toDF("src"), "src").join(left.toDF("dst"), "dst").select("src", "dst"))
    return out if out is not None else vertices.select(F.col("id").alias("node"), F.col("id").alias("component_id"))


def bridges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_from, node_to): edges on no cycle.

    Every edge beside a breadth-first forest gets a 64-bit label; the labels at the vertices of a subtree cancel unless one leaves it,
    so a forest edge whose subtree has the sum 0 (by exclusive or) is a bridge. A wrong answer has a chance of 2^-64 for each edge.
    """
    plain = cut(_plain(edges))
    roots = weakly_connected_components(vertices, plain).select(F.col("component_id").alias("id")).distinct()
    depth = cut(reach(both_ways(plain), roots).select("node", "depth"))
    up = both_ways(plain).join(depth.toDF("src", "d"), "src").join(depth.toDF("dst", "e"), "dst").where("e = d - 1")
    tree = cut(up.groupBy("src", "d").agg(F.min("dst").alias("parent")).select(F.col("src").alias("node"), "d", "parent"))
    spanned = tree.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    labelled = plain.join(spanned, ["src", "dst"], "left_anti").withColumn("x", F.xxhash64("src", "dst"))
    own = labelled.select(F.explode(F.array("src", "dst")).alias("node"), "x").groupBy("node").agg(F.bit_xor("x").alias("x"))
    values = cut(tree.join(own, "node", "left").select("node", "d", "parent", F.coalesce("x", F.lit(0)).alias("x")))
    deepest = values.agg(F.max("d")).first()[0] or 0
    level, found = None, None
    for d in range(deepest, 0, -1):
        here = values.where(F.col("d") == d)
        if level is not None:
            below = level.groupBy("parent").agg(F.bit_xor("x").alias("y")).withColumnRenamed("parent", "node")
            here = here.join(below, "node", "left").select("node", "d", "parent", F.col("x").bitwiseXOR(F.coalesce("y", F.lit(0))).alias("x"))
        level = cut(here)
        cuts = level.where("x = 0").select(F.least("node", "parent").alias("node_from"), F.greatest("node", "parent").alias("node_to"))
        found = cuts if found is None else found.unionByName(cuts)
    return found if found is not None else plain.select(F.col("src").alias("node_from"), F.col("dst").alias("node_to")).limit(0)


def two_edge_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id): components after all bridges are taken away."""
    plain = _plain(edges)
    return weakly_connected_components(vertices, plain.join(bridges(vertices, edges).toDF("src", "dst"), ["src", "dst"], "left_anti"))


def is_bipartite(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(is_bipartite): no cycle is odd.

    Each node joins its least neighbour below it, and the trees that this gives become the nodes of the next round; an edge keeps the parity of the steps between
    its new ends. An odd edge from a node to itself closes an odd cycle.
    """
    left, odd = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("x"))), edges.where("src = dst").isEmpty() is False
    while not odd and not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to"), "x"), F.struct(F.col("b").alias("node"), F.col("a").alias("to"), "x"))).alias("e")).select("e.*")
        up = cut(ends.groupBy("node").agg(F.min("to").alias("m"), F.min_by("x", "to").alias("x")).select("node", F.least("node", "m").alias("root"), F.when(F.col("m") < F.col("node"), F.col("x")).otherwise(0).alias("x")))
        while True:
            far = up.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("x").alias("y"))
            jumped = cut(up.join(far, "root").select("node", F.col("root").alias("old"), F.col("next").alias("root"), F.expr("x ^ y").alias("x")))
            drop(up)
            up = jumped
            if up.where("root != old").isEmpty():
                break
        half = cut(left.join(up.select(F.col("node").alias("a"), "root", F.col("x").alias("y")), "a").select(F.col("root").alias("a"), "b", F.expr("x ^ y").alias("x")).distinct())
        drop(left)
        left = cut(half.join(up.select(F.col("node").alias("b"), "root", F.col("x").alias("y")), "b").select("a", F.col("root").alias("b"), F.expr("x ^ y").alias("x")).where("a != b OR x = 1").distinct())
        drop(half, up)
        odd = not left.where("a = b").isEmpty()
    return vertices.sparkSession.createDataFrame([(not odd,)], "is_bipartite boolean")


def fold(near: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Takes pendant nodes off near(src, dst, mutual), which has each edge both ways, until none is left: (node, parent) of each round, and the rest of near.

    A node is pendant if it has one neighbour, with edges to and from it; of two that have only each other the greater goes.
    """
    rounds, left = [], cut(near)
    while True:
        ends = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("parent"), F.min("mutual").alias("mutual")).where("n = 1 AND mutual").select("node", "parent")
        ends = cut(ends)
        if ends.isEmpty():
            return rounds, left
        pair = ends.toDF("parent", "node").select("node", "parent")
        gone = cut(ends.join(pair, ["node", "parent"], "left_anti").unionByName(ends.where("node > parent").join(pair, ["node", "parent"], "left_semi")))
        rounds.append(gone)
        left = cut(left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "mutual"))


def betweenness_centrality(vertices: DataFrame, edges: DataFrame, directed: bool = True, normalized: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness_centrality): path counts down the breadth-first levels of every source, shares back up.

    Undirected graphs lose their pendant trees first. A tree's part of a node's measure is a product of the sizes of what hangs on it; what is left counts each
    node as often as it stands for nodes (w) and sources (a).
    """
    starts = vertices.select("id") if sources is None else sources.select("id").distinct()
    own = cut(vertices.select(F.col("id").alias("node")).join(starts.select(F.col("id").alias("node"), F.lit(1).alias("a")), "node", "left").select("node", F.lit(1).alias("w"), F.coalesce("a", F.lit(0)).alias("a")))
    hung, rounds = None, []
    if directed:
        steps, kept = cut(edges.where("src != dst").select("src", "dst").distinct()), own.select("node", F.col("w").cast("double").alias("w"), F.col("a").cast("double").alias("a"))
    else:
        rounds, near = fold(both_ways(_plain(edges)).withColumn("mutual", F.lit(True)))
        steps, sums = near.select("src", "dst"), cut(own.select("node", F.col("w").cast("double").alias("w"), F.col("a").cast("double").alias("a"), F.lit(0.0).alias("aw")))
        for gone in rounds:  # sums: what stands at a node and has been hung on it; aw: products of each branch
            top = sums.join(gone, "node").select(F.col("parent").alias("node"), "w", "a", (F.col("w") * F.col("a")).alias("aw"))
            sums = cut(sums.unionByName(top).groupBy("node").agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("aw").alias("aw")))
        folded = None
        for gone in rounds:
            folded = gone.select("node") if folded is None else folded.unionByName(gone.select("node"))
        kept = cut(sums.join(folded, "node", "left_anti") if folded is not None else sums)
        parts = weakly_connected_components(kept.select(F.col("node").alias("id")), steps)
        whole = parts.join(kept, "node").groupBy("component_id").agg(F.sum("w").alias("tw"), F.sum("a").alias("ta"))
        totals = cut(parts.join(whole, "component_id").select("node", "tw", "ta"))
        for gone in reversed(rounds):
            totals = cut(totals.unionByName(gone.join(totals.withColumnRenamed("node", "parent"), "parent").select("node", "tw", "ta")))
        hung = sums.join(totals, "node").join(own.select("node", F.col("a").alias("own")), "node").select(
            "node", ((F.col("ta") - F.col("own")) * (F.col("tw") - 1) - F.col("aw") - (F.col("ta") - F.col("a")) * (F.col("tw") - F.col("w"))).alias("s"))
    depth = cut(reach(steps, kept.where("a > 0").select(F.col("node").alias("id"))))
    last = depth.agg(F.max("depth")).first()[0] or 0
    a, b = depth.toDF("source", "src", "d"), depth.toDF("source", "dst", "e")
    dag = cut(steps.join(a, "src").join(b, ["source", "dst"]).where("e = d + 1").select("source", "src", "dst", "d"))
    paths = [cut(depth.where("depth = 0").select("source", "node", F.lit(1.0).alias("n")))]
    for d in range(last):
        moved = dag.where(F.col("d") == d).join(paths[d].withColumnRenamed("node", "src"), ["source", "src"])
        paths.append(cut(moved.groupBy("source", "dst").agg(F.sum("n").alias("n")).withColumnRenamed("dst", "node")))
    share, total = None, hung
    for d in range(last, 0, -1):
        lower = paths[d].select("source", F.col("node").alias("dst"), F.col("n").alias("m"))
        if share is not None:
            lower = lower.join(share.withColumnRenamed("node", "dst"), ["source", "dst"], "left")
        else:
            lower = lower.withColumn("s", F.lit(0.0))
        lower = lower.join(kept.select(F.col("node").alias("dst"), "w"), "dst")
        pair = dag.where(F.col("d") == d - 1).join(lower, ["source", "dst"]).join(paths[d - 1].withColumnRenamed("node", "src"), ["source", "src"])
        share = cut(pair.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("n") / F.col("m") * (F.col("w") + F.coalesce("s", F.lit(0.0)))).alias("s")))
        got = share.where("source != node").join(kept.select(F.col("node").alias("source"), "a"), "source").select("node", (F.col("s") * F.col("a")).alias("s"))
        total = got if total is None else total.unionByName(got)
    n = vertices.count()
    scale = (1.0 if directed else 0.5) * ((1.0 if directed else 2.0) / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0)
    base = vertices.select(F.col("id").alias("node"))
    if total is None:
        return base.withColumn("betweenness_centrality", F.lit(0.0))
    summed = total.groupBy("node").agg(F.sum("s").alias("s"))
    return base.join(summed, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness_centrality"))


def distances(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, eccentricity, total, closeness, harmonic) over what each node reaches along the edges.

    Only how many nodes are at each distance is held (node, k, c). Pendant trees are taken off first: what is far from a pendant node is one nearer to its parent.
    """
    pairs = edges.where("src != dst").select("src", "dst", F.lit(True).alias("there"))
    near = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("there"))).groupBy("src", "dst").agg((F.max("there") & ~F.min("there")).alias("mutual"))
    rounds, left = fold(near)
    own = cut(vertices.select(F.col("id").alias("node"), F.lit(0).alias("k"), F.lit(1).cast("bigint").alias("c")))
    folded = own.select("node").limit(0)
    for gone in rounds:  # own: the nodes of a node's own tree
        own = cut(own.unionByName(own.join(gone, "node").select(F.col("parent").alias("node"), (F.col("k") + 1).alias("k"), "c")).groupBy("node", "k").agg(F.sum("c").alias("c")))
        folded = folded.unionByName(gone.select("node"))
    core = cut(vertices.select("id").join(folded.withColumnRenamed("node", "id"), "id", "left_anti"))
    inner = pairs.join(core.toDF("src"), "src", "left_semi").join(core.toDF("dst"), "dst", "left_semi") if rounds else pairs
    hist = cut(reach(inner, core).join(own, "node").groupBy(F.col("source").alias("node"), (F.col("depth") + F.col("k")).alias("k")).agg(F.sum("c").alias("c")))
    for gone in reversed(rounds):
        mine = own.join(gone.select("node"), "node", "left_semi")
        back = gone.join(hist.withColumnRenamed("node", "parent"), "parent").select("node", (F.col("k") + 1).alias("k"), "c")
        less = mine.select("node", (F.col("k") + 2).alias("k"), (-F.col("c")).alias("c"))
        hist = cut(hist.unionByName(mine.unionByName(back).unionByName(less).groupBy("node", "k").agg(F.sum("c").alias("c"))))
    far = hist.where("k > 0 AND c > 0").groupBy(F.col("node").alias("source")).agg(
        F.max("k").alias("eccentricity"), F.sum(F.col("k") * F.col("c")).alias("total"), F.sum("c").alias("n"), F.sum(F.col("c") / F.col("k")).alias("harmonic"))
    return vertices.select(F.col("id").alias("node")).join(far, F.col("node") == F.col("source"), "left").select(
        "node", F.coalesce("eccentricity", F.lit(0)).alias("eccentricity"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("closeness"), F.coalesce("harmonic", F.lit(0.0)).alias("harmonic"))


def colouring(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color): no edge joins equal colours. A node takes its least free colour once all its neighbours of higher rank have one."""
    near = cut(both_ways(_plain(edges)))
    degree = near.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    rank = cut(vertices.join(degree, vertices["id"] == degree["src"], "left").select("id", F.struct(F.coalesce("d", F.lit(0)), F.xxhash64("id"), "id").alias("rank")))
    above = cut(near.join(rank.select(F.col("id").alias("src"), F.col("rank").alias("r")), "src").join(rank.select(F.col("id").alias("dst"), F.col("rank").alias("s")), "dst").where("s > r").select("src", "dst"))
    left, done = rank.select("id"), None
    while not left.isEmpty():
        waiting = above.join(left.toDF("dst"), "dst").select(F.col("src").alias("id")).distinct()
        ready = left.join(waiting, "id", "left_anti")
        if done is None:
            new = ready.select(F.col("id").alias("node"), F.lit(0).alias("color"))
        else:
            used = above.join(done.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("c").alias("used"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
            new = ready.join(used, "id", "left").select(F.col("id").alias("node"), F.coalesce(F.when(F.col("used").isNotNull(), free), F.lit(0)).alias("color"))
        new = cut(new)
        left = cut(left.join(new.select(F.col("node").alias("id")), "id", "left_anti"))
        done = new if done is None else cut(done.unionByName(new))
    return done if done is not None else vertices.select(F.col("id").alias("node"), F.lit(0).alias("color"))


def maximal_matching(edges: DataFrame) -> DataFrame:
    """(src, dst): edges without common ends to which none can be added; each round takes edges that rank least at both their ends."""
    left, out = cut(_plain(edges).withColumn("r", F.struct(F.xxhash64("src", "dst"), "src", "dst"))), None
    while not left.isEmpty():
        least = left.select(F.explode(F.array("src", "dst")).alias("v"), "r").groupBy("v").agg(F.min("r").alias("m"))
        picked = cut(left.join(least.toDF("src", "ms"), "src").join(least.toDF("dst", "md"), "dst").where("r = ms AND r = md").select("src", "dst"))
        out = picked if out is None else out.unionByName(picked)
        ends = picked.select(F.explode(F.array("src", "dst")).alias("v"))
        left = cut(left.join(ends.toDF("src"), "src", "left_anti").join(ends.toDF("dst"), "dst", "left_anti").select("src", "dst", "r"))
    return out if out is not None else left.select("src", "dst")


def cycles(edges: DataFrame, longest: int | None = None, directed: bool = True) -> DataFrame:
    """(cycle_id, nodes): simple cycles, each once, from its least node; of at most so many edges, or else of any length.

    A path goes on to greater nodes than its first only. Undirected cycles have three edges or more and go round towards the lesser neighbour.
    """
    steps = cut((edges if directed else both_ways(edges)).select("src", "dst").distinct())
    front, out, hop = cut(steps.select(F.col("src").alias("node")).distinct().select("node", F.array("node").alias("nodes"))), None, 0
    while longest is None or hop < longest:
        hop += 1
        back = F.col("dst") == F.element_at("nodes", 1)
        # the last move can only close a cycle, which is a join on both its ends
        goes = back if hop == longest else back | ((F.col("dst") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("dst")))
        moved = cut(front.join(steps, (front["node"] == steps["src"]) & goes).select("dst", "nodes"))
        closed = moved.where(F.col("dst") == F.col("nodes")[0])
        if not directed:
            closed = closed.where((F.size("nodes") > 2) & (F.try_element_at("nodes", F.lit(2)) < F.element_at("nodes", -1)))
        out = closed.select("nodes") if out is None else out.unionByName(closed.select("nodes"))
        front = moved.where(F.col("dst") != F.col("nodes")[0]).select(F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"))
        if front.isEmpty():
            break
    return out.select(F.xxhash64("nodes").alias("cycle_id"), "nodes")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(modularity) of communities(node, community_id) over undirected edges; without a weight each edge counts 1."""
    own = edges.withColumn("w", F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)).select("src", "dst", "w")
    sided = own.join(communities.toDF("src", "a"), "src").join(communities.toDF("dst", "b"), "dst")
    whole = sided.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    sums = sided.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    return sums.crossJoin(F.broadcast(whole)).agg((F.first("inside") / F.first("m") - F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2))).alias("modularity"))


def louvain(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community_id): local moves by modularity gain until no node moves, then contraction, until no pass moves any. Only nodes of one half move in a
    round, so that two never swap; a move has to raise the modularity."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    graph = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    member = cut(vertices.select(F.col("id").alias("node"), F.col("id").alias("community_id")))
    m = graph.agg(F.sum("w")).first()[0]
    if not m:
        return member
    while True:
        near = cut(both_ways(graph.where("src != dst")))
        k = cut(graph.select(F.explode(F.array("src", "dst")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k")))
        at = k.select("node", "k", F.col("node").alias("c"))
        moved, idle, turn, whole = False, 0, 0, None
        while idle < 2 or turn % 2:  # until neither half of one deal moves
            sums = at.groupBy("c").agg(F.sum("k").alias("total"))
            links = near.join(at.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("inner"))
            own = at.select("node", F.col("c").alias("old"), "k")
            here = own.select("node", F.col("old").alias("c"), F.lit(0.0).alias("inner"))
            offers = links.unionByName(here).groupBy("node", "c").agg(F.sum("inner").alias("inner")).join(own, "node").join(sums, "c")
            gain = F.col("inner") - F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)) / (2 * m)
            best = offers.groupBy("node", "old", "k").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (F.col("c") == F.col("old")).alias("stay"), (-F.col("c")).alias("m"))).alias("b"))
            mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
            new = cut(best.select("node", "k", "old", F.when(mine, -F.col("b.m")).otherwise(F.col("old")).alias("c")))
            at = new.select("node", "k", "c")
            idle = idle + 1 if new.where("old != c").isEmpty() else 0
            moved, turn = moved or not idle, turn + 1
            if not idle and turn % 8 == 0:  # many move at once, so the sum of their gains may be a loss: stop when eight rounds gained nothing
                inner = near.join(at.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
                weights = at.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t"), 2))).first()[0]
                now = inner / (2 * m) - weights / (4 * m * m)
                if whole is not None and now <= whole + 1e-9:
                    break
                whole = now
        if not moved:
            least = member.groupBy("community_id").agg(F.min("node").alias("least"))
            return cut(member.join(least, "community_id").select("node", F.col("least").alias("community_id")))
        names = cut(at.groupBy("c").agg(F.min("node").alias("name")).join(at.select("node", "c"), "c").select("node", "name"))
        member = cut(member.join(names.withColumnRenamed("node", "community_id"), "community_id", "left").select("node", F.coalesce("name", "community_id").alias("community_id")))
        graph = cut(graph.join(names.toDF("src", "s"), "src").join(names.toDF("dst", "d"), "dst").groupBy(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).agg(F.sum("w").alias("w")))


def set_cover(pairs: DataFrame) -> DataFrame:
    """(containing_set) of pairs(element, containing_set): greedy, the set with the most open elements first, ties by the least set.

    Sets without common elements do not bear on each other, so each component is covered by itself, in one task.
    """
    own = cut(pairs.select("element", "containing_set").where("element IS NOT NULL AND containing_set IS NOT NULL").distinct())
    # a component is named by its least set; elements take the least of their sets, sets the least of their elements
    label = cut(own.select("containing_set").distinct().withColumn("part", F.col("containing_set")))
    while True:
        low = own.join(label, "containing_set").groupBy("element").agg(F.min("part").alias("part"))
        new = own.join(low, "element").groupBy("containing_set").agg(F.min("part").alias("part"))
        jump = cut(new.join(label.select(F.col("containing_set").alias("part"), F.col("part").alias("far")), "part").select("containing_set", F.least("part", "far").alias("part")))
        rest = jump.join(label.withColumnRenamed("part", "old"), "containing_set").where("part != old").isEmpty()
        drop(label)
        label = jump
        if rest:
            break

    def cover(table):
        import heapq

        import numpy as np
        import pyarrow as pa

        element = table.column("element").combine_chunks().dictionary_encode().indices.to_numpy()
        names, of = np.unique(table.column("containing_set").to_numpy(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        element, ends = element[order], np.r_[0, np.cumsum(np.bincount(of, minlength=len(names)))]
        open_, rest = np.ones(element.max() + 1, bool), element.max() + 1
        heap = [(-int(n), i) for i, n in enumerate(np.diff(ends))]
        heapq.heapify(heap)
        picked = []
        while rest:
            n, i = heapq.heappop(heap)  # a count can only have fallen since
            mine = element[ends[i] : ends[i + 1]]
            now = int(open_[mine].sum())
            if now == -n:
                picked.append(i)
                open_[mine] = False
                rest -= now
            elif now:
                heapq.heappush(heap, (-now, i))
        return pa.table({"containing_set": pa.array(names[picked]).cast(table.column("containing_set").type)})

    kind = own.select("containing_set").schema
    return own.join(label, "containing_set").groupBy("part").applyInArrow(cover, kind)


def independent_set(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): a maximal independent set, which is also a dominating set: the nodes of the first colour."""
    return colouring(vertices, edges).where("color = 0").select("node")


def voronoi_cells(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """(node, center): the nearest center by hops, ties by the least id. All centers go out at once, and a node takes the first that comes."""
    steps = edges.select("src", "dst")
    seen = front = cut(centers.select(F.col("id").alias("node"), F.col("id").alias("center")).distinct())
    while True:
        new = front.join(steps, front["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("center").alias("center"))
        front = cut(new.join(seen, "node", "left_anti").select("node", "center"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def kmeans(rows: DataFrame, clusters: int, column: str = "embedding", key: str = "id", max_iter: int = 10, seed: int = 1998) -> DataFrame:
    """(node, cluster_id)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = rows.select(F.col(key).alias("node"), array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return KMeans(k=clusters, maxIter=max_iter, seed=seed).fit(points).transform(points).select("node", F.col("prediction").alias("cluster_id"))
