"""Traversals as frontier loops over edges(src, dst[, id, weight]). A loop ends on an empty frontier or at its bound."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may do without spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'graphloom-checkpoints')}"
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts a loop's lineage: the rows are written as Parquet into the shared folder and read back.

    Unlike a checkpoint the plan is computed once, and the next plan knows the rows' real size: sizes that are estimated from one round to the next grow
    without bound. The files go when the JVM ends. What Parquet cannot hold (columns without a type, no columns) is checkpointed.
    """
    spark = df.sparkSession
    if not df.columns or "void" in df.schema.simpleString() or "variant" in df.schema.simpleString():
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_dir(spark))
        return df.checkpoint()
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what was shuffled goes once the rows are written, not when the driver happens to collect its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Removes the files of tables that cut() gave and that no later plan reads; other DataFrames are left alone."""
    for df in cuts:
        if path := getattr(df, "_cut_at", None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, name: str, start: Column | int = 0, step: int = 1) -> DataFrame:
    """df with gapless numbers: the rows of each partition are numbered where they lie, after the sizes of the partitions before."""
    placed = cut(df.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    place = F.col("_before") + F.col("_place") - F.col("_first")
    first = F.lit(start) if isinstance(start, int) else start
    return placed.join(F.broadcast(before), "_part").withColumn(name, (first + place * step).cast("bigint")).drop("_part", "_place", "_first", "_before")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; a self-loop once."""
    back = edges.where("src != dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def reach(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, node, depth): least number of hops from each source(id), itself at 0.

    Sources are numbered and taken 64 at a time as the bits of one number, so an edge is walked once for all sources of a set that are at its start, and
    what a node has been reached from is masked out.
    """
    named = cut(numbered(sources.select("id").distinct(), "n"))
    bit = F.expr("shiftleft(1L, int(n % 64))")
    front = cut(named.select(F.floor(F.col("n") / 64).alias("set"), F.col("id").alias("node"), bit.alias("bits")))
    steps, seen, levels, hop = edges.select("src", "dst"), front, [front.withColumn("depth", F.lit(0))], 0
    while max_hops is None or hop < max_hops:
        hop += 1
        new = front.join(steps, front["node"] == steps["src"]).groupBy("set", F.col("dst").alias("node")).agg(F.bit_or("bits").alias("bits"))
        new = new.join(seen.withColumnRenamed("bits", "old"), ["set", "node"], "left").withColumn("bits", F.expr("bits & ~coalesce(old, 0L)"))
        front = cut(new.where("bits != 0").select("set", "node", "bits"))
        if front.isEmpty():
            break
        levels.append(front.withColumn("depth", F.lit(hop)))
        last, seen = seen, cut(seen.unionByName(front).groupBy("set", "node").agg(F.bit_or("bits").alias("bits")))
        drop(*([last] if hop > 1 else []))
    found = levels[0]
    for one in levels[1:]:
        found = found.unionByName(one)
    each = found.select("node", "depth", F.explode(F.expr("transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> set * 64 + i)")).alias("n"))
    return each.join(named.withColumnRenamed("id", "source"), "n").select("source", "node", "depth")


class Hops:
    """A query's budget of edge visits (USING HOPS LIMIT) and how many were made; without a limit visits are only counted where that is asked for."""

    def __init__(self, limit: int | None = None, counting: bool = False) -> None:
        self.limit, self.used, self.counting = limit, 0, counting or limit is not None

    def visit(self, moved: DataFrame, *order: str) -> DataFrame:
        """The moves that the budget still allows, in a fixed order."""
        if not self.counting:
            return moved
        if self.limit is not None:
            moved = moved.orderBy(*order).limit(max(0, self.limit - self.used))
        moved = cut(moved)
        self.used += moved.count()
        return moved


Keep = Callable[[DataFrame], DataFrame]


class Walker:
    """Moves a frontier along steps(e, src, dst[, r][, weight]).

    The frontier has source, node, ids (of the edges), and where they are asked for rels and nodes (structs, nodes with the start). keep filters moves
    that have r, n (the node moved to), rels, nodes and weight beside them.
    """

    def __init__(self, steps: DataFrame, nodes: DataFrame | None = None, rels: bool = False, keep: Keep | None = None, weigh: Keep | None = None, unit: str = "double", hops: Hops | None = None) -> None:
        self.nodes, self.rels, self.keep, self.weigh, self.unit, self.hops = nodes, rels, keep, weigh, unit, hops or Hops()
        self.steps = cut(steps)

    def begin(self, sources: DataFrame) -> DataFrame:
        front = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.array().cast("array<bigint>").alias("ids")).distinct()
        if self.rels:
            front = front.withColumn("rels", F.array().cast(f"array<{dict(self.steps.dtypes)['r']}>"))
        if self.nodes is not None:
            front = front.join(self.nodes.select(F.col("n.id").alias("node"), F.array("n").alias("nodes")), "node")
        if self.weigh is not None:
            front = front.withColumn("weight", F.lit(None).cast(self.unit))
        return cut(front.select("source", "node", "ids", *self.carried, *(["weight"] if self.weigh is not None else [])))

    @property
    def carried(self) -> list[str]:
        return (["rels"] if self.rels else []) + (["nodes"] if self.nodes is not None else [])

    def move(self, front: DataFrame) -> DataFrame:
        moved = front.join(self.steps, front["node"] == self.steps["src"]).where(~F.array_contains("ids", F.col("e")))
        moved = self.hops.visit(moved, "ids", "e")
        if self.nodes is not None:
            moved = moved.join(self.nodes.select("n", F.col("n.id").alias("_to")), F.col("dst") == F.col("_to")).drop("_to")
        if self.rels:
            moved = moved.withColumn("rels", F.concat("rels", F.array("r")))
        if self.nodes is not None:
            moved = moved.withColumn("nodes", F.concat("nodes", F.array("n")))
        if self.weigh is not None:
            moved = self.weigh(moved)
        if self.keep is not None:
            moved = self.keep(moved)
        weight = ["weight"] if self.weigh is not None else []
        return moved.select("source", F.col("dst").alias("node"), F.concat("ids", F.array("e")).alias("ids"), *self.carried, *weight)

    def every(self, sources: DataFrame, low: int, high: int | None) -> DataFrame:
        """Every path of low to high edges that repeats no edge. A loop until no path goes on, unrolled where high is small."""
        front = self.begin(sources)
        out, hop = front.where(F.lit(low <= 0)), 0
        short = high is not None and high <= 4 and not self.hops.counting
        while high is None or hop < high:
            hop += 1
            front = self.move(front)
            if not short:
                front = cut(front)
                if front.isEmpty():
                    break
            if hop >= low:
                out = out.unionByName(front)
        return out

    def nearest(self, sources: DataFrame, low: int, high: int | None) -> DataFrame:
        """One path of the least number of edges to each node (of equal ones the least by its edges' ids), without the start itself."""
        front = self.begin(sources)
        seen, hop = front, 0
        while high is None or hop < high:
            hop += 1
            best = self.move(front).groupBy("source", "node").agg(F.min(F.struct("ids", *self.carried)).alias("m") if not self.carried else F.min_by(F.struct("ids", *self.carried), "ids").alias("m"))
            front = cut(best.select("source", "node", "m.*").join(seen.select("source", "node"), ["source", "node"], "left_anti").select(*seen.columns))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
            if hop % 4 == 0:
                seen = cut(seen)
        return seen.where(F.size("ids") >= max(low, 1))

    def lightest(self, sources: DataFrame, high: int | None, ties: bool = False) -> DataFrame:
        """The lightest path to each node within high edges, or with ties every one; of equal ones the least by its edges' ids.

        After round k the best weights are those over at most k edges, so a bound on edges gives the lightest path within it.
        """
        front = self.begin(sources)
        best, found, hop = front.select("source", "node", F.col("weight").alias("top")).limit(0), [], 0
        while high is None or hop < high:
            hop += 1
            moved = cut(self.move(front).where("source != node"))
            lows = moved.groupBy("source", "node").agg(F.min("weight").alias("low"))
            new = cut(lows.join(best, ["source", "node"], "full"))
            better = new.where(F.col("low").isNotNull() & (F.col("top").isNull() | (F.col("low") <= F.col("top") if ties else F.col("low") < F.col("top"))))
            tight = moved.join(better.select("source", "node", "low"), ["source", "node"]).where(F.col("weight") == F.col("low")).drop("low")
            if not ties:
                tight = tight.groupBy("source", "node").agg(F.min_by(F.struct(*[c for c in tight.columns if c not in ("source", "node")]), "ids").alias("m")).select("source", "node", "m.*")
            front = cut(tight.select(*front.columns))
            if front.isEmpty():
                break
            found.append(front)
            best = cut(new.select("source", "node", F.least("low", "top").alias("top")))
        out = front.limit(0)
        for one in found:
            out = out.unionByName(one)
        ends = out.join(best, ["source", "node"]).where(F.col("weight") == F.col("top")).drop("top")
        if ties:
            return ends
        return ends.groupBy("source", "node").agg(F.min_by(F.struct(*[c for c in ends.columns if c not in ("source", "node")]), "ids").alias("m")).select("source", "node", "m.*")

    def k_nearest(self, pairs: DataFrame, k: int, low: int, high: int | None) -> DataFrame:
        """For each (source, target) the k shortest simple paths by edges; ties by their edges' ids. A move has to be able to reach its target still."""
        pairs = cut(pairs.distinct())
        back = cut(reach(self.steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pairs.select(F.col("target").alias("id")).distinct(), high).select(F.col("source").alias("goal"), F.col("node").alias("via")))
        front = self.begin(pairs.select(F.col("source").alias("id"))).withColumn("been", F.array("node")).join(pairs, "source")
        wide = front.columns
        found, hop = None, 0
        while high is None or hop < high:
            hop += 1
            moved = front.join(self.steps, front["node"] == self.steps["src"]).where(~F.array_contains("been", F.col("dst")))
            moved = moved.join(back, (F.col("target") == F.col("goal")) & (F.col("dst") == F.col("via")), "left_semi")
            if self.nodes is not None:
                moved = moved.join(self.nodes.select("n", F.col("n.id").alias("_to")), F.col("dst") == F.col("_to")).drop("_to").withColumn("nodes", F.concat("nodes", F.array("n")))
            if self.rels:
                moved = moved.withColumn("rels", F.concat("rels", F.array("r")))
            if self.keep is not None:
                moved = self.keep(moved)
            moved = moved.select("source", "target", F.col("dst").alias("node"), F.concat("ids", F.array("e")).alias("ids"), F.concat("been", F.array("dst")).alias("been"), *self.carried)
            front = cut(moved.select(*wide))
            if front.isEmpty():
                break
            done = front.where((F.col("node") == F.col("target")) & (F.size("ids") >= low))
            found = done if found is None else found.unionByName(done)
            full = found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("source", "target")
            front = cut(front.where("node != target").join(full, ["source", "target"], "left_anti").select(*wide))
        if found is None:
            found = front.limit(0)
        rank = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.size("ids"), "ids"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("been", "target")


def trails(edges: DataFrame, sources: DataFrame, low: int = 1, high: int | None = 2) -> DataFrame:
    """(source, node, rels, nodes): every path of low to high edges that repeats no edge. Unrolled joins; without high a loop until no path goes on."""
    front = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.array().cast("array<bigint>").alias("rels"), F.array("id").alias("nodes"))
    out, hop = front.where(F.lit(low == 0)), 0
    steps = edges.select(F.col("id").alias("e"), "src", "dst")
    if high is None:
        front, steps = cut(front), cut(steps)
    while high is None or hop < high:
        hop += 1
        front = front.join(steps, (front["node"] == steps["src"]) & ~F.array_contains("rels", F.col("e"))).select(
            "source", F.col("dst").alias("node"), F.concat("rels", F.array("e")).alias("rels"), F.concat("nodes", F.array("dst")).alias("nodes")
        )
        if high is None:
            front = cut(front)
            if front.isEmpty():
                break
        if hop >= low:
            out = out.unionByName(front)
    return out


def weighted_shortest(edges: DataFrame, sources: DataFrame, max_hops: int | None = None, paths: bool = True) -> DataFrame:
    """(source, node, weight, path): the lightest path to each node; of equal ones the least by its nodes. Null or negative weights raise.

    Without paths only the weights are carried, and a node goes on only when its weight falls.
    """
    bad = F.col("weight").isNull() | (F.col("weight") < 0)
    w = F.when(bad, F.raise_error(F.lit("weights must be numbers of 0 or more"))).otherwise(F.col("weight")).cast("double").alias("w")
    steps = cut(edges.select("src", "dst", w) if paths else edges.groupBy("src", "dst").agg(F.min(w).alias("w")))
    best = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("weight"), *([F.array("id").alias("path")] if paths else [])).distinct())
    front, hop = best, 0

    def least(rows: DataFrame) -> DataFrame:
        if not paths:
            return rows.groupBy("source", "node").agg(F.min("weight").alias("weight"))
        return rows.groupBy("source", "node").agg(F.min(F.struct("weight", "path")).alias("m")).select("source", "node", "m.weight", "m.path")

    better = "oldw IS NULL OR weight < oldw" + (" OR (weight = oldw AND path < oldp)" if paths else "")
    while max_hops is None or hop < max_hops:
        hop += 1
        found = least(front.join(steps, front["node"] == steps["src"]).select(
            "source", F.col("dst").alias("node"), (F.col("weight") + F.col("w")).alias("weight"), *([F.concat("path", F.array("dst")).alias("path")] if paths else [])))
        old = best.select("source", "node", F.col("weight").alias("oldw"), *([F.col("path").alias("oldp")] if paths else []))
        last, front = front, cut(found.join(old, ["source", "node"], "left").where(better).select(*best.columns))
        drop(*([] if last is best else [last]))
        if front.isEmpty():
            break
        before, best = best, cut(least(best.unionByName(front)))
        drop(before)
    return best


def all_shortest(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, node, depth, rels): every path of the least number of edges, by walking only edges between successive depths."""
    depth = cut(reach(edges, sources, max_hops))
    last = depth.agg(F.max("depth")).first()[0] or 0
    front = depth.where("depth = 0").select("source", "node", "depth", F.array().cast("array<bigint>").alias("rels"))
    out = front
    steps = edges.select(F.col("id").alias("e"), "src", "dst")
    for hop in range(1, last + 1):
        level = depth.where(F.col("depth") == hop)
        moved = front.join(steps, front["node"] == steps["src"]).select("source", F.col("dst").alias("node"), F.concat("rels", F.array("e")).alias("rels"))
        front = cut(moved.join(level, ["source", "node"]).select("source", "node", "depth", "rels"))
        out = out.unionByName(front)
    return out


def k_shortest(edges: DataFrame, source: int, target: int, k: int, max_hops: int) -> DataFrame:
    """(rank, rels, nodes): the k shortest simple paths between two nodes; ties by their nodes."""
    spark = edges.sparkSession
    found = trails(edges, spark.createDataFrame([(source,)], "id bigint"), 1, max_hops)
    simple = found.where((F.col("node") == target) & (F.size(F.array_distinct("nodes")) == F.size("nodes")))
    top = simple.orderBy(F.size("rels"), "nodes", "rels").limit(k)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.size("rels"), "nodes", "rels"))).select("rank", "rels", "nodes")
