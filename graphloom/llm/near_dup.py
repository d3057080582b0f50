"""Near-duplicate classes by an inverted join over MinHash signature coordinates.

1. Every text becomes its set of word shingles and a signature of 64 coordinates; equal sets fall together first.
2. Each set is posted under its (coordinate, value) pairs. Two sets of similarity 0.75 agree in 48 of 64 coordinates on
   average and in fewer than MATCHES = 27 with a chance near 1e-8, so a pair needs MATCHES common postings.
   Prefix: with each set's postings ordered by rarity, such a pair meets in the first 64 - 27 + 1; values that
   no other set has fill the prefix first, so most sets post nothing. Skip: a set of which less than 3/4 of the shingles occur in
   any other candidate cannot reach 0.75, and a pair whose shared counts bound it below 0.75 is left out.
3. Each list is merged from its most central set (the largest share of shared shingles), which links
   groups of copies in as many pairs as there are postings. Pairs are confirmed on the full sets.
4. What is left are sets of different components in one list. Against large components they are checked in blocks of
   BLOCK sets a side, which give back links only; between small components pair by pair. Same components are skipped: their
   pairs change nothing. So no link between components is lost, and no group is turned into all its pairs.
5. Components by least-id propagation with pointer jumping.

Defined results: null, empty or blank text has the empty set and is linked with nothing; rows that repeat share a class, and
rows of one id are one node; a row with a null id has a null class and is kept; an empty table gives no rows; other columns are
not carried by near_duplicates() and are kept by deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, stored
from .shingles import COORDINATES, shingle_set, signature

MATCHES = 27
BLOCK = 64
#: Candidate ids (8 bytes each) up to which they are broadcast.
MAX_BROADCAST = 1_000_000


def _fingerprints(docs: DataFrame, with_set: bool) -> DataFrame:
    """doc_id, n, h1, h2 (two independent sums over the set) and the signature, or the set itself."""
    last = "items array<bigint>" if with_set else "sig array<int>"
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                h1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                h2 = [int((s * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                if with_set:
                    column = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                else:
                    column = pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), column],
                    names=["doc_id", "n", "h1", "h2", last.split()[0]],
                )

    return docs.select("doc_id", docs["text"].alias("_text")).mapInArrow(run, f"doc_id {kind}, n bigint, h1 bigint, h2 bigint, {last}")


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): the least node of each node's component. Nodes without edges do not appear."""
    both = stored(edges.select("a", "b").where("a != b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a != b")).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        lower = stored(lower)
        jump = lower.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = stored(lower.join(jump, lower["root"] == jump["at"], "left").select("node", "old", F.least("root", "far").alias("root")))
        changed = new.where("root != old").limit(1).count()
        drop_stored(lower)
        drop_stored(labels)
        labels = new.select("node", "root")
        if not changed:
            return labels


def _lists(postings: DataFrame) -> DataFrame:
    """The postings of keys that two or more have."""
    keys = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return postings.join(keys, "key")


def _prefix_lists(sets: DataFrame) -> DataFrame:
    """(key, id): postings within each set's prefix of rarest coordinates."""
    value = F.col("val").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    postings = sets.select("id", F.posexplode("sig").alias("pos", "val")).select("id", (F.col("pos").cast("bigint") * (1 << 32) + value).alias("key"))
    shared = _lists(postings).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("own")).where(F.size("own") >= MATCHES)
    first = F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))
    return _lists(shared.select("id", F.explode(F.transform(first, lambda x: x["key"])).alias("key"))).select("key", "id")


def _can_link(a: str, b: str) -> Column:
    """Whether the shared counts s allow a similarity of 0.75: min(s) / (n_a + n_b - min(s)) >= 3/4."""
    return F.least(f"{a}s", f"{b}s") * 7 >= (F.col(f"{a}n") + F.col(f"{b}n")) * 3


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("items").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * 75).select("a", "b")


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            left, right = (
                [(i, np.sort(np.asarray(s, dtype=np.int64))) for i, s in zip(v.values.field(0).to_pylist(), (e.values.to_numpy() for e in v.values.field(1)), strict=True)]
                for v in (x, y)
            )
            a, b = [], []
            for i, s in left:
                for j, u in right:
                    if min(len(s), len(u)) * 4 >= max(len(s), len(u)) * 3:
                        common = int((u[np.minimum(np.searchsorted(u, s), len(u) - 1)] == s).sum())
                        if common * 100 >= (len(s) + len(u) - common) * 75:
                            a.append(i)
                            b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _against_large(wanted: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """wanted(id, comp) against all members(id, comp, size) of the large components, in blocks; links (a, b)."""
    counts = wanted.groupBy("comp").agg(F.count(F.lit(1)).alias("wanted_size"))
    def blocks(rows: DataFrame, size: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK))
        return rows.join(sets.select("id", "items"), "id").groupBy("comp", block.alias("block")).agg(F.collect_list(F.struct("id", "items")).alias(name)).drop("block")

    pairs = blocks(wanted.join(counts, "comp"), "wanted_size", "x").join(blocks(members, "size", "y"), "comp")
    return pairs.select("x", "y").repartition(F.xxhash64(F.col("x")[0]["id"], F.col("y")[0]["id"])).mapInArrow(_block_links, "a bigint, b bigint")


def links(docs: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets: id, n, h1, h2 for each distinct set; links a, b between ids that join its components)."""
    known = fingerprints.where("n > 0 AND doc_id IS NOT NULL")
    reps = stored(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").cast("bigint").alias("id"), F.first("sig").alias("sig")))
    lists = stored(_prefix_lists(reps.select("id", "sig")))
    wanted = lists.select("id").distinct()
    wanted = stored(reps.select("id", "n", "h1", "h2").join(wanted, "id"))
    ids = wanted.select(F.col("id").alias("doc_id"))
    ids = F.broadcast(ids) if wanted.count() <= MAX_BROADCAST else ids
    full = _fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), True)
    sets = stored(
        full.withColumnRenamed("doc_id", "id").join(wanted, ["id", "n", "h1", "h2"], "left_semi").dropDuplicates(["id", "n", "h1", "h2"])
    )
    items = sets.select("id", F.explode("items").alias("item"))
    known_items = items.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("item")
    s = items.join(known_items, "item").groupBy("id").agg(F.count(F.lit(1)).alias("s"))
    facts = sets.select("id", "n").join(s, "id").where("s * 4 >= n * 3")
    placed = stored(_lists(lists.join(facts, "id")).select("key", "id", "n", "s"))

    lead = placed.groupBy("key").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("part"), (-F.col("id")).alias("minus"), "n", "s")).alias("m"))
    stars = placed.join(lead, "key").select("id", "n", "s", (-F.col("m.minus")).alias("hub"), F.col("m.n").alias("hub_n"), F.col("m.s").alias("hub_s"))
    pairs = stars.where("id != hub").where(_can_link("", "hub_")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    first = stored(_confirmed(pairs, sets))

    roots = connected(first)
    comp = placed.join(roots, placed["id"] == roots["node"], "left").select("key", "id", "n", "s", F.coalesce("root", "id").alias("comp"))
    mixed = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    sizes = comp.select("id", "comp").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    left = stored(comp.join(mixed, "key").join(sizes, "comp"))
    large = left.where(F.col("size") > BLOCK).select("key", F.col("comp").alias("large")).distinct()
    wanted_large = left.join(large, "key").where((F.col("comp") != F.col("large")) & ((F.col("size") <= BLOCK) | (F.col("comp") > F.col("large"))))
    wanted_large = wanted_large.select("id", F.col("large").alias("comp")).distinct()
    members = comp.select("id", "comp").distinct().join(sizes.where(F.col("size") > BLOCK), "comp")
    second = _against_large(stored(wanted_large), members, sets)
    small = left.where(F.col("size") <= BLOCK).select("key", "id", "n", "s", "comp")
    own = small.groupBy("id").agg(F.collect_list("key").alias("keys"))  # a prefix, so 38 at most
    small = small.join(own, "id")
    x, y = (small.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "s", "comp", "keys")]) for p in "xy")
    # a pair is taken in the first of the lists in which it meets only
    once = F.array_min(F.array_intersect("x_keys", "y_keys")) == x["key"]
    met = x.join(y, (x["key"] == y["key"]) & (F.col("x_id") < F.col("y_id")) & (F.col("x_comp") != F.col("y_comp")) & _can_link("x_", "y_") & once)
    third = _confirmed(met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct(), sets)
    return reps, stored(first.unionByName(second).unionByName(third))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    prints = stored(_fingerprints(docs, False))
    reps, edges = links(docs, prints)
    known = prints.where("n > 0 AND doc_id IS NOT NULL")
    # rows of one id with different sets are one node
    several = known.groupBy("doc_id").agg(F.countDistinct("n", "h1", "h2").alias("k")).where("k > 1").select("doc_id")
    owned = known.join(several, "doc_id").join(reps.drop("sig"), ["n", "h1", "h2"]).select(F.col("doc_id").cast("bigint").alias("a"), F.col("id").alias("b"))
    roots = connected(edges.unionByName(owned))
    classes = reps.drop("sig").join(roots, reps["id"] == roots["node"], "left").select("n", "h1", "h2", F.coalesce("root", "id").alias("class"))
    joined = prints.drop("sig").join(classes, ["n", "h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id").cast("bigint")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns; of rows that repeat an id one stays."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
