"""Procedures that change or copy parts of a graph: create, merge, nodes, refactor, periodic and do. Each gives (graph, rows).

Ids come as a table ids(source[, target]); rows that belong to one of them say so by the same columns. Nodes and relationships live in tables by labels and
types, so renaming and relabelling moves rows between tables, and new ones are appended.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, Rel, _stacked, key_of, labels_in
from .traversal import cut, numbered

Result = tuple[Graph, DataFrame]


def _top(table: DataFrame) -> int:
    """One beyond the largest id."""
    top = table.agg(F.max("id")).first()[0]
    return 0 if top is None else top + 1


def _value(v: object) -> Column:
    return F.expr("null") if v is None else F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])


def _each(graph: Graph, change, nodes: bool = True) -> Graph:
    """change(table) on every node table, or on every relationship table."""
    if nodes:
        return replace(graph, nodes={k: change(t) for k, t in graph.nodes.items()})
    return replace(graph, rels=tuple(replace(r, table=change(r.table)) for r in graph.rels))


def _marked(ids: DataFrame) -> DataFrame:
    return cut(ids.select(F.col("source").alias("id")).distinct()).withColumn("_hit", F.lit(True))


def _set(table: DataFrame, marked: DataFrame, values: dict[str, object]) -> DataFrame:
    joined = table.join(marked, "id", "left")
    for k, v in values.items():
        old = F.col(f"`{k}`") if k in table.columns else F.lit(None)
        if v is None and k not in table.columns:
            continue
        new = _value(v)
        if k in table.columns and v is not None:
            kind = dict(table.dtypes)[k]
            fits = kind in ("string",) if isinstance(v, str) else kind not in ("string",)
            if not fits:
                new, old = new.cast("string"), old.cast("string")
        joined = joined.withColumn(k, F.when(F.col("_hit"), new).otherwise(old))
    return joined.drop("_hit")


def _same(ids: DataFrame, name: str = "node") -> DataFrame:
    return ids.select("source", F.col("source").alias(name))


def set_properties(graph: Graph, ids: DataFrame, keys: list[str] | str, values: object = None, nodes: bool = True) -> Result:
    keys, values = (keys, values) if isinstance(keys, list) else ([keys], [values])
    marked = _marked(ids)
    return _each(graph, lambda t: _set(t, marked, dict(zip(keys, values or [None] * len(keys), strict=True))), nodes), _same(ids, "node" if nodes else "relationship")


def remove_properties(graph: Graph, ids: DataFrame, keys: list[str] | str, nodes: bool = True) -> Result:
    keys = keys if isinstance(keys, list) else [keys]
    marked = _marked(ids)
    return _each(graph, lambda t: _set(t, marked, dict.fromkeys([k for k in keys if k in t.columns])), nodes), _same(ids, "node" if nodes else "relationship")


def relabel(graph: Graph, ids: DataFrame | None, add: set[str], drop: set[str]) -> Graph:
    """Moves nodes (all if ids is None) to the tables of their new labels."""
    marked = None if ids is None else cut(ids.select(F.col("source").alias("id")).distinct())
    nodes: dict[str, DataFrame] = {}
    moved: list[tuple[str, str, DataFrame]] = []
    for key, t in graph.nodes.items():
        new = key_of((labels_in(key) | add) - drop)
        if new == key or drop and not add and not labels_in(key) & drop:
            nodes[key] = t
        elif marked is None:
            moved.append((key, new, t))
        else:
            nodes[key] = t.join(marked, "id", "left_anti")
            moved.append((key, new, t.join(marked, "id", "left_semi")))
    for _, new, t in moved:
        nodes[new] = _stacked([nodes[new], t]) if new in nodes else t
    wide = {key: f"{key}|{new}" if marked is not None else new for key, new, _ in moved}

    def ends(name: str) -> str:
        return "|".join(dict.fromkeys(x for k in name.split("|") for x in wide.get(k, k).split("|")))

    return replace(graph, nodes=nodes, rels=tuple(replace(r, source=ends(r.source), target=ends(r.target)) for r in graph.rels))


def remove_labels(graph: Graph, ids: DataFrame, labels: list[str] | str) -> Result:
    return relabel(graph, ids, set(), set(labels if isinstance(labels, list) else [labels])), _same(ids)


def create_nodes(graph: Graph, labels: list[str] | str, props: dict | list[dict] | None = None) -> Result:
    many = props if isinstance(props, list) else [props or {}]
    key, first = key_of(labels if isinstance(labels, list) else [labels]), _top(graph.node_table())
    made = None
    for i, p in enumerate(many):  # one row for each map that was given
        one = graph.spark.range(1).select(F.lit(first + i).cast("bigint").alias("id"), *[_value(v).alias(k) for k, v in p.items() if v is not None])
        made = one if made is None else _stacked([made, one])
    old = graph.nodes.get(key)
    out = graph.with_nodes(key, made if old is None else _stacked([old, made]))
    return out, graph.spark.range(first, first + len(many)).select(F.col("id").alias("node"))


def create_relationships(graph: Graph, pairs: DataFrame, type: str, props: dict | None = None, name: str = "relationship") -> Result:
    """One relationship for each pair(source, target)."""
    own = [_value(v).alias(k) for k, v in (props or {}).items() if v is not None]
    made = cut(numbered(pairs.select("source", "target"), "id", _top(graph.rel_table())))
    every = "|".join(graph.nodes)
    rows = made.select("id", F.col("source").alias("src"), F.col("target").alias("dst"), *own)
    return graph.create_rels(type, every, every, rows), made.select("source", "target", F.col("id").alias(name))


def merge_node(graph: Graph, labels: list[str], ident: dict, create: dict | None = None, match: dict | None = None) -> Result:
    """The nodes with the labels and identifying properties, with match set; or one new node with ident and create."""
    keys = frozenset(k for k in graph.nodes if set(labels) <= labels_in(k))
    found = graph.node_keys(keys)
    for k, v in ident.items():
        found = found.where(F.col(f"`{k}`") == _value(v)) if k in found.columns else found.limit(0)
    found = cut(found.select(F.col("id").alias("source")))
    if found.isEmpty():
        return create_nodes(graph, labels, ident | (create or {}))
    if match:
        graph, _ = set_properties(graph, found, list(match), list(match.values()))
    return graph, found.select(F.col("source").alias("node"))


def merge_relationship(graph: Graph, pairs: DataFrame, type: str, ident: dict, create: dict | None = None, match: dict | None = None) -> Result:
    """For each pair the relationships with the identifying properties, or a new one."""
    table = graph.rel_table({type})
    for k, v in ident.items():
        table = table.where(F.col(f"`{k}`") == _value(v)) if k in table.columns else table.limit(0)
    found = cut(pairs.join(table.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("id").alias("rel")), ["source", "target"]))
    missing = cut(pairs.distinct().join(found.select("source", "target"), ["source", "target"], "left_anti"))
    rows = found
    if match:
        graph, _ = set_properties(graph, found.select(F.col("rel").alias("source")), list(match), list(match.values()), nodes=False)
    if not missing.isEmpty():
        graph, new = create_relationships(graph, missing, type, ident | (create or {}), "rel")
        rows = rows.unionByName(new)
    return graph, rows


def delete_nodes(graph: Graph, ids: DataFrame) -> Result:
    gone = cut(ids.select("source").distinct())
    rels = tuple(replace(r, table=r.table.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(*r.table.columns)) for r in graph.rels)
    nodes = {k: t.join(gone.toDF("id"), "id", "left_anti") for k, t in graph.nodes.items()}
    return replace(graph, nodes=nodes, rels=rels), gone.select("source", F.lit(None).cast("string").alias("value"))


def chain(graph: Graph, ids: list[int], type: str) -> Result:
    """Relationships from each node to the next."""
    pairs = graph.spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:], strict=False)], "source bigint, target bigint")
    graph, rows = create_relationships(graph, pairs, type)
    return graph, rows.select("relationship")


# refactor

def rename_label(graph: Graph, old: str, new: str, ids: DataFrame | None = None) -> Result:
    own = graph.node_table({old}).select(F.col("id").alias("source"))
    chosen = cut(own if ids is None else own.join(ids.select("source").distinct(), "source", "left_semi"))
    return relabel(graph, chosen, {new}, {old}), chosen.agg(F.count(F.lit(1)).alias("nodes_changed"))


def rename_property(graph: Graph, old: str, new: str, ids: DataFrame | None = None, nodes: bool = True) -> Result:
    marked = None if ids is None else _marked(ids)
    field = "nodes_changed" if nodes else "relationships_changed"
    tables = list(graph.nodes.values()) if nodes else [r.table for r in graph.rels]
    counts = None
    for t in tables:
        if old in t.columns:
            hit = t.where(F.col(f"`{old}`").isNotNull())
            hit = hit if marked is None else hit.join(marked, "id", "left_semi")
            one = hit.agg(F.count(F.lit(1)).alias("n"))
            counts = one if counts is None else counts.unionByName(one)

    def renamed(t: DataFrame) -> DataFrame:
        if old not in t.columns:
            return t
        if marked is None and new not in t.columns:
            return t.withColumnRenamed(old, new)
        joined = t.join(marked, "id", "left") if marked is not None else t.withColumn("_hit", F.lit(True))
        move = F.col("_hit") & F.col(f"`{old}`").isNotNull()
        kept = F.col(f"`{new}`") if new in t.columns else F.lit(None)
        return joined.withColumn("_new", F.when(move, F.col(f"`{old}`")).otherwise(kept)).withColumn(old, F.when(~F.coalesce(F.col("_hit"), F.lit(False)), F.col(f"`{old}`"))).drop(new, "_hit").withColumnRenamed("_new", new)

    rows = graph.spark.range(1).select(F.lit(0).cast("bigint").alias(field)) if counts is None else counts.agg(F.sum("n").alias(field))
    return _each(graph, renamed, nodes), rows


def rename_type(graph: Graph, old: str, new: str, ids: DataFrame | None = None) -> Result:
    if ids is None:
        count = graph.rel_table({old}).agg(F.count(F.lit(1)).alias("relationships_changed"))
        return replace(graph, rels=tuple(replace(r, type=new) if r.type == old else r for r in graph.rels)), count
    marked = cut(ids.select(F.col("source").alias("id")).distinct())
    out: list[Rel] = []
    for r in graph.rels:
        if r.type == old:
            out += [replace(r, table=r.table.join(marked, "id", "left_anti")), replace(r, type=new, table=r.table.join(marked, "id", "left_semi"))]
        else:
            out.append(r)
    return replace(graph, rels=tuple(out)), graph.rel_table({old}).join(marked, "id", "left_semi").agg(F.count(F.lit(1)).alias("relationships_changed"))


def move_end(graph: Graph, pairs: DataFrame, side: str) -> Result:
    """Each relationship (source) gets another start or end node (target)."""
    moved = cut(pairs.select(F.col("source").alias("id"), F.col("target").alias("_to")).distinct())
    every = "|".join(graph.nodes)
    column, label = ("src", "source") if side == "from" else ("dst", "target")
    rels = tuple(replace(r, table=r.table.join(moved, "id", "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(*r.table.columns), **{label: every}) for r in graph.rels)
    return replace(graph, rels=rels), pairs.select("source", "target", F.col("source").alias("relationship"))


def invert(graph: Graph, ids: DataFrame) -> Result:
    marked = _marked(ids)
    every = "|".join(graph.nodes)

    def turned(t: DataFrame) -> DataFrame:
        j = t.join(marked, "id", "left")
        return j.withColumns({"src": F.when(F.col("_hit"), F.col("dst")).otherwise(F.col("src")), "dst": F.when(F.col("_hit"), F.col("src")).otherwise(F.col("dst"))}).select(*t.columns)

    rels = tuple(replace(r, source=every, target=every, table=turned(r.table)) for r in graph.rels)
    return replace(graph, rels=rels), ids.select("source", F.col("source").alias("input"), F.col("source").alias("output"), F.lit(None).cast("string").alias("error"))


def _copied(graph: Graph, ids: DataFrame, skip: list[str]) -> tuple[Graph, DataFrame]:
    """The graph with copies of the nodes, and (old, new)."""
    pairs = cut(numbered(ids.select(F.col("source").alias("old")).distinct(), "new", _top(graph.node_table())))
    nodes = {k: _stacked([t, t.join(pairs, F.col("id") == F.col("old")).withColumn("id", F.col("new")).drop("old", "new", *skip)]) for k, t in graph.nodes.items()}
    return replace(graph, nodes=nodes), pairs


def clone_nodes(graph: Graph, ids: DataFrame, with_rels: bool = False, skip: list[str] | None = None) -> Result:
    graph, pairs = _copied(graph, ids, skip or [])
    if with_rels:
        rels = []
        for r in graph.rels:
            names = r.table.columns
            out = r.table.join(pairs, F.col("src") == F.col("old")).withColumn("src", F.col("new")).select(*names)
            into = r.table.join(pairs, F.col("dst") == F.col("old")).withColumn("dst", F.col("new")).select(*names)
            new = numbered(out.unionByName(into).drop("id"), "id", _top(_everything(graph, rels)))
            rels += [r, replace(r, table=cut(new.select(*names)))]
        graph = replace(graph, rels=tuple(rels))
    return graph, pairs.select(F.col("old").alias("source"), F.col("old").alias("input"), F.col("new").alias("output"), F.lit(None).cast("string").alias("error"))


def _everything(graph: Graph, more: list[Rel]) -> DataFrame:
    """All relationship ids, those of a list of new tables included."""
    ids = graph.rel_table().select("id")
    for r in more:
        ids = ids.unionByName(r.table.select("id"))
    return ids


def clone_subgraph(graph: Graph, nodes: list[int], rels: list[int] | None = None, config: dict | None = None) -> Result:
    """Copies of nodes and of the relationships between them (or of those named); standinNodes are used in place of copies."""
    config = config or {}
    stand = {int(a): int(b) for a, b in config.get("standinNodes", [])}
    ids = graph.spark.createDataFrame([(int(n),) for n in nodes if int(n) not in stand], "source bigint")
    graph, pairs = _copied(graph, ids, config.get("skipProperties", []))
    every = pairs if not stand else pairs.unionByName(graph.spark.createDataFrame(list(stand.items()), "old bigint, new bigint"))
    wanted = None if not rels else graph.spark.createDataFrame([(int(r),) for r in rels], "id bigint")
    out: list[Rel] = []
    for r in graph.rels:
        names = r.table.columns
        t = r.table if wanted is None else r.table.join(wanted, "id", "left_semi")
        new = t.join(every.toDF("src", "_s"), "src").join(every.toDF("dst", "_d"), "dst").withColumns({"src": F.col("_s"), "dst": F.col("_d")}).drop("_s", "_d", "id")
        out += [r, replace(r, table=cut(numbered(new, "id", _top(_everything(graph, out))).select(*names)))]
    graph = replace(graph, rels=tuple(out))
    return graph, pairs.select(F.col("old").alias("input"), F.col("new").alias("output"), F.lit(None).cast("string").alias("error"))


def categorize(graph: Graph, key: str, type: str, outgoing: bool, label: str, new_key: str, copy: list[str] | None = None) -> Result:
    """One new node for each value of a property, linked with the nodes that had it; the property goes."""
    copy = copy or []
    have = [(k, t) for k, t in graph.nodes.items() if key in t.columns]
    if not have:
        return graph, graph.spark.createDataFrame([("success",)], "status string")
    rows = _stacked([t.select("id", *[F.col(f"`{c}`") for c in dict.fromkeys([key, *[c for c in copy if c in t.columns]])]) for _, t in have]).where(F.col(f"`{key}`").isNotNull())
    rows = cut(rows)
    kept = [F.first(f"`{c}`", ignorenulls=True).alias(c) for c in copy if c in rows.columns]
    values = rows.groupBy(F.col(f"`{key}`").alias(new_key)).agg(*kept, F.lit(1).alias("_one")).drop("_one")
    made = cut(numbered(values, "id", _top(graph.node_table())))
    own_key = key_of([label])
    old = graph.nodes.get(own_key)
    links = rows.select(F.col("id").alias("node"), F.col(f"`{key}`").alias(new_key)).join(made.select(F.col("id").alias("category"), new_key), new_key)
    ends = links.select(F.col("node" if outgoing else "category").alias("source"), F.col("category" if outgoing else "node").alias("target"))
    nodes = {k: t.drop(key, *copy) if key in t.columns else t for k, t in graph.nodes.items()}
    nodes[own_key] = made if old is None else _stacked([old, made])
    graph, _ = create_relationships(replace(graph, nodes=nodes), cut(ends), type)
    return graph, graph.spark.createDataFrame([("success",)], "status string")


def collapse_node(graph: Graph, ids: DataFrame, type: str) -> Result:
    """A node between two others becomes a relationship from the one that leads to it to the one it leads to, with its properties."""
    gone = cut(ids.select("source").distinct())
    table = graph.rel_table()
    into = table.join(gone.toDF("dst"), "dst").select(F.col("dst").alias("mid"), F.col("src").alias("source"))
    out = table.join(gone.toDF("src"), "src").select(F.col("src").alias("mid"), F.col("dst").alias("target"))
    props = graph.node_table().join(gone.toDF("id"), "id").drop("labels").withColumnRenamed("id", "mid")
    made = cut(numbered(into.join(out, "mid").join(props, "mid"), "id", _top(table)))
    every = "|".join(graph.nodes)
    graph, _ = delete_nodes(graph, gone)
    graph = graph.create_rels(type, every, every, made.select("id", F.col("source").alias("src"), F.col("target").alias("dst"), *[c for c in props.columns if c != "mid"]))
    return graph, made.select(F.col("mid").alias("source"), F.col("mid").alias("id_collapsed"), F.col("id").alias("new_relationship"))


def extract_node(graph: Graph, ids: DataFrame, labels: list[str], out_type: str, in_type: str) -> Result:
    """A relationship becomes a node with its properties, between its two ends."""
    marked = cut(ids.select(F.col("source").alias("id")).distinct())
    table = graph.rel_table().join(marked, "id")
    made = cut(numbered(table.withColumnRenamed("id", "old").drop("type"), "id", _top(graph.node_table())))
    key = key_of(labels if isinstance(labels, list) else [labels])
    rows = made.drop("old", "src", "dst")
    old = graph.nodes.get(key)
    graph = replace(graph, rels=tuple(replace(r, table=r.table.join(marked, "id", "left_anti").select(*r.table.columns)) for r in graph.rels)).with_nodes(key, rows if old is None else _stacked([old, rows]))
    graph, _ = create_relationships(graph, made.select(F.col("src").alias("source"), F.col("id").alias("target")), in_type)
    graph, _ = create_relationships(graph, made.select(F.col("id").alias("source"), F.col("dst").alias("target")), out_type)
    return graph, made.select(F.col("old").alias("source"), F.col("old").alias("input"), F.col("id").alias("output"), F.lit(None).cast("string").alias("error"))


def merge_nodes(graph: Graph, ids: list[int], config: dict | None = None) -> Result:
    """All nodes become the first one: their labels and relationships go to it; properties by overwrite (the last), discard (the first) or combine (lists)."""
    config = config or {}
    how = config.get("properties", "combine")
    how = how if isinstance(how, str) else next(iter(how.values()), "combine")
    order = {int(n): i for i, n in enumerate(ids)}
    first = int(ids[0])
    place = F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(i))])
    rows = graph.node_table().where(F.col("id").isin(list(order))).withColumn("_i", place[F.col("id")])
    props = [c for c in rows.columns if c not in ("id", "labels", "_i")]
    labels = set(rows.agg(F.array_distinct(F.flatten(F.collect_list("labels")))).first()[0])

    def joined(c: str) -> Column:
        listed = F.transform(F.array_sort(F.collect_list(F.when(F.col(f"`{c}`").isNotNull(), F.struct("_i", F.col(f"`{c}`").alias("v"))))), lambda s: s["v"])
        return F.array_distinct(listed) if how == "combine" else F.try_element_at(listed, F.lit(1 if how == "discard" else -1))

    one = cut(rows.agg(*[joined(c).alias(c) for c in props]).withColumn("id", F.lit(first).cast("bigint")))
    if how == "combine":  # a single value stays a value
        kept = one.select(*[F.size(f"`{c}`").alias(c) for c in props]).first()
        one = one.select("id", *[F.col(f"`{c}`") if kept[c] > 1 else F.try_element_at(f"`{c}`", F.lit(1)).alias(c) for c in props])
    moved = tuple(
        replace(r, source="|".join(dict.fromkeys([*r.source.split("|"), key_of(labels)])), target="|".join(dict.fromkeys([*r.target.split("|"), key_of(labels)])),
                table=r.table.withColumns({s: F.when(F.col(s).isin(list(order)), F.lit(first).cast("bigint")).otherwise(F.col(s)) for s in ("src", "dst")})) for r in graph.rels)
    nodes = {k: t.where(~F.col("id").isin(list(order))) for k, t in graph.nodes.items()}
    key = key_of(labels)
    nodes[key] = _stacked([nodes[key], one]) if key in nodes else one
    return replace(graph, nodes=nodes, rels=moved), graph.spark.createDataFrame([(first,)], "node bigint")


def delete_and_reconnect(graph: Graph, path: list[int], nodes: list[int], config: dict | None = None) -> Result:
    """Nodes of a path go; what is left of it is linked again by relationships of the type of those before."""
    gone = {int(n) for n in nodes}
    left = [int(n) for n in path if int(n) not in gone]
    table = graph.rel_table().select("src", "dst", "type")
    graph_after, _ = delete_nodes(graph, graph.spark.createDataFrame([(n,) for n in gone], "source bigint"))
    rels = None
    for a, b in zip(left, left[1:], strict=False):
        i, j = path.index(a), path.index(b)
        if j == i + 1:
            continue
        near = table.where(F.col("src").isin(int(path[i]), int(path[i + 1])) & F.col("dst").isin(int(path[i]), int(path[i + 1]))).first()
        pair = graph.spark.createDataFrame([(a, b)], "source bigint, target bigint")
        graph_after, made = create_relationships(graph_after, pair, near["type"] if near else "RELATED")
        rels = made if rels is None else rels.unionByName(made)
    rows = graph.spark.createDataFrame([(left,)], "nodes array<bigint>")
    links = F.array().cast("array<bigint>")
    return graph_after, rows.withColumn("relationships", links) if rels is None else rows.crossJoin(rels.agg(F.collect_list("relationship").alias("relationships")))


# queries in procedures

def do_when(graph: Graph, condition: bool, then: str, other: str = "", params: dict | None = None) -> Result:
    from ..plans import execute

    text = then if condition else other
    if not text:
        return graph, graph.spark.createDataFrame([(None,)], "value string")
    graph, rows = execute(graph, text, **(params or {}))
    return graph, (rows.select(F.struct("*").alias("value")) if rows is not None else graph.spark.createDataFrame([], "value string"))


def do_case(graph: Graph, conditionals: list, other: str = "", params: dict | None = None) -> Result:
    for condition, query in zip(conditionals[::2], conditionals[1::2], strict=True):
        if condition:
            return do_when(graph, True, query, "", params)
    return do_when(graph, False, "", other, params)


def iterate(graph: Graph, source: str, action: str, config: dict | None = None) -> Result:
    """Runs an update over the rows of a query as one job; batches change no result."""
    from ..plans import run_update
    from ..plans.query import run_query

    rows = run_query(graph, source)
    count = rows.count()
    names = ", ".join(f"`{c}`" for c in rows.columns)
    out = run_update(graph, f"CALL {{ {source.rstrip('; ')} }} WITH {names} {action}" if rows.columns else action)
    size = int((config or {}).get("batch_size", 10_000))
    return out, graph.spark.createDataFrame([(True, -(-count // size))], "success boolean, number_of_executed_batches bigint")


def delete_all(graph: Graph, config: dict | None = None) -> Result:
    """periodic.delete: nodes of the labels with their relationships, or relationships of the types."""
    config = config or {}
    labels, types = config.get("labels"), config.get("edge_types")
    labels, types = (x if isinstance(x, list) or x is None else [x] for x in (labels, types))
    n_nodes = n_rels = 0
    before = graph.rel_table().count()
    if types:
        n_rels += graph.rel_table(set(types)).count()
        graph = replace(graph, rels=tuple(r for r in graph.rels if r.type not in types))
    if labels or not types:
        ids = cut(graph.node_table(set(labels) if labels else None).select(F.col("id").alias("source")))
        n_nodes = ids.count()
        graph, _ = delete_nodes(graph, ids)
        n_rels = before - graph.rel_table().count()
    size = int(config.get("batch_size", 10_000))
    return graph, graph.spark.createDataFrame([(True, max(1, -(-(n_nodes + n_rels) // size)), n_nodes, n_rels)], "success boolean, number_of_executed_batches bigint, number_of_deleted_nodes bigint, number_of_deleted_relationships bigint")
