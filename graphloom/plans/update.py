"""Updates as query text: each statement gives a new graph.

CREATE, MERGE with ON CREATE and ON MATCH, SET and REMOVE of properties, nested properties, maps and labels, [DETACH] DELETE and FOREACH, after any reading
clause. The rows that a writing clause works on are checkpointed first, so new ids stay the same when they are read again; variables are read anew from
the graph after it changed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph, Rel, key_of, labels_in
from ..operators.traversal import cut, numbered
from . import syntax as X
from .expression import Scope, kind_of, quoted
from .query import Compiler, names_in


class Updater(Compiler):
    def clause(self, c: object, scope: Scope) -> Scope:
        if isinstance(c, X.Create):
            scope = self.held(scope)
            for p in c.paths:
                scope = self.create(p, scope)
            return scope
        if isinstance(c, X.Merge):
            return self.merge(c, self.held(scope))
        if isinstance(c, X.Changes):
            scope = self.held(scope)
            for one in c.items:
                scope = self.change(one, scope)
            return scope
        if isinstance(c, X.Delete):
            return self.delete(c, self.held(scope))
        if isinstance(c, X.Foreach):
            return self.foreach(c, self.held(scope))
        return super().clause(c, scope)

    def held(self, scope: Scope) -> Scope:
        """The rows, kept as they are before the graph changes."""
        return scope.over(cut(scope.df if scope.df.columns else scope.df.select(F.lit(1).alias("_one"))))

    def foreach(self, c: X.Foreach, scope: Scope) -> Scope:
        tree, lifted = self.lift(c.items, scope)
        x = self.writer(lifted).write(tree)
        sql = "cast(array() as array<string>)" if x.kind == "null" else x.sql
        inner = lifted.over(lifted.df.select("*", F.explode(F.expr(sql)).alias(c.var)))
        if x.kind == "list" and kind_of(x.type.elementType) == "node":
            inner.keys[c.var] = frozenset(self.graph.nodes)
        for one in c.body:
            inner = self.clause(one, inner)
        return self.fresh_all(scope)

    # variables after a change

    def changed(self, scope: Scope) -> Scope:
        return self.fresh_all(scope)

    def fresh_all(self, scope: Scope) -> Scope:
        for var, t in scope.types.items():
            if not var.startswith("_") and kind_of(t) in ("node", "rel"):
                scope = self.refreshed(scope, var)
        return scope

    def refreshed(self, scope: Scope, var: str) -> Scope:
        """A node or relationship variable with what the graph holds of it now; of a deleted one what was there."""
        kind = kind_of(scope.types[var])
        table = self.graph.node_table() if kind == "node" else self.rel_rows()
        now = table.select(F.struct("*").alias("_now"))
        joined = scope.df.join(now, F.col(f"`{var}`.id") == F.col("_now.id"), "left")
        keep = F.col("_now")
        return scope.over(joined.select(*[keep.alias(var) if c == var else F.col(f"`{c}`") for c in scope.df.columns]), keys={**scope.keys, **({var: frozenset(self.graph.nodes)} if kind == "node" else {})})

    def rel_rows(self) -> DataFrame:
        table = self.graph.rel_table()
        return table.select("id", "src", "dst", "type", *[c for c in table.columns if c not in ("id", "src", "dst", "type")])

    # CREATE

    def fixed_labels(self, labels: list[list], scope: Scope) -> tuple[set[str], list[tuple]]:
        known, late = set(), []
        for some in labels:
            if len(some) > 1:
                raise SyntaxError("a new node cannot have one label or another")
            label = some[0]
            if isinstance(label, str):
                known.add(label)
            elif label[0] == "param":
                given = self.params[label[1]]
                known |= set(given if isinstance(given, (list, tuple)) else [given])
            else:
                late.append(label)
        return known, late

    def top(self, df: DataFrame) -> int:
        return (df.agg(F.max("id")).first()[0] if df.columns else None) or 0

    def create(self, path: X.Path, scope: Scope) -> Scope:
        parts = [replace(p, var=p.var or self.new_name("made")) for p in path.parts]
        for node in parts[::2]:
            if node.var in scope.types:
                if len(parts) == 1 or node.labels or node.props:
                    raise SyntaxError(f"the variable {node.var} is bound already")
                continue
            scope = self.create_node(node, scope)
        for left, rel, right in zip(parts[::2], parts[1::2], parts[2::2], strict=False):
            scope = self.create_rel(left, rel, right, scope)
        if path.var:
            nodes = ", ".join(f"`{p.var}`" for p in parts[::2])
            rels = f"array({', '.join(f'`{p.var}`' for p in parts[1::2])})" if len(parts) > 1 else "cast(array() as array<struct<id:bigint,src:bigint,dst:bigint,type:string>>)"
            from .expression import unified, widened

            kinds = [scope.types[p.var] for p in parts[::2]]
            want = unified(kinds)
            nodes = ", ".join(widened(f"`{p.var}`", k, want) for p, k in zip(parts[::2], kinds, strict=True))
            scope = scope.over(scope.df.withColumn(path.var, F.expr(f"struct(array({nodes}) as nodes, {rels} as rels)")))
        return scope

    def properties(self, p: X.NodePattern | X.RelPattern, scope: Scope) -> dict[str, str]:
        """Property -> SQL over the rows; a null leaves the property away."""
        out = {}
        for k, tree in self.props_of(p):
            x = self.writer(scope).write(tree)
            if x.kind != "null":
                out[k] = x.sql
        return out

    def create_node(self, node: X.NodePattern, scope: Scope) -> Scope:
        known, late = self.fixed_labels(node.labels, scope)
        props = self.properties(node, scope)
        df = numbered(scope.df, "_id", self.top(self.graph.node_table()) + 1 if self.graph.nodes else 0)
        keys = {key_of(known): None}
        if late:  # labels that the rows name: one table for each set of them
            w = self.writer(scope)
            each = []
            for tree in late:
                x = w.write(tree)
                each.append(x.sql if x.kind == "list" else f"array({x.sql})")
            df = cut(df.withColumn("_labels", F.expr(f"array_sort(array_distinct(concat({', '.join([*each, 'array(' + ', '.join(map(quoted, sorted(known))) + ')'])})))")))
            keys = {key_of(r[0]): r[0] for r in df.select("_labels").distinct().collect()}  # as many rows as sets of labels
        for key, labels in keys.items():
            own = df if labels is None else df.where(F.col("_labels") == F.array(*[F.lit(x) for x in labels]))
            made = own.select(F.col("_id").alias("id"), *[F.expr(sql).alias(k) for k, sql in props.items()])
            self.graph = self.add_nodes(key, made)
        names = "`_labels`" if late else f"cast(array({', '.join(map(quoted, sorted(known)))}) as array<string>)"
        struct = F.expr(f"named_struct('id', `_id`, 'labels', {names}{''.join(f', {quoted(k)}, {sql}' for k, sql in props.items())})")
        return scope.over(df.withColumn(node.var, struct).drop("_id", "_labels"), scope.keys | {node.var: frozenset(keys)})

    def add_nodes(self, key: str, rows: DataFrame) -> Graph:
        old = self.graph.nodes.get(key)
        if old is not None:
            from ..graph import _stacked

            rows = _stacked([old, rows])
        return self.graph.with_nodes(key, rows)

    def create_rel(self, left: X.NodePattern, rel: X.RelPattern, right: X.NodePattern, scope: Scope) -> Scope:
        types = self.types_of(rel.types) or frozenset()
        if len(types) != 1 or rel.direction == "both" or rel.kind != "one":
            raise SyntaxError("a new relationship needs one type and a direction")
        kind, = types
        source, target = (left, right) if rel.direction == "out" else (right, left)
        props = self.properties(rel, scope)
        df = numbered(scope.df, "_id", self.top(self.graph.rel_table()) + 1 if self.graph.rels else 0)
        made = df.where(F.col(f"`{source.var}`.id").isNotNull() & F.col(f"`{target.var}`.id").isNotNull()).select(
            F.col("_id").alias("id"), F.col(f"`{source.var}`.id").alias("src"), F.col(f"`{target.var}`.id").alias("dst"), *[F.expr(sql).alias(k) for k, sql in props.items()])
        every = frozenset(self.graph.nodes)
        ends = ["|".join(sorted(scope.keys.get(p.var, every) & every)) for p in (source, target)]
        self.graph = self.graph.create_rels(kind, *ends, made)
        struct = F.expr(f"named_struct('id', `_id`, 'src', `{source.var}`.id, 'dst', `{target.var}`.id, 'type', {quoted(kind)}{''.join(f', {quoted(k)}, {sql}' for k, sql in props.items())})")
        return scope.over(df.withColumn(rel.var, struct).drop("_id"))

    # MERGE

    def merge(self, c: X.Merge, scope: Scope) -> Scope:
        """Finds the whole path or makes it: once for the rows that ask for the same one."""
        values, parts = {}, []
        for p in c.path.parts:
            p = replace(p, var=p.var or self.new_name("made"))
            self.uses[p.var] = 2
            own = []
            for k, tree in self.props_of(p):
                tree, scope = self.lift(tree, scope)
                column = self.new_name("want")
                values[column] = self.writer(scope).sql(tree)
                own.append((k, ("column", column)))
            parts.append(replace(p, props=own, whole=None))
        bound = [p.var for p in parts if isinstance(p, X.NodePattern) and p.var in scope.types]
        if len(bound) == len(parts) == 1:
            raise SyntaxError(f"the variable {bound[0]} is bound already")
        bad = [f"{sql} is null" for sql in values.values()]
        checked = {k: f"case when {' or '.join(bad)} then raise_error('a property in MERGE is null') else {sql} end" for k, sql in values.items()}
        wide = scope.over(cut(scope.df.select("*", *[F.expr(sql).alias(k) for k, sql in checked.items()])))
        keys = [*values, *[f"_of_{v}" for v in bound]]
        rows = wide.df.select("*", *[F.col(f"`{v}`.id").alias(f"_of_{v}") for v in bound])
        if keys:
            asked = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), *[F.first(f"`{v}`").alias(v) for v in bound]))
        else:
            asked = cut(rows.agg(F.count(F.lit(1)).alias("_times")).where("_times > 0"))
        begin = Scope(asked, {v: scope.keys.get(v, frozenset(self.graph.nodes)) for v in bound})
        # a pattern with conditions on row values: they are compared once its nodes are joined
        pattern, where = [], []
        for p in parts:
            where += [("compare", "=", ("get", ("var", p.var), k), tree) for k, tree in p.props if p.var not in bound]
            pattern.append(replace(p, props=[]))
        new = [p.var for p in parts if p.var not in bound]
        if begin.df.isEmpty():
            hit = None
        else:
            hit = self.merged(pattern, where, begin, keys, new)
        if hit is None:
            return scope
        found, scope_made, fresh = hit
        for one in c.on_create:
            if fresh is not None:
                fresh = self.change(one, fresh)
        matched = found
        for one in c.on_match:
            matched = self.change(one, matched)
            if fresh is not None:
                again = fresh.over(cut(fresh.df.where("_times > 1")))
                self.change(one, again)
        ids = found.df.select(*keys, *[F.col(f"`{v}`.id").alias(f"_id_{v}") for v in new])
        if fresh is not None:
            ids = ids.unionByName(fresh.df.select(*keys, *[F.col(f"`{v}`.id").alias(f"_id_{v}") for v in new]))
        out = rows.join(ids, keys) if keys else rows.crossJoin(ids)
        nodes = dict(scope.keys)
        for p in parts:
            if p.var in new:
                node = isinstance(p, X.NodePattern)
                table = (self.graph.node_table() if node else self.rel_rows()).select(F.struct("*").alias(p.var))
                out = out.join(table, F.col(f"_id_{p.var}") == F.col(f"`{p.var}`.id"))
                if node:
                    nodes[p.var] = frozenset(self.graph.nodes)
        out = out.drop(*keys, *[f"_id_{v}" for v in new])
        result = scope.over(out, nodes)
        for v in bound:
            result = self.refreshed(result, v)
        if c.path.var:
            from .expression import unified, widened

            want = unified([result.types[p.var] for p in parts[::2]])
            nodes_sql = ", ".join(widened(f"`{p.var}`", result.types[p.var], want) for p in parts[::2])
            result = result.over(result.df.withColumn(c.path.var, F.expr(f"struct(array({nodes_sql}) as nodes, array({', '.join(f'`{p.var}`' for p in parts[1::2])}) as rels)")))
        return result

    def merged(self, pattern: list, where: list, begin: Scope, keys: list[str], new: list[str]):
        """(rows that were found, None, rows that were made or None)."""
        known = all(not isinstance(p, X.NodePattern) or self.keys_of(p.labels)[0] for p in pattern) and all(
            self.graph.rel_ends(self.types_of(p.types), None, None)[0] is not None for p in pattern if isinstance(p, X.RelPattern))
        if known:
            found = self.paths([X.Path(None, pattern)], where, begin)
            found = found.over(cut(found.df))
            left = begin.df.join(found.df.select(*keys).distinct(), keys, "left_anti") if keys else begin.df.where(F.lit(found.df.isEmpty()))
            left = cut(left)
        else:
            found, left = None, begin.df
        fresh = None
        if not left.isEmpty():
            given = {w[2][1][1]: [] for w in where}
            for w in where:
                given[w[2][1][1]].append((w[2][2], w[3]))
            made = [replace(p, props=given.get(p.var, []), direction="out" if isinstance(p, X.RelPattern) and p.direction == "both" else p.direction) if isinstance(p, X.RelPattern) else replace(p, props=given.get(p.var, [])) for p in pattern]
            bound = set(begin.types)
            made = [replace(p, labels=[]) if isinstance(p, X.NodePattern) and p.var in bound else p for p in made]
            fresh = self.create(X.Path(None, made), begin.over(left))
            fresh = fresh.over(cut(fresh.df))
        if found is None:
            columns = {v: self.graph.node_table().select(F.struct("*").alias(v)) if isinstance(p, X.NodePattern) else self.rel_rows().select(F.struct("*").alias(v)) for p in pattern for v in [p.var] if v in new}
            empty = begin.df.limit(0)
            for one in columns.values():
                empty = empty.crossJoin(one.limit(0))
            found = begin.over(empty, keys=begin.keys | {p.var: frozenset(self.graph.nodes) for p in pattern if isinstance(p, X.NodePattern)})
        return found, None, fresh

    # SET and REMOVE

    def change(self, c: X.Change, scope: Scope) -> Scope:
        if c.var not in scope.types:
            raise SyntaxError(f"the variable {c.var} is not bound")
        if kind_of(scope.types[c.var]) not in ("node", "rel"):
            if kind_of(scope.types[c.var]) == "null":
                return scope
            raise TypeError("only nodes and relationships have properties to be set")
        if c.kind in ("labels", "drop_labels"):
            self.relabel(c, scope)
            return self.refreshed(scope, c.var)
        if c.kind == "drop_property" and len(c.keys) > 1:
            self.assign(scope, c.var, {c.keys[0]: self.nested(scope, c.var, c.keys, None)})
        elif c.kind == "drop_property":
            self.assign(scope, c.var, {c.keys[0]: "null"})
        elif c.kind in ("property", "property_add"):
            tree, lifted = self.lift(c.value, scope)
            x = self.writer(lifted).write(tree)
            if c.kind == "property_add":
                old = self.writer(lifted).write(("get", ("var", c.var), c.keys[0]))
                have = dict.fromkeys(old.type.fieldNames()) if old.kind == "struct" else {}
                fields = {k: f"{old.sql}.`{k}`" for k in have} | {k: f"{x.sql}.`{k}`" for k in x.type.fieldNames()}
                sql = f"named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in fields.items())})"
            else:
                sql = x.sql if len(c.keys) == 1 else self.nested(lifted, c.var, c.keys, x.sql)
            self.assign(lifted, c.var, {c.keys[0]: sql})
        else:
            tree, lifted = self.lift(c.value, scope)
            x = self.writer(lifted).write(tree)
            own = self.writer(lifted)
            if x.kind == "map":
                raise TypeError("a map with typed fields is needed")
            values = own.fields_of(x) if x.kind in ("node", "rel", "struct") else {}
            if c.kind == "replace":
                mine = own.write(("var", c.var))
                values = {k: "null" for k in own.fields_of(mine)} | values
            if values:
                self.assign(lifted, c.var, values)
        return self.refreshed(scope, c.var)

    def nested(self, scope: Scope, var: str, keys: list[str], value: str | None) -> str:
        """The property's map with a field within it set or dropped."""
        def build(at: str, t: T.DataType | None, rest: list[str]) -> str | None:
            if not rest:
                return value
            names = t.fieldNames() if isinstance(t, T.StructType) else []
            parts = {k: f"{at}.`{k}`" for k in names if k != rest[0]}
            inner = build(f"{at}.`{rest[0]}`", t[rest[0]].dataType if rest[0] in names else None, rest[1:])
            if inner is not None:
                parts[rest[0]] = inner
            return f"named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in parts.items())})" if parts else "cast(null as struct<>)"

        x = self.writer(scope).write(("get", ("var", var), keys[0]))
        return build(x.sql, x.type, keys[1:])

    def assign(self, scope: Scope, var: str, values: dict[str, str]) -> None:
        """One row for each node or relationship; if a match gives several, the least value wins."""
        new = scope.df.select(F.expr(f"`{var}`.id").alias("id"), F.struct(*[F.expr(sql).alias(k) for k, sql in values.items()]).alias("_new")).where("id IS NOT NULL")
        simple = "map<" not in new.schema["_new"].dataType.simpleString() and "variant" not in new.schema["_new"].dataType.simpleString() and "void" not in new.schema["_new"].dataType.simpleString()
        new = cut(new.groupBy("id").agg((F.min("_new") if simple else F.first("_new")).alias("_new"), F.lit(True).alias("_hit")))
        kinds = dict(new.select("_new.*").dtypes)

        def written(table: DataFrame) -> DataFrame:
            joined = table.join(new, "id", "left")
            columns = []
            for c in [*table.columns, *[k for k in values if k not in table.columns]]:
                if c not in values:
                    columns.append(F.col(f"`{c}`"))
                    continue
                old_kind = dict(table.dtypes).get(c)
                value = F.col(f"_new.`{c}`")
                if old_kind is None:
                    if kinds[c] != "void":
                        columns.append(F.when(F.col("_hit"), value).alias(c))
                    continue
                if kinds[c] != old_kind and kinds[c] != "void" and old_kind != "void":
                    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
                    both = ("double" if {"float", "double"} & {kinds[c], old_kind} else "bigint") if {kinds[c], old_kind} <= numbers else None
                    if both is None and any(k.startswith(("struct", "map", "array")) for k in (kinds[c], old_kind)):
                        from .expression import unified, widened

                        a, b = table.schema[c].dataType, new.schema["_new"].dataType[c].dataType
                        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
                            want = unified([a, b])
                            columns.append(F.expr(f"case when _hit then {widened(f'_new.`{c}`', b, want)} else {widened(f'`{c}`', a, want)} end").alias(c))
                            continue
                        columns.append(F.when(F.col("_hit"), F.to_json(value) if kinds[c].startswith(("struct", "map", "array")) else value.cast("string")).otherwise(F.to_json(f"`{c}`") if old_kind.startswith(("struct", "map", "array")) else F.col(f"`{c}`").cast("string")).alias(c))
                        continue
                    both = both or "string"
                    columns.append(F.when(F.col("_hit"), value.cast(both)).otherwise(F.col(f"`{c}`").cast(both)).alias(c))
                    continue
                columns.append(F.when(F.col("_hit"), value if kinds[c] != "void" else F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c))
            return joined.select(*columns)

        if kind_of(scope.types[var]) == "rel":
            self.graph = replace(self.graph, rels=tuple(replace(r, table=written(r.table)) for r in self.graph.rels))
            return
        keys = scope.keys.get(var, frozenset(self.graph.nodes))
        self.graph = replace(self.graph, nodes={k: written(t) if k in keys else t for k, t in self.graph.nodes.items()})

    def relabel(self, c: X.Change, scope: Scope) -> None:
        """Moves nodes to the tables of their new labels."""
        known, late = self.fixed_labels([[x] for x in c.labels], scope)
        every = [(known, scope.df)]
        if late:
            w = self.writer(scope)
            sql = [x.sql if x.kind == "list" else f"array({x.sql})" for x in (w.write(t) for t in late)]
            wide = cut(scope.df.withColumn("_labels", F.expr(f"array_sort(array_distinct(concat({', '.join(sql)})))")))
            every = [(known | set(r[0]), wide.where(F.col("_labels") == F.array(*[F.lit(x) for x in r[0]]))) for r in wide.select("_labels").distinct().collect() if r[0]]
        for labels, rows in every:
            ids = cut(rows.select(F.col(f"`{c.var}`.id").alias("id")).dropna().distinct())
            nodes, moved = {}, {}
            for key, table in self.graph.nodes.items():
                new = key_of(labels_in(key) | labels if c.kind == "labels" else labels_in(key) - labels)
                if new == key or key not in scope.keys.get(c.var, frozenset(self.graph.nodes)) and not late:
                    nodes[key] = table
                    continue
                nodes[key] = table.join(ids, "id", "left_anti")
                moved[key] = (new, table.join(ids, "id", "left_semi"))
            for new, rows_moved in moved.values():
                if new in nodes:
                    from ..graph import _stacked

                    nodes[new] = _stacked([nodes[new], rows_moved])
                else:
                    nodes[new] = rows_moved
            wide_name = {k: "|".join(dict.fromkeys([k, v[0]])) for k, v in moved.items()}

            def ends(name: str, wide_name: dict[str, str] = wide_name) -> str:
                return "|".join(dict.fromkeys(x for k in name.split("|") for x in wide_name.get(k, k).split("|")))

            self.graph = replace(self.graph, nodes=nodes, rels=tuple(replace(r, source=ends(r.source), target=ends(r.target)) for r in self.graph.rels))

    # DELETE

    def delete(self, c: X.Delete, scope: Scope) -> Scope:
        nodes, rels = None, None
        for tree in c.values:
            x = self.writer(scope).write(tree)
            if x.kind == "null":
                continue
            if x.kind == "path":
                pairs = [("node", f"transform({x.sql}.nodes, n -> n.id)"), ("rel", f"transform({x.sql}.rels, r -> r.id)")]
            elif x.kind in ("node", "rel"):
                pairs = [(x.kind, f"array({x.sql}.id)")]
            elif x.kind == "list" and kind_of(x.type.elementType) in ("node", "rel"):
                pairs = [(kind_of(x.type.elementType), f"transform({x.sql}, n -> n.id)")]
            else:
                raise TypeError("only nodes, relationships and paths can be deleted")
            for kind, sql in pairs:
                ids = scope.df.select(F.explode(F.expr(sql)).alias("id")).dropna()
                if kind == "node":
                    nodes = ids if nodes is None else nodes.union(ids)
                else:
                    rels = ids if rels is None else rels.union(ids)
        graph = self.graph
        if rels is not None:
            gone = cut(rels.distinct())
            graph = replace(graph, rels=tuple(replace(r, table=r.table.join(gone, "id", "left_anti")) for r in graph.rels))
        if nodes is not None:
            gone = cut(nodes.distinct())
            if c.detach:
                own = []
                for r in graph.rels:
                    kept = r.table.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
                    own.append(replace(r, table=kept.select(*r.table.columns)))
                graph = replace(graph, rels=tuple(own))
            else:
                for r in graph.rels:
                    if not (r.table.join(gone.toDF("src"), "src", "left_semi").isEmpty() and r.table.join(gone.toDF("dst"), "dst", "left_semi").isEmpty()):
                        raise ValueError("a node still has relationships; use DETACH DELETE")
            graph = replace(graph, nodes={k: t.join(gone, "id", "left_anti") for k, t in graph.nodes.items()})
        self.graph = graph
        return scope


def run_update(graph: Graph, text: str, **params: object) -> Graph:
    """The graph after a query."""
    return execute(graph, text, **params)[0]


def execute(graph: Graph, text: str, **params: object) -> tuple[Graph, DataFrame | None]:
    """The graph after a query, and the rows that it returns, if any."""
    updater = Updater(graph, params)
    rows = updater.run(X.parse(text))
    return updater.graph, rows


__all__ = ["Rel", "Updater", "execute", "names_in", "run_update"]
