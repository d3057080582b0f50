"""Query text -> DataFrame. Patterns become joins on typed tables; variables are struct columns, of which Catalyst keeps only the fields used.

A node that is named nowhere else is not read at all where the relationship tables already say what it may be. Conditions are applied as soon as their
variables are there, so a traversal starts from few nodes. Subqueries run once for the distinct values of the outer variables that they name, and are
joined back; nothing runs row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import procedures
from ..operators.traversal import Hops, Walker
from ..sources import load_csv, load_jsonl, load_parquet
from . import syntax as X
from .expression import Scope, Writer, kind_of, quoted, replaced, unified, widened

_LIVE = "_live"


@dataclass
class Slot:
    """A node of a pattern: SQL of its id, the tables that it may be in, and whether its column is there."""

    id: str
    keys: frozenset[str]
    full: bool


@dataclass
class Found:
    """A relationship or a walk of a pattern: SQL of its id or ids, of its struct(s), and of the nodes it goes through (in the pattern's direction)."""

    types: frozenset[str] | None
    many: bool
    ids: str
    rels: str | None = None
    nodes: str | None = None


def conjuncts(tree: tuple | None) -> list[tuple]:
    if tree is None:
        return []
    return conjuncts(tree[1]) + conjuncts(tree[2]) if tree[0] == "and" else [tree]


def names_in(tree: object) -> set[str]:
    """Names of variables in a tree, those that patterns and lambdas bind included."""
    out: set[str] = set()
    for t in X.inside(tree):
        if isinstance(t, tuple) and len(t) > 1 and t[0] in ("var",) and isinstance(t[1], str):
            out.add(t[1])
        elif isinstance(t, (X.NodePattern, X.RelPattern, X.Path)) and t.var:
            out.add(t.var)
    return out


_LIFTED = ("exists", "count", "rollup", "exists_query", "count_query")


def lifts(tree: object) -> bool:
    return any(isinstance(t, tuple) and t and t[0] in _LIFTED and len(t) > 1 and not isinstance(t[1], str) for t in X.inside(tree))


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, object], uses: dict[str, int] | None = None, hops: Hops | None = None) -> None:
        self.graph, self.params, self.fresh = graph, params, 0
        self.uses, self.hops = uses or {}, hops or Hops()

    def once(self) -> Scope:
        return Scope(self.graph.spark.range(1).select(), unit=True)

    def new_name(self, stem: str = "") -> str:
        self.fresh += 1
        return f"_{stem}{self.fresh}"

    def run(self, query: X.Query) -> DataFrame | None:
        """The rows of a query; None where it ends in an update."""
        self.uses = {}
        for t in X.inside(query):
            names = [t[1]] if isinstance(t, tuple) and len(t) == 2 and t[0] == "var" else [t.var] if isinstance(t, (X.NodePattern, X.RelPattern)) and t.var else [t.var] if isinstance(t, X.Change) else t.imports or [] if isinstance(t, X.Subquery) else []
            for n in names:
                self.uses[n] = self.uses.get(n, 0) + 1
        if any(isinstance(t, X.Project) and t.everything or isinstance(t, X.Subquery) for t in X.inside(query)):
            self.uses = {n: 2 for n in self.uses}
        counting = any(isinstance(t, tuple) and t[:2] == ("call", "gethopscounter") for t in X.inside(query))
        limit = self.constant(query.hops) if query.hops else None
        self.hops = Hops(limit, counting)
        return self.union(query, self.once())

    def union(self, query: X.Query, outer: Scope) -> DataFrame | None:
        out = self.single(query.parts[0], outer)
        for part, every in zip(query.parts[1:], query.every, strict=True):
            right = self.single(part, outer)
            if out is None or right is None or set(out.variables) != set(right.variables):
                raise SyntaxError("UNION needs the same column names on both sides")
            both = out.df.unionByName(right.df)
            out = out.over(both if every else both.distinct(), {k: out.keys[k] | right.keys[k] for k in out.keys if k in right.keys})
        self.last = out
        return out.df if out else None

    def single(self, part: X.Single, scope: Scope) -> Scope | None:
        for i, clause in enumerate(part.clauses):
            scope = self.clause(clause, scope)
            if isinstance(clause, X.Project) and clause.final:
                if i + 1 < len(part.clauses):
                    raise SyntaxError("RETURN is the last clause")
                return scope
        last = part.clauses[-1]
        if isinstance(last, X.Call):
            return scope if last.fields is None else self.needs_return()
        if isinstance(last, (X.Match, X.Unwind, X.Project, X.Load)):
            return self.needs_return()
        return None

    @staticmethod
    def needs_return() -> None:
        raise SyntaxError("a query ends with RETURN or an update")

    def clause(self, c: object, scope: Scope) -> Scope:
        if isinstance(c, X.Match):
            return self.match(c, scope)
        if isinstance(c, X.Project):
            return self.project(c, scope)
        if isinstance(c, X.Unwind):
            return self.unwind(c, scope)
        if isinstance(c, X.Call):
            return self.call(c, scope)
        if isinstance(c, X.Subquery):
            return self.subquery(c, scope)
        if isinstance(c, X.Load):
            return self.load(c, scope)
        raise SyntaxError("an update needs run_update")

    # expressions

    def writer(self, scope: Scope) -> Writer:
        return Writer(scope, self.params, self.graph)

    def constant(self, tree: tuple) -> object:
        """The value of an expression without variables."""
        if tree[0] == "value":
            return tree[1]
        if tree[0] == "param":
            return self.writer(self.once())._param(tree[1]) and self.params[tree[1]]
        if tree[0] == "negative":
            return -self.constant(tree[1])
        if tree[0] == "list":
            return [self.constant(t) for t in tree[1]]
        if tree[0] == "map":
            return {k: self.constant(t) for k, t in tree[1]}
        one = self.once()
        return one.df.select(F.expr(self.writer(one).sql(tree)).alias("x")).first()[0]

    def lift(self, tree: object, scope: Scope) -> tuple[object, Scope]:
        """Subqueries, ends of relationships, degrees and counters of an expression become columns of the rows."""
        if isinstance(tree, list):
            out = []
            for t in tree:
                t, scope = self.lift(t, scope)
                out.append(t)
            return out, scope
        if not isinstance(tree, tuple) or not tree:
            return tree, scope
        if tree[0] in _LIFTED and len(tree) > 1 and not isinstance(tree[1], str):
            return self.lifted(tree, scope)
        if tree[0] == "call" and len(tree) == 4:
            _, name, _, args = tree
            if name in ("startnode", "endnode") and args and args[0][0] == "var" and args[0][1] in scope.types:
                if kind_of(scope.types[args[0][1]]) == "rel":
                    return self.lifted_end(name, args[0][1], scope)
            if name in ("degree", "indegree", "outdegree") and len(args) == 1:
                return self.lifted_degree(name, args[0], scope)
            if name == "counter" and len(args) >= 2:
                from ..operators.traversal import numbered

                own = self.new_name("counter")
                step = int(self.constant(args[2])) if len(args) > 2 else 1
                return ("column", own), scope.over(numbered(scope.df, own, int(self.constant(args[1])), step))
            if name == "gethopscounter":
                return ("value", self.hops.used), scope
        if tree[0] == "get" and tree[1][0] == "call" and tree[1][1] in ("startnode", "endnode") and tree[2] == "id":
            return ("get", tree[1][3][0], "src" if tree[1][1] == "startnode" else "dst"), scope
        if tree[0] == "call" and tree[1] == "id" and tree[3] and tree[3][0][0] == "call" and tree[3][0][1] in ("startnode", "endnode"):
            return ("get", tree[3][0][3][0], "src" if tree[3][0][1] == "startnode" else "dst"), scope
        out = []
        for t in tree:
            t, scope = self.lift(t, scope)
            out.append(t)
        return tuple(out), scope

    def lifted_end(self, name: str, var: str, scope: Scope) -> tuple[tuple, Scope]:
        own = self.new_name("end")
        nodes = self.graph.node_table().select(F.struct("*").alias(own))
        side = "src" if name == "startnode" else "dst"
        return ("column", own), scope.over(scope.df.join(nodes, F.col(f"{var}.{side}") == F.col(f"{own}.id"), "left"))

    def lifted_degree(self, name: str, tree: tuple, scope: Scope) -> tuple[tuple, Scope]:
        own = self.new_name("degree")
        side = {"degree": ["src", "dst"], "indegree": ["dst"], "outdegree": ["src"]}[name]
        counts = self.graph.rel_table().select(F.explode(F.array(*side)).alias(f"{own}of")).groupBy(f"{own}of").agg(F.count(F.lit(1)).alias(f"{own}n"))
        at = self.writer(scope).write(tree)
        df = scope.df.join(counts, F.expr(f"{at.sql}.id") == F.col(f"{own}of"), "left").drop(f"{own}of")
        return ("sqltext", f"(case when {at.sql} is not null then coalesce(`{own}n`, 0L) end)"), scope.over(df)

    def lifted(self, tree: tuple, scope: Scope) -> tuple[tuple, Scope]:
        """EXISTS, COUNT or a pattern comprehension as a column, by a left join on the outer values that it names."""
        own = self.new_name("sub")
        whole = tree[0].endswith("_query")
        used = sorted(names_in(tree[1:]) & set(scope.variables))
        keys, inner = self.callers(scope, used, tree[1:])
        if whole:
            compiler = self.inner()
            compiler.union(tree[1], replace(inner, hidden=tuple(keys), callers=inner.df.select(*keys) if keys else None))
            result = compiler.last
            value = F.count(F.lit(1))
            found = result.df.where(_LIVE).groupBy(*keys).agg(value.alias(own)) if _LIVE in result.df.columns else result.df.groupBy(*keys).agg(value.alias(own))
        else:
            result = self.paths(tree[1], conjuncts(tree[2]), inner)
            if tree[0] == "rollup":
                body, result = self.lift(tree[3], result)
                x = self.writer(result).write(body)
                # a list keeps its nulls
                found = result.df.groupBy(*keys).agg(F.transform(F.collect_list(F.struct(F.expr(x.sql).alias("x"))), lambda s: s["x"]).alias(own)) if keys else result.df.agg(F.transform(F.collect_list(F.struct(F.expr(x.sql).alias("x"))), lambda s: s["x"]).alias(own))
                empty = f"cast(array() as {found.schema[own].dataType.simpleString()})"
                return ("sqltext", f"coalesce(`{own}`, {empty})"), self.joined_back(scope, keys, found)
            found = result.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(own)) if keys else result.df.agg(F.count(F.lit(1)).alias(own))
        value = f"coalesce(`{own}`, 0L)"
        return ("sqltext", f"({value} > 0)" if tree[0].startswith("exists") else value), self.joined_back(scope, keys, found)

    def inner(self) -> Compiler:
        out = type(self)(self.graph, self.params, self.uses, self.hops)
        out.fresh = self.fresh + 1000
        return out

    def callers(self, scope: Scope, used: list[str], tree: object, every: bool = False) -> tuple[dict[str, str], Scope]:
        """The distinct values of outer variables, with key columns (name -> SQL over the outer rows); of a node only its id where no more is used."""
        bare = {t[1] for t in X.inside(tree) if isinstance(t, tuple) and len(t) == 2 and t[0] == "var"}
        noted = {t.var for t in X.inside(tree) if isinstance(t, X.NodePattern) and t.var and (t.labels or t.props or t.whole)}
        keys, columns = {}, []
        for var in used:
            key = self.new_name("key")
            x = self.writer(scope).write(("var", var))
            keys[key] = self.writer(scope).comparable(x)
            columns.append(F.expr(keys[key]).alias(key))
            if not every and x.kind == "node" and var not in bare and var not in noted:
                columns.append(F.struct(F.col(f"{var}.id").alias("id"), F.col(f"{var}.labels").alias("labels")).alias(var))
            else:
                columns.append(F.col(f"`{var}`"))
        if not columns and not scope.hidden:
            return {}, self.once()
        hidden = [F.col(h) for h in scope.hidden]
        keys |= {h: f"`{h}`" for h in scope.hidden}
        live = [F.expr(f"`{_LIVE}`")] if _LIVE in scope.df.columns else []
        df = scope.df.select(*columns, *hidden, *live).dropDuplicates(list(keys))
        return keys, Scope(df.drop(_LIVE) if live else df, {v: k for v, k in scope.keys.items() if v in used})

    @staticmethod
    def joined_back(scope: Scope, keys: dict[str, str], found: DataFrame, how: str = "left") -> Scope:
        if not keys:
            return scope.over(found if scope.unit else scope.df.crossJoin(found))
        names = {k: f"{k}_r" for k in keys}
        right = found.withColumnsRenamed(names)
        same = F.lit(True)
        for k, sql in keys.items():
            same = same & F.expr(sql).eqNullSafe(F.col(names[k]))
        return scope.over(scope.df.join(right, same, how).drop(*names.values()))

    def filtered(self, scope: Scope, tree: tuple | None) -> Scope:
        """WHERE. EXISTS as a conjunct becomes a semi join, its negation an anti join."""
        for c in conjuncts(tree):
            negative = c[0] == "not" and isinstance(c[1], tuple) and c[1][0] == "exists" and not isinstance(c[1][1], str)
            test = c[1] if negative else c
            if test[0] == "exists" and not isinstance(test[1], str):
                used = sorted(names_in(test[1:]) & set(scope.variables))
                keys, inner = self.callers(scope, used, test[1:])
                if keys:
                    found = self.paths(test[1], conjuncts(test[2]), inner).df.select(*keys).distinct()
                    scope = self.joined_back(scope, keys, found, "left_anti" if negative else "left_semi")
                    continue
            before = scope.df.columns
            c, wide = self.lift(c, scope)
            df = wide.df.where(F.expr(self.writer(wide).truth(c)))
            scope = scope.over(df.select(*before) if wide is not scope and before else df)
        return scope

    # reading clauses

    def unwind(self, c: X.Unwind, scope: Scope) -> Scope:
        begun = scope.df.columns
        tree, scope = self.lift(c.items, scope)
        x = self.writer(scope).write(tree)
        if x.kind not in ("list", "null"):
            raise TypeError(f"UNWIND needs a list, not {x.kind}")
        each = F.explode(F.expr("cast(null as array<string>)" if x.kind == "null" else x.sql)).alias(c.var)
        out = scope.over(scope.df.select(*begun, each))
        if x.kind == "list" and kind_of(x.type.elementType) == "node":
            out.keys[c.var] = frozenset(self.graph.nodes)
        return out

    @staticmethod
    def beside(scope: Scope, df: DataFrame) -> DataFrame:
        return df if scope.unit else scope.df.crossJoin(df)

    def load(self, c: X.Load, scope: Scope) -> Scope:
        options = {k: v if isinstance(v, bool) else self.constant(v) for k, v in c.options.items()}
        rows = {"CSV": load_csv, "PARQUET": load_parquet, "JSONL": load_jsonl}[c.kind](self.graph.spark, self.constant(c.source), **options)
        whole = F.struct("*") if options.get("header", True) else F.array("*")
        return scope.over(self.beside(scope, rows.select(whole.alias(c.var))))

    def call(self, c: X.Call, scope: Scope) -> Scope:
        name = c.name.lower()
        if name not in procedures.PROCEDURES:
            raise SyntaxError(f"there is no procedure {c.name}")
        body, places, keys, drop = procedures.PROCEDURES[name], procedures.TAKES.get(name, ()), {}, []
        places = tuple(i for i in places if i < len(c.args))
        rest = [a for i, a in enumerate(c.args) if i not in places]
        if names_in(rest) & set(scope.variables):
            raise SyntaxError(f"only the nodes and relationships that {c.name} takes may be variables")
        constants = [self.constant(a) for a in rest]
        if places:
            columns = ("source", "target")[: len(places)]
            if names_in([c.args[i] for i in places]) & set(scope.variables):
                wide = scope
                for column, i in zip(columns, places, strict=True):
                    x = self.writer(wide).write(c.args[i])
                    own = self.new_name("key")
                    listed = x.kind == "list"
                    inner = kind_of(x.type.elementType) if listed else x.kind
                    sql = (f"explode(transform({x.sql}, n -> n.id))" if inner in ("node", "rel") else f"explode({x.sql})") if listed else f"{x.sql}.id" if inner in ("node", "rel") else x.sql
                    wide = wide.over(wide.df.select("*", F.expr(sql).cast("bigint").alias(own)) if listed else wide.df.withColumn(own, F.expr(sql).cast("bigint")))
                    keys[column] = own
                asked = wide.df.select(*[F.col(k).alias(column) for column, k in keys.items()]).dropna().distinct()
                scope, drop = wide, list(keys.values())
            else:
                given = [x if isinstance(x, list) else [x] for x in (self.constant(c.args[i]) for i in places)]
                pairs = [(int(a),) for a in given[0]] if len(given) == 1 else [(int(a), int(b)) for a in given[0] for b in given[1]]
                asked = self.graph.spark.createDataFrame(pairs, ", ".join(f"{x} bigint" for x in columns))
            result = body(self.graph, asked, *constants)
        else:
            result = body(self.graph, *constants)
        if name in procedures.WRITES:
            self.graph, out = result
        else:
            out = result
        if places:
            names = {"source": "_source", "target": "_target"} if keys else {}
            plain = [x for x in ("source", "target")[: len(places)] if x in out.columns and x not in {f for f, _ in c.fields or []}]
            out = out.withColumnsRenamed({k: v for k, v in names.items() if k in plain}) if keys else out.drop(*plain)
            keys = {names[k]: f"`{own}`" for k, own in keys.items() if k in plain}
        nodes = dict(scope.keys)
        picked: list[tuple[str, str]] = []
        for field, alias in c.fields or [("*", "*")]:
            picked += [(x, x) for x in out.columns if x not in keys] if field == "*" else [(field, alias)]
        for field, _ in picked:
            if field not in out.columns:
                raise SyntaxError(f"{c.name} does not yield {field}")
        out = out.select(*keys, *[F.col(f"`{x}`").alias(n) for x, n in picked])
        for field, n in picked if c.fields is not None else []:
            if field in procedures.NODE_FIELDS and kind_of(out.schema[n].dataType) == "int":  # ids of nodes become the nodes
                found = self.graph.node_table().select(F.struct("*").alias(f"{n}_node"))
                out = out.join(found, F.col(f"`{n}`") == F.col(f"{n}_node.id")).drop(n).withColumnRenamed(f"{n}_node", n)
            elif field in procedures.REL_FIELDS and kind_of(out.schema[n].dataType) == "int":
                found = self.graph.rel_table().select(F.struct("id", "src", "dst", "type", *[x for x in self.graph.rel_table().columns if x not in ("id", "src", "dst", "type")]).alias(f"{n}_rel"))
                out = out.join(found, F.col(f"`{n}`") == F.col(f"{n}_rel.id")).drop(n).withColumnRenamed(f"{n}_rel", n)
            if kind_of(out.schema[n].dataType) == "node":
                nodes[n] = frozenset(self.graph.nodes)
        scope = scope.over(self.joined_back(scope, keys, out, "inner").df if keys else self.beside(scope, out), nodes)
        scope = scope.over(scope.df.drop(*drop)) if drop else scope
        if name in procedures.WRITES:
            scope = self.changed(scope)
        return self.filtered(scope, c.where)

    def changed(self, scope: Scope) -> Scope:
        """The rows after a procedure changed the graph."""
        return scope

    def subquery(self, c: X.Subquery, scope: Scope) -> Scope:
        """CALL { query }: runs over the distinct values of the variables that it takes in; a unit subquery leaves the rows as they are."""
        query, taken = c.query, c.imports
        if taken == ["*"]:
            taken = scope.variables
        if taken is None:
            parts, taken = [], []
            for part in query.parts:
                first = part.clauses[0]
                if isinstance(first, X.Project) and not first.final and not first.distinct and not first.limit and not first.order and all(i.value == ("var", i.name) for i in first.items) and (first.items or first.everything):
                    taken = scope.variables if first.everything else taken + [i.name for i in first.items]
                    part = X.Single(part.clauses[1:])
                parts.append(part)
            query = X.Query(parts, query.every, query.hops)
        taken = list(dict.fromkeys(taken))
        for name in taken:
            if name not in scope.types:
                raise SyntaxError(f"the variable {name} is not bound")
        compiler = self.inner()
        if not taken:
            compiler.union(query, self.once())
            self.graph = compiler.graph
            if compiler.last is None:
                return scope
            result = compiler.last
            return scope.over(self.beside(scope, result.df), scope.keys | result.keys)
        keys, begin = self.callers(scope, taken, query, every=True)
        compiler.union(query, replace(begin, hidden=tuple(keys), callers=begin.df.select(*keys)))
        self.graph = compiler.graph
        if compiler.last is None:
            return scope
        result = compiler.last
        rows = result.df.where(_LIVE).drop(_LIVE) if _LIVE in result.df.columns else result.df
        clash = set(rows.columns) & set(scope.df.columns)
        if clash - set(keys):
            raise SyntaxError(f"the subquery gives {sorted(clash)} again")
        out = self.joined_back(scope, keys, rows, "inner")
        return scope.over(out.df, scope.keys | {k: v for k, v in result.keys.items() if k in rows.columns})

    # projections

    def project(self, c: X.Project, scope: Scope) -> Scope:
        items = list(c.items)
        if c.everything:
            items = [X.Item(n, ("var", n), n) for n in scope.variables] + items
            if not items:
                raise SyntaxError("there is nothing to return")
        seen = [i.name for i in items]
        if len(set(seen)) < len(seen):
            raise SyntaxError("two columns have one name")
        originals = [i.value for i in items]
        values = []
        for i in items:
            value, scope = self.lift(i.value, scope)
            values.append(value)
        hidden = list(scope.hidden)
        w = self.writer(scope)
        written, sums = [], []
        for value in values:
            w.aggregate = False
            written.append(w.write(value).sql)
            sums.append(w.aggregate)
        grouped = any(sums)
        place = {i.name: f"_out{k}" for k, i in enumerate(items)}
        order = [(replaced(one.value, list(zip(originals, [("column", p) for p in place.values()], strict=True)) + [(("var", i.name), ("column", place[i.name])) for i in items]), down) for one, down in c.order]
        if grouped:
            df = self.with_ghosts(scope) if hidden and all(sums) else scope.df
            if hidden and _LIVE not in df.columns:
                df = df.withColumn(_LIVE, F.lit(True))
            by = [F.col(h) for h in hidden] + [F.expr(s).alias(place[i.name]) for s, i, a in zip(written, items, sums, strict=True) if not a]
            # an aggregate beside a grouping expression sees that as a column
            plain = [(v, ("column", place[i.name])) for v, i, a in zip(values, items, sums, strict=True) if not a]
            totals = []
            inner = scope.over(df.select("*", *[F.expr(s).alias(place[i.name]) for s, i, a in zip(written, items, sums, strict=True) if not a]))
            for v, i, a in zip(values, items, sums, strict=True):
                if a:
                    totals.append(F.expr(self.writer(inner).write(replaced(v, plain)).sql if plain else self.writer(inner).sql(v)).alias(place[i.name]))
            extra = []  # aggregates that only ORDER BY names
            for k, (tree, down) in enumerate(order):
                wo = self.writer(scope.over(inner.df))
                sql = wo.write(tree).sql
                if wo.aggregate:
                    extra.append(F.expr(sql).alias(f"_order{k}"))
                    order[k] = (("column", f"_order{k}"), down)
            wide = inner.df.groupBy(*[F.col(h) for h in hidden], *[place[i.name] for i, a in zip(items, sums, strict=True) if not a]).agg(*totals, *extra)
            del by
        else:
            wide = scope.df.select("*", *[F.expr(s).alias(place[i.name]) for s, i in zip(written, items, strict=True)])
        keys = {}
        for i, value in zip(items, values, strict=True):
            if value[0] == "var" and value[1] in scope.keys:
                keys[i.name] = scope.keys[value[1]]
            elif kind_of(wide.schema[place[i.name]].dataType) == "node":
                keys[i.name] = frozenset(self.graph.nodes)
        outs = list(place.values())
        kept = hidden + ([_LIVE] if _LIVE in wide.columns and hidden and not grouped else [])
        if c.distinct:
            wide = wide.select(*kept, *outs)
            mixed = [p for p in outs if kind_of(wide.schema[p].dataType) in ("node", "rel")]
            wide = self.unique(wide, mixed, kept, outs)
        scope_wide = Scope(wide, {}, tuple(hidden))
        by = []
        for tree, down in order:
            tree, scope_wide = self.lift(tree, scope_wide)
            x = self.writer(scope_wide).write(tree)
            column = F.expr(self.writer(scope_wide).comparable(x) if x.kind != "null" else "cast(null as string)")
            by.append(column.desc_nulls_first() if down else column.asc_nulls_last())
        df = scope_wide.df
        skip, limit = (None if t is None else int(self.constant(t)) for t in (c.skip, c.limit))
        for n in (skip, limit):
            if n is not None and n < 0:
                raise ValueError("SKIP and LIMIT take numbers of 0 or more")
        if hidden and (skip is not None or limit is not None):
            rank = F.row_number().over(Window.partitionBy(*hidden).orderBy(*(by or [F.lit(1)])))
            df = df.withColumn("_rank", rank).where((F.col("_rank") > (skip or 0)) & (F.col("_rank") <= (skip or 0) + (limit if limit is not None else 2**31 - 2 - (skip or 0))))
        else:
            df = df.orderBy(*by) if by else df
            df = df.offset(skip) if skip is not None else df
            df = df.limit(limit) if limit is not None else df
        out = scope.over(df.select(*[F.col(f"`{k}`") for k in kept], *[F.col(place[i.name]).alias(i.name) for i in items]), keys)
        return self.filtered(out, c.where)

    @staticmethod
    def unique(df: DataFrame, entities: list[str], kept: list[str], outs: list[str]) -> DataFrame:
        """DISTINCT; entities are the same if their ids are."""
        if not entities:
            return df.distinct()
        keyed = df.withColumns({f"{p}_id": F.col(f"{p}.id") for p in entities})
        return keyed.dropDuplicates(kept + [f"{p}_id" if p in entities else p for p in outs]).select(*kept, *outs)

    @staticmethod
    def with_ghosts(scope: Scope) -> DataFrame:
        """The rows and one more for each caller of the subquery, which aggregates leave out: a caller without rows gets counts of 0 and empty lists."""
        df = scope.df if _LIVE in scope.df.columns else scope.df.withColumn(_LIVE, F.lit(True))
        return df.unionByName(scope.callers.select(*scope.hidden).withColumn(_LIVE, F.lit(False)), allowMissingColumns=True)

    # patterns

    def types_of(self, labels: list) -> frozenset[str] | None:
        out: set[str] = set()
        for label in labels:
            if isinstance(label, str):
                out.add(label)
            elif label[0] == "param":
                given = self.params[label[1]]
                out |= set(given if isinstance(given, (list, tuple)) else [given])
            else:
                raise SyntaxError("a relationship's type has to be a name or a parameter here")
        return frozenset(out) or None

    def keys_of(self, labels: list[list]) -> tuple[frozenset[str], list[tuple]]:
        """The node tables that labels allow, and labels that only the rows tell."""
        keys, late = set(self.graph.nodes), []
        for some in labels:
            fixed: set[str] = set()
            groups: list[set[str]] = []
            for label in some:
                if isinstance(label, str):
                    fixed.add(label)
                elif label[0] == "param":
                    given = self.params[label[1]]
                    groups.append(set(given if isinstance(given, (list, tuple)) else [given]))
                else:
                    late.append(label)
            if not any(isinstance(label, tuple) and label[0] != "param" for label in some):
                keys = {k for k in keys if set(k.split(":")) & fixed or any(g <= set(k.split(":")) for g in groups)}
        return frozenset(keys), late

    def props_of(self, p: X.NodePattern | X.RelPattern) -> list[tuple[str, tuple]]:
        if p.whole is not None:
            return [(k, ("value", v)) for k, v in dict(self.params[p.whole[1]]).items()]
        return p.props

    def scan(self, keys: frozenset[str], var: str, props: list[tuple[str, tuple]]) -> DataFrame:
        """The nodes of the tables as structs; constant properties filter the tables."""
        df = self.graph.node_keys(keys)
        if props:
            w = self.writer(Scope(df))
            for key, tree in props:
                df = df.where(F.expr(w._compare("=", ("column", key) if key in df.columns else ("value", None), tree).sql))
        return df.select(F.struct("*").alias(var))

    def paths(self, paths: list[X.Path], where: list[tuple], scope: Scope, made: dict | None = None) -> Scope:
        """The rows with the variables of the paths bound; conditions are applied as soon as they can be."""
        binding = Binding(self, scope, paths, where)
        for p in paths:
            binding.path(p)
        return binding.finish()

    def match(self, c: X.Match, scope: Scope) -> Scope:
        if not c.optional:
            return self.paths(c.paths, conjuncts(c.where), scope)
        used = sorted(names_in([c.paths, c.where]) & set(scope.variables))
        direct = self.optional_join(c, scope, used)
        if direct is not None:
            return direct
        keys, inner = self.callers(scope, used, [c.paths, c.where])
        found = self.paths(c.paths, conjuncts(c.where), inner)
        new = [v for v in found.variables if v not in scope.types]
        rows = found.df.select(*keys, *new)
        if keys:
            out = self.joined_back(scope, keys, rows)
        else:
            out = scope.over(scope.df.select("*", F.lit(1).alias("_one")).join(rows, F.lit(True), "left").drop("_one"))
        return scope.over(out.df, scope.keys | {v: found.keys[v] for v in new if v in found.keys})

    def optional_join(self, c: X.Match, scope: Scope, used: list[str]) -> Scope | None:
        """OPTIONAL MATCH of one hop from a bound node to a new one as one left join, with WHERE in its condition."""
        if len(c.paths) != 1 or c.paths[0].var or len(c.paths[0].parts) != 3 or lifts([c.paths, c.where]) or self.hops.counting:
            return None
        left, rel, right = c.paths[0].parts
        if right.var in scope.types and right.var is not None and left.var not in scope.types:
            left, right = right, left
            rel = replace(rel, direction={"in": "out", "out": "in"}.get(rel.direction, "both"))
        if left.var not in scope.keys or right.var in scope.types or rel.kind != "one" or left.labels or left.props or left.whole or rel.var in scope.types:
            return None
        if any(names_in(t) for _, t in self.props_of(rel) + self.props_of(right)):
            return None
        own = self.new_name("start")
        mark = X.NodePattern(own, [], [])
        inner = Binding(self, self.once(), [X.Path(None, [mark, rel, right])], [], {own: scope.keys[left.var]})
        inner.path(X.Path(None, [mark, rel, right]))
        start = inner.slots[own]
        rows = inner.scope.df.withColumn(f"{own}id", F.expr(start.id))
        new = [x for x in (rel.var, right.var) if x and x in rows.columns]
        rows = rows.select(f"{own}id", *new, *([F.expr(inner.found[0].ids).alias(f"{own}e")] if not new else []))
        wide = Scope(scope.df.limit(0).crossJoin(rows.limit(0)) if rows.columns else scope.df)
        same = F.col(f"{left.var}.id") == F.col(f"{own}id")
        for t in conjuncts(c.where):
            same = same & F.expr(self.writer(wide).truth(t))
        df = scope.df.join(rows, same, "left").drop(f"{own}id", f"{own}e")
        keys = scope.keys | ({right.var: inner.scope.keys[right.var]} if right.var in new else {})
        return scope.over(df, keys)


class Binding:
    """Binds the paths of one MATCH: no relationship is used twice in it."""

    def __init__(self, compiler: Compiler, scope: Scope, paths: list[X.Path], where: list[tuple], given: dict[str, frozenset[str]] | None = None) -> None:
        self.c, self.scope, self.where = compiler, scope, list(where)
        self.slots: dict[str, Slot] = {}
        for v, keys in scope.keys.items():
            self.slots[v] = Slot(f"`{v}`.id", keys, True)
        for v, t in scope.types.items():
            if v not in self.slots and kind_of(t) == "node":
                self.slots[v] = Slot(f"`{v}`.id", frozenset(compiler.graph.nodes), True)
        self.given = given or {}
        self.found: list[Found] = []
        self.named = {p.var for p in paths if p.var}
        self.all = [x for p in paths for x in p.parts if isinstance(x, X.RelPattern)]
        self.begun = set(scope.df.columns) | {x.var for p in paths for x in [p, *p.parts] if x.var}
        self.early()

    @property
    def df(self) -> DataFrame:
        return self.scope.df

    def put(self, df: DataFrame, **keys: frozenset[str]) -> None:
        self.scope = self.scope.over(df, self.scope.keys | keys)

    def early(self) -> None:
        """Applies the conditions whose variables are all bound; those with subqueries wait for the end."""
        rest = []
        for t in self.where:
            need = names_in(t)
            lambdas = {x[1] for x in X.inside(t) if isinstance(x, tuple) and x and x[0] in ("comprehension",)} | {x[2] for x in X.inside(t) if isinstance(x, tuple) and x and x[0] == "quantifier"}
            lambdas |= {n for x in X.inside(t) if isinstance(x, tuple) and x and x[0] == "reduce" for n in (x[1], x[3])}
            if not self.scope.unit and need - lambdas <= set(self.df.columns) and not lifts(t) and not any(isinstance(x, tuple) and x[:1] == ("call",) and x[1] in ("startnode", "endnode", "degree", "indegree", "outdegree", "counter") for x in X.inside(t)):
                self.put(self.df.where(F.expr(self.c.writer(self.scope).truth(t))))
            else:
                rest.append(t)
        self.where = rest

    def finish(self) -> Scope:
        out = self.scope
        rest, self.where = self.where, []
        for t in rest:
            out = self.c.filtered(out, t)
        return out.over(out.df.select(*[F.col(f"`{c}`") for c in out.df.columns if not c.startswith("_") or c in self.begun]))

    def needs(self, p: X.NodePattern) -> bool:
        """Whether a node's struct is used: by its name elsewhere, or by a condition on its properties."""
        return p.var is not None and p.var not in self.given and self.c.uses.get(p.var, 2) > 1 or any(names_in(t) for _, t in self.c.props_of(p))

    # paths

    def path(self, path: X.Path) -> None:
        parts = list(path.parts)
        if path.var:
            parts = [replace(p, var=p.var or self.c.new_name("anon")) if isinstance(p, (X.NodePattern, X.RelPattern)) else p for p in parts]
            for p in parts:
                self.c.uses[p.var] = 2
        # without a name a pattern's node still needs an identity
        parts = [replace(p, var=self.c.new_name("n")) if isinstance(p, X.NodePattern) and p.var is None else p for p in parts]
        for p in parts:
            if isinstance(p, X.NodePattern) and p.var.startswith("_n"):
                self.c.uses.setdefault(p.var, 1)
        where = self.anchor(parts)
        segments: dict[int, Found] = {}
        if parts[where].var in self.slots:
            self.checked(parts[where])
        elif len(parts) == 1 or not self.lazy(parts, where):
            self.open(parts[where])
        for i in range(where + 1, len(parts), 2):
            segments[i] = self.hop(parts[i - 1], parts[i], parts[i + 1], False)
        for i in range(where - 1, 0, -2):
            segments[i] = self.hop(parts[i + 1], parts[i], parts[i - 1], True)
        if path.var:
            self.name_path(path.var, parts, segments)
            self.early()

    def anchor(self, parts: list) -> int:
        nodes = range(0, len(parts), 2)
        for i in nodes:
            if parts[i].var in self.slots:
                return i
        if any(isinstance(p, X.RelPattern) and (p.kind != "one") for p in parts):
            # a traversal starts where properties say which nodes
            if not any(isinstance(p, X.RelPattern) and (p.keep or p.weigh or p.kind == "kshortest") for p in parts):
                for i in nodes:
                    if self.c.props_of(parts[i]):
                        return i
        return 0

    def lazy(self, parts: list, at: int) -> bool:
        """Whether the first node can be left to the first relationship's table."""
        near = parts[at + 1] if at + 1 < len(parts) else parts[at - 1]
        keys, late = self.keys(parts[at])
        return near.kind == "one" and not late and not self.needs(parts[at]) and not self.c.props_of(parts[at]) and near.var not in self.scope.types

    def keys(self, p: X.NodePattern) -> tuple[frozenset[str], list[tuple]]:
        keys, late = self.c.keys_of(p.labels)
        return (keys & self.given[p.var] if p.var in self.given else keys), late

    def constant_props(self, p: X.NodePattern | X.RelPattern) -> tuple[list, list]:
        own = self.c.props_of(p)
        return [(k, t) for k, t in own if not names_in(t) and not lifts(t)], [(k, t) for k, t in own if names_in(t) or lifts(t)]

    def open(self, p: X.NodePattern) -> None:
        """Scans a node."""
        keys, late = self.keys(p)
        fixed, loose = self.constant_props(p)
        df = self.c.scan(keys, p.var, fixed)
        self.put(self.c.beside(self.scope, df), **{p.var: keys})
        self.slots[p.var] = Slot(f"`{p.var}`.id", keys, True)
        self.loose(p, loose, late)
        self.early()

    def loose(self, p: X.NodePattern, props: list, labels: list[tuple]) -> None:
        for key, tree in props:
            self.put(self.df.where(F.expr(self.c.writer(self.scope).sql(("compare", "=", ("get", ("var", p.var), key), tree)))))
        for label in labels:
            x = self.c.writer(self.scope).write(label)
            test = f"exists({x.sql}, l -> array_contains(`{p.var}`.labels, l))" if x.kind == "list" else f"array_contains(`{p.var}`.labels, {x.sql})"
            self.put(self.df.where(F.expr(test)))

    def checked(self, p: X.NodePattern) -> None:
        """Labels and properties of a node that is bound already."""
        keys, late = self.c.keys_of(p.labels)
        slot = self.slots[p.var]
        if not slot.full and (p.labels and not slot.keys <= keys or self.c.props_of(p) or late):
            self.fill(p.var)
            slot = self.slots[p.var]
        if p.labels and not slot.keys <= keys:
            for some in p.labels:
                if all(isinstance(x, str) for x in some):
                    self.put(self.df.where(F.expr(self.c.writer(self.scope).sql(("haslabels", ("var", p.var), [some])))))
            slot.keys = slot.keys & keys
        self.loose(p, self.c.props_of(p), late)

    def fill(self, var: str) -> None:
        """Joins the struct of a node of which only the id is there."""
        slot = self.slots[var]
        df = self.df.join(self.c.scan(slot.keys, var, []), F.expr(slot.id) == F.col(f"`{var}`.id"))
        self.put(df, **{var: slot.keys})
        self.slots[var] = Slot(f"`{var}`.id", slot.keys, True)

    # relationships

    def table(self, rel: X.RelPattern, here: frozenset[str] | None, there: frozenset[str] | None) -> tuple[DataFrame, frozenset[str], frozenset[str]]:
        """Steps (s, d, r: struct) in the pattern's direction from here to there, and the tables that both ends may be in."""
        types = self.c.types_of(rel.types)
        fixed, _ = self.constant_props(rel)
        graph = self.c.graph
        ways = {"out": [False], "in": [True], "both": [False, True]}[rel.direction]
        wide = graph.rel_columns(types)
        parts, near, far = [], set(), set()
        for back in ways:
            source, target = (there, here) if back else (here, there)
            table, sources, targets = graph.rel_ends(types, source, target)
            if table is None:
                continue
            names = table.columns
            w = self.c.writer(Scope(table))
            for key, tree in fixed:
                table = table.where(F.expr(w._compare("=", ("column", key) if key in names else ("value", None), tree).sql))
            if back and len(ways) == 2:
                table = table.where("src != dst")  # a self-loop counts once
            order = ["id", "src", "dst", "type", *[c for c in wide if c not in ("id", "src", "dst", "type")]]
            r = F.struct(*[F.col(c) if c in names else F.lit(None).cast(wide[c]).alias(c) for c in order]).alias("r")
            parts.append(table.select(F.col("dst" if back else "src").alias("s"), F.col("src" if back else "dst").alias("d"), r))
            near |= targets if back else sources
            far |= sources if back else targets
        if not parts:
            empty = graph.spark.createDataFrame([], "s bigint, d bigint, r struct<id:bigint,src:bigint,dst:bigint,type:string>")
            return empty, frozenset(), frozenset()
        out = parts[0]
        for one in parts[1:]:
            out = out.unionByName(one)
        return out, frozenset(near), frozenset(far)

    def overlaps(self, rel: X.RelPattern) -> bool:
        """Whether another relationship of this MATCH might be the same one."""
        own = self.c.types_of(rel.types)
        others = [o for o in self.all if o is not rel]
        same = [o for o in others if (a := self.c.types_of(o.types)) is None or own is None or a & own]
        return len(same) > 0 if rel in self.all else len(self.all) > 1

    def hop(self, left: X.NodePattern, rel: X.RelPattern, right: X.NodePattern, flipped: bool) -> Found:
        if flipped:
            rel = replace(rel, direction={"in": "out", "out": "in"}.get(rel.direction, "both"))
        if rel.kind != "one":
            return self.walk(left, rel, right, flipped)
        c = self.c
        there = self.slots[right.var].keys if right.var in self.slots else self.keys(right)[0]
        here = self.slots[left.var].keys if left.var in self.slots else self.keys(left)[0]
        steps, near, far = self.table(rel, here, there)
        again = rel.var is not None and rel.var in self.scope.types
        _, loose = self.constant_props(rel)
        k = c.new_name("e")
        var = rel.var if rel.var and not again and (c.uses.get(rel.var, 2) > 1 or loose) else (f"{k}r" if loose else None)
        fields = [F.col("s").alias(f"{k}s"), F.col("d").alias(f"{k}d"), F.col("r.id").alias(f"{k}i")] + ([F.col("r").alias(var)] if var else [])
        steps = steps.select(*fields)
        if left.var in self.slots:
            df = self.df.join(steps, F.expr(self.slots[left.var].id) == F.col(f"{k}s"))
        else:
            df = c.beside(self.scope, steps)
            self.slots[left.var] = Slot(f"`{k}s`", near, False)
        df = c.hops.visit(df, f"{k}i")
        self.put(df)
        if left.var not in self.scope.keys and not self.slots[left.var].full and not near <= self.keys(left)[0]:
            self.fill_checked(left)
        found = Found(c.types_of(rel.types), False, f"`{k}i`", f"`{var}`" if var else None)
        if again:
            self.put(self.df.where(F.expr(f"`{k}i` = `{rel.var}`.id")))
            found.rels = f"`{rel.var}`"
        for key, tree in loose:
            self.put(self.df.where(F.expr(c.writer(self.scope).sql(("compare", "=", ("get", ("column", var), key), tree)))))
        self.arrive(right, f"{k}d", far)
        if not again:
            self.apart(found)
        self.early()
        return found

    def fill_checked(self, p: X.NodePattern) -> None:
        slot = self.slots[p.var]
        slot.keys = slot.keys & self.keys(p)[0]
        self.fill(p.var)

    def arrive(self, p: X.NodePattern, column: str, far: frozenset[str]) -> None:
        """Binds the node that a step leads to: a bound one has to be it, a new one is joined if its struct or labels are needed."""
        if p.var in self.slots:
            self.put(self.df.where(F.expr(f"{self.slots[p.var].id} = `{column}`")))
            self.checked(p)
            return
        keys, late = self.keys(p)
        fixed, loose = self.constant_props(p)
        if self.needs(p) or fixed or loose or late or not far <= keys:
            df = self.df.join(self.c.scan(keys & far, p.var, fixed), F.col(column) == F.col(f"`{p.var}`.id"))
            self.put(df, **{p.var: keys & far})
            self.slots[p.var] = Slot(f"`{p.var}`.id", keys & far, True)
            self.loose(p, loose, late)
        else:
            self.slots[p.var] = Slot(f"`{column}`", far, False)

    def apart(self, new: Found) -> None:
        """No relationship twice in one MATCH."""
        for old in self.found:
            if old.types is None or new.types is None or old.types & new.types:
                if old.many and new.many:
                    test = f"not arrays_overlap({old.ids}, {new.ids})"
                elif old.many or new.many:
                    many, one = (old, new) if old.many else (new, old)
                    test = f"not array_contains({many.ids}, {one.ids})"
                else:
                    test = f"{old.ids} <> {new.ids}"
                self.put(self.df.where(F.expr(test)))
        self.found.append(new)

    # traversals

    def tested(self, lam: X.Lambda | None):
        """A filter of moves by a lambda."""
        if lam is None:
            return None

        def keep(df: DataFrame) -> DataFrame:
            scope = Scope(self.named_for(lam, df))
            return scope.df.where(F.expr(self.c.writer(scope).truth(lam.body))).select("_row.*")

        return keep

    @staticmethod
    def named_for(lam: X.Lambda, df: DataFrame) -> DataFrame:
        """The lambda's variables beside the whole row."""
        own = {lam.edge: F.col("r"), lam.node: F.col("n")}
        if lam.path:
            own[lam.path] = F.struct("nodes", "rels")
        if lam.weight and "weight" in df.columns:
            own[lam.weight] = F.col("weight")
        return df.select(F.struct("*").alias("_row"), *[v.alias(k) for k, v in own.items()])

    def walk(self, left: X.NodePattern, rel: X.RelPattern, right: X.NodePattern, flipped: bool) -> Found:
        c = self.c
        if flipped and (rel.keep or rel.weigh or rel.kind in ("wshortest", "allshortest", "kshortest")):
            # lambdas see the way from the pattern's left to its right
            if right.var not in self.slots:
                self.open(right)
            rel = replace(rel, direction={"in": "out", "out": "in"}.get(rel.direction, "both"))
            left, right, flipped = right, left, False
        if left.var not in self.slots:
            self.open(left)
        if rel.kind == "kshortest" and right.var not in self.slots:
            self.open(right)
        self.early()
        named = rel.var is not None and c.uses.get(rel.var, 2) > 1
        whole = any(v and v.startswith("_anon") for v in (rel.var, left.var, right.var)) or bool(self.named)
        paths = any(lam is not None and (lam.path or True) for lam in (rel.keep, rel.weigh))
        steps, _, far = self.table(rel, None, None)
        if not rel.types:
            far = frozenset(c.graph.nodes)
        steps = steps.select(F.col("r.id").alias("e"), F.col("s").alias("src"), F.col("d").alias("dst"), "r")
        need_rels, need_nodes = named or whole or paths, whole or paths
        nodes = c.graph.node_table().select(F.struct("*").alias("n")) if need_nodes else None
        low = int(c.constant(rel.low)) if rel.low is not None else 1
        high = int(c.constant(rel.high)) if rel.high is not None else None
        if rel.kind in ("bfs", "wshortest", "allshortest", "kshortest") and rel.low is not None and rel.high is not None and rel.low is rel.high:
            low = 1  # one number bounds the length
        start = c.new_name("e")
        starts = self.df.select(F.expr(self.slots[left.var].id).alias("id")).distinct()
        weigh, unit = None, "double"
        if rel.kind in ("wshortest", "allshortest"):
            weigh, unit = self.weights(rel.weigh, steps, nodes)
        walker = Walker(steps if need_rels or weigh else steps.drop("r"), nodes, need_rels, self.tested(rel.keep), weigh, unit, c.hops)
        if rel.kind == "walk":
            rows = walker.every(starts, low, high)
        elif rel.kind == "bfs":
            rows = walker.nearest(starts, low, high)
        elif rel.kind == "kshortest":
            pairs = self.df.select(F.expr(self.slots[left.var].id).alias("source"), F.expr(self.slots[right.var].id).alias("target")).where("source != target")
            k = int(c.constant(rel.k)) if rel.k is not None else 2**31 - 1
            rows = walker.k_nearest(pairs, k, low, high)
        else:
            rows = walker.lightest(starts, high, rel.kind == "allshortest")
        names = {"source": f"{start}s", "node": f"{start}d", "ids": f"{start}i"}
        keep = [F.col(x).alias(y) for x, y in names.items()]
        reverse = F.reverse if flipped else (lambda x: x)
        found = Found(c.types_of(rel.types), True, f"`{start}i`")
        if need_rels and (named or whole):
            var = rel.var or f"{start}r"
            keep.append(reverse(F.col("rels")).alias(var))
            found.rels = f"`{var}`"
        if need_nodes and whole:
            keep.append(F.col("nodes").alias(f"{start}n"))
            # the nodes after the left one: a flipped walk began at the right one
            found.nodes = f"slice(reverse(`{start}n`), 2, size(`{start}n`))" if flipped else f"slice(`{start}n`, 2, size(`{start}n`))"
        if rel.total:
            keep.append(F.col("weight").alias(rel.total))
        self.put(self.df.join(rows.select(*keep), F.expr(self.slots[left.var].id) == F.col(f"{start}s")))
        self.arrive(right, f"{start}d", far)
        self.apart(found)
        self.early()
        return found

    def weights(self, lam: X.Lambda | None, steps: DataFrame, nodes: DataFrame | None):
        """(weigh, type): moves with the weight so far; numbers of 0 or more, or durations."""
        lam = lam or X.Lambda("_edge", "_node", None, None, ("value", 1.0))
        probe = steps.limit(0)
        if nodes is not None:
            probe = probe.crossJoin(nodes.limit(0))
            probe = probe.withColumns({"nodes": F.array("n"), "rels": F.array("r")})
        else:
            probe = probe.withColumns({"n": F.lit(None), "nodes": F.lit(None), "rels": F.lit(None)})
        x = self.c.writer(Scope(self.named_for(lam, probe))).write(lam.body)
        if x.kind not in ("int", "float", "duration", "null"):
            raise TypeError("weights must be numbers of 0 or more, or durations")
        unit = "interval day to second" if x.kind == "duration" else "bigint" if x.kind == "int" else "double"
        zero = "interval '0' second" if x.kind == "duration" else "0"

        def weigh(df: DataFrame) -> DataFrame:
            wide = df if "n" in df.columns else df.withColumns({"n": F.lit(None), "nodes": F.lit(None), "rels": F.lit(None)})
            scope = Scope(self.named_for(lam, wide))
            sql = f"cast({self.c.writer(scope).write(lam.body).sql} as {unit})"
            checked = f"case when ({sql}) is null or ({sql}) < {zero} then raise_error('weights must be numbers of 0 or more') else {sql} end"
            own = scope.df.withColumn("_w", F.expr(checked)).select("_row.*", "_w")
            return own.withColumn("weight", F.expr("case when weight is null then _w else weight + _w end")).select(*df.columns)

        return weigh, unit

    def name_path(self, var: str, parts: list, segments: dict[int, Found]) -> None:
        """p = (...) as struct<nodes, rels>."""
        w = self.c.writer(self.scope)
        nodes, rels, kinds_n, kinds_r = [], [], [], []
        for i, p in enumerate(parts):
            if isinstance(p, X.NodePattern):
                if i and segments[i - 1].nodes:
                    continue  # the walk before ends in it
                if not self.slots[p.var].full:
                    self.fill(p.var)
                    w = self.c.writer(self.scope)
                x = w.write(("column", p.var))
                nodes.append((f"`{p.var}`", False))
                kinds_n.append(x.type)
                continue
            seg = segments[i]
            if seg.rels is None:
                raise SyntaxError("a relationship of a named path was not kept")
            t = w.v(seg.rels).type
            rels.append((seg.rels, seg.many))
            kinds_r.append(t.elementType if seg.many else t)
            if seg.nodes:
                nodes.append((seg.nodes, True))
                kinds_n.append(w.v(seg.nodes).type.elementType)

        def joined(each: list, kinds: list, least: str) -> str:
            if not each:
                return f"cast(array() as array<{least}>)"
            want = unified(kinds)
            pieces = [f"transform({sql}, x -> {widened('x', k, want)})" if many and k != want else sql if many else f"array({widened(sql, k, want)})" for (sql, many), k in zip(each, kinds, strict=True)]
            return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"

        path = f"struct({joined(nodes, kinds_n, 'struct<id:bigint,labels:array<string>>')} as nodes, {joined(rels, kinds_r, 'struct<id:bigint,src:bigint,dst:bigint,type:string>')} as rels)"
        self.put(self.df.withColumn(var, F.expr(path)))


def run_query(graph: Graph, text: str, **params: object) -> DataFrame:
    """The rows of a query; EXPLAIN and PROFILE give one row with the plan. An update's rows are those of its RETURN."""
    from .update import Updater

    query = X.parse(text)
    compiler = Updater(graph, params)
    out = compiler.run(query)
    if out is None:
        out = graph.spark.createDataFrame([], "done boolean")
    if query.explain:
        plan = out._jdf.queryExecution().explainString(graph.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return graph.spark.createDataFrame([(plan,)], "plan string")
    return out


__all__ = ["Compiler", "run_query", "quoted"]
