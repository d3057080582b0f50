"""Property graphs as typed DataFrames: one table for each set of labels, one for each (source, type, target)."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_of(labels: set[str] | frozenset[str] | list[str]) -> str:
    """The name of the table of the nodes that have just these labels."""
    return ":".join(sorted(labels))


def labels_in(key: str) -> set[str]:
    return set(filter(None, key.split(":")))


@dataclass(frozen=True)
class Rel:
    """A relationship table with the columns id, src, dst and its properties. source and target name node tables, several joined by |."""

    type: str
    source: str
    target: str
    table: DataFrame

    @property
    def sources(self) -> set[str]:
        return set(self.source.split("|"))

    @property
    def targets(self) -> set[str]:
        return set(self.target.split("|"))


@dataclass(frozen=True)
class Graph:
    """nodes: labels joined by : -> table with a column id, unique over the graph. An update gives a new Graph."""

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: tuple[Rel, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def with_labels(self, labels: set[str] | None) -> frozenset[str]:
        """The node tables whose nodes have one of the labels (all if None)."""
        return frozenset(k for k in self.nodes if labels is None or labels_in(k) & labels)

    def node_table(self, labels: set[str] | None = None) -> DataFrame:
        """Nodes that have one of the labels (all if None), with a column labels."""
        return self.node_keys(self.with_labels(labels))

    def node_keys(self, keys: frozenset[str] | set[str]) -> DataFrame:
        """The nodes of some tables: id, labels, properties."""
        own = [(k, t) for k, t in self.nodes.items() if k in keys]
        if not own:
            return self.spark.createDataFrame([], "id bigint, labels array<string>")
        return _stacked([t.select("id", F.array(*[F.lit(x) for x in k.split(":") if x]).cast("array<string>").alias("labels"), *[F.col(f"`{c}`") for c in t.columns if c not in ("id", "labels")]) for k, t in own])

    def rel_table(self, types: set[str] | None = None, source: set[str] | None = None, target: set[str] | None = None) -> DataFrame:
        """Relationships (id, src, dst, type, properties) of the types between nodes that may have the labels; other tables are not read."""
        table, _, _ = self.rel_ends(types, None if source is None else self.with_labels(source), None if target is None else self.with_labels(target))
        return table if table is not None else self.spark.createDataFrame([], "id bigint, src bigint, dst bigint, type string")

    def rel_ends(self, types: set[str] | frozenset[str] | None, source: frozenset[str] | None, target: frozenset[str] | None) -> tuple[DataFrame | None, set[str], set[str]]:
        """The relationships of the types that may lead from the source tables to the target tables, and the tables that their ends may be in."""
        own = [
            r for r in self.rels
            if (types is None or r.type in types) and (source is None or r.sources & source) and (target is None or r.targets & target)
        ]
        if not own:
            return None, set(), set()
        stacked = _stacked([r.table.withColumn("type", F.lit(r.type)).select("id", "src", "dst", "type", *[F.col(f"`{c}`") for c in r.table.columns if c not in ("id", "src", "dst", "type")]) for r in own])
        return stacked, set().union(*(r.sources for r in own)), set().union(*(r.targets for r in own))

    def rel_columns(self, types: set[str] | frozenset[str] | None) -> dict[str, T.DataType]:
        """Columns of the relationships of the types, with their types."""
        own = self.rel_ends(types, None, None)[0]
        return {"id": T.LongType(), "src": T.LongType(), "dst": T.LongType(), "type": T.StringType()} if own is None else {f.name: f.dataType for f in own.schema.fields}

    def with_nodes(self, label: str, table: DataFrame) -> Graph:
        return replace(self, nodes={**self.nodes, label: table})

    def create_nodes(self, label: str, rows: DataFrame) -> Graph:
        """Appends nodes; rows without an id get new ids beyond the graph's largest."""
        if "id" not in rows.columns:
            top = self.node_table().agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
            rows = rows.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1 + F.monotonically_increasing_id()).drop("top")
        old = self.nodes.get(label)
        return self.with_nodes(label, rows if old is None else old.unionByName(rows, allowMissingColumns=True))

    def create_rels(self, type: str, source: str, target: str, rows: DataFrame) -> Graph:
        return replace(self, rels=(*self.rels, Rel(type, source, target, rows)))

    def set_property(self, label: str, name: str, value: Column, where: Column | None = None) -> Graph:
        table = self.nodes[label]
        old = F.col(name) if name in table.columns else F.lit(None)
        return self.with_nodes(label, table.withColumn(name, value if where is None else F.when(where, value).otherwise(old)))

    def remove_property(self, label: str, name: str) -> Graph:
        return self.with_nodes(label, self.nodes[label].drop(name))

    def delete_nodes(self, label: str, where: Column, detach: bool = False) -> Graph:
        """Removes nodes; without detach a node that still has a relationship raises when the result is computed."""
        gone = self.nodes[label].where(where).select("id")
        rels = []
        for r in self.rels:
            t = r.table
            for side, name in ((r.source, "src"), (r.target, "dst")):
                if side == label:
                    if detach:
                        t = t.join(gone.withColumnRenamed("id", name), name, "left_anti").select(*r.table.columns)
                    else:
                        hit = gone.withColumnRenamed("id", name).withColumn("_hit", F.lit(1))
                        t = t.join(hit, name, "left").where(F.col("_hit").isNull() | F.raise_error(F.lit("node still has relationships")).isNull()).select(*r.table.columns)
            rels.append(replace(r, table=t))
        return replace(self, nodes={**self.nodes, label: self.nodes[label].where(~F.coalesce(where, F.lit(False)))}, rels=tuple(rels))

    def merge_nodes(self, label: str, rows: DataFrame, on: list[str]) -> Graph:
        """Match-or-create: rows whose key properties are not found are created."""
        rows = rows.dropDuplicates(on)
        return self.create_nodes(label, rows.join(self.nodes[label].select(*on).distinct(), on, "left_anti") if label in self.nodes else rows)

    def save(self, path: str) -> None:
        """Writes the tables as Parquet and their names as JSON lines; load reads them back."""
        named = [("node", k, "", "", f"nodes/{i}") for i, k in enumerate(self.nodes)] + [("rel", r.type, r.source, r.target, f"rels/{i}") for i, r in enumerate(self.rels)]
        for t, row in zip([*self.nodes.values(), *(r.table for r in self.rels)], named, strict=True):
            t.write.mode("overwrite").parquet(f"{path}/{row[4]}")
        for k, values in self.enums.items():
            named.append(("enum", k, ",".join(values), "", ""))
        self.spark.createDataFrame(named, "kind string, name string, source string, target string, folder string").coalesce(1).write.mode("overwrite").json(f"{path}/catalog")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        nodes, rels, enums = {}, {}, {}
        for r in spark.read.schema("kind string, name string, source string, target string, folder string").json(f"{path}/catalog").collect():  # one row a table
            if r.kind == "enum":
                enums[r.name] = tuple(r.source.split(","))
                continue
            table = spark.read.parquet(f"{path}/{r.folder}")
            if r.kind == "node":
                nodes[int(r.folder.split("/")[1])] = (r.name, table)
            else:
                rels[int(r.folder.split("/")[1])] = Rel(r.name, r.source, r.target, table)
        return Graph(spark, dict(nodes[i] for i in sorted(nodes)), tuple(rels[i] for i in sorted(rels)), enums)

    def with_enum(self, name: str, values: list[str]) -> Graph:
        return replace(self, enums={**self.enums, name: tuple(values)})

    def dump(self) -> DataFrame:
        """(statement): the graph as query text, one statement a node and one a relationship; ids are kept in a property of their own."""
        def pairs(t: DataFrame, skip: tuple[str, ...]) -> Column:
            own = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"`{c}`: "), _written(t, c))) for c in t.columns if c not in skip]
            return F.concat_ws(", ", F.lit(None).cast("string"), *own)

        out = []
        for k, t in self.nodes.items():
            names = "".join(f":`{x}`" for x in k.split(":") if x)
            out.append(t.select(F.lit(0).alias("turn"), F.format_string(f"CREATE ({names.replace('%', '%%')}:`__dump` {{`__id`: %d, %s}});", F.col("id"), pairs(t, ("id", "labels"))).alias("statement")))
        for r in self.rels:
            out.append(r.table.select(F.lit(1).alias("turn"), F.format_string(f"MATCH (u:`__dump`), (v:`__dump`) WHERE u.`__id` = %d AND v.`__id` = %d CREATE (u)-[:`{r.type}` {{%s}}]->(v);", F.col("src"), F.col("dst"), pairs(r.table, ("id", "src", "dst", "type"))).alias("statement")))
        if not out:
            return self.spark.createDataFrame([], "statement string")
        every = out[0]
        for one in out[1:]:
            every = every.unionByName(one)
        return every.orderBy("turn", "statement").select(F.regexp_replace("statement", r", \}", "}").alias("statement"))

    def schema_info(self) -> DataFrame:
        """kind, name, properties, n for each label and relationship table."""
        out = None
        if not self.nodes and not self.rels:
            return self.spark.createDataFrame([], "kind string, name string, properties string, n bigint")
        for kind, name, t in [*(("node", k, t) for k, t in self.nodes.items()), *(("relationship", f"{r.source}-{r.type}-{r.target}", r.table) for r in self.rels)]:
            one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(",".join(sorted(t.columns))).alias("properties"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def violations(self, label: str, exists: str | None = None, unique: list[str] | None = None) -> DataFrame:
        """Rows against an existence or uniqueness constraint."""
        t = self.nodes[label]
        if exists:
            return t.where(F.col(exists).isNull())
        return t.dropna(subset=unique).groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")



def _stacked(tables: list[DataFrame]) -> DataFrame:
    """One below the other by names; a property that has several types becomes a double or a string."""
    types: dict[str, set[str]] = {}
    for t in tables:
        for c, kind in t.dtypes:
            if kind != "void":
                types.setdefault(c, set()).add(kind)
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    wide = {c: "double" if kinds & {"float", "double"} else "bigint" for c, kinds in types.items() if len(kinds) > 1 and kinds <= numbers}
    wide |= {c: "string" for c, kinds in types.items() if len(kinds) > 1 and not kinds <= numbers and not any(k.startswith(("array", "struct", "map")) for k in kinds)}
    out = None
    for t in tables:
        own = {c: F.col(f"`{c}`").cast(wide[c]) for c in t.columns if c in wide}
        one = t.withColumns(own) if own else t
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _written(table: DataFrame, column: str) -> Column:
    """A value as query text."""
    kind, c = dict(table.dtypes)[column], F.col(f"`{column}`")
    if kind == "string":
        return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    if kind == "date":
        return F.concat(F.lit("date('"), c.cast("string"), F.lit("')"))
    if kind.startswith("timestamp"):
        return F.concat(F.lit("localDateTime('"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("')"))
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    return c.cast("string")


_STEP = 1_000_000_000_000
LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Order")


def from_star_schema(spark: SparkSession, sf_dir: str) -> Graph:
    """The trade tables as a graph; an id is the label's number times 10^12 plus the key."""
    @functools.cache  # a table's footer is read once for all its labels and relationships
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def gid(label: str, key: str) -> Column:
        return (F.col(key).cast("bigint") + LABELS.index(label) * _STEP).alias("id")

    def nodes(table: str, label: str, key: str) -> DataFrame:
        df = read(table)
        prefix = key.split("_")[0] + "_"
        return df.select(gid(label, key), *[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns])

    def rel(table: str, src: tuple[str, str], dst: tuple[str, str], ident: Column, *props: Column) -> DataFrame:
        return read(table).where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull()).select(ident.cast("bigint").alias("id"), gid(*src).alias("src"), gid(*dst).alias("dst"), *props)

    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    facts = [F.col(f"l_{c}").alias(c) for c in ("linenumber", "quantity", "extendedprice", "discount", "returnflag", "shipdate")]
    return Graph(spark, {
        "Region": nodes("region", "Region", "r_regionkey"), "Nation": nodes("nation", "Nation", "n_nationkey"),
        "Customer": nodes("customer", "Customer", "c_custkey"), "Supplier": nodes("supplier", "Supplier", "s_suppkey"),
        "Part": nodes("part", "Part", "p_partkey"), "Order": nodes("orders", "Order", "o_orderkey"),
    }, (
        Rel("IN_REGION", "Nation", "Region", rel("nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), F.col("n_nationkey"))),
        Rel("IN_NATION", "Customer", "Nation", rel("customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), F.col("c_custkey") + _STEP)),
        Rel("IN_NATION", "Supplier", "Nation", rel("supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), F.col("s_suppkey") + 2 * _STEP)),
        Rel("PLACED", "Customer", "Order", rel("orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), F.col("o_orderkey") + 3 * _STEP)),
        Rel("CONTAINS", "Order", "Part", rel("lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), line + 4 * _STEP, *facts)),
        Rel("SUPPLIED_BY", "Part", "Supplier", rel("lineitem", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), line + 5 * _STEP, *facts)),
    ))
