"""Streams into a graph: each micro-batch goes through a transformation and is appended as Parquet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Starts the stream; without an interval it takes what there is and ends. A batch that is written again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def changes(old: DataFrame, new: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a trigger sees: created, deleted and updated rows."""
    created, deleted = new.join(old.select(key), key, "left_anti"), old.join(new.select(key), key, "left_anti")
    return created, deleted, new.exceptAll(old).join(created.select(key), key, "left_anti")


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per window and kind, for batches and for streams."""
    grouped = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.window("ts", every), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Events per user and session: a session ends after a gap without events."""
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = stamped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


class Streams:
    """Named streams into one graph: each micro-batch of messages becomes rows of (query, parameters), which are run one after the other.

    A transformation gets a batch and gives a DataFrame with a column query and any parameter columns; the batch's statements are replayed in order on the
    driver, as each may read what the one before wrote. Batches are bounded by the source's own options (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """

    def __init__(self, graph: Graph, folder: str) -> None:
        self.graph, self.folder = graph, folder
        self.known: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame], str | None]] = {}
        self.running: dict[str, StreamingQuery] = {}

    def create(self, name: str, stream: DataFrame, transform: Callable[[DataFrame], DataFrame], interval: str | None = None) -> None:
        if name in self.known:
            raise ValueError(f"the stream {name} exists already")
        self.known[name] = (stream, transform, interval)

    def _apply(self, rows: DataFrame) -> None:
        from ..plans import run_update

        for r in rows.collect():  # one micro-batch of statements
            self.graph = run_update(self.graph, r["query"], **{k: v for k, v in r.asDict(True).items() if k != "query"})

    def start(self, name: str) -> StreamingQuery:
        stream, transform, interval = self.known[name]
        if name in self.running and self.running[name].isActive:
            raise ValueError(f"the stream {name} runs already")
        writer = stream.writeStream.foreachBatch(lambda batch, _: self._apply(transform(batch))).option("checkpointLocation", f"{self.folder}/{name}")
        self.running[name] = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        return self.running[name]

    def start_all(self) -> None:
        for name in self.known:
            if name not in self.running or not self.running[name].isActive:
                self.start(name)

    def stop(self, name: str) -> None:
        self.running.pop(name).stop()

    def stop_all(self) -> None:
        for name in list(self.running):
            self.stop(name)

    def drop(self, name: str) -> None:
        if name in self.running:
            self.stop(name)
        del self.known[name]

    def check(self, name: str, batch: DataFrame, limit: int = 1) -> DataFrame:
        """What the transformation makes of the first messages of a batch; nothing is run."""
        return self.known[name][1](batch.limit(limit))

    def show(self) -> DataFrame:
        rows = [(k, v[2] or "once", k in self.running and self.running[k].isActive) for k, v in self.known.items()]
        return self.graph.spark.createDataFrame(rows, "name string, batch_interval string, is_running boolean")


#: Events that a trigger can wait for: kind of object and of change.
EVENTS = {f"{obj} {change}".strip() for obj in ("", "()", "-->") for change in ("CREATE", "UPDATE", "DELETE")} | {"ANY"}


class Triggers:
    """Actions on changes of a graph: each gets the tables of what was created, deleted and updated, as createdVertices, deletedEdges and so on."""

    def __init__(self) -> None:
        self.actions: dict[str, tuple[str, str, Callable[..., Graph | None]]] = {}

    def create(self, name: str, on: str, action: Callable[..., Graph | None], phase: str = "AFTER COMMIT") -> None:
        if on not in EVENTS or phase not in ("BEFORE COMMIT", "AFTER COMMIT"):
            raise ValueError(f"no event {on} {phase}")
        self.actions[name] = (on, phase, action)

    def drop(self, name: str) -> None:
        del self.actions[name]

    def show(self, graph: Graph) -> DataFrame:
        return graph.spark.createDataFrame([(k, on, phase) for k, (on, phase, _) in self.actions.items()], "trigger_name string, event_type string, phase string")

    @staticmethod
    def variables(old: Graph, new: Graph) -> dict[str, DataFrame]:
        """What changed between two graphs, by rows: only tables that are not the same are compared."""
        out: dict[str, DataFrame] = {}
        for kind, before, after in (("Vertices", old.node_table(), new.node_table()), ("Edges", old.rel_table(), new.rel_table())):
            shared = [c for c in after.columns if c in before.columns]
            created, deleted = after.join(before.select("id"), "id", "left_anti"), before.join(after.select("id"), "id", "left_anti")
            moved = after.select(*shared).exceptAll(before.select(*shared)).select("id")
            grown = [c for c in after.columns if c not in before.columns]
            for c in grown:
                moved = moved.unionByName(after.where(F.col(f"`{c}`").isNotNull()).select("id"))
            gone = [c for c in before.columns if c not in after.columns]
            for c in gone:
                moved = moved.unionByName(before.where(F.col(f"`{c}`").isNotNull()).select("id"))
            updated = after.join(moved.distinct(), "id", "left_semi").join(created.select("id"), "id", "left_anti")
            out |= {f"created{kind}": created, f"deleted{kind}": deleted, f"updated{kind}": updated}
        before, after = old.node_table().select("id", F.col("labels").alias("old")), new.node_table().select("id", "labels")
        met = before.join(after, "id")
        out["setVertexLabels"] = met.select("id", F.explode(F.array_except("labels", "old")).alias("label"))
        out["removedVertexLabels"] = met.select("id", F.explode(F.array_except("old", "labels")).alias("label"))
        return out

    def commit(self, old: Graph, new: Graph) -> Graph:
        """Runs the actions whose events happened; an action before the commit may give the graph that is committed."""
        found = self.variables(old, new)
        names = {"CREATE": "created", "DELETE": "deleted", "UPDATE": "updated"}
        graph = new
        for phase in ("BEFORE COMMIT", "AFTER COMMIT"):
            for on, own, action in self.actions.values():
                if own != phase:
                    continue
                obj, change = ("", on) if " " not in on else on.split(" ", 1)
                kinds = {"": ("Vertices", "Edges"), "()": ("Vertices",), "-->": ("Edges",)}[obj]
                changes_ = names.values() if change == "ANY" else (names[change],)
                if any(not found[f"{c}{k}"].isEmpty() for c in changes_ for k in kinds):
                    given = action(graph, **found)
                    graph = given if given is not None and phase == "BEFORE COMMIT" else graph
        return graph


def expired(graph: Graph, now: int, label: str | None = None, column: str = "ttl") -> Graph:
    """The graph without nodes whose time to live (microseconds since 1970 in a property) is over, and without their relationships; relationships likewise."""
    from ..operators.rewrite import delete_nodes

    due = None
    for key, table in graph.nodes.items():
        if column in table.columns and (label is None or label in key.split(":")):
            one = table.where(F.col(f"`{column}`") <= now).select(F.col("id").alias("source"))
            due = one if due is None else due.unionByName(one)
    rels = tuple(replace(r, table=r.table.where(F.coalesce(F.col(f"`{column}`") > now, F.lit(True)))) if column in r.table.columns else r for r in graph.rels)
    graph = replace(graph, rels=rels)
    return graph if due is None else delete_nodes(graph, due)[0]
