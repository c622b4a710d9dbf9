"""Vertex programs as a loop of DataFrame plans.

``pregel`` takes the program as column expressions: all of a superstep is one join of senders and edges,
one pre-aggregated group by target and one join back. ``vertex_program`` takes a Python class instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .aggregators import Aggregator
from .storage import dealt, written


@dataclass
class Context:
    """What a superstep knows: its number, the vertices, and the last superstep's aggregates."""

    superstep: int
    num_vertices: int
    max_iterations: int
    aggregates: dict[str, Any] = field(default_factory=dict)


def merged_vertices(rows: DataFrame, self_edges: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of rows (id, edges array<struct<dst, weight>>): rows of one id become one vertex
    with all their edges; ``self_edges`` adds an edge without weight from each vertex to itself."""
    vertices = rows.select("id").distinct()
    edges = rows.select(F.col("id").alias("src"), F.explode("edges").alias("_e")).select("src", "_e.dst", "_e.weight")
    if self_edges:
        edges = edges.unionByName(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast(edges.schema["weight"].dataType).alias("weight")))
    return vertices, edges


def pregel(
    vertices: DataFrame,
    edges: DataFrame,
    *,
    compute: Callable[[Column, Column, Context], Column],
    message: Callable[[Column, Column], Column],
    combine: Callable[[Column], Column],
    send: Callable[[Column, Column, Context], Column] | None = None,
    halt: Callable[[Column, Column, Context], Column] | None = None,
    aggregators: dict[str, Aggregator] | None = None,
    until: Callable[[Context], bool] | None = None,
    max_iterations: int = -1,
    missing: str = "drop",
    checkpoint_every: int = 1,
    columns: list[str] | None = None,
    path: str | None = None,
    resume_at: int | None = None,
    laid_out: bool = False,
) -> DataFrame:
    """``vertices`` (id, value, more columns named in ``columns``) after the program has run.

    compute(value, message, context) gives the new value; in superstep 0 the message is the vertex's own
    value, later it is null where none came. message(value, weight) is what goes along an edge and combine
    reduces a target's messages. send(old, new, context) says which vertices that computed send (all by
    default); halt which go to sleep (none by default) until a message wakes them. The loop ends when all
    sleep and nothing was sent, when until(context) holds, or after superstep 0 and ``max_iterations`` more
    (-1: no limit). missing: 'drop' messages to ids that don't exist, or 'error'. The state is written to the
    shared folder every ``checkpoint_every`` supersteps; with a number over 1 the end is only looked for there.
    ``path``: keeps these states there; ``resume_at`` k goes on from the one that superstep k left. Edges are
    written once, in buckets by source, since each superstep reads them, unless they are ``laid_out`` in files already;
    with them states without a path lie in buckets by id, so that a superstep shuffles its messages alone.
    """
    if missing == "error":
        lost = edges.join(vertices.select(F.col("id").alias("dst")), "dst", "left_anti").select("dst").first()
        if lost is not None:
            raise ValueError(f"an edge leads to {lost[0]!r}, which is no vertex")
    extra = columns or []
    links = edges.select("src", "dst", "weight")
    links = links if laid_out else dealt(links, "edges", "src")
    context = Context(resume_at or 0, vertices.count(), max_iterations)
    old = F.col("value")
    state = vertices.select("id", "value", *extra).withColumns({"_halted": F.lit(False), "_sends": F.lit(False), "_old": old, "_ran": F.lit(True)})

    def ran(frame: DataFrame, incoming: Column, arrived: Column) -> DataFrame:
        active = ~F.col("_halted") | arrived
        new = compute(old, incoming, context)
        frame = frame.withColumns({"_ran": active, "_old": old, "_new": F.when(active, new).otherwise(old)})
        was, now = F.col("_old"), F.col("_new")
        sends = F.col("_ran") & (send(was, now, context) if send else F.lit(True))
        sleeps = F.when(F.col("_ran"), halt(was, now, context) if halt else F.lit(False)).otherwise(F.col("_halted"))
        return frame.withColumns({"_sends": F.coalesce(sends, F.lit(False)), "_halted": sleeps}).select("id", F.col("_new").alias("value"), *extra, "_halted", "_sends", "_old", "_ran")

    if resume_at is None:
        state = ran(state, old, F.lit(True))
    joins_kept = False
    while True:
        last = 0 <= max_iterations <= context.superstep
        if last or context.superstep % checkpoint_every == 0:
            place = f"{path.rstrip('/')}/superstep={context.superstep}" if path else None
            if place or laid_out:
                state = vertices.sparkSession.read.parquet(place) if context.superstep == resume_at else written(state, "vertices", place)
            else:
                # The join of the last superstep has left the rows dealt by id.
                state = dealt(state, "vertices", "id", together=joins_kept)
            joins_kept = not (place or laid_out)
            looks = [F.count_if(~F.col("_halted")).alias("_awake"), F.count_if(F.col("_sends")).alias("_sent")]
            looks += [a.column(F.when(F.col("_ran"), F.col("_old")), F.when(F.col("_ran"), old)).alias(n) for n, a in (aggregators or {}).items()]
            if last:
                break
            seen = state.agg(*looks).first().asDict()
            context.aggregates = {n: seen[n] for n in aggregators or {}}
            if (not seen["_awake"] and not seen["_sent"]) or (until is not None and until(context)):
                break
        context.superstep += 1
        out = state.filter("_sends").join(links, state["id"] == links["src"]).select("dst", message(old, F.col("weight")).alias("_m"))
        inbox = out.groupBy("dst").agg(combine(F.col("_m")).alias("_m"), F.lit(True).alias("_came"))
        joined = (state if laid_out else state.hint("merge")).join(inbox, state["id"] == inbox["dst"], "left")
        state = ran(joined, F.col("_m"), F.coalesce("_came", F.lit(False)))
    return state.select("id", "value", *extra)


class Vertex:
    """The base of a vertex program in Python: override ``compute``."""

    def __init__(self, key, value, edges, halted, superstep, num_vertices, aggregates):
        self.id, self.value, self.edges, self.halted = key, value, edges, halted
        self.superstep, self.num_vertices, self.aggregates = superstep, num_vertices, aggregates
        self.sent: list[tuple] = []
        self.added: list[tuple] = []
        self.gone = False
        self.given: list[tuple[str, float]] = []

    def setup(self) -> None:
        """Runs once, before superstep 0."""

    def compute(self, messages: list) -> None:
        raise NotImplementedError

    def send(self, target, message) -> None:
        self.sent.append((target, message))

    def send_to_neighbors(self, message) -> None:
        for target, _ in self.edges:
            self.send(target, message)

    def vote_to_halt(self) -> None:
        self.halted = True

    def add_vertex(self, key, value, edges=()) -> None:
        self.added.append((key, value, list(edges)))

    def remove(self) -> None:
        self.gone = True

    def aggregate(self, name: str, value: float) -> None:
        self.given.append((name, float(value)))


def vertex_program(vertices: DataFrame, program: type[Vertex], value_type: str, message_type: str, max_iterations: int = -1,
                   combine: Callable[[Column], Column] | None = None, reduce: dict[str, Callable[[Column], Column]] | None = None,
                   id_type: str = "string") -> DataFrame:
    """(id, value) after running ``program`` on ``vertices`` (id, value, edges array<struct<dst, weight>>).

    Rows with their messages stream through Python tasks. Vertices added or removed count from the next
    superstep; adding an id that exists is an error. ``reduce`` has an aggregate for each name that vertices
    give values to. Without ``combine`` a vertex gets all messages in one list, so programs with very many
    messages to one vertex should combine.
    """
    edge = f"array<struct<dst:{id_type},weight:double>>"
    made = StructType.fromDDL(f"kind string, id {id_type}, value {value_type}, edges {edge}, halted boolean, message {message_type}, amount double, key string")
    state = vertices.select(F.col("id").cast(id_type).alias("id"), F.col("value").cast(value_type).alias("value"), F.col("edges").cast(edge).alias("edges"), F.lit(False).alias("halted"))
    state = written(state, "vertices")
    inbox, aggregates, step = None, {}, 0
    while True:
        n = state.count()
        if inbox is None:
            rows = state.withColumns({"messages": F.array(F.lit(None).cast(message_type)), "came": F.lit(True)})
        else:
            rows = state.join(inbox, "id", "left").withColumn("came", F.col("messages").isNotNull())
        number, seen = step, dict(aggregates)

        def run(batches, number=number, n=n, seen=seen):
            import pandas as pd

            for frame in batches:
                out = []
                for r in frame.itertuples(index=False):
                    edges = [(e["dst"], e["weight"]) for e in (r.edges if r.edges is not None else [])]
                    value = None if r.value is None or r.value != r.value else r.value
                    v = program(r.id, value, edges, bool(r.halted), number, n, seen)
                    if not r.halted or r.came:
                        v.halted = False
                        if number == 0:
                            v.setup()
                            v.compute([v.value])
                        else:
                            v.compute(list(r.messages) if r.messages is not None else [])
                    if not v.gone:
                        out.append(("state", v.id, v.value, [{"dst": d, "weight": w} for d, w in v.edges], v.halted, None, None, None))
                    out += [("message", d, None, None, None, m, None, None) for d, m in v.sent]
                    out += [("add", k, x, [{"dst": d, "weight": w} for d, w in e], False, None, None, None) for k, x, e in v.added]
                    out += [("give", None, None, None, None, None, a, name) for name, a in v.given]
                yield pd.DataFrame(out, columns=made.names).astype(object)

        result = written(rows.select("id", "value", "edges", "halted", "messages", "came").mapInPandas(run, made), "superstep")
        fields = ["id", "value", "edges", "halted"]
        kept, added = result.filter("kind = 'state'").select(*fields), result.filter("kind = 'add'").select(*fields)
        if added.groupBy("id").count().filter("count > 1").unionByName(added.join(kept, "id", "left_semi").select("id", F.lit(1).cast("long").alias("count"))).first() is not None:
            raise ValueError("a vertex that exists already was added")
        state = written(kept.unionByName(added), "vertices")
        sent = result.filter("kind = 'message'")
        given = result.filter("kind = 'give'")
        aggregates = {r["key"]: r["x"] for name, f in (reduce or {}).items() for r in given.filter(F.col("key") == name).groupBy("key").agg(f(F.col("amount")).alias("x")).collect()}
        gathered = F.array(combine(F.col("message"))) if combine else F.collect_list("message")
        inbox = sent.groupBy("id").agg(gathered.alias("messages"))
        awake = state.filter("not halted").limit(1).count() + sent.limit(1).count()
        if not awake or 0 <= max_iterations <= step:
            return state.select("id", "value")
        step += 1
