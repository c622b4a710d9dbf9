"""Graph algorithms over vertices (id, ...) and edges (src, dst, weight)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.aggregators import ABS_DIFF, LEGACY_ABS_DIFF, Aggregator
from ..plans.pregel import Context, Vertex, pregel, vertex_program
from ..plans.storage import written


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30, eps: float | None = 0.001,
             legacy_error: bool = False, self_edges: bool = True, checkpoint_every: int = 5, path: str | None = None, resume_at: int | None = None) -> DataFrame:
    """(id, value): 1/N at first, then (1-d)/N + d * sum of rank/out-degree over in-edges, ``rounds`` times
    or, from the third round, until the mean change is under ``eps`` (None: a fixed number of rounds, with
    no look at the ranks in between). Self edges keep the rank of vertices without out-edges."""
    vertices = written(vertices.select("id"), "ids")
    links = edges.select("src", "dst")
    if self_edges:
        links = links.unionByName(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    links = written(links, "links")
    degree = links.groupBy("src").agg(F.count("*").alias("_d"))
    # The share that goes along an edge is fixed: it is the edge's weight.
    weighted = links.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("_d")).alias("weight"))
    change = LEGACY_ABS_DIFF if legacy_error else ABS_DIFF
    n = vertices.count()
    start = vertices.select("id", F.lit(1.0 / max(n, 1)).alias("value"))

    def compute(value: Column, message: Column, c: Context) -> Column:
        return value if c.superstep == 0 else F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce(message, F.lit(0.0))

    return pregel(
        start, weighted, compute=compute, message=lambda v, w: v * w, combine=F.sum, max_iterations=rounds,
        aggregators={"error": Aggregator(lambda old, new: change.column(old, new) / max(n, 1))} if eps is not None else None,
        until=(lambda c: c.superstep > 2 and c.aggregates["error"] < eps) if eps is not None else None,
        checkpoint_every=1 if eps is not None else checkpoint_every, path=path, resume_at=resume_at,
    )


UNREACHED = 2147483647


def shortest_paths(vertices: DataFrame, edges: DataFrame, start, unreached: int | None = UNREACHED, max_iterations: int = -1) -> DataFrame:
    """(id, value): the least sum of weights from ``start``; only vertices whose distance fell send again."""
    far = 1 << 60
    begin = vertices.select("id", F.when(F.col("id") == start, F.lit(0)).otherwise(F.lit(far)).cast("long").alias("value"))
    out = pregel(
        begin, edges,
        compute=lambda v, m, c: F.least(v, m),
        message=lambda v, w: v + w.cast("long"), combine=F.min,
        send=lambda old, new, c: new < far if c.superstep == 0 else new < old,
        halt=lambda old, new, c: F.lit(True), max_iterations=max_iterations,
    )
    return out.select("id", F.when(F.col("value") < far, F.col("value")).otherwise(F.lit(unreached)).alias("value"))


def components(vertices: DataFrame, edges: DataFrame, undirected: bool = False, max_iterations: int = 30) -> DataFrame:
    """(id, value): the least id among a vertex, its out-neighbours and those that reach it along edges; where edges
    count both ways, the least of the whole component, by contraction in a few rounds whatever its diameter."""
    if undirected:
        ids = vertices.select("id").distinct()
        known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
        roots = connected(known)
        return ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("value"))
    links = edges.select("src", "dst", "weight")
    near = links.groupBy("src").agg(F.min("dst").alias("_m"))
    begin = vertices.join(near, vertices["id"] == near["src"], "left").select("id", F.least("id", "_m").alias("value"))
    return pregel(
        begin, links, compute=lambda v, m, c: F.least(v, m), message=lambda v, w: v, combine=F.min,
        send=lambda old, new, c: F.lit(True) if c.superstep == 0 else new < old,
        halt=lambda old, new, c: F.lit(True), max_iterations=max_iterations,
    )


#: Edges of 16 bytes that fit one task, as adaptive plans would merge them: their steps need no shuffles. More are dealt.
FEW_EDGES = 400_000


def _stars(most: int):
    """What edges (hi, lo) of whole numbers connect, ``most`` of a task's edges at a time or a batch: each node but the
    least of a component with that one. So many edges between few nodes become as few as the nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([edges.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while len(root) and ((up := root[root]) != root).any():
                root = up
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["hi", "lo"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if n and n + batch.num_rows > most:
                yield stars(held)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield stars(held)

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): the least node of each component. Where nodes are whole numbers each
    task first reduces its edges to stars; of few edges one task then makes the components. More go through large and
    small star steps until they are few or nothing changes. Each step groups by one end of pre-aggregated edges and is
    written to the shared folder."""
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo")
    whole = isinstance(now.schema["hi"].dataType, IntegralType)
    reduced = (lambda df: df.mapInArrow(_stars(FEW_EDGES), df.schema)) if whole else (lambda df: df)
    now = written(reduced(now).distinct(), "edges")
    few = now.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    if whole and not few:
        # The edges of a lower end come together, so a task leaves few of them.
        now = written(reduced(now.repartition("lo")).distinct(), "edges")
        few = now.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    mark = None
    while not (whole and few):
        # Large star: neighbours above a node go to the node's least neighbour.
        both = together(now).select(F.inline(F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), F.col("hi").alias("lo")))))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        # Small star: a node and its lower neighbours go to the least of these.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        now = written(together(small.unionByName(low.select("hi", F.col("m").alias("lo")))).distinct(), "edges")
        # A sum of hashes, folded to whole numbers that can't overflow.
        state = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31)))).first())
        if state == mark:
            break
        mark = state
        if whole and state[0] <= FEW_EDGES:
            few, together = True, lambda df: df.coalesce(1)
    if whole and few:
        now = written(reduced(together(now)), "edges")
    least = together(now).select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return written(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(least), "components")


def in_links(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value): in-edges of each vertex."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"))
    return vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("value"))


def bipartite_matching(vertices: DataFrame, edges: DataFrame, seed: int = 1, max_rounds: int = 30) -> DataFrame:
    """(id, side, value): a maximal matching between sides L and R; value is the partner or null.

    A round: each free left vertex asks its neighbours, each free right one grants one request, each left one
    accepts one grant. Choices are by seeded hash, so a run can be repeated. It ends when no free pair is
    joined by an edge, or after ``max_rounds`` such rounds."""
    sides = written(vertices.select("id", "side"), "sides")
    left = sides.filter("side = 'L'").select(F.col("id").alias("l"))
    right = sides.filter("side = 'R'").select(F.col("id").alias("r"))
    open_edges = edges.select(F.col("src").alias("l"), F.col("dst").alias("r")).join(left, "l", "left_semi").join(right, "r", "left_semi").distinct()
    open_edges = written(open_edges, "edges")
    matched = None
    for number in range(max_rounds):
        pick = lambda salt: F.xxhash64(F.lit(seed), F.lit(number), F.lit(salt), "l", "r")  # noqa: B023, E731
        grants = open_edges.groupBy("r").agg(F.min_by("l", F.struct(pick("grant"), "l")).alias("l"))
        accepted = written(grants.groupBy("l").agg(F.min_by("r", F.struct(pick("accept"), "r")).alias("r")), "accepted")
        matched = accepted if matched is None else matched.unionByName(accepted)
        open_edges = written(open_edges.join(accepted.select("l"), "l", "left_anti").join(accepted.select("r"), "r", "left_anti"), "edges")
        if not open_edges.limit(1).count():
            break
    both = matched.select(F.col("l").alias("id"), F.col("r").alias("value")).unionByName(matched.select(F.col("r").alias("id"), F.col("l").alias("value"))) if matched is not None else sides.select("id", F.col("id").alias("value")).limit(0)
    return sides.join(both, "id", "left").select("id", "side", "value")


class _Collapse(Vertex):
    """Adds a vertex "sum", gives it all values, and removes the rest."""

    def compute(self, messages):
        if self.superstep == 0:
            if self.id != "sum":
                self.aggregate("asked", 1)
        elif self.superstep == 1 and self.id != "sum":
            self.send("sum", self.value)
            self.remove()
        elif self.superstep >= 2 and self.id == "sum":
            self.value = sum(messages) + self.num_vertices
            self.vote_to_halt()


def dynamic_sum(vertices: DataFrame) -> DataFrame:
    """(id, value): the one vertex that is left, ``sum``: all values plus the vertices alive then."""
    spark = vertices.sparkSession
    held = vertices.select(F.col("id").cast("string").alias("id"), F.col("value").cast("long").alias("value"), F.array().cast("array<struct<dst:string,weight:double>>").alias("edges"))
    added = held.unionByName(spark.createDataFrame([("sum", 0, [])], held.schema))
    return vertex_program(added, _Collapse, "long", "long", max_iterations=3, combine=F.sum)


def semi_clusters(vertices: DataFrame, edges: DataFrame, max_clusters: int = 10, max_sent: int = 10, max_size: int = 10,
                  boundary: float = 0.0, rounds: int = 10) -> DataFrame:
    """(id, cluster, members, score): the best clusters that hold each vertex.

    A cluster's score is (inner - boundary * crossing weight) / (V (V-1) / 2), 1 for one member. Each round
    vertices send their best ``max_sent`` clusters to neighbours, which join those that have room and keep
    the best ``max_clusters`` that hold them, by score, then size, then name. Each edge counts once."""
    both = edges.select("src", "dst", "weight").filter("src <> dst")
    links = written(both.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight")), "links")
    sym = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    sym = written(sym, "edges")
    near = sym.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("_near"), F.sum("weight").alias("_all"))
    # What a cluster keeps: members, the weight inside it and the weight that leaves it.
    known = vertices.select("id").distinct().join(near, "id", "left").select("id", F.coalesce("_near", F.map_from_arrays(F.array(), F.array()).cast("map<string,double>")).alias("_near"), F.coalesce("_all", F.lit(0.0)).alias("_all"))
    known = written(known, "near")
    n = F.size("members")
    score = F.when(n > 1, (F.col("inner") - boundary * F.col("outer")) / (n * (n - 1) / 2)).otherwise(F.lit(1.0))
    name = F.concat(F.lit("C"), F.sha2(F.array_join("members", "\x01"), 256))
    fields = ["id", "members", "inner", "outer"]
    state = known.select("id", F.array("id").alias("members"), F.lit(0.0).alias("inner"), F.col("_all").alias("outer"))

    def best(frame: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("id").orderBy(F.round(score, 9).desc(), n.desc(), name)
        return frame.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).select(*fields)

    state = written(state, "clusters")
    mark = None
    for _ in range(rounds):
        sent = best(state, max_sent).join(sym, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "members", "inner", "outer").distinct()
        met = sent.join(known, "id").filter(~F.array_contains("members", F.col("id")) & (F.size("members") < max_size))
        gain = F.aggregate("members", F.lit(0.0), lambda s, m: s + F.coalesce(F.element_at("_near", m), F.lit(0.0)))
        grown = met.select("id", F.array_sort(F.array_append("members", F.col("id"))).alias("members"), (F.col("inner") + gain).alias("inner"), (F.col("outer") - gain + F.col("_all") - gain).alias("outer"))
        back = sent.filter(F.array_contains("members", F.col("id"))).select(*fields)
        merged = state.unionByName(grown).unionByName(back).dropDuplicates(["id", "members"])
        state = written(best(merged, max_clusters), "clusters")
        seen = state.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("id", "members"), F.lit(1 << 31)))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return state.select("id", name.alias("cluster"), "members", score.alias("score"))


def estimate_pi(spark: SparkSession, peers: int = 8, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """(value): the mean over peers of 4 times the share of points inside the quarter circle."""
    points = spark.range(peers * draws, numPartitions=peers).withColumn("peer", F.expr(f"id div {draws}"))
    points = points.withColumn("_in", (F.sqrt(F.pow(F.rand(seed), 2) + F.pow(F.rand(seed + 1), 2)) < 1).cast("double"))
    each = points.groupBy("peer").agg((4.0 * F.avg("_in")).alias("_v"))
    return each.agg(F.avg("_v").alias("value"))


def combiner_demo(spark: SparkSession, peers: int, values: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(sender, receiver, value): each sends all values to each; the sum combiner leaves one message a pair."""
    to = spark.range(peers).select(F.col("id").alias("sender"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(peers - 1).cast("long"))).alias("receiver"))
    return to.withColumn("v", F.explode(F.array(*[F.lit(v) for v in values]))).groupBy("sender", "receiver").agg(F.sum("v").alias("value"))


def random_graph(spark: SparkSession, size: int, degree: int, seed: int = 1) -> DataFrame:
    """(id, adj): each of ``size`` vertices with up to ``degree`` distinct targets."""
    draws = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(size))))
    return spark.range(size).select(F.col("id").cast("string").alias("id"), F.transform(draws, lambda x: x.cast("string")).alias("adj"))


def random_symmetric_matrix(spark: SparkSession, size: int, density: float, seed: int = 1) -> DataFrame:
    """Cells (i, j, x) of a symmetric 0/1 matrix. Each row draws as many cells right of its diagonal, itself
    included, as its length asks for; what is drawn twice counts once, so draws are a little more than cells."""
    wanted = F.round((size - F.col("i")) * F.lit(-math.log1p(-min(density, 0.999)))).cast("int")
    rows = spark.range(size).select(F.col("id").alias("i")).withColumn("_n", wanted).filter("_n > 0")
    drawn = rows.select("i", F.explode(F.sequence(F.lit(1), "_n")).alias("_k")).select("i", (F.col("i") + F.pmod(F.xxhash64(F.lit(seed), "i", "_k"), size - F.col("i"))).alias("j"))
    upper = drawn.distinct().withColumn("x", F.lit(1.0))
    return upper.unionByName(upper.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "x"))


def random_vectors(spark: SparkSession, rows: int, columns: int, seed: int = 1) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("row"), F.array(*[F.rand(seed + j) for j in range(columns)]).alias("vec"))
