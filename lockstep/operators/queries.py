"""The engine's operators on the test tables, each with its SQL.

Graphs: nations that trade (customer's nation to supplier's nation, weight the orders' count), suppliers
and the parts they sell, and orders in a row that are chained where one is in state P.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..functions import vectors as V
from ..plans import bsp
from ..plans.aggregators import ABS_DIFF, AVERAGE_CHANGE, COUNT, MAX, MIN, SUM
from ..plans.pregel import pregel
from ..plans.storage import shared_dir, written
from ..sources import text as T
from . import exchange, graph, joins, learning


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and an edge from each customer's nation to each supplier's with the lines between them.

    Lines are counted by customer and supplier keys' nations through the two key joins; the nation side
    of each join is small and Spark broadcasts it by its size."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src")
    sold = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "dst")
    edges = sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), edges


_TRADE = """trade AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def _sales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers (below 0: -1 - key) and suppliers, linked both ways where one bought from the other."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((-1 - F.col("o_custkey")).alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    pairs = written(pairs, "pairs")  # read for vertices and for both ways
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1).cast("long"))
    return edges.select(F.col("src").alias("id")).distinct(), edges


_SALES = """pairs AS (SELECT DISTINCT -1 - o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), vertices AS (SELECT DISTINCT src AS id FROM edges)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    after = orders.select((F.col("id")).alias("dst"))
    step = orders.filter("o_orderstatus = 'P'").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(after, "dst", "left_semi").select("src", "dst")
    both = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return orders.select("id"), both.withColumn("weight", F.lit(1).cast("long"))


_CHAIN = """step AS (SELECT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderstatus = 'P'),
edges AS (SELECT src, dst FROM step UNION ALL SELECT dst, src FROM step)"""


def _pagerank_sql(base: str, vertices: str, edges: str, rounds: int, digits: int) -> str:
    out = f"WITH {base}, links AS (SELECT src, dst FROM {edges} UNION ALL SELECT id, id FROM {vertices}), degree AS (SELECT src, count(*) AS d FROM links GROUP BY src), n AS (SELECT count(*) AS n FROM {vertices}),\nr0 AS (SELECT id, 1.0::DOUBLE / n AS value FROM {vertices}, n)"
    for k in range(rounds):
        out += f",\nr{k + 1} AS (SELECT v.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(m.s, 0) AS value FROM {vertices} v CROSS JOIN n LEFT JOIN (SELECT l.dst, sum(r.value * (1.0::DOUBLE / d.d)) AS s FROM links l JOIN r{k} r ON r.id = l.src JOIN degree d ON d.src = l.src GROUP BY l.dst) m ON m.dst = v.id)"
    return out + f"\nSELECT id, round(value, {digits}) AS rank FROM r{rounds}"


def pagerank_trade(spark, sf_dir):
    vertices, edges = _trade(spark, sf_dir)
    return graph.pagerank(vertices, edges, rounds=10, eps=None).select("id", F.round("value", 9).alias("rank"))


def pagerank_sales(spark, sf_dir):
    vertices, edges = _sales(spark, sf_dir)
    return graph.pagerank(vertices, edges, rounds=10, eps=None).select("id", F.round("value", 9).alias("rank"))


def shortest_paths_trade(spark, sf_dir):
    vertices, edges = _trade(spark, sf_dir)
    return graph.shortest_paths(vertices, edges, 0).select("id", F.col("value").alias("distance"))


def shortest_paths_chain(spark, sf_dir):
    vertices, edges = _chain(spark, sf_dir)
    return graph.shortest_paths(vertices, edges, 5).select("id", F.col("value").alias("distance"))


def components_chain(spark, sf_dir):
    vertices, edges = _chain(spark, sf_dir)
    return graph.components(vertices, edges, undirected=True).select("id", F.col("value").alias("component"))


def components_directed(spark, sf_dir):
    """As above, along edges in both directions by the vertex loop."""
    vertices, edges = _chain(spark, sf_dir)
    return graph.components(vertices, edges, max_iterations=-1).select("id", F.col("value").alias("component"))


def pagerank_resumed(spark, sf_dir):
    """Four rounds of PageRank whose last two are run again from what the second left."""
    vertices, edges = _trade(spark, sf_dir)
    path = f"{shared_dir(spark)}/pagerank-{uuid.uuid4().hex}"
    graph.pagerank(vertices, edges, rounds=4, eps=None, checkpoint_every=1, path=path)
    return graph.pagerank(vertices, edges, rounds=4, eps=None, checkpoint_every=1, path=f"{path}/", resume_at=2).select("id", F.round("value", 9).alias("rank"))


def in_links_sales(spark, sf_dir):
    vertices, edges = _sales(spark, sf_dir)
    return graph.in_links(vertices, edges).select("id", F.col("value").alias("links"))


def matching_size(spark, sf_dir):
    """A matching of customers and suppliers: edges left between free ends, ends matched twice, pairs that are no
    edge, partners that don't agree, and whether it is of half the smaller side's size at least."""
    _, edges = _sales(spark, sf_dir)
    pairs = written(edges.filter("src < 0").select("src", "dst", "weight"), "pairs")
    sides = pairs.select(F.col("src").alias("id"), F.lit("L").alias("side")).unionByName(pairs.select(F.col("dst").alias("id"), F.lit("R").alias("side"))).distinct()
    got = written(graph.bipartite_matching(sides, pairs), "matching")
    free, held = got.filter("value is null").select("id"), got.filter("value is not null")
    open_pairs = pairs.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_semi")
    left = held.filter("side = 'L'").select(F.col("id").alias("src"), F.col("value").alias("dst"))
    back = held.filter("side = 'R'").select(F.col("value").alias("src"), F.col("id").alias("dst"))
    counts = {
        "open_pairs": open_pairs, "twice_matched": held.groupBy("value").count().filter("count > 1"), "no_edges": left.join(pairs, ["src", "dst"], "left_anti"),
        "one_sided": left.join(back, ["src", "dst"], "left_anti").unionByName(back.join(left, ["src", "dst"], "left_anti")),
    }
    size, least = left.count(), min(r["count"] for r in sides.groupBy("side").count().collect())
    return spark.createDataFrame([(*[f.count() for f in counts.values()], 2 * size >= least)], ", ".join(f"{n} long" for n in counts) + ", large boolean")


def semi_clusters_trade(spark, sf_dir):
    vertices, edges = _trade(spark, sf_dir)
    named = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
    return graph.semi_clusters(vertices.select(F.col("id").cast("string").alias("id")), named, max_size=4, rounds=4).select("id", "cluster", F.array_join("members", ",").alias("members"), "score")


def dynamic_sum_orders(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_custkey").alias("value"))
    return graph.dynamic_sum(rows)


def sender_combine(spark, sf_dir):
    """Messages from suppliers to parts, combined by target: sum, least and greatest."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("m"))
    return exchange.combined(rows, ["dst"], "m", {"total": F.sum, "least": F.min, "most": F.max})


def combine_text_min(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("m"))
    return exchange.combined(rows, ["o_custkey"], "m", F.min)


def superstep_aggregates(spark, sf_dir):
    """What all aggregators know after a superstep that takes a tenth off each order's price."""
    vertices = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    edges = vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1).alias("weight")).limit(0)
    seen = {}

    def until(c):
        seen.update(c.aggregates)
        return c.superstep == 1

    held = {"total": SUM, "least": MIN, "most": MAX, "vertices": COUNT, "change": ABS_DIFF, "average_change": AVERAGE_CHANGE}
    pregel(vertices, edges, compute=lambda v, m, c: v if c.superstep == 0 else v * 0.9, message=lambda v, w: v, combine=F.sum, aggregators=held, until=until)
    names = ["total", "least", "most", "change", "average_change"]
    return spark.createDataFrame([(*[round(float(seen[n]), 2) for n in names], seen["vertices"])], ", ".join(f"{n} double" for n in names) + ", vertices long")


def _two(spark, sf_dir):
    """Documents' lengths and labels' qualities by document; labels cover some documents."""
    a = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v"))
    b = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.col("quality").cast("long").alias("v"))
    return a, b


_TWO = "a AS (SELECT doc_id AS k, n_chars AS v FROM documents), b AS (SELECT doc_id AS k, CAST(quality AS BIGINT) AS v FROM labels)"


def join_inner(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return joins.compose("inner", a, b, key="k").select("k", F.col("_0.v").alias("v0"), F.col("_1.v").alias("v1"))


def join_outer(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return joins.compose("outer", a, b, key="k").select("k", F.col("_0.v").alias("v0"), F.col("_1.v").alias("v1"), "has_0", "has_1")


def join_override(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return joins.compose("override", a, b, key="k").select("k", "v")


def join_nested(spark, sf_dir):
    """override(a, inner(b, vectors))."""
    a, b = _two(spark, sf_dir)
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "label")
    return joins.compose("override", a, joins.compose("inner", b, vectors, key="k").select("k", F.col("_0.v").alias("v")), key="k")


def join_choosing(spark, sf_dir):
    """A user's operator: keys that one input alone has, with that input's value."""
    a, b = _two(spark, sf_dir)
    joins.define("either", joins.choosing(lambda v, has: F.when(has[0] & ~has[1], v[0]["v"]).when(has[1] & ~has[0], v[1]["v"])))
    return joins.compose("either", a, b, key="k").filter("value is not null").select("k", "value")


def join_where(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return joins.joined_where(lambda has: has[0] & ~has[1])(a, b, key="k").select("k", F.col("_0.v").alias("v"))


def feature_lookup(spark, sf_dir):
    asked = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return joins.lookup(asked, _t(spark, sf_dir, "part").filter("p_size > 20").select("p_partkey", "p_brand"), "p_partkey")


def key_value_text(spark, sf_dir):
    """Order lines as text, parsed back; keys without a separator give an empty value."""
    text = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus")).alias("value"))
    return T.key_values(text)


def vector_text(spark, sf_dir):
    text = _t(spark, sf_dir, "lineitem").select(F.concat(F.col("l_quantity").cast("int"), F.lit(">"), F.col("l_linenumber"), F.lit(" "), F.col("l_orderkey")).alias("value"))
    return T.labelled_vectors(text).select("label", F.get("vec", 0).alias("x0"), F.get("vec", 1).alias("x1"))


def adjacency_text(spark, sf_dir):
    """The trade graph as weighted adjacency lines, parsed back and merged."""
    _, edges = _trade(spark, sf_dir)
    lines = edges.groupBy("src").agg(F.concat_ws("\t", F.first(F.col("src").cast("string")), F.array_join(F.collect_list(F.concat_ws(":", F.col("dst").cast("string"), F.col("weight").cast("string"))), "\t")).alias("value"))
    return T.weighted_adjacency(lines.select("value")).select("id", F.explode("edges").alias("e")).select(F.col("id").alias("src"), "e.dst", "e.weight")


def partition_owner(spark, sf_dir):
    """Rows of each peer when orders are dealt by customer."""
    rows = exchange.by_function(_t(spark, sf_dir, "orders"), 6, F.col("o_custkey"))
    return rows.groupBy("peer").agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("keys"))


def sort_within(spark, sf_dir):
    """Neighbours in sorted partitions that are out of order: none, and all rows are there."""
    rows = exchange.sorted_partitions(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 6, "o_custkey", lambda c: c % 97)

    def look(batches):
        import pandas as pd

        last = None
        for f in batches:
            route = [x % 97 for x in f["o_custkey"]]
            bad = sum(a > b for a, b in zip([route[0] if last is None else last, *route], route, strict=False))
            last = route[-1]
            yield pd.DataFrame({"n": [len(f)], "bad": [bad]})

    return rows.mapInPandas(look, "n long, bad long").agg(F.sum("n").alias("rows"), F.sum("bad").alias("out_of_order"))


def superstep_sums(spark, sf_dir):
    """A two-step program: peers sum their rows and send the sums to peer 0, which writes the total."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("x"))

    def gather(peer):
        n = total = 0
        for r in peer.rows():
            n += 1
            total += r["x"]
        peer.increment("rows", n)
        peer.send(0, float(total))

    def finish(peer):
        got = list(peer.messages())
        if got:
            peer.write(len(got), float(sum(got)))

    return bsp.run_supersteps(spark, [gather, finish], 4, "double", "messages long, total double", rows)[0]


def combiner_pairs(spark, sf_dir):
    return graph.combiner_demo(spark, 5)


def vector_algebra(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _t(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", v.alias("v"))
    a = F.col("v")
    b = V.subtract(V.multiply(a, 2.0), 0.5)
    return rows.select(
        "vec_id", F.round(V.total(a), 6).alias("total"), F.round(V.dot(a, b), 6).alias("dot"), F.round(V.maximum(a), 6).alias("most"), F.round(V.minimum(a), 6).alias("least"),
        V.max_index(a).alias("at_most"), F.round(V.euclidean(a, b), 6).alias("euclidean"), F.round(V.total(V.absolute(V.part(a, 2, 5))), 6).alias("part_total"),
    )


def sparse_matrix_vector(spark, sf_dir):
    """Quantities of suppliers (rows) and nations of customers (columns) times the columns' numbers plus 1."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    cells = joined.groupBy(F.col("l_suppkey").alias("i"), F.col("c_nationkey").cast("long").alias("j")).agg(F.sum("l_quantity").alias("x"))
    v = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("j"), (F.col("n_nationkey") + 1.0).alias("x"))
    return M.multiply_vector(cells, v)


def matrix_product(spark, sf_dir):
    """The trade graph's weights squared as a matrix: paths of two steps."""
    _, edges = _trade(spark, sf_dir)
    cells = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").cast("double").alias("x"))
    return M.multiply(cells, M.transpose(cells))


def matrix_cells(spark, sf_dir):
    _, edges = _trade(spark, sf_dir)
    a = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").cast("double").alias("x"))
    return M.subtract(M.map_cells(a, lambda x: x * 2), M.transpose(a.filter("x > 50")))


_CENTRES = [[0.0, 0.0], [25.0, 0.05], [50.0, 0.1]]


def kmeans_rounds(spark, sf_dir):
    """Three centres of (quantity, discount) after three rounds, and their rows."""
    rows = _t(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_discount")).alias("vec"))
    centres = learning.kmeans(rows, _CENTRES, max_iterations=2)
    sizes = learning.assigned(rows, centres).groupBy("centre").agg(F.count("*").alias("rows"))
    known = spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "centre int, x double, y double")
    return known.join(sizes, "centre", "left").select("centre", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _kmeans_sql() -> str:
    out = "WITH p AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), c0(centre, x, y) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(_CENTRES)) + ")"
    near = "(SELECT g.a, g.b, arg_min(c.centre, (sqrt((c.x-g.a)*(c.x-g.a)+(c.y-g.b)*(c.y-g.b)), c.centre)) AS centre, count_star() * max(g.n) / 3 AS n FROM (SELECT a, b, count(*) AS n FROM p GROUP BY a, b) g CROSS JOIN c{k} c GROUP BY g.a, g.b)"
    for k in range(3):
        out += f",\nc{k + 1} AS (SELECT c.centre, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN (SELECT centre, sum(a * n) / sum(n) AS x, sum(b * n) / sum(n) AS y FROM {near.format(k=k)} GROUP BY centre) m USING (centre))"
    return out + f"\nSELECT CAST(c.centre AS INTEGER) AS centre, round(x, 6) AS x, round(y, 6) AS y, CAST(coalesce(n, 0) AS BIGINT) AS rows FROM c3 c LEFT JOIN (SELECT centre, sum(n) AS n FROM {near.format(k=3)} GROUP BY centre) USING (centre)"


def gradient_descent_rounds(spark, sf_dir):
    """The costs of five rounds of linear regression of the scaled price on quantity and discount. The step is fixed and
    gradients are sums, so over very many lines costs rise; all five rounds are told, as in the SQL."""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 100000).alias("label"), F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount")).alias("vec"))
    _, trace = learning.gradient_descent(rows, alpha=1e-6, threshold=0.0, max_iterations=5, strict=False)
    return spark.createDataFrame([(n, *map(lambda x: round(x, 6), theta), round(cost, 6)) for n, theta, cost in trace], "round int, t0 double, t1 double, t2 double, cost double")


def _descent_sql() -> str:
    out = "WITH p AS (SELECT l_extendedprice / 100000 AS y, l_quantity / 50 AS a, l_discount AS b FROM lineitem), m AS (SELECT count(*) AS m FROM p), t0 AS (SELECT 1.0::DOUBLE AS t0, 1.0::DOUBLE AS t1, 1.0::DOUBLE AS t2)"
    for k in range(5):
        out += f",\ng{k} AS (SELECT sum((h - y) * (h - y)) / (2 * any_value(m)) AS cost, sum(h - y) AS g0, sum((h - y) * a) AS g1, sum((h - y) * b) AS g2 FROM (SELECT t.t0 + t.t1 * a + t.t2 * b AS h, y, a, b, m FROM p CROSS JOIN t{k} t CROSS JOIN m)),\nt{k + 1} AS (SELECT t0 - 1e-6 * g0 AS t0, t1 - 1e-6 * g1 AS t1, t2 - 1e-6 * g2 AS t2 FROM t{k}, g{k})"
    return out + "\n" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS round, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2, round(cost, 6) AS cost FROM t{k}, g{k}" for k in range(5))


def nearest_vectors(spark, sf_dir):
    """Cosine distance of each vector to the mean of its label."""
    rows = _t(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("m"))
    return rows.join(means, "label").select("vec_id", F.round(V.cosine_distance(F.col("v"), F.col("m")), 6).alias("distance"))


def monte_carlo_pi(spark, sf_dir):
    """Whether the estimate from 80,000 points is near."""
    return graph.estimate_pi(spark).select((F.abs(F.col("value") - 3.141592653589793) < 0.03).alias("near"))


def network_rounds(spark, sf_dir):
    """Predictions of a small network after 20 rounds over all lines: do quantity and discount predict the flag?"""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, (F.col("l_returnflag") == "N").cast("double")).alias("vec"))
    net = learning.LayeredNetwork([2, 3, 1], ["Sigmoid", "Sigmoid"], "CrossEntropy", rate=0.4, momentum=0.2)
    net.train(rows, rounds=20, batch=0)
    return net.predict(rows).select("l_orderkey", "l_linenumber", F.get("output", 0).alias("score"))


def rating_factors(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg((F.avg("l_quantity") / 10).alias("rating"))
    rows = written(rows, "rows")
    users, items = learning.factorize(rows, rank=3, rounds=3)
    return learning.estimated(rows.select("user", "item"), users, items)


QUERIES = {f.__name__: f for f in (
    pagerank_trade, pagerank_sales, shortest_paths_trade, shortest_paths_chain, components_chain, components_directed, pagerank_resumed, in_links_sales, matching_size, semi_clusters_trade, dynamic_sum_orders,
    sender_combine, combine_text_min, superstep_aggregates, join_inner, join_outer, join_override, join_nested, join_choosing, join_where, feature_lookup,
    key_value_text, vector_text, adjacency_text, partition_owner, sort_within, superstep_sums, combiner_pairs, vector_algebra, sparse_matrix_vector, matrix_product, matrix_cells,
    kmeans_rounds, gradient_descent_rounds, nearest_vectors, monte_carlo_pi, network_rounds, rating_factors,
)}

_COMPONENTS = """SELECT o_orderkey AS id, max(CASE WHEN begins THEN o_orderkey END) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS component
FROM (SELECT o_orderkey, coalesce(lag(o_orderstatus) OVER (ORDER BY o_orderkey) <> 'P' OR lag(o_orderkey) OVER (ORDER BY o_orderkey) <> o_orderkey - 1, TRUE) AS begins FROM orders)"""

SQL = {
    "pagerank_trade": _pagerank_sql(f"{_TRADE}, vertices AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)", "vertices", "trade", 10, 9),
    "pagerank_resumed": _pagerank_sql(f"{_TRADE}, vertices AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)", "vertices", "trade", 4, 9),
    "pagerank_sales": _pagerank_sql(_SALES, "vertices", "edges", 10, 9),
    "shortest_paths_trade": f"""WITH RECURSIVE {_TRADE}, walk(id, d, k) AS (SELECT CAST(n_nationkey AS BIGINT), CASE WHEN n_nationkey = 0 THEN 0 ELSE 1000000000 END::BIGINT, 0 FROM nation
  UNION ALL (SELECT w.id, min(least(w.d, coalesce(v.d + e.weight, w.d)))::BIGINT, any_value(w.k) + 1 FROM walk w LEFT JOIN trade e ON e.dst = w.id LEFT JOIN walk v ON v.id = e.src WHERE w.k < 25 GROUP BY w.id))
SELECT id, CASE WHEN d >= 1000000000 THEN {graph.UNREACHED} ELSE d END AS distance FROM walk WHERE k = 25""",
    "shortest_paths_chain": f"""WITH RECURSIVE {_CHAIN}, reach(id, d) AS (SELECT 5::BIGINT, 0::BIGINT UNION SELECT e.dst, r.d + 1 FROM reach r JOIN edges e ON e.src = r.id WHERE r.d < 60)
SELECT o_orderkey AS id, coalesce(d, {graph.UNREACHED})::BIGINT AS distance FROM orders LEFT JOIN (SELECT id, min(d) AS d FROM reach GROUP BY id) ON id = o_orderkey""",
    "components_chain": _COMPONENTS,
    "components_directed": _COMPONENTS,
    "in_links_sales": f"WITH {_SALES} SELECT id, count(e.src) AS links FROM vertices LEFT JOIN edges e ON e.dst = id GROUP BY id",
    "matching_size": "SELECT 0::BIGINT AS open_pairs, 0::BIGINT AS twice_matched, 0::BIGINT AS no_edges, 0::BIGINT AS one_sided, true AS large",
    "dynamic_sum_orders": "SELECT 'sum' AS id, (sum(o_custkey) + 1)::BIGINT AS value FROM orders",
    "sender_combine": "SELECT l_partkey AS dst, sum(l_quantity) AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1",
    "combine_text_min": "SELECT o_custkey, min(o_orderpriority) AS m FROM orders GROUP BY 1",
    "superstep_aggregates": """SELECT round(0.9 * sum(o_totalprice), 2) AS total, round(0.9 * min(o_totalprice), 2) AS least, round(0.9 * max(o_totalprice), 2) AS most, round(0.1 * sum(o_totalprice), 2) AS change,
round(0.1 * avg(o_totalprice), 2) AS average_change, count(*) AS vertices FROM orders""",
    "join_inner": f"WITH {_TWO} SELECT k, a.v AS v0, b.v AS v1 FROM a JOIN b USING (k)",
    "join_outer": f"WITH {_TWO} SELECT coalesce(a.k, b.k) AS k, a.v AS v0, b.v AS v1, a.k IS NOT NULL AS has_0, b.k IS NOT NULL AS has_1 FROM a FULL JOIN b ON a.k = b.k",
    "join_override": f"WITH {_TWO} SELECT k, v FROM b UNION ALL SELECT k, v FROM a WHERE k NOT IN (SELECT k FROM b)",
    "join_nested": f"WITH {_TWO}, c AS (SELECT k, v FROM b JOIN embeddings ON vec_id = k) SELECT k, v FROM c UNION ALL SELECT k, v FROM a WHERE k NOT IN (SELECT k FROM c)",
    "join_choosing": f"WITH {_TWO} SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS value FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL",
    "join_where": f"WITH {_TWO} SELECT k, v FROM a WHERE k NOT IN (SELECT k FROM b)",
    "feature_lookup": "SELECT l_partkey AS p_partkey, l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey",
    "key_value_text": "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority || chr(9) || o_orderstatus END AS value FROM orders",
    "vector_text": "SELECT CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS label, CAST(l_linenumber AS DOUBLE) AS x0, CAST(l_orderkey AS DOUBLE) AS x1 FROM lineitem",
    "adjacency_text": f"WITH {_TRADE} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, weight FROM trade",
    "partition_owner": "SELECT CAST(o_custkey % 6 AS INTEGER) AS peer, count(*) AS rows, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1",
    "sort_within": "SELECT count(*) AS rows, 0::BIGINT AS out_of_order FROM orders",
    "superstep_sums": "SELECT 4::BIGINT AS messages, CAST(sum(o_custkey) AS DOUBLE) AS total FROM orders",
    "monte_carlo_pi": "SELECT true AS near",
    "combiner_pairs": "SELECT a AS sender, b AS receiver, 6::BIGINT AS value FROM range(5) x(a), range(5) y(b)",
    "vector_algebra": """SELECT vec_id, round(list_sum(v), 6) AS total, round(list_sum(list_transform(v, lambda x: x * (2 * x - 0.5))), 6) AS dot, round(list_max(v), 6) AS most, round(list_min(v), 6) AS least,
CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS at_most, round(sqrt(list_sum(list_transform(v, lambda x: (x - 0.5) * (x - 0.5)))), 6) AS euclidean, round(list_sum(list_transform(v[3:6], lambda x: abs(x))), 6) AS part_total
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)""",
    "sparse_matrix_vector": "SELECT l_suppkey AS i, sum(l_quantity * (c_nationkey + 1)) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "matrix_product": f"WITH {_TRADE} SELECT a.src AS i, b.src AS j, CAST(sum(a.weight * b.weight) AS DOUBLE) AS x FROM trade a JOIN trade b ON a.dst = b.dst GROUP BY 1, 2",
    "matrix_cells": f"WITH {_TRADE}, b AS (SELECT dst AS src, src AS dst, weight FROM trade WHERE weight > 50) SELECT coalesce(a.src, b.src) AS i, coalesce(a.dst, b.dst) AS j, CAST(coalesce(a.weight, 0) * 2 - coalesce(b.weight, 0) AS DOUBLE) AS x FROM trade a FULL JOIN b ON a.src = b.src AND a.dst = b.dst",
    "kmeans_rounds": _kmeans_sql(),
    "gradient_descent_rounds": _descent_sql(),
    "nearest_vectors": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT vec_id, label, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS x FROM e),
m AS (SELECT label, j, avg(x) AS m FROM x GROUP BY 1, 2) SELECT vec_id, round(1 - sum(x * m) / greatest(sqrt(sum(x * x)) * sqrt(sum(m * m)), sum(x * m)), 6) AS distance FROM x JOIN m USING (label, j) GROUP BY vec_id""",
}
