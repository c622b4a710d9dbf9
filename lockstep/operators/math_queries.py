"""Vectors, matrices and learning on the test tables, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..functions import random as R
from ..functions import vectors as V
from ..plans.storage import written
from ..sources import sinks
from ..sources import text as T
from . import graph, learning
from .io_queries import _place
from .queries import _TRADE, _t, _trade


def _vectors(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return _t(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", v.alias("v"))


_V = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL"


def vector_rounding(spark, sf_dir):
    """Sums of powers, roots and roundings of the components."""
    v = F.col("v")
    ten, total = V.multiply(v, 10.0), lambda a: F.round(V.total(a), 6)
    return _vectors(spark, sf_dir).select(
        "vec_id", total(V.power(v, 3)).alias("cubes"), total(V.sqrt(V.absolute(v))).alias("roots"), total(V.rint(ten)).alias("even"),
        total(V.round_half_up(ten)).alias("half_up"), total(V.ceil(ten)).alias("up"), V.min_index(v).alias("at_least"),
    )


def vector_products(spark, sf_dir):
    """The first two components times a matrix, a user function of two vectors, and scalar forms."""
    v, two = F.col("v"), V.part(F.col("v"), 2)
    got = V.times_matrix(two, [[1, 2], [3, 4]])
    return _vectors(spark, sf_dir).select(
        "vec_id", F.round(F.get(got, 0), 6).alias("m0"), F.round(F.get(got, 1), 6).alias("m1"),
        F.round(V.total(V.apply(v, lambda x, y: x * y + 1, V.subtract_from(v, 1.0))), 6).alias("applied"),
        F.round(V.total(V.apply(v, lambda x: x * x)), 6).alias("squares"), F.round(V.total(V.divide(V.add(v, V.ones(64)), 4.0)), 6).alias("quarter"),
        F.round(V.total(V.divide_from(V.add(v, 2.0), 1.0)), 6).alias("inverse"),
    )


def vector_makers(spark, sf_dir):
    """Ranges, order and non-zero components of orders' figures as vectors."""
    vec = F.array("o_totalprice", F.lit(0.0), F.col("o_custkey").cast("double"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", V.ordered(vec).alias("s"), V.non_zero(vec).alias("nz"), V.from_up_to(1.0, 4.0, 0.5).alias("range"), V.dense(F.lit(4), F.array(F.lit(2)), F.array(F.col("o_totalprice"))).alias("d"))
    return rows.select("o_orderkey", F.get("s", 2)["value"].alias("most"), F.get("s", 0)["index"].alias("least_at"), F.size("nz").alias("filled"), V.total(F.col("range")).alias("steps"), F.get("d", 2).alias("at_two"), F.size("d").alias("size"))


def named_vectors(spark, sf_dir):
    """Tab-separated numbers with a name in front."""
    lines = _t(spark, sf_dir, "lineitem").select(F.concat_ws("\t", F.concat(F.lit("o"), "l_orderkey"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string")).alias("value"))
    return T.tab_vectors(lines, named=True).select("name", F.get("vec", 0).alias("x0"), F.get("vec", 1).alias("x1"))


def matrix_columns(spark, sf_dir):
    """Statistics of the columns of all vectors as a matrix."""
    stats = M.column_stats(M.from_rows(_vectors(spark, sf_dir), "vec_id", "v"))
    return stats.select("j", F.round("most", 6).alias("most"), F.round("least", 6).alias("least"), F.round("total", 5).alias("total"))


def _cells(spark, sf_dir):
    _, edges = _trade(spark, sf_dir)
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").cast("double").alias("x"))


def matrix_parts(spark, sf_dir):
    """A part of the trade matrix, with a column set to that of another."""
    a = written(_cells(spark, sf_dir), "cells")
    changed = M.with_column_set(a, 3, M.column(a, 4))
    return M.part(changed, (2, 12), (1, 9))


def matrix_vectors(spark, sf_dir):
    """The trade matrix less its first row, in each row, over its second."""
    a = written(_cells(spark, sf_dir), "cells")
    return M.divide_vector(M.subtract_vector(a, M.row(a, 0)), M.row(a, 1)).select("i", "j", F.round("x", 6).alias("x"))


def matrix_sums(spark, sf_dir):
    """Cellwise sums, products and quotients, all cells together, and the error against the transpose."""
    a = written(_cells(spark, sf_dir), "cells")
    b = M.transpose(a)
    named = [("sum", M.total(M.add(a, b))), ("product", M.total(M.multiply_cells(a, b))), ("error", M.error(a, b)), ("quotient", M.total(M.divide_cells(a, a))), ("powers", M.total(M.map_cells(a, lambda x: F.pow(x, 2))))]
    out = None
    for name, frame in named:
        row = frame.select(F.lit(name).alias("name"), F.round("x", 4).alias("x"))
        out = row if out is None else out.unionByName(row)
    return out


def matrix_splits(spark, sf_dir):
    """Vectors' last components as labels; a random split's parts, which together are all rows and share none."""
    rows = _vectors(spark, sf_dir).select(F.col("vec_id").alias("row"), F.col("v").alias("vec"))
    low, high = M.split_random(M.split_last_column(rows), 0.3, 5)
    both = low.withColumn("part", F.lit(1)).unionByName(high.withColumn("part", F.lit(1)))
    return both.groupBy("row").agg(F.sum("part").alias("parts"), F.round(F.first("label"), 6).alias("label"), F.round(V.total(F.first("features")), 6).alias("features"))


def sparse_rows(spark, sf_dir):
    """Trade as sparse rows times a vector that fits the plan."""
    _, edges = _trade(spark, sf_dir)
    held = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct(F.col("dst").cast("int").alias("j"), F.col("weight").cast("double").alias("x")))).alias("c"))
    rows = held.select(F.col("src").alias("row"), F.transform("c", lambda c: c["j"]).alias("idx"), F.transform("c", lambda c: c["x"]).alias("val"), F.lit(25).alias("size"))
    return M.sparse_times_vector(rows, [float(j + 1) for j in range(25)])


def activations(spark, sf_dir):
    """Values and derivatives of the activations, and of the costs against the tax, by name."""
    x, t = F.col("l_discount") * 10 + 0.1, F.col("l_tax") * 10
    out = []
    for name in ("Sigmoid", "Tanh", "IdentityFunction", "Square"):
        value, slope = V.function(name)
        out += [F.round(value(x), 6).alias(name.lower()), F.round(slope(value(x)), 6).alias(f"{name.lower()}_slope")]
    for name in ("SquaredError", "CrossEntropy"):
        value, slope = V.function(name)
        out += [F.round(value(t, x * 0.5), 6).alias(name.lower()), (F.round(slope(t, x * 0.5), 6) + 0.0).alias(f"{name.lower()}_slope")]
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *out)


def variates(spark, sf_dir):
    """Draws for each order, and whether their ranges and means are those of their laws."""
    draws = {
        "uniform": (R.uniform(2, 4, 1), 3, 2, 4), "normal": (R.normal(1, 2, 2), 1, -99, 99), "chi2": (R.chi2(3, 3), 3, 0, 999), "exponential": (R.exponential(2, 4), 0.5, 0, 99),
        "triangular": (R.triangular(0, 1, 5, 5), 2, 0, 5), "symmetric": (R.symmetric_triangular(0, 2, 6), 1, 0, 2), "beta": (R.beta(2, 3, 7), 0.4, 0, 1), "weibull": (R.weibull(2, 1, 8), 2, 0, 999),
        "whole": (R.rand_int(1, 6, 9), 3.5, 1, 6), "log_normal": (R.log_normal(0, 0.5, 10), 1.1331, 0, 999), "dirac": (R.dirac(7), 7, 7, 7),
    }
    rows = _t(spark, sf_dir, "orders").select(*[c.alias(n) for n, (c, *_) in draws.items()], R.rand_string(5, 20).alias("word"))
    fine = [((F.abs(F.avg(n) - mean) < 0.15) & (F.min(n) >= low) & (F.max(n) <= high)).alias(n) for n, (_, mean, low, high) in draws.items()]
    return rows.agg(F.count("*").alias("rows"), *fine, F.bool_and(F.col("word").rlike("^[a-z]{5}$")).alias("word"))


def generated_graph(spark, sf_dir):
    """A random graph: vertices, and whether targets are distinct vertices and no more than asked for."""
    rows = graph.random_graph(spark, 1000, 8)
    fine = (F.size("adj") <= 8) & (F.size(F.array_distinct("adj")) == F.size("adj")) & F.forall("adj", lambda x: x.cast("int").between(0, 999))
    return rows.agg(F.count("*").alias("vertices"), F.bool_and(fine).alias("fine"))


def generated_matrix(spark, sf_dir):
    """A random symmetric matrix: whether it is symmetric and of the density asked for."""
    a = written(graph.random_symmetric_matrix(spark, 400, 0.1), "matrix")
    lost = a.join(M.transpose(a), ["i", "j"], "left_anti").count()
    return a.agg((F.abs(F.count("*") / 160_000 - 0.1) < 0.01).alias("dense"), (F.max("j") < 400).alias("inside"), F.lit(lost).cast("long").alias("one_sided"), (F.count("*") - F.countDistinct("i", "j")).alias("twice"))


def assigned_by_city_block(spark, sf_dir):
    """The nearest of three centres by a distance of the user's."""
    block = lambda a, b: V.total(V.absolute(V.subtract(a, b)))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_discount") * 100).alias("vec"))
    return learning.assigned(rows, [[5.0, 9.0], [25.0, 1.0], [40.0, 5.0]], distance=block).select("l_orderkey", "l_linenumber", "centre")


def _labelled(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("vec"))


def _trace(spark, trace):
    return spark.createDataFrame([(n, *[round(x, 6) for x in theta], round(cost, 6)) for n, theta, cost in trace], "round int, t0 double, t1 double, t2 double, cost double")


def logistic_rounds(spark, sf_dir):
    """Three rounds of logistic regression of the return flag, all told, whether costs rise or not, as in the SQL."""
    return _trace(spark, learning.gradient_descent(_labelled(spark, sf_dir), "logistic", alpha=1e-6, threshold=0.0, max_iterations=3, strict=False)[1])


def own_model_rounds(spark, sf_dir):
    """Two rounds of a model of the user's, a linear one with a cost of its own, over transformed features.
    Both are told, whether costs rise or not, as in the SQL."""
    model = (lambda theta, x: V.dot(theta, x) * 0.5, lambda h, y, m: F.abs(h - y) / m)
    return _trace(spark, learning.gradient_descent(_labelled(spark, sf_dir), model, alpha=1e-6, threshold=0.0, max_iterations=2, transform=lambda v: V.multiply(v, 2.0), strict=False)[1])


def _descent(hypothesis: str, cost: str, rounds: int, scale: int = 1) -> str:
    out = f"WITH p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::DOUBLE AS y, {scale}::DOUBLE AS o, l_quantity / 50 * {scale} AS a, l_discount * 10 * {scale} AS b FROM lineitem), m AS (SELECT count(*) AS m FROM p), t0 AS (SELECT 1.0::DOUBLE AS t0, 1.0::DOUBLE AS t1, 1.0::DOUBLE AS t2)"
    for k in range(rounds):
        out += f",\ng{k} AS (SELECT sum({cost}) AS cost, sum((h - y) * o) AS g0, sum((h - y) * a) AS g1, sum((h - y) * b) AS g2 FROM (SELECT {hypothesis} AS h, y, o, a, b, m FROM (SELECT t.t0 * o + t.t1 * a + t.t2 * b AS z, y, o, a, b, m FROM p CROSS JOIN t{k} t CROSS JOIN m))),\nt{k + 1} AS (SELECT t0 - 1e-6 * g0 AS t0, t1 - 1e-6 * g1 AS t1, t2 - 1e-6 * g2 AS t2 FROM t{k}, g{k})"
    return out + "\n" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS round, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2, round(cost, 6) AS cost FROM t{k}, g{k}" for k in range(rounds))


# Weights of a small network: (to, 1 + from) of each layer.
_WEIGHTS = [[[0.1, 0.4, -0.3], [-0.2, 0.25, 0.5]], [[0.05, -0.6, 0.35]]]


def _network():
    net = learning.LayeredNetwork([2, 2, 1], ["Sigmoid", "Sigmoid"], "SquaredError", rate=0.5)
    net.weights = [np.array(w) for w in _WEIGHTS]
    return net


def _examples(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, (F.col("l_returnflag") == "N").cast("double")).alias("vec"))


def network_forward(spark, sf_dir):
    return _network().predict(_examples(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.round(F.get("output", 0), 9).alias("score"))


def network_round(spark, sf_dir):
    """All weights after a round of training over all rows, written as a model and read back."""
    net, path = _network(), _place(spark, "model")
    net.train(_examples(spark, sf_dir), rounds=1, batch=0)
    sinks.write_model(spark, net.settings(), net.weights, path)
    settings, weights = sinks.read_model(spark, path)
    rows = [(layer, i, j, round(float(x), 9)) for layer, w in enumerate(weights) for (i, j), x in np.ndenumerate(w)]
    return spark.createDataFrame(rows, "layer int, unit int, input int, weight double").withColumn("sizes", F.lit(",".join(map(str, settings["sizes"]))))


_NET = "n AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 10 AS b, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END::DOUBLE AS y FROM lineitem)"
_NET += ", h AS (SELECT *, " + ", ".join(f"1 / (1 + exp(-({w[0]} + {w[1]} * a + {w[2]} * b))) AS h{k}" for k, w in enumerate(_WEIGHTS[0])) + " FROM n)"
_NET += ", f AS (SELECT *, 1 / (1 + exp(-({} + {} * h0 + {} * h1))) AS o FROM h)".format(*_WEIGHTS[1][0])


def _round_sql() -> str:
    d = "(o - y) * o * (1 - o)"
    cells = [(1, 0, j, f"{d} * {x}", _WEIGHTS[1][0][j]) for j, x in enumerate(("1", "h0", "h1"))]
    for k in range(2):
        back = f"{d} * {_WEIGHTS[1][0][k + 1]} * h{k} * (1 - h{k})"
        cells += [(0, k, j, f"{back} * {x}", _WEIGHTS[0][k][j]) for j, x in enumerate(("1", "a", "b"))]
    return f"WITH {_NET} " + " UNION ALL ".join(f"SELECT {layer}::INTEGER AS layer, {i}::INTEGER AS unit, {j}::INTEGER AS input, round({w} - 0.5 * avg({g}), 9) AS weight, '2,2,1' AS sizes FROM f" for layer, i, j, g, w in cells)


def _ratings(spark, sf_dir):
    lines, orders = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg((F.avg("l_quantity") / 10).alias("rating"))


def _one_round(spark, sf_dir):
    ratings = written(_ratings(spark, sf_dir), "ratings")
    start = lambda key, m: ratings.select(key).distinct().withColumn("vec", F.array((F.col(key) % m) / m, F.col(key) % 3 + 0.5))
    return learning.factorize(ratings, rank=2, rounds=1, rate=0.01, initial=(start("user", 7), start("item", 5)))


def rating_round(spark, sf_dir):
    """Users' and items' factors after one round from known ones, saved and loaded."""
    path = _place(spark, "factors")
    learning.save_factors(*_one_round(spark, sf_dir), path)
    users, items = learning.load_factors(spark, path)
    sides = [f.select(F.lit(n).alias("side"), F.col(n).alias("id"), F.round(F.get("vec", 0), 9).alias("x0"), F.round(F.get("vec", 1), 9).alias("x1")) for n, f in (("user", users), ("item", items))]
    return sides[0].unionByName(sides[1])


def rating_tops(spark, sf_dir):
    """The five items of greatest estimate for user 1, and the five items most like item 1."""
    users, items = _one_round(spark, sf_dir)
    top = learning.preferred_items(users, items, 1, 5).select(F.lit("preferred").alias("kind"), "item", F.round("estimate", 6).alias("x"))
    return top.unionByName(learning.most_similar(items, "item", 1, 5).select(F.lit("similar").alias("kind"), "item", F.round("distance", 6).alias("x")))


_ROUND = """r AS (SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) / 10 AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
v AS (SELECT u, i, (u % 7) / 7.0::DOUBLE AS u0, u % 3 + 0.5::DOUBLE AS u1, (i % 5) / 5.0::DOUBLE AS i0, i % 3 + 0.5::DOUBLE AS i1, r FROM r),
e AS (SELECT *, 0.02 * (r - (u0 * i0 + u1 * i1)) AS e FROM v),
users AS (SELECT u AS id, any_value(u0) + sum(e * i0) * least(1, 8.0::DOUBLE / count(*)) AS x0, any_value(u1) + sum(e * i1) * least(1, 8.0::DOUBLE / count(*)) AS x1 FROM e GROUP BY u),
items AS (SELECT i AS id, any_value(i0) + sum(e * u0) * least(1, 8.0::DOUBLE / count(*)) AS x0, any_value(i1) + sum(e * u1) * least(1, 8.0::DOUBLE / count(*)) AS x1 FROM e GROUP BY i)"""


def semi_clusters_pairs(spark, sf_dir):
    """Semi-clusters of the trade graph after one round: each nation alone and with each other one."""
    vertices, edges = _trade(spark, sf_dir)
    named = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
    got = graph.semi_clusters(vertices.select(F.col("id").cast("string").alias("id")), named, max_clusters=40, max_size=2, boundary=0.5, rounds=1)
    return got.select("id", "cluster", F.array_join("members", ",").alias("members"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    vector_rounding, vector_products, vector_makers, named_vectors, matrix_columns, matrix_parts, matrix_vectors, matrix_sums, matrix_splits, sparse_rows, activations, variates,
    generated_graph, generated_matrix, assigned_by_city_block, logistic_rounds, own_model_rounds, network_forward, network_round, rating_round, rating_tops, semi_clusters_pairs,
)}

_LAWS = ["uniform", "normal", "chi2", "exponential", "triangular", "symmetric", "beta", "weibull", "whole", "log_normal", "dirac"]
_LIST = lambda f: f"round(list_sum(list_transform(v, lambda x: {f})), 6)"
_PART = f"WITH {_TRADE}, a AS (SELECT src AS i, dst AS j, CAST(weight AS DOUBLE) AS x FROM trade)"

SQL = {
    "vector_rounding": f"SELECT vec_id, {_LIST('x * x * x')} AS cubes, {_LIST('sqrt(abs(x))')} AS roots, {_LIST('round_even(x * 10, 0)')} AS even, {_LIST('floor(x * 10 + 0.5)')} AS half_up, {_LIST('ceil(x * 10)')} AS up, CAST(list_position(v, list_min(v)) - 1 AS INTEGER) AS at_least FROM ({_V})",
    "vector_products": f"SELECT vec_id, round(v[1] + 3 * v[2], 6) AS m0, round(2 * v[1] + 4 * v[2], 6) AS m1, {_LIST('x * (1 - x) + 1')} AS applied, {_LIST('x * x')} AS squares, {_LIST('(x + 1) / 4')} AS quarter, {_LIST('1 / (x + 2)')} AS inverse FROM ({_V})",
    "vector_makers": "SELECT o_orderkey, greatest(o_totalprice, o_custkey::DOUBLE, 0.0) AS most, 1 AS least_at, CASE WHEN o_custkey = 0 THEN 1 ELSE 2 END AS filled, 13.5::DOUBLE AS steps, o_totalprice AS at_two, 4 AS size FROM orders",
    "named_vectors": "SELECT 'o' || l_orderkey AS name, l_linenumber::DOUBLE AS x0, l_quantity AS x1 FROM lineitem",
    "matrix_columns": f"SELECT j - 1 AS j, round(max(x), 6) AS most, round(min(x), 6) AS least, round(sum(x), 5) AS total FROM (SELECT unnest(range(1, len(v) + 1)) AS j, unnest(v) AS x FROM ({_V})) GROUP BY j",
    "matrix_parts": f"{_PART}, b AS (SELECT i, j, x FROM a WHERE j <> 3 UNION ALL SELECT i, 3, x FROM a WHERE j = 4) SELECT i - 2 AS i, j - 1 AS j, x FROM b WHERE i BETWEEN 2 AND 11 AND j BETWEEN 1 AND 8",
    "matrix_vectors": f"{_PART} SELECT a.i, a.j, round((a.x - coalesce(z.x, 0)) / o.x, 6) AS x FROM a LEFT JOIN a z ON z.i = 0 AND z.j = a.j JOIN a o ON o.i = 1 AND o.j = a.j",
    "matrix_sums": f"""{_PART} SELECT 'sum' AS name, round(2 * sum(x), 4) AS x FROM a UNION ALL SELECT 'product', round(sum(a.x * b.x), 4) FROM a JOIN a b ON a.i = b.j AND a.j = b.i
UNION ALL SELECT 'error', round(sum(abs(coalesce(a.x, 0) - coalesce(b.x, 0))), 4) FROM a FULL JOIN (SELECT j AS i, i AS j, x FROM a) b ON a.i = b.i AND a.j = b.j
UNION ALL SELECT 'quotient', round(sum(x / x), 4) FROM a UNION ALL SELECT 'powers', round(sum(x * x), 4) FROM a""",
    "matrix_splits": f"SELECT vec_id AS row, 1::BIGINT AS parts, round(v[-1], 6) AS label, round(list_sum(v[1:-2]), 6) AS features FROM ({_V})",
    "sparse_rows": f"WITH {_TRADE} SELECT src AS row, CAST(sum(weight * (dst + 1)) AS DOUBLE) AS x FROM trade GROUP BY src",
    "activations": """SELECT l_orderkey, l_linenumber, round(s, 6) AS sigmoid, round(s * (1 - s), 6) AS sigmoid_slope, round(t, 6) AS tanh, round(1 - t * t, 6) AS tanh_slope, round(x, 6) AS identityfunction, 1.0::DOUBLE AS identityfunction_slope,
round(x * x, 6) AS square, round(2 * sqrt(x * x), 6) AS square_slope, round(0.5 * (y - a) * (y - a), 6) AS squarederror, round(a - y, 6) + 0.0 AS squarederror_slope,
round(-y * ln(c) - (1 - y) * ln(1 - c), 6) AS crossentropy, round(-y / c + (1 - y) / (1 - c), 6) + 0.0 AS crossentropy_slope
FROM (SELECT l_orderkey, l_linenumber, x, y, 1 / (1 + exp(-x)) AS s, tanh(x) AS t, x * 0.5 AS a, least(greatest(x * 0.5, 1e-7), 1 - 1e-7) AS c FROM (SELECT *, l_discount * 10 + 0.1 AS x, l_tax * 10 AS y FROM lineitem))""",
    "variates": "SELECT count(*) AS rows, " + ", ".join(f"true AS {n}" for n in _LAWS) + ", true AS word FROM orders",
    "generated_graph": "SELECT 1000::BIGINT AS vertices, true AS fine",
    "generated_matrix": "SELECT true AS dense, true AS inside, 0::BIGINT AS one_sided, 0::BIGINT AS twice",
    "assigned_by_city_block": """SELECT l_orderkey, l_linenumber, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS centre
FROM (SELECT *, abs(l_quantity - 5) + abs(l_discount * 100 - 9) AS d0, abs(l_quantity - 25) + abs(l_discount * 100 - 1) AS d1, abs(l_quantity - 40) + abs(l_discount * 100 - 5) AS d2 FROM lineitem)""",
    "logistic_rounds": _descent("least(1 / (1 + exp(-z)), 1 - 1e-16)", "(y * ln(h) + (1 - y) * ln(greatest(1 - h, 1e-300))) / -m", 3),
    "own_model_rounds": _descent("z * 0.5", "abs(h - y) / m", 2, scale=2),
    "network_forward": f"WITH {_NET} SELECT l_orderkey, l_linenumber, round(o, 9) AS score FROM f",
    "network_round": _round_sql(),
    "rating_round": f"WITH {_ROUND} SELECT 'user' AS side, id, round(x0, 9) AS x0, round(x1, 9) AS x1 FROM users UNION ALL SELECT 'item', id, round(x0, 9), round(x1, 9) FROM items",
    "rating_tops": f"""WITH {_ROUND} (SELECT 'preferred' AS kind, i.id AS item, round(u.x0 * i.x0 + u.x1 * i.x1, 6) AS x FROM users u, items i WHERE u.id = 1 ORDER BY u.x0 * i.x0 + u.x1 * i.x1 DESC, i.id LIMIT 5)
UNION ALL (SELECT 'similar', i.id, round(sqrt((i.x0 - o.x0) * (i.x0 - o.x0) + (i.x1 - o.x1) * (i.x1 - o.x1)), 6) FROM items i, items o WHERE o.id = 1 AND i.id <> 1 ORDER BY sqrt((i.x0 - o.x0) * (i.x0 - o.x0) + (i.x1 - o.x1) * (i.x1 - o.x1)), i.id LIMIT 5)""",
    "semi_clusters_pairs": f"""WITH {_TRADE}, pairs AS (SELECT least(src::VARCHAR, dst::VARCHAR) AS a, greatest(src::VARCHAR, dst::VARCHAR) AS b, max(weight)::DOUBLE AS w FROM trade WHERE src <> dst GROUP BY 1, 2),
near AS (SELECT id, sum(w) AS s FROM (SELECT a AS id, w FROM pairs UNION ALL SELECT b, w FROM pairs) GROUP BY id),
held AS (SELECT n_nationkey::VARCHAR AS id, n_nationkey::VARCHAR AS one, NULL AS two, 1.0::DOUBLE AS score FROM nation
  UNION ALL SELECT unnest([a, b]), a, b, w - 0.5 * (x.s + y.s - 2 * w) FROM pairs JOIN near x ON x.id = a JOIN near y ON y.id = b)
SELECT id, 'C' || sha256(one || coalesce(chr(1) || two, '')) AS cluster, one || coalesce(',' || two, '') AS members, round(score, 6) AS score FROM held""",
}
