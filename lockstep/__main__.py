"""Programs by name: python -m lockstep NAME [arguments]; each writes text or Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import graph, learning
from .plans.pregel import merged_vertices
from .sources import text as T


def _graph(spark: SparkSession, path: str, weighted: bool = False):
    return merged_vertices((T.weighted_adjacency if weighted else T.adjacency)(T.lines(spark, path)))


def _pagerank(spark, a) -> DataFrame:
    return graph.pagerank(*_graph(spark, a.input), rounds=a.rounds)


def _sssp(spark, a) -> DataFrame:
    return graph.shortest_paths(*_graph(spark, a.input, True), a.start)


def _components(spark, a) -> DataFrame:
    return graph.components(*_graph(spark, a.input), max_iterations=a.rounds)


def _in_links(spark, a) -> DataFrame:
    return graph.in_links(*_graph(spark, a.input))


def _bipartite(spark, a) -> DataFrame:
    rows = T.bipartite(T.lines(spark, a.input))
    from pyspark.sql import functions as F

    return graph.bipartite_matching(rows, rows.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("src", "e.dst"), max_rounds=a.rounds)


def _semi(spark, a) -> DataFrame:
    return graph.semi_clusters(*merged_vertices(T.cluster_adjacency(T.lines(spark, a.input))), rounds=a.rounds)


def _pi(spark, a) -> DataFrame:
    return graph.estimate_pi(spark)


def _combine(spark, a) -> DataFrame:
    return graph.combiner_demo(spark, a.k)


def _generate(spark, a) -> DataFrame:
    return graph.random_graph(spark, a.k, 10)


def _symmetric(spark, a) -> DataFrame:
    return graph.random_symmetric_matrix(spark, a.k, a.density)


def _vectors(spark, a) -> DataFrame:
    return graph.random_vectors(spark, a.k, 10)


def _network(spark, a) -> DataFrame:
    """Trains a network with one hidden layer on tab-separated numbers, the last being the label, and stores the
    model; with a stored model, gives each row its output."""
    from pyspark.sql import functions as F

    from .sources import sinks

    rows = T.tab_vectors(T.lines(spark, a.input)).select("vec")
    if not a.train:
        settings, weights = sinks.read_model(spark, a.model_path)
        net = learning.LayeredNetwork(**settings)
        net.weights = weights
        return net.predict(rows)
    d = rows.select(F.size("vec")).first()[0] - 1
    net = learning.LayeredNetwork([d, a.k, 1], ["Sigmoid", "Sigmoid"], "CrossEntropy", rate=0.5, momentum=0.2)
    net.train(rows, a.rounds, batch=0)
    sinks.write_model(spark, net.settings(), net.weights, a.model_path)
    return net.predict(rows)


def _kmeans(spark, a) -> DataFrame:
    from pyspark.sql import functions as F

    rows = T.tab_vectors(T.lines(spark, a.input)).withColumn("id", F.monotonically_increasing_id())
    return learning.assigned(rows, learning.kmeans(rows, learning.first_centres(rows, a.k, "id"), a.rounds))


def _descent(spark, a) -> DataFrame:
    _, trace = learning.gradient_descent(T.labelled_vectors(T.lines(spark, a.input)), a.model, max_iterations=a.rounds)
    return spark.createDataFrame(trace, "round int, theta array<double>, cost double")


PROGRAMS = {
    "pagerank": _pagerank, "sssp": _sssp, "components": _components, "inlinks": _in_links, "bipartite": _bipartite, "semi": _semi,
    "pi": _pi, "combine": _combine, "generate": _generate, "symmetric": _symmetric, "vectors": _vectors, "network": _network, "kmeans": _kmeans, "descent": _descent,
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lockstep")
    parser.add_argument("name", choices=sorted(PROGRAMS))
    parser.add_argument("--input")
    parser.add_argument("--output")
    parser.add_argument("--start", default="0")
    parser.add_argument("--rounds", type=int, default=30)
    parser.add_argument("--k", type=int, default=4)
    parser.add_argument("--density", type=float, default=0.1)
    parser.add_argument("--train", action="store_true")
    parser.add_argument("--model-path")
    parser.add_argument("--model", default="linear", choices=sorted(learning.MODELS))
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"lockstep {a.name}").getOrCreate()
    out = PROGRAMS[a.name](spark, a)
    if a.output:
        out.write.mode("error").parquet(a.output)
    else:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
