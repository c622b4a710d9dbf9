"""Writers: key-value text, binary pairs, vertices, clusters, models and nothing at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import as_text


def write_text(df: DataFrame, path: str, key: str = "key", value: str = "value", separator: str = "\t", compression: str | None = None) -> None:
    """``key<sep>value`` lines; a null side goes with the separator, rows with both null go."""
    rows = df.filter(F.col(key).isNotNull() | F.col(value).isNotNull()).select(as_text(F.col(key), F.col(value), separator).alias("value"))
    writer = rows.write.mode("error")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_pairs(df: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """Binary key-value files for exchange with Hadoop tools; Parquet is better for Spark."""
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path)


def write_nothing(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_vertices(vertices: DataFrame, path: str) -> None:
    vertices.select("id", "value").write.mode("error").parquet(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """id and the ids of its clusters as text."""
    rows = clusters.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("cluster")), ",").alias("clusters"))
    rows.select(as_text(F.col("id"), F.col("clusters")).alias("value")).write.mode("error").text(path)


def write_centres(spark: SparkSession, centres: list[list[float]], path: str) -> None:
    spark.createDataFrame(list(enumerate(centres)), "centre int, vec array<double>").coalesce(1).write.mode("error").parquet(path)


def write_model(spark: SparkSession, settings: dict, weights: list, path: str) -> None:
    """Settings as JSON and each layer's weights as Parquet rows."""
    rows = [(layer, i, [float(x) for x in row]) for layer, matrix in enumerate(weights) for i, row in enumerate(matrix)]
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("error").text(f"{path}/settings")
    spark.createDataFrame(rows, "layer int, row int, vec array<double>").coalesce(1).write.mode("error").parquet(f"{path}/weights")


def read_model(spark: SparkSession, path: str) -> tuple[dict, list]:
    import numpy as np

    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    rows = spark.read.parquet(f"{path}/weights").orderBy("layer", "row").collect()
    return settings, [np.array([r["vec"] for r in rows if r["layer"] == k]) for k in sorted({r["layer"] for r in rows})]


def pairs_as_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A binary key-value file as lines."""
    from .text import sequence_pairs

    return sequence_pairs(spark, path, schema).select(as_text(F.col("key"), F.col("value")).alias("value"))
