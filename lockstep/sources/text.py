"""Readers of key-value, vector, adjacency, bipartite, cluster and rating texts, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(value) of text files: one path, several, or a comma-separated list; ``pattern`` filters file names."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text([p for x in ([paths] if isinstance(paths, str) else paths) for p in x.split(",")])


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(offset, value): the byte at which each line begins in its file."""
    rows = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"
    )
    return rows.toDF("offset long, value string")


def key_values(text: DataFrame, separator: str = "\t") -> DataFrame:
    """(key, value) cut at the first separator; a line without one is a key with an empty value."""
    at = F.locate(separator, F.col("value"))
    key = F.when(at > 0, F.substr("value", F.lit(1), at - 1)).otherwise(F.col("value"))
    rest = F.when(at > 0, F.substr("value", at + F.lit(len(separator)))).otherwise(F.lit(""))
    return text.select(key.alias("key"), rest.alias("value"))


def sequence_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, value) of a binary key-value file of basic types."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)


def empty_splits(spark: SparkSession, n: int) -> DataFrame:
    """n partitions with one row each."""
    return spark.range(n, numPartitions=n).select(F.col("id").cast("int").alias("peer"))


def labelled_vectors(text: DataFrame) -> DataFrame:
    """(label, vec) of lines ``y>x1 x2 ...``; a line of another form is an error."""
    parts = F.split("value", ">")
    ok = F.size(parts) == 2
    bad = F.raise_error(F.concat(F.lit("not a labelled vector: "), F.col("value")))
    label = F.when(ok, F.get(parts, 0).cast("double")).otherwise(bad)
    vec = F.transform(F.split(F.trim(F.get(parts, 1)), r"\s+"), lambda x: x.cast("double"))
    return text.select(label.alias("label"), vec.alias("vec"))


def tab_vectors(text: DataFrame, named: bool = False) -> DataFrame:
    """(name, vec) of tab-separated numbers, the first field being a name if ``named``."""
    parts = F.split("value", "\t")
    numbers = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))) if named else parts
    return text.select((F.get(parts, 0) if named else F.lit(None).cast("string")).alias("name"), F.transform(numbers, lambda x: x.cast("double")).alias("vec"))


def weighted_adjacency(text: DataFrame) -> DataFrame:
    """(id, edges) of lines ``id<tab>dst:w<tab>dst:w``."""
    return _adjacency(text, lambda x: F.struct(F.get(F.split(x, ":"), 0).alias("dst"), F.get(F.split(x, ":"), 1).cast("long").alias("weight")))


def adjacency(text: DataFrame) -> DataFrame:
    """(id, edges) of lines ``id<tab>dst<tab>dst``, without weights."""
    return _adjacency(text, lambda x: F.struct(x.alias("dst"), F.lit(None).cast("long").alias("weight")))


def _adjacency(text: DataFrame, edge) -> DataFrame:
    parts = F.split("value", "\t")
    held = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    return text.select(F.get(parts, 0).alias("id"), F.transform(held, edge).alias("edges"))


def array_adjacency(rows: DataFrame, key: str, targets: str) -> DataFrame:
    """(id, edges) of rows with an array of ids."""
    return rows.select(F.col(key).alias("id"), F.transform(targets, lambda x: F.struct(x.alias("dst"), F.lit(None).cast("long").alias("weight"))).alias("edges"))


def bipartite(text: DataFrame) -> DataFrame:
    """(id, side, edges) of lines ``id side:adj adj``; the side is L or R."""
    head = F.split("value", ":")
    names = F.split(F.trim(F.get(head, 0)), r"\s+")
    others = F.filter(F.split(F.trim(F.get(head, 1)), r"\s+"), lambda x: x != "")
    return text.select(F.get(names, 0).alias("id"), F.get(names, 1).alias("side"), F.transform(others, lambda x: F.struct(x.alias("dst"), F.lit(None).cast("double").alias("weight"))).alias("edges"))


def cluster_adjacency(text: DataFrame) -> DataFrame:
    """(id, edges) of lines ``id<tab>dst-w,dst-w``; lines that begin with # are comments."""
    parts = F.split("value", "\t")
    pairs = F.filter(F.split(F.coalesce(F.get(parts, 1), F.lit("")), ","), lambda x: x != "")
    edge = lambda x: F.struct(F.get(F.split(x, "-"), 0).alias("dst"), F.get(F.split(x, "-"), 1).cast("double").alias("weight"))
    return text.filter(~F.col("value").startswith("#")).select(F.get(parts, 0).alias("id"), F.transform(pairs, edge).alias("edges"))


def bare_ids(text: DataFrame) -> DataFrame:
    """(id, value): the line as text and as a number."""
    return text.select(F.trim("value").alias("id"), F.trim("value").cast("long").alias("value"))


def ratings(text: DataFrame) -> DataFrame:
    """(user, item, rating) of lines ``user::item::rating``, more fields ignored."""
    p = F.split("value", "::")
    return text.select(F.get(p, 0).cast("long").alias("user"), F.get(p, 1).cast("long").alias("item"), F.get(p, 2).cast("double").alias("rating"))


# The genre slots of the item file's published format.
GENRES = [
    "unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy",
    "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
]


def rated_items(text: DataFrame, genres: list[str] | None = None) -> DataFrame:
    """(item, title, features) of lines ``id::title::A|B``; features has a 1 for each genre named."""
    p = F.split("value", "::")
    held = F.split(F.get(p, 2), r"\|")
    slots = F.array(*[F.lit(g) for g in genres or GENRES])
    return text.select(F.get(p, 0).cast("long").alias("item"), F.get(p, 1).alias("title"), F.transform(slots, lambda g: F.array_contains(held, g).cast("double")).alias("features"))


def typed_rows(text: DataFrame, prefixes: dict[str, str]) -> dict[str, DataFrame]:
    """A frame for each one-character prefix of a mixed file: {name: prefix} gives {name: lines without it}."""
    return {name: text.filter(F.col("value").startswith(x)).select(F.substr("value", F.lit(len(x) + 1)).alias("value")) for name, x in prefixes.items()}


def file_places(df: DataFrame) -> DataFrame:
    """``df`` with the file, the first byte and the bytes of the split that each row came from."""
    return df.withColumns({"file": F.input_file_name(), "split_start": F.input_file_block_start(), "split_bytes": F.input_file_block_length()})


def as_text(key: Column, value: Column, separator: str = "\t") -> Column:
    return F.concat_ws(separator, key.cast("string"), value.cast("string"))
