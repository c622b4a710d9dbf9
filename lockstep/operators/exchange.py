"""Dealing rows to partitions, and what peers do with each other's rows."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of a key together, in n partitions."""
    return df.repartition(n, *keys)


def by_function(df: DataFrame, n: int, owner: Column) -> DataFrame:
    """Rows with the peer (0 to n-1) that the whole number ``owner`` gives, dealt by it."""
    return df.withColumn("peer", F.pmod(owner, F.lit(n)).cast("int")).repartition(n, "peer")


def merged(df: DataFrame, partitions: int, peers: int, owner: Column) -> DataFrame:
    """Rows with the peer that merges their partition: partition ``owner`` mod partitions goes to partition mod
    peers, so equal keys stay together when there are fewer peers than partitions."""
    return df.withColumn("peer", F.pmod(F.pmod(owner, F.lit(partitions)), F.lit(peers)).cast("int")).repartition(peers, "peer")


def sorted_partitions(df: DataFrame, n: int, key: str, converted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Dealt and sorted within partitions by the key, or by what it is converted to; rows stay as they are."""
    route = converted(F.col(key)) if converted else F.col(key)
    return df.withColumn("_route", route).repartition(n, "_route").sortWithinPartitions("_route").drop("_route")


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).count()


def combined(messages: DataFrame, to: list[str], amount: str, combine: Callable[[Column], Column] | dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Messages reduced by target, partly before they are shuffled: one combiner, or several by the names of what
    they give."""
    named = combine if isinstance(combine, dict) else {amount: combine}
    return messages.groupBy(*to).agg(*[f(F.col(amount)).alias(n) for n, f in named.items()])


def all_reduce(df: DataFrame, **aggregates: Column) -> dict:
    """One row of totals, known to the driver and so to each later plan."""
    return df.agg(*[c.alias(n) for n, c in aggregates.items()]).first().asDict()
