"""Joins of several inputs by key: inner, outer and override, nestable, with operators by name.

An input is a frame with the key columns and values; an operator takes inputs in order and gives a frame
with the key, a struct _i of each input's values, and has_i, whether that input has the key in the row.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _leaf(df: DataFrame, key: list[str], i: int) -> DataFrame:
    values = [c for c in df.columns if c not in key]
    return df.select(*key, F.struct(*values).alias(f"_{i}"), F.lit(True).alias(f"has_{i}"))


def inner(*inputs: DataFrame, key: str | list[str]) -> DataFrame:
    """All combinations of the inputs' rows of each key that every input has."""
    keys = [key] if isinstance(key, str) else key
    return reduce(lambda a, b: a.join(b, keys, "inner"), [_leaf(d, keys, i) for i, d in enumerate(inputs)])


def outer(*inputs: DataFrame, key: str | list[str]) -> DataFrame:
    """As ``inner`` over the inputs that have the key; an input without it gives null and has_i false."""
    keys = [key] if isinstance(key, str) else key
    joined = reduce(lambda a, b: a.join(b, keys, "full_outer"), [_leaf(d, keys, i) for i, d in enumerate(inputs)])
    return joined.withColumns({f"has_{i}": F.coalesce(f"has_{i}", F.lit(False)) for i in range(len(inputs))})


def override(*inputs: DataFrame, key: str | list[str]) -> DataFrame:
    """Of each key all rows of the last input that has it. The inputs share their columns.

    The last input of each key is found by a pre-aggregated group, so a key with very many rows is never
    sorted in one task."""
    keys = [key] if isinstance(key, str) else key
    rows = reduce(lambda a, b: a.unionByName(b), [d.withColumn("_place", F.lit(i)) for i, d in enumerate(inputs)])
    last = rows.groupBy(*keys).agg(F.max("_place").alias("_place"))
    return rows.join(last, [*keys, "_place"], "left_semi").drop("_place")


def joined_where(predicate: Callable[[list[Column]], Column]) -> Callable[..., DataFrame]:
    """An operator that keeps the outer join's rows for which predicate([has_0, has_1, ...]) holds."""

    def run(*inputs: DataFrame, key: str | list[str]) -> DataFrame:
        return outer(*inputs, key=key).filter(predicate([F.col(f"has_{i}") for i in range(len(inputs))]))

    return run


def choosing(choose: Callable[[list[Column], list[Column]], Column]) -> Callable[..., DataFrame]:
    """An operator that gives (key, value) with value = choose([_0, _1, ...], [has_0, has_1, ...])."""

    def run(*inputs: DataFrame, key: str | list[str]) -> DataFrame:
        keys = [key] if isinstance(key, str) else key
        n = range(len(inputs))
        return outer(*inputs, key=keys).select(*keys, choose([F.col(f"_{i}") for i in n], [F.col(f"has_{i}") for i in n]).alias("value"))

    return run


OPERATORS: dict[str, Callable[..., DataFrame]] = {"inner": inner, "outer": outer, "override": override}


def define(name: str, operator: Callable[..., DataFrame]) -> None:
    OPERATORS[name] = operator


def compose(name: str, *inputs: DataFrame, key: str | list[str]) -> DataFrame:
    """The operator of a name over inputs, which may be composed ones."""
    if name not in OPERATORS:
        raise ValueError(f"no join operator named {name}")
    return OPERATORS[name](*inputs, key=key)


def lookup(requests: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Each request with its key's features, null where there are none."""
    return requests.join(features, key, "left")


def ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)
