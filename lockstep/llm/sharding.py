"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row number n of N goes to place p = permute(n); shard = p mod shards and slot = p div shards. Anyone can
compute a row's shard and slot from (n, N, seed), and the row of a slot by the inverse; shard sizes
differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import numbered, table, text_bytes

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed & (2**64 - 1))]


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """Applies ``step`` until every value is below n; a cycle that left the range comes back to it."""
    x = step(x)
    while (out := x >= np.uint64(n)).any():
        x[out] = step(x[out])
    return x


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places 0..n-1 of the row numbers 0..n-1: a bijection. The halves run over 0..ceil(sqrt n)-1, so
    fewer than 2 * ceil(sqrt n) of the square's cells lie outside and walks are short."""
    side = np.uint64(max(2, math.isqrt(max(n - 1, 0)) + 1))
    keys = _keys(seed)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x // side, x % side
        for key in keys:
            left, right = right, (left + _mix(right, key) % side) % side
        return left * side + right

    return _walk(rows.astype(np.uint64), n, step).astype(np.int64)


def restore(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row numbers of places: the inverse of ``permute``."""
    side = np.uint64(max(2, math.isqrt(max(n - 1, 0)) + 1))
    keys = _keys(seed)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x // side, x % side
        for key in reversed(keys):
            left, right = (right + side - _mix(left, key) % side) % side, left
        return left * side + right

    return _walk(places.astype(np.uint64), n, step).astype(np.int64)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Columns ``order`` with row_number, shard and slot.

    Row numbers follow the hash bucket and then the values of ``order``, so they depend on the rows and
    not on partitions. Rows equal in ``order`` get numbers of their own. Nulls are values like others; an
    empty table gives an empty result. Columns row_number, shard and slot in ``order`` are an error.
    """
    if clash := {"row_number", "shard", "slot"} & set(order):
        raise ValueError(f"columns by the names of new ones: {sorted(clash)}")
    rows, totals = numbered(df.select(*order), order, buckets=buckets)
    n = totals.agg(F.sum("group_rows")).first()[0] or 0

    @pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    placed = rows.withColumn("_place", place("row_number"))
    return placed.withColumns({
        "shard": F.pmod("_place", F.lit(shards)).cast("int"),
        "slot": F.expr(f"_place div {shards}"),
    }).drop("_place")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_bytes()) + 16).cast("long").alias("size"), F.crc32(text_bytes()).alias("text_crc32")
    )
    return shard_rows(docs, ["doc_id", "size", "text_crc32"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


QUERIES = {"op3_feistel_shards": op3_feistel_shards}
SQL: dict[str, str] = {}
