"""Packing: length buckets of least padding, and batches of a token budget inside each.

The histogram of lengths over all rows goes to a dynamic programme that chooses the bucket bounds with
the least padding in all; each row is padded to its bucket's bound. Within a bucket rows are numbered in
a hashed order and each batch takes as many as the budget holds. A row's length is any whole number, such as
the tokens that an encoder counted; words where none is given.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, quoted, table, written

BUCKETS, BUDGET = 12, 65_536


def word_count(text: str = "text") -> Column:
    """Words of a text, runs without ASCII white space; null as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds, ascending and the last the greatest length, of at most ``buckets`` buckets with the least
    sum of count * (bound - length). ``lengths`` ascending and distinct.

    best[j] for k buckets is the least over i of best'[i] + cost(i, j); the cost is Monge, so the best i
    never falls as j grows, and each layer is solved by halving, whatever the number of lengths."""
    m = len(lengths)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * n[1:] - total[1:]
    choice = []
    for _ in range(min(buckets, m) - 1):
        cost, at = _layer(best, lengths, n, total)
        better = cost < best
        choice.append(np.where(better, at, -1))
        best = np.where(better, cost, best)
    out, j = [int(lengths[-1])], m - 1
    for came in reversed(choice):
        if came[j] >= 0:
            j = int(came[j])
            out.append(int(lengths[j]))
    return sorted(set(out))


def _layer(best: np.ndarray, lengths: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least best[i] + cost(i, j) over i < j, and its i. All midpoints of a level at once: each
    has for bounds the choices of its neighbours in the levels before, so a level looks at 2m places at most."""
    m = len(best)
    cost, at = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
    step = 1 << int(m).bit_length()
    while step > 1:
        j = np.arange(step // 2 - 1, m, step)
        left, right = j - step // 2, j + step // 2
        low = np.where(left >= 0, at[np.maximum(left, 0)], 0)
        high = np.minimum(np.where(right < m, at[np.minimum(right, m - 1)], m - 1), j - 1)
        some = high >= low
        at[j[~some]] = low[~some]
        j, low, size = j[some], low[some], (high - low + 1)[some]
        if len(j):
            starts = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(starts - low, size)
            to = np.repeat(j, size)
            value = best[i] + lengths[to] * (n[to + 1] - n[i + 1]) - (total[to + 1] - total[i + 1])
            cost[j] = np.minimum.reduceat(value, starts)
            # The first place of the least value in each range.
            hit = np.flatnonzero(value == np.repeat(cost[j], size))
            at[j] = i[hit[np.searchsorted(hit, starts)]]
        step //= 2
    return cost, at


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """id_col with n_tokens, bucket (from 0), padded_to, batch (from 0 in a bucket), slot (from 0 in a
    batch) and padding.

    ``length``: a column of whole numbers from 0; null counts as 0, as do null texts. A batch holds budget div
    padded_to rows, one at least (with a bound of 0 the budget itself), so only a row that is padded to
    more than the budget has a batch over it; only the last batch of a bucket may hold fewer. What comes to the
    driver is a count for each distinct length. Rows equal in id and length are told apart by number alone. A
    null id is an id like others. An empty table gives an empty result; other columns aren't read.
    """
    n = length if length is not None else word_count()
    # Lengths are worked out once; both passes read these.
    rows = written(docs.select(quoted(id_col).alias("_id"), F.coalesce(n.cast("long"), F.lit(0)).alias("n_tokens")), "lengths")
    histogram = sorted(tuple(r) for r in rows.groupBy("n_tokens").count().collect())
    lengths, counts = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    bounds = best_bounds(lengths, counts, buckets)
    bucket = F.lit(None)
    for k in reversed(range(len(bounds))):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
    placed = rows.withColumn("bucket", bucket.cast("int"))
    counted, _ = numbered(placed, ["_id", "n_tokens"], within="bucket", name="_n")
    known = F.array(*[F.lit(b) for b in bounds or [0]])
    out = counted.withColumn("padded_to", F.get(known, F.col("bucket")).cast("long"))
    out = out.withColumn("_rows", F.greatest(F.lit(1), F.expr(f"{budget} div greatest(padded_to, 1)")).cast("long"))
    return out.select(
        F.col("_id").alias(id_col), "n_tokens", "bucket", "padded_to", F.expr("_n div _rows").alias("batch"),
        F.expr("_n % _rows").alias("slot"), (F.col("padded_to") - F.col("n_tokens")).alias("padding"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
