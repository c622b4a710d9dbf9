"""Approximate nearest neighbours: anisotropic product quantisation, four-bit scans, exact reranking.

The nearest vector x to a query q has the greatest inner product of (q, 1) and (x, -|x|^2 / 2). Vectors
are coded in subspaces of four components by 16 centres each, two codes a byte. Codes and centres minimise
a score-aware loss: the part of the residual that is parallel to the vector, which moves large inner
products, weighs PARALLEL times the orthogonal part. A scan adds up one table entry for each code and
query, keeps the best of each block of rows, and reranks these exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Components of a subspace, weight of the parallel residual, rows the index is fitted on, rows of a block,
#: rows of a block that are reranked for a query, and queries that are searched at a time.
WIDTH, PARALLEL, SAMPLE, BLOCK, RERANK, QUERIES_AT_ONCE = 4, 4.0, 8192, 4096, 320, 4096
CENTRES = 16


class Quantizer:
    """Centres of each subspace: (subspaces, 16, WIDTH)."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def split(self, x: np.ndarray) -> np.ndarray:
        spaces = self.centres.shape[0]
        return np.pad(x, ((0, 0), (0, spaces * WIDTH - x.shape[1]))).reshape(len(x), spaces, WIDTH)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of least anisotropic loss, by coordinate descent over the subspaces."""
        parts, unit = self.split(x), self.split(_unit(x))
        codes = np.stack([_nearest(parts[:, m], self.centres[m]) for m in range(len(self.centres))], axis=1)
        along = sum(_dot(unit[:, m], parts[:, m] - self.centres[m][codes[:, m]]) for m in range(len(self.centres)))
        for _ in range(rounds):
            for m, centres in enumerate(self.centres):
                r = parts[:, m, None, :] - centres[None]
                side = np.einsum("nw,nkw->nk", unit[:, m], r)
                rest = along - np.take_along_axis(side, codes[:, m, None], 1)[:, 0]
                loss = (r * r).sum(2) + (PARALLEL - 1) * (rest[:, None] + side) ** 2
                codes[:, m] = loss.argmin(1)
                along = rest + np.take_along_axis(side, codes[:, m, None], 1)[:, 0]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of the queries' parts with all centres: (queries, subspaces, 16)."""
        return np.einsum("qmw,mkw->qmk", self.split(queries), self.centres)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("nw,nw->n", a, b)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)


def fit(x: np.ndarray, rounds: int = 8, seed: int = 3) -> Quantizer:
    """Centres from a sample of vectors: plain k-means in each subspace, then alternating codes and the
    weighted least squares that the anisotropic loss asks of each centre."""
    random = np.random.default_rng(seed)
    spaces = -(-x.shape[1] // WIDTH)
    quantizer = Quantizer(np.zeros((spaces, CENTRES, WIDTH)))
    parts, unit = quantizer.split(x), quantizer.split(_unit(x))
    for m in range(spaces):
        centres = parts[random.choice(len(x), CENTRES, replace=len(x) < CENTRES), m].copy()
        for _ in range(rounds):
            codes = _nearest(parts[:, m], centres)
            for c in range(CENTRES):
                if (own := codes == c).any():
                    centres[c] = parts[own, m].mean(0)
        quantizer.centres[m] = centres
    for _ in range(3):
        codes = quantizer.encode(x, rounds=1)
        along = sum(_dot(unit[:, m], parts[:, m] - quantizer.centres[m][codes[:, m]]) for m in range(spaces))
        for m in range(spaces):
            u, p = unit[:, m], parts[:, m]
            rest = along - _dot(u, p - quantizer.centres[m][codes[:, m]])
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    left = np.eye(WIDTH) * own.sum() + (PARALLEL - 1) * u[own].T @ u[own]
                    right = p[own].sum(0) + (PARALLEL - 1) * (u[own] * (_dot(u[own], p[own]) + rest[own])[:, None]).sum(0)
                    quantizer.centres[m, c] = np.linalg.solve(left, right)
            along = rest + _dot(u, p - quantizer.centres[m][codes[:, m]])
    return quantizer


def usable(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not empty, not zero, all components finite, a
    known id."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)


def _pack(codes: np.ndarray) -> np.ndarray:
    wide = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return wide[:, ::2] | wide[:, 1::2] << 4


def build_index(vectors: DataFrame, quantizer: Quantizer, keep: int) -> DataFrame:
    """(block, v, ids, code) for each distinct vector: its codes, and the ``keep`` least ids that hold it.

    More than ``keep`` ids of one vector can't be among the nearest, as ties go to smaller ids; they stay
    represented by the vector. Blocks are by hash, BLOCK rows each on average."""
    ranked = vectors.groupBy("v", "vec_id").agg(F.lit(1).alias("_"))
    # Pre-aggregated in pieces, so copies of one vector don't meet in one task.
    pieces = ranked.withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = _least_ids(pieces, ["v", "_s"], F.array("vec_id"), keep)
    held = written(_least_ids(some, ["v"], F.col("ids"), keep), "vectors")
    blocks = max(1, -(-held.count() // BLOCK))

    def encode(batches):
        for frame in batches:
            x = np.stack(frame["v"].to_numpy()).astype(np.float64)
            frame["code"] = [c.tobytes() for c in _pack(quantizer.encode(x))]
            yield frame

    coded = held.mapInPandas(encode, "v array<double>, ids array<long>, code binary")
    return coded.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))


def _least_ids(rows: DataFrame, by: list[str], ids, keep: int) -> DataFrame:
    if "ids" not in rows.columns:
        inside = Window.partitionBy(*by).orderBy("vec_id")
        rows = rows.withColumn("_k", F.row_number().over(inside)).filter(F.col("_k") <= keep)
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return rows.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list(ids))), 1, keep).alias("ids"))


def scan(frame: pd.DataFrame, query_ids: np.ndarray, queries: np.ndarray, tables: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of one block to each query: by added table entries, then exactly."""
    x = np.stack(frame["v"].to_numpy())
    packed = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1)
    spaces = tables.shape[1]
    half = (x * x).sum(1) / 2
    # Two four-bit codes a byte: one table of 256 sums for each byte and query.
    if spaces % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
    both = (tables[:, ::2, None, :] + tables[:, 1::2, :, None]).reshape(len(tables), -1, 256).astype(np.float32)
    ids = frame["ids"].to_list()
    out = []
    take = min(RERANK, len(x))
    for at, (key, q) in enumerate(zip(query_ids, queries, strict=True)):
        score = np.zeros(len(x), np.float32)
        for j in range(packed.shape[1]):
            score += both[at, j][packed[:, j]]
        score -= half
        some = np.argpartition(-score, take - 1)[:take] if take < len(x) else np.arange(len(x))
        near = np.sqrt(((x[some] - q) ** 2).sum(1))
        # The query itself may be among them, so one more than k; rows of equal distance all stay.
        last = np.partition(near, min(k, take - 1))[min(k, take - 1)]
        close = np.flatnonzero(near <= last)
        rows = sorted((float(near[c]), i) for c in close for i in ids[some[c]] if i != key)
        out += [(key, i, d) for d, i in rows[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", column: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in doubles) of each query's k nearest found.

    A query is never its own candidate. Vectors of another length than the most usual one's count as
    unusable, as do null and zero ones and those with null or non-finite components. The quantiser is
    fitted on the ``sample`` rows of least hash; all rows are indexed. Queries are searched in portions of
    QUERIES_AT_ONCE. An id that repeats with different vectors gives each of them. Empty tables give an
    empty result.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_col, column)
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.filter(F.size("v") == lengths["n"])
    chosen = base.orderBy(F.xxhash64("v"), "vec_id").limit(sample).toPandas()
    quantizer = fit(np.stack(chosen["v"].to_numpy()))
    index = written(build_index(base, quantizer, k + 1).repartition("block"), "index")
    asked = usable(queries, id_col, column).filter(F.size("v") == lengths["n"]).distinct()
    portions, held = [], []

    def search(held: list) -> DataFrame:
        ids = np.array([r["vec_id"] for r in held])
        x = np.array([r["v"] for r in held])
        shared = spark.sparkContext.broadcast((ids, x, quantizer.tables(x)))  # QUERIES_AT_ONCE rows at most

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return scan(frame, *shared.value, k)

        found = index.groupBy("block").applyInPandas(run, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == QUERIES_AT_ONCE:
            portions.append(written(search(held), "found"))
            held = []
    if held:
        portions.append(search(held))
    out = portions[0] if portions else spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    for p in portions[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "rank", "vec_id", "score")


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op5_anisotropic_search": op5_anisotropic_search}
SQL: dict[str, str] = {}
