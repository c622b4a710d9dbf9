"""Learning loops: k-means, gradient descent, layered networks, autoencoder, collaborative filtering."""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import vectors as V
from ..plans.storage import dealt, written


def _array(x) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def nearest_centre(vec: Column, centres: list[list[float]], distance: Callable[[Column, Column], Column] = V.euclidean) -> Column:
    """The index of the nearest centre, the lowest of equals."""
    away = F.array(*[distance(vec, _array(c)) for c in centres])
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def kmeans(rows: DataFrame, centres: list[list[float]], max_iterations: int = 10, vec: str = "vec", distance=V.euclidean) -> list[list[float]]:
    """Centres after up to max_iterations + 1 rounds, or when none moves. A centre without rows stays.

    Each round is one pre-aggregated group by centre; what comes back is a row for each centre."""
    now = [list(map(float, c)) for c in centres]
    dims = len(now[0])
    rows = written(rows.select(vec), "points")  # what each round reads
    done = 0
    while True:
        found = rows.select(nearest_centre(F.col(vec), now, distance).alias("c"), F.col(vec).alias("v")).groupBy("c").agg(F.count("*").alias("n"), *[F.sum(F.get("v", j)).alias(f"s{j}") for j in range(dims)]).collect()
        new = [list(c) for c in now]
        for r in found:
            new[r["c"]] = [r[f"s{j}"] / r["n"] for j in range(dims)]
        moved = any(abs(a - b) > 0 for x, y in zip(now, new, strict=True) for a, b in zip(x, y, strict=True))
        now = new
        done += 1
        if not moved or (max_iterations > 0 and done > max_iterations):
            return now


def first_centres(rows: DataFrame, k: int, order: str, vec: str = "vec") -> list[list[float]]:
    return [list(r[0]) for r in rows.orderBy(order).limit(k).select(vec).collect()]


def assigned(rows: DataFrame, centres: list[list[float]], vec: str = "vec", distance=V.euclidean) -> DataFrame:
    return rows.withColumn("centre", nearest_centre(F.col(vec), centres, distance))


def linear_hypothesis(theta: Column, x: Column) -> Column:
    return V.dot(theta, x)


def linear_cost(h: Column, y: Column, m: int, legacy: bool = False) -> Column:
    """(h - y)^2 / 2m; ``legacy`` multiplies by y."""
    cost = F.pow(h - y, 2) / (2.0 * m)
    return y * cost if legacy else cost


def logistic_hypothesis(theta: Column, x: Column) -> Column:
    return F.least(V.sigmoid(V.dot(theta, x)), F.lit(1 - 1e-16))


def logistic_cost(h: Column, y: Column, m: int) -> Column:
    # A logarithm of 0 is null here, and a sum would leave the row out: the least double stands for it.
    return (y * F.log(F.greatest(h, F.lit(5e-324))) + (F.lit(1.0) - y) * F.log(F.greatest(F.lit(1.0) - h, F.lit(1e-300)))) / (-float(m))


MODELS = {"linear": (linear_hypothesis, linear_cost), "logistic": (logistic_hypothesis, logistic_cost)}


def gradient_descent(rows: DataFrame, model="linear", alpha: float = 0.003, threshold: float = 0.1, max_iterations: int = 10_000, initial: float = 1.0,
                     label: str = "label", vec: str = "vec", transform: Callable[[Column], Column] | None = None, strict: bool = True) -> tuple[list[float], list[tuple[int, list[float], float]]]:
    """(theta, trace of (round, theta, cost)): theta falls by alpha times the summed gradient.

    It ends at a cost of 0, one under ``threshold``, or after ``max_iterations`` rounds; a cost that rises
    after the first round is an error if ``strict``."""
    hypothesis, cost = MODELS[model] if isinstance(model, str) else model
    x = transform(F.col(vec)) if transform else F.col(vec)
    data = written(rows.select(F.col(label).cast("double").alias("y"), x.alias("x")), "examples")  # what each round reads
    first = data.select(F.size("x").alias("d")).first()
    if first is None:
        return [], []
    m = data.count()
    theta, trace, before = [float(initial)] * first["d"], [], None
    for number in range(max_iterations):
        h = hypothesis(_array(theta), F.col("x"))
        got = data.withColumn("h", h).agg(F.sum(cost(F.col("h"), F.col("y"), m)).alias("cost"), *[F.sum((F.col("h") - F.col("y")) * F.get("x", j)).alias(f"g{j}") for j in range(len(theta))]).first()
        trace.append((number, list(theta), got["cost"]))
        if strict and before is not None and got["cost"] > before:
            raise RuntimeError(f"the cost rises: {before} to {got['cost']}")
        if got["cost"] == 0 or got["cost"] < threshold:
            break
        before = got["cost"]
        theta = [t - alpha * got[f"g{j}"] for j, t in enumerate(theta)]
    return theta, trace


_ACT = {
    "sigmoid": (lambda x: 1 / (1 + np.exp(-x)), lambda y: y * (1 - y)), "tanh": (np.tanh, lambda y: 1 - y * y),
    "identityfunction": (lambda x: x, np.ones_like),
}
_COST = {
    "squarederror": lambda t, a: a - t,
    "crossentropy": lambda t, a: (np.clip(a, 1e-7, 1 - 1e-7) - t) / (np.clip(a, 1e-7, 1 - 1e-7) * (1 - np.clip(a, 1e-7, 1 - 1e-7))),
}


class LayeredNetwork:
    """Sizes and activations of layers; each but the last has a bias unit. Weights are (to, 1 + from)."""

    def __init__(self, sizes: list[int], activations: list[str], cost: str = "SquaredError", rate: float = 0.1, momentum: float = 0.0, decay: float = 0.0, unsupervised: bool = False, seed: int = 1):
        self.sizes, self.cost, self.rate, self.momentum, self.decay, self.unsupervised = sizes, cost.lower(), rate, momentum, decay, unsupervised
        self.activations = [a.lower() for a in activations]
        for a in self.activations:
            if a not in _ACT:
                raise ValueError(f"no function named {a}")
        if self.cost not in _COST:
            raise ValueError(f"no function named {cost}")
        random = np.random.default_rng(seed)
        self.weights = [random.uniform(-0.5, 0.5, (b, a + 1)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.last = [np.zeros_like(w) for w in self.weights]

    def forward(self, x: np.ndarray, bias: float = 1.0) -> list[np.ndarray]:
        """Outputs of all layers of rows x, the input's first."""
        outs = [x]
        for w, a in zip(self.weights, self.activations, strict=True):
            outs.append(_ACT[a][0](np.hstack([np.full((len(outs[-1]), 1), bias), outs[-1]]) @ w.T))
        return outs

    def gradients(self, x: np.ndarray, y: np.ndarray, outs: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Summed gradients of rows, of whose layers ``outs`` are the outputs if known; each delta uses the derivative
        of its own layer's activation."""
        outs = self.forward(x) if outs is None else outs
        delta = (_COST[self.cost](y, outs[-1]) + self.decay * self.weights[-1].sum(1)) * _ACT[self.activations[-1]][1](outs[-1])
        grads = []
        for k in reversed(range(len(self.weights))):
            grads.insert(0, delta.T @ np.hstack([np.ones((len(outs[k]), 1)), outs[k]]))
            if k:
                back = delta @ self.weights[k][:, 1:] + self.decay * self.weights[k - 1].sum(1)
                delta = back * _ACT[self.activations[k - 1]][1](outs[k])
        return grads

    def step(self, grads: list[np.ndarray], n: int) -> None:
        for k, g in enumerate(grads):
            self.last[k] = -self.rate * g / max(n, 1) + self.momentum * self.last[k]
            self.weights[k] = self.weights[k] + self.last[k]

    def train_online(self, x: np.ndarray, y: np.ndarray) -> None:
        for a, b in zip(x, y, strict=True):
            self.step(self.gradients(a[None], b[None]), 1)

    def train(self, rows: DataFrame, rounds: int, batch: int = 50, vec: str = "vec", check_every: int = 0, tolerance: float = 1e-6, seed: int = 1) -> list[float]:
        """Rounds of parallel training: each partition sums the gradients of about ``batch`` of its rows (0: all), the
        sums are added up by Spark, and one step of their mean follows. The tail of ``vec`` is the label, or
        the whole of it when unsupervised. Every ``check_every`` rounds the mean cost is compared; the list of
        these costs is returned."""
        d, out = self.sizes[0], self.sizes[-1]
        data = written(rows.select(F.col(vec).cast("array<double>").alias("v")), "training")
        n, parts = data.count(), max(1, data.rdd.getNumPartitions())
        share = min(1.0, batch * parts / max(n, 1)) if batch else 1.0
        costs: list[float] = []
        for number in range(rounds):
            shared = self

            def run(batches):
                total, seen, error = None, 0, 0.0
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    v = _matrix(batch.column(0))
                    x = v[:, :d]
                    y = x if shared.unsupervised else v[:, d : d + out]
                    outs = shared.forward(x)
                    g = shared.gradients(x, y, outs)
                    error += float(((outs[-1] - y) ** 2).sum())
                    total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
                    seen += len(v)
                if total is not None:
                    flat = np.concatenate([[seen, error], *[g.ravel() for g in total]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["j", "x"])

            some = data if share >= 1 else data.sample(False, share, seed + number)
            sums = some.mapInArrow(run, "j int, x double").groupBy("j").agg(F.sum("x").alias("x")).orderBy("j").collect()
            if not sums:
                continue
            flat = np.array([r["x"] for r in sums])
            grads, at = [], 2
            for w in self.weights:
                grads.append(flat[at : at + w.size].reshape(w.shape))
                at += w.size
            self.step(grads, int(flat[0]))
            if check_every and (number + 1) % check_every == 0:
                costs.append(flat[1] / flat[0])
                if len(costs) > 1 and abs(costs[-2] - costs[-1]) < tolerance:
                    break
        return costs

    def predict(self, rows: DataFrame, vec: str = "vec") -> DataFrame:
        """``rows`` with output, the last layer's values."""
        shared, d = self, self.sizes[0]

        out = StructType([*rows.schema.fields, StructField("output", ArrayType(DoubleType()))])
        arrow, at = to_arrow_schema(out), rows.columns.index(vec)

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(at))[:, :d] if batch.num_rows else np.zeros((0, d))
                got = shared.forward(x)[-1]
                ends = pa.array(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32))
                made = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(got).ravel()))
                columns = [c.cast(t.type) for c, t in zip([*batch.columns, made], arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return rows.mapInArrow(run, out)

    def settings(self) -> dict:
        return {"sizes": self.sizes, "activations": self.activations, "cost": self.cost, "rate": self.rate, "momentum": self.momentum, "decay": self.decay, "unsupervised": self.unsupervised}


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a column of a batch, as a matrix without a Python object for each."""
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) % len(column) or len(set(column.value_lengths().unique().to_pylist())) > 1:
        raise ValueError("vectors are null, hold nulls or differ in length")
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def linear_network(d: int, **more) -> LayeredNetwork:
    return LayeredNetwork([d, 1], ["IdentityFunction"], "SquaredError", **more)


def logistic_network(d: int, **more) -> LayeredNetwork:
    return LayeredNetwork([d, 1], ["Sigmoid"], "CrossEntropy", **more)


class AutoEncoder(LayeredNetwork):
    def __init__(self, d: int, hidden: int, **more):
        super().__init__([d, hidden, d], ["Sigmoid", "Sigmoid"], "SquaredError", unsupervised=True, **more)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[1]

    def decode(self, h: np.ndarray) -> np.ndarray:
        return _ACT["sigmoid"][0](np.hstack([np.ones((len(h), 1)), h]) @ self.weights[1].T)


#: Ratings of a cell, on average at most.
CELL = 4_000_000


def factorize(ratings: DataFrame, rank: int = 10, rounds: int = 20, rate: float = 0.01, seed: int = 1, initial: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(users, items) with factors: (user, vec) and (item, vec), from (user, item, rating).

    Ratings lie in cells, by blocks of users and of items, and stay there. In a round the factors are sent to the
    cells of their block, every rating gives both sides a correction of 2 * rate * error * other, and each cell
    sends back one sum for each user and item that it holds. A cell of more than CELL ratings is divided, so neither
    a busy user nor a popular item fills a task. A sum of n > 8 corrections is scaled by 8/n. Factors
    begin as hashes from 0 to 1, or as the (users, items) of ``initial``, such as those of an earlier run."""
    data = ratings.select("user", "item", F.col("rating").cast("double").alias("rating"))
    blocks = max(4, math.ceil(math.sqrt(data.count() / CELL)))

    def block(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks))

    at = F.struct(block("user").alias("p"), block("item").alias("q"))
    counted = written(data.groupBy(at.alias("_at")).agg(F.ceil(F.count("*") / CELL).alias("_k")).select("_at.*", "_k"), "cells")
    number = ((F.col("p") * blocks + F.col("q")) * (1 << 20)).alias("cell")
    placed = data.withColumns({"p": block("user"), "q": block("item")}).join(F.broadcast(counted), ["p", "q"])
    cells = dealt(placed.select((number + F.pmod(F.xxhash64("user", "item"), F.col("_k"))).alias("cell"), "user", "item", "rating"), "ratings", "cell")
    pieces = F.broadcast(counted.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).select("p", "q", (number + F.col("_s")).alias("cell")))
    kinds = {key: data.schema[key].dataType for key in ("user", "item")}

    def begin(key: str, salt: int) -> DataFrame:
        draw = F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.lit(j), F.col(key)), F.lit(1 << 20)) / float(1 << 20) for j in range(rank)])
        return cells.select(key).distinct().withColumn("vec", draw)

    users, items = (begin("user", 1), begin("item", 2)) if initial is None else initial
    none = {key: F.lit(None).cast(kinds[key]).alias(key) for key in kinds}
    state = written(users.select(F.lit(0).alias("side"), F.col("user").cast(kinds["user"]), none["item"], "vec").unionByName(
        items.select(F.lit(1).alias("side"), none["user"], F.col("item").cast(kinds["item"]), "vec")), "factors")
    made = StructType([StructField("side", IntegerType()), *[StructField(k, t) for k, t in kinds.items()], StructField("n", LongType()), StructField("c", ArrayType(DoubleType()))])
    keys = ["side", "user", "item"]
    for _ in range(rounds):
        # Both sides are corrected by the factors before the round.
        sent = [state.filter(F.col("side") == i).withColumn(place, block(key)).join(pieces, place).select("cell", *keys, "vec") for i, (place, key) in enumerate((("p", "user"), ("q", "item")))]
        change = cells.groupBy("cell").cogroup(sent[0].unionByName(sent[1]).groupBy("cell")).applyInArrow(_corrections(rate, rank, to_arrow_schema(made)), made)
        n = F.sum("n")
        # Summed up to 8 ratings, averaged times 8 beyond: a popular item must not overshoot.
        damp = F.when(n > 8, F.lit(8.0) / n).otherwise(F.lit(1.0))
        change = change.groupBy(*keys).agg(F.array(*[F.sum(F.get("c", j)) * damp for j in range(rank)]).alias("_c")).toDF(*[f"_{k}" for k in keys], "_c")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        state = written(state.join(change, same, "left").select(*keys, F.when(F.col("_c").isNull(), F.col("vec")).otherwise(V.add(F.col("vec"), F.col("_c"))).alias("vec")), "factors")
    return state.filter("side = 0").select("user", "vec"), state.filter("side = 1").select("item", "vec")


def _corrections(rate: float, rank: int, schema: pa.Schema):
    """From a cell's ratings and the factors of its users and items: each one's ratings and summed corrections."""

    def run(rated: pa.Table, factors: pa.Table) -> pa.Table:
        ids, vectors, places = [], [], []
        for side, key in enumerate(("user", "item")):
            own = factors.filter(pc.equal(factors["side"], side))
            ids.append(own[key].combine_chunks())
            vectors.append(own["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank))
            place = pc.index_in(rated[key], value_set=ids[side], skip_nulls=True)
            places.append(pc.fill_null(place, -1).to_numpy())
        met = (places[0] >= 0) & (places[1] >= 0)
        u, i = places[0][met], places[1][met]
        error = rated["rating"].to_numpy()[met]
        for j in range(rank):
            error = error - vectors[0][u, j] * vectors[1][i, j]
        error = np.where(np.isnan(error) & rated["rating"].is_null().to_numpy()[met], 0.0, 2 * rate * error)
        out = []
        for side, (own, other) in enumerate(((u, i), (i, u))):
            count = np.bincount(own, minlength=len(ids[side]))
            sums = np.stack([np.bincount(own, error * vectors[1 - side][other, j], minlength=len(ids[side])) for j in range(rank)], axis=1)
            some = np.flatnonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * rank + 1, rank, dtype=np.int32)), pa.array(sums[some].ravel()))
            known = ids[side].take(pa.array(some))
            columns = {"side": pa.array(np.full(len(some), side, np.int32)), "user": pa.nulls(len(some)), "item": pa.nulls(len(some)), "n": pa.array(count[some])} | {("user", "item")[side]: known, "c": lists}
            out.append(pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema))
        return pa.concat_tables(out)

    return run


def estimated(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user, item, estimate) of pairs; 0 where either is unknown."""
    got = pairs.join(users.withColumnRenamed("vec", "_u"), "user", "left").join(items.withColumnRenamed("vec", "_i"), "item", "left")
    return got.select("user", "item", F.coalesce(V.dot_unchecked(F.col("_u"), F.col("_i")), F.lit(0.0)).alias("estimate"))


def preferred_items(users: DataFrame, items: DataFrame, user: int, n: int) -> DataFrame:
    """The n items of greatest estimate for one user, ties to the smaller id."""
    own = users.filter(F.col("user") == user).select("vec").first()
    if own is None:
        return items.select("item", F.lit(0.0).alias("estimate")).limit(0)
    return items.select("item", V.dot_unchecked(F.col("vec"), _array(own[0])).alias("estimate")).orderBy(F.desc("estimate"), "item").limit(n)


def similarity(side: DataFrame, key: str, a: int, b: int) -> float:
    """Euclidean distance of two factors; the greatest double where one is unknown."""
    got = {r[key]: r["vec"] for r in side.filter(F.col(key).isin(a, b)).collect()}
    return float(np.linalg.norm(np.array(got[a]) - np.array(got[b]))) if a in got and b in got else 1.7976931348623157e308


def most_similar(side: DataFrame, key: str, of: int, n: int) -> DataFrame:
    """The n nearest of the others, ties to the smaller id."""
    own = side.filter(F.col(key) == of).select("vec").first()
    if own is None:
        return side.select(key, F.lit(0.0).alias("distance")).limit(0)
    return side.filter(F.col(key) != of).select(key, V.euclidean(F.col("vec"), _array(own[0])).alias("distance")).orderBy("distance", key).limit(n)


def save_factors(users: DataFrame, items: DataFrame, path: str) -> None:
    users.write.mode("error").parquet(f"{path}/users")
    items.write.mode("error").parquet(f"{path}/items")


def load_factors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users, items) as ``save_factors`` left them."""
    return spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items")
