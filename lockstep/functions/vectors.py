"""Vector algebra on ARRAY<DOUBLE> columns, as expressions that Spark compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_length(a: Column, b: Column, what: Column) -> Column:
    return F.when(F.size(a) == F.size(b), what).otherwise(F.raise_error(F.lit("vectors differ in length")))


def _pairwise(a: Column, b: Column, f) -> Column:
    return _same_length(a, b, F.zip_with(a, b, f))


def add(a: Column, b) -> Column:
    return _pairwise(a, b, lambda x, y: x + y) if isinstance(b, Column) else F.transform(a, lambda x: x + F.lit(float(b)))


def subtract(a: Column, b) -> Column:
    return _pairwise(a, b, lambda x, y: x - y) if isinstance(b, Column) else F.transform(a, lambda x: x - F.lit(float(b)))


def subtract_from(a: Column, scalar: float) -> Column:
    return F.transform(a, lambda x: F.lit(float(scalar)) - x)


def multiply(a: Column, b) -> Column:
    return _pairwise(a, b, lambda x, y: x * y) if isinstance(b, Column) else F.transform(a, lambda x: x * F.lit(float(b)))


def divide(a: Column, scalar: float) -> Column:
    return F.transform(a, lambda x: x / F.lit(float(scalar)))


def divide_from(a: Column, scalar: float) -> Column:
    """scalar / x, and 0 where x is 0."""
    return F.transform(a, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.lit(float(scalar)) / x))


def power(a: Column, n: int) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(n)))


def sqrt(a: Column) -> Column:
    return F.transform(a, F.sqrt)


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def rint(a: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.transform(a, F.rint)


def round_half_up(a: Column) -> Column:
    return F.transform(a, lambda x: F.floor(x + F.lit(0.5)).cast("long"))


def ceil(a: Column) -> Column:
    return F.transform(a, lambda x: F.ceil(x).cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def maximum(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(-1.7976931348623157e308))


def minimum(a: Column) -> Column:
    return F.coalesce(F.array_min(a), F.lit(1.7976931348623157e308))


def max_index(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def min_index(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def dot_unchecked(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def dot(a: Column, b: Column) -> Column:
    return _same_length(a, b, dot_unchecked(a, b))


def part(a: Column, start: int, end: int | None = None) -> Column:
    """Components start to end, both included, from 0; with one argument the first ``start``."""
    if end is None:
        start, end = 0, start - 1
    bad = F.raise_error(F.lit("slice outside the vector"))
    return F.when((F.lit(start) >= 0) & (F.lit(end) >= start) & (F.lit(end) < F.size(a)), F.slice(a, start + 1, end - start + 1)).otherwise(bad)


def times_matrix(a: Column, matrix: list[list[float]]) -> Column:
    """Row vector times a matrix small enough to be written into the plan."""
    columns = list(zip(*matrix, strict=True))
    return F.array(*[dot(a, F.array(*[F.lit(float(x)) for x in c])) for c in columns])


def apply(a: Column, f, b: Column | None = None) -> Column:
    return F.transform(a, f) if b is None else _pairwise(a, b, f)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def from_up_to(start: float, end: float, step: float) -> Column:
    n = max(0, int(round((end - start) / step + 0.5)))
    return F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.lit(float(start)) + i * F.lit(float(step)))


def ordered(a: Column) -> Column:
    """(value, index) pairs by value, then index."""
    return F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("value"), i.alias("index"))))


def non_zero(a: Column) -> Column:
    """(index, value) pairs of the components that aren't 0."""
    return F.filter(F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value"))), lambda p: p["value"] != 0)


def dense(size: Column, idx: Column, val: Column) -> Column:
    """A sparse vector's dense form."""
    places = F.map_from_arrays(idx, val)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.element_at(places, i), F.lit(0.0)))


def sparse_dot(idx: Column, val: Column, vector: Column) -> Column:
    return total(F.zip_with(idx, val, lambda i, x: x * F.get(vector, i)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(_pairwise(a, b, lambda x, y: (y - x) * (y - x))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|), with a product of norms of a.b at least; 1 where a norm is 0."""
    d = dot(a, b)
    norms = F.sqrt(dot_unchecked(a, a)) * F.sqrt(dot_unchecked(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - d / F.greatest(norms, d))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


#: Value, and derivative given the output.
ACTIVATIONS = {
    "sigmoid": (sigmoid, lambda y: y * (F.lit(1.0) - y)),
    "tanh": (F.tanh, lambda y: F.lit(1.0) - y * y),
    "identityfunction": (lambda x: x, lambda y: F.lit(1.0)),
    "square": (lambda x: x * x, lambda y: F.lit(2.0) * F.sqrt(y)),
}


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(1e-7)), F.lit(1 - 1e-7))


#: Cost of (target, actual), and its derivative by actual.
COSTS = {
    "squarederror": (lambda t, a: F.lit(0.5) * (t - a) * (t - a), lambda t, a: a - t),
    "crossentropy": (
        lambda t, a: -t * F.log(_clamped(a)) - (F.lit(1.0) - t) * F.log(F.lit(1.0) - _clamped(a)),
        lambda t, a: -t / _clamped(a) + (F.lit(1.0) - t) / (F.lit(1.0) - _clamped(a)),
    ),
}


def function(name: str, kind: dict | None = None):
    """A function by its name in any case; an unknown name is an error."""
    held = {**ACTIVATIONS, **COSTS} if kind is None else kind
    if name.lower() not in held:
        raise ValueError(f"no function named {name}")
    return held[name.lower()]
