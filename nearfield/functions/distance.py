"""Vector distances as column expressions, and the same in numpy for blocks of vectors.

Smaller is closer. l2 is squared; cosine is 1 - dot / sqrt(|a|^2 |b|^2), and 1 where a norm is zero; ip is the
negated inner product. Sums run in double from left to right, in either form, so that both
give the same bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = {"l2": "l2", "cosine": "cosine", "ip": "ip", "inner_product": "ip"}


def metric_name(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return METRICS[metric]


def as_column(vector: str | Column | list[float] | np.ndarray) -> Column:
    if isinstance(vector, str):
        return F.col(vector)
    return vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])


def _sum(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    terms = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(as_column(a), as_column(b), lambda x, y: x * y)


def norm_sq(a: str | Column) -> Column:
    return dot(a, a)


def l2(a: str | Column, b: str | Column) -> Column:
    return _sum(as_column(a), as_column(b), lambda x, y: (x - y) * (x - y))


def cosine(a: str | Column, b: str | Column) -> Column:
    product = norm_sq(a) * norm_sq(b)
    return F.when(product == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / F.sqrt(product))


def inner_product(a: str | Column, b: str | Column) -> Column:
    return -dot(a, b)


def distance(metric: str) -> Callable[[str | Column, str | Column], Column]:
    return {"l2": l2, "cosine": cosine, "ip": inner_product}[metric_name(metric)]


def norm(a: str | Column) -> Column:
    return F.sqrt(norm_sq(a))


def normalized(a: str | Column) -> Column:
    """Unit length; a zero vector stays what it is."""
    a = as_column(a)
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def valid(vector: str | Column, dim: int) -> Column:
    """Whether a vector has dim numbers, none of them null, NaN or infinite."""
    v = as_column(vector)
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def probit(p: str | Column) -> Column:
    """The standard normal quantile by the rational approximation 26.2.23 of Abramowitz and Stegun; at
    most -6 and 6 at the ends. Its coefficients are fixed values."""
    p = as_column(p)
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    top = 2.515517 + 0.802853 * tail + 0.010328 * tail * tail
    bottom = 1 + 1.432788 * tail + 0.189269 * tail * tail + 0.001308 * tail * tail * tail
    size = tail - top / bottom
    return F.when(p <= 0, F.lit(-6.0)).when(p >= 1, F.lit(6.0)).when(p == 0.5, F.lit(0.0)).when(p < 0.5, -size).otherwise(size)


# The same over numpy blocks.


def exact_sum(terms: np.ndarray) -> np.ndarray:
    """Sums of the last axis from left to right."""
    if not terms.shape[-1]:
        return np.zeros(terms.shape[:-1])
    columns = np.ascontiguousarray(terms.reshape(-1, terms.shape[-1]).T)
    total = columns[0].copy()
    for column in columns[1:]:
        total += column
    return total.reshape(terms.shape[:-1])


def exact_distance(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of paired rows, in double, bit for bit what the expressions give."""
    q, v = np.asarray(q, np.float64), np.asarray(v, np.float64)
    metric = metric_name(metric)
    if metric == "l2":
        return exact_sum((q - v) * (q - v))
    d = exact_sum(q * v)
    if metric == "ip":
        return -d
    product = exact_sum(q * q) * exact_sum(v * v)
    return np.where(product == 0, 1.0, 1 - d / np.sqrt(np.where(product == 0, 1.0, product)))


def block_distance(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All distances of two blocks by one matrix product: right up to rounding, for choosing candidates."""
    metric, d = metric_name(metric), q @ v.T
    if metric == "ip":
        return -d
    nq, nv = (q * q).sum(1)[:, None], (v * v).sum(1)[None]
    if metric == "l2":
        return np.maximum(nq + nv - 2 * d, 0)
    product = nq * nv
    return np.where(product == 0, 1.0, 1 - d / np.sqrt(np.where(product == 0, 1.0, product)))
