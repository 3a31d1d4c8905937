"""Product quantization: codebooks, codes, lookup tables and distances by lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.operators.knn import Bound, checked, over_blocks, scan_topk, top

CENTROIDS = 256
TRAIN_ROWS = 65_536


def kmeans(data: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from k different rows; ties go to the lower number, an empty cluster keeps its
    centroid, and it ends when no row changes (from the second round on)."""
    data = np.asarray(data, np.float64)
    centroids = data[np.random.default_rng(seed).permutation(len(data))[:k]].copy()
    last = None
    for _ in range(rounds):
        near = _nearest(data, centroids)
        if last is not None and (near == last).all():
            break
        last = near
        count = np.bincount(near, minlength=k)
        for d in range(data.shape[1]):
            total = np.bincount(near, data[:, d], k)
            centroids[:, d] = np.where(count > 0, total / np.maximum(count, 1), centroids[:, d])
    return centroids


def _nearest(data: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, by exact sums among those that rounding leaves open."""
    out = np.empty(len(data), np.int64)
    for a in range(0, len(data), 8192):
        part = data[a : a + 8192]
        rough = D.block_distance("l2", part, centroids)
        m = min(4, len(centroids))
        near = np.sort(np.argpartition(rough, m - 1, axis=1)[:, :m], axis=1)
        exact = D.exact_distance("l2", np.repeat(part, m, 0), centroids[near.ravel()]).reshape(near.shape)
        out[a : a + 8192] = near[np.arange(len(part)), exact.argmin(1)]
    return out


def train(vectors: DataFrame, m: int, rounds: int = 10, seed: int = 42, k: int = CENTROIDS, rows: int = TRAIN_ROWS) -> DataFrame:
    """vectors(vec_id, embedding) -> codebook(m, c, centroid): each of m parts clustered in a task of its own, on at most
    about `rows` vectors drawn by hash of the id (a documented bound)."""
    n = vectors.count()
    dim = len(vectors.select("embedding").first()[0]) if n else 0
    if n < k:
        raise ValueError(f"{n} vectors; a codebook needs {k}")
    if dim % m:
        raise ValueError(f"{dim} dimensions don't divide by {m}")
    width = dim // m
    unit = F.xxhash64(F.lit(seed), "vec_id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = checked(vectors, dim).where(unit < min(1.0, rows / n))
    parts = drawn.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("embedding", i * width + 1, F.lit(width)))).alias("m", "part"))

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(group.sort_values("vec_id")["part"])
        found = kmeans(data, min(k, len(data)), rounds, seed + int(key[0]))
        return pd.DataFrame({"m": int(key[0]), "c": range(len(found)), "centroid": list(found)})

    return parts.groupBy("m").applyInPandas(cluster, "m int, c int, centroid array<double>")


def fixed_codebook(vectors: DataFrame, m: int, k: int = CENTROIDS) -> DataFrame:
    """The parts of vectors 0 to k - 1 as centroids."""
    dim = len(vectors.select("embedding").first()[0])
    width = dim // m
    return vectors.where(F.col("vec_id") < k).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("embedding", i * width + 1, F.lit(width)))).alias("m", "centroid"), F.col("vec_id").cast("int").alias("c")).select("m", "c", "centroid")


def as_array(codebook: DataFrame) -> np.ndarray:
    """(m, k, width): m * k small rows, whatever the number of vectors."""
    rows = codebook.orderBy("m", "c").toPandas()
    m = rows["m"].max() + 1
    flat = np.stack(rows["centroid"].map(lambda v: np.asarray(v, np.float64)))
    return flat.reshape(m, len(rows) // m, -1)


def encode(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, code: for each part the number of the nearest centroid."""
    m, _, width = book.shape

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = np.stack(batch["embedding"]).astype(np.float64)
            found = np.stack([_nearest(data[:, i * width : (i + 1) * width], book[i]) for i in range(m)], 1)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "code": list(found.astype(np.int16))})

    return checked(vectors.select("vec_id", "embedding"), m * width).mapInPandas(codes, "vec_id long, code array<smallint>")


def tables(queries: np.ndarray, book: np.ndarray, metric: str = "l2") -> np.ndarray:
    """(queries, m, k): the distance (or inner product) of each query's part to each centroid."""
    m, k, width = book.shape
    parts = queries.reshape(len(queries), m, 1, width)
    terms = (parts - book[None]) ** 2 if D.metric_name(metric) == "l2" else parts * book[None]
    return D.exact_sum(terms)


def lookup_tables(queries: DataFrame, book: np.ndarray, metric: str = "l2") -> DataFrame:
    """queries(qid, qvec) -> qid, lut: m * k numbers, that of centroid c of part m at m * k + c."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lut = tables(np.stack(batch["qvec"]).astype(np.float64), book, metric)
            yield pd.DataFrame({"qid": batch["qid"], "lut": list(lut.reshape(len(batch), -1))})

    return queries.mapInPandas(build, "qid long, lut array<double>")


def adc_knn(codes: DataFrame, queries: DataFrame, book: np.ndarray, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest by table lookups: sums of squared parts for l2; for ip and cosine (of unit vectors) the sum
    of inner products, negated or taken from 1."""
    metric = D.metric_name(metric)
    m, size, _ = book.shape

    def score(total: np.ndarray) -> np.ndarray:
        return total if metric == "l2" else -total if metric == "ip" else 1 - total

    def bind(part: np.ndarray) -> Bound:
        """A query's handle is its place in the lookup tables, which only these queries have in memory."""
        lut = tables(part, book, metric).reshape(len(part), -1)

        def rough(handles: np.ndarray, code: np.ndarray) -> np.ndarray:
            total = np.zeros((len(lut), len(code)))
            for i in range(m):
                total += lut[:, i * size + code[:, i].astype(np.int64)]
            return score(total)

        def exact(handles: np.ndarray, code: np.ndarray) -> np.ndarray:
            return score(D.exact_sum(lut[handles, np.arange(m) * size + code.astype(np.int64)]))

        return np.arange(len(part))[:, None], rough, exact, 1e-9

    return top(over_blocks(queries, lambda qids, qs: scan_topk(codes, qids, qs, k, bind)), k)
