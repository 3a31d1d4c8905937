"""Search budgets by query: how the distances of a query should be distributed, and how near its seeds lie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.operators.knn import SLICE_QUERIES, checked, over_blocks

BINS, STEP = 5, 0.001


def dimension_stats(vectors: DataFrame) -> DataFrame:
    """vectors(embedding) -> pos, mean, variance (of the sample) of the normalised components. One vector has no variance, an error."""
    rows = checked(vectors).select(F.posexplode(D.normalized("embedding")).alias("pos", "x"))
    found = rows.groupBy("pos").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    return found.withColumn("variance", F.coalesce("variance", F.raise_error(F.lit("statistics need two vectors")).cast("double")))


def distance_params(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """queries(qid, qvec) -> qid, mu, sigma: the mean and spread of cosine distance that the statistics foretell; 1 and 0.01 for
    a zero vector. stats has one row per dimension and is a broadcast."""
    rows = queries.select("qid", D.norm("qvec").alias("size"), F.posexplode(D.normalized("qvec")).alias("pos", "x"))
    sums = rows.join(F.broadcast(stats), "pos").groupBy("qid").agg(F.max("size").alias("size"), F.sum(F.col("x") * F.col("mean")).alias("m"), F.sum(F.col("x") * F.col("x") * F.col("variance")).alias("v"))
    zero = F.col("size") < 1e-12
    return sums.select("qid", F.when(zero, 1.0).otherwise(1 - F.col("m")).alias("mu"), F.when(zero, 0.01).otherwise(F.sqrt(F.greatest("v", F.lit(1e-18)))).alias("sigma"))


def thresholds(mu: Column, sigma: Column) -> list[Column]:
    return [mu + sigma * D.probit(F.lit(STEP * i)) for i in range(1, BINS + 1)]


def difficulty(vectors: DataFrame, queries: DataFrame, params: DataFrame) -> DataFrame:
    """qid, score: each cosine distance from the query to a seed counts in the lowest of five bins that holds it, bin i of weight
    100 e^(1 - i); score is the weighted count by the number of seeds. Vectors pass once, in blocks, and send counts."""
    ends = params.select("qid", F.array(*thresholds(F.col("mu"), F.col("sigma"))).alias("ends"))
    bound = {r["qid"]: r["ends"] for r in ends.collect()}  # five numbers for each of the queries, which a pass takes along anyway

    def near(qids: np.ndarray, qs: np.ndarray) -> DataFrame:
        limits = np.array([bound[q] for q in qids.tolist()])

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros((len(qids), BINS), np.int64), 0
            for batch in batches:
                block = np.stack(batch["embedding"]).astype(np.float64)
                for a in range(0, len(qids), SLICE_QUERIES):
                    d, ends = D.block_distance("cosine", qs[a : a + SLICE_QUERIES], block), limits[a : a + SLICE_QUERIES]
                    at_most = np.stack([(d <= ends[:, [i]]).sum(1) for i in range(BINS)], 1)
                    total[a : a + SLICE_QUERIES] += np.diff(at_most, axis=1, prepend=0)
                n += len(batch)
            yield pd.DataFrame({"qid": qids, "counts": list(total), "n": n})

        return checked(vectors, qs.shape[1]).select("embedding").mapInPandas(count, "qid long, counts array<long>, n long")

    found = over_blocks(queries, near, "qid long, counts array<long>, n long")
    sums = found.groupBy("qid").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(BINS)], F.sum("n").alias("n"))
    score = sum((F.col(f"c{i}") * (100 * math.exp(-i)) for i in range(BINS)), F.lit(0.0)) / F.col("n")
    return sums.select("qid", score.alias("score"))


def lookup(scores: DataFrame, rows: list[tuple[float, int, int, int]], floor: tuple[int, int, int]) -> DataFrame:
    """scores(qid, score, ...) with ef, stall, drain of the highest threshold at or below the score; floor below all."""
    names = ("ef", "stall", "drain")
    out = scores
    for k, name in enumerate(names):
        value = F.lit(floor[k])
        for threshold, *params in sorted(rows):
            value = F.when(F.col("score") >= threshold, F.lit(params[k])).otherwise(value)
        out = out.withColumn(name, value)
    return out
