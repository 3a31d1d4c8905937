"""Vector tables: checking, preparing, foreign files in and out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.operators.knn import knn
from nearfield.sources import formats

WIDTH = {"<f4": 4, "<f2": 2, "i1": 1, "<u4": 4}


def read_vectors(spark: SparkSession, path: str, dim: int, dtype: str = "<f4", n: int | None = None, header: int = 0) -> DataFrame:
    """Flat row-major files -> vec_id, embedding: float32, half or int8 numbers, ids by place from 0. n rows are due if given (padding behind them is passed
    over); a short file is an error. A file must be under 2 GB; each is one task."""
    if dtype not in WIDTH:
        raise ValueError(f"unknown type {dtype}")
    row = dim * WIDTH[dtype]
    as_long = dtype == "<u4"
    schema = f"vec_id long, embedding array<{'long' if as_long else 'float'}>"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                count = n if n is not None else (len(content) - header) // row
                if (len(content) - header) < count * row or (n is None and (len(content) - header) % row):
                    raise ValueError(f"{len(content)} bytes don't hold {count} rows of {dim}")
                data = np.frombuffer(content, dtype, count * dim, header).reshape(count, dim).astype(np.int64 if as_long else np.float32)
                for a in range(0, count, 10_000):
                    part = data[a : a + 10_000]
                    yield pd.DataFrame({"vec_id": np.arange(a, a + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def write_vectors(vectors: DataFrame, path: str, dtype: str = "<f4", header: bool = False) -> str:
    """Rows by vec_id as one flat file on the driver's disk, a partition at a time; returns the SHA-256 of what follows the header.
    A foreign format wants one file; tables stay Parquet."""
    digest, count, dim = hashlib.sha256(), 0, 0
    with Path(path).open("wb") as out:
        if header:
            out.write(b"\0" * 8)
        for row in vectors.select("vec_id", "embedding").orderBy("vec_id").toLocalIterator(prefetchPartitions=False):
            v = np.array(row["embedding"], np.float32)
            data = formats.int8_file(v[None])[: len(v)] if dtype == "i1" else v.astype(dtype).tobytes()
            out.write(data)
            digest.update(data)
            count, dim = count + 1, len(v)
        if header:
            out.seek(0)
            out.write(np.array([count, dim], "<u4").tobytes())
        elif dtype in ("i1", "<f2"):
            out.write(b"\0" * (-out.tell() % 512))
    return digest.hexdigest()


def check_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: rows, bad (null, NaN or of another length), repeated ids and norms. Nothing is dropped."""
    ids = vectors.groupBy("vec_id").agg(F.count("*").alias("c")).agg(F.sum((F.col("c") > 1).cast("long")).alias("repeated"))
    rows = vectors.select(D.valid("embedding", dim).alias("ok"), F.when(D.valid("embedding", dim), D.norm("embedding")).alias("size"))
    return rows.agg(F.count("*").alias("rows"), F.sum((~F.col("ok")).cast("long")).alias("bad"), F.min("size").alias("least_norm"), F.max("size").alias("most_norm"), F.avg("size").alias("mean_norm")).join(F.broadcast(ids))  # one row each


def prepare(raw: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Raw rows (vec_id and a vector) -> normalised vectors; with n only ids under n."""
    rows = raw.select("vec_id", F.transform(D.normalized(column), lambda x: x.cast("float")).alias("embedding"))
    return rows if n is None else rows.where(F.col("vec_id") < n)


def ground_truth(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """qid, gt: ids of the k nearest in order."""
    near = knn(vectors, queries, k, metric)
    return near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("gt"))


def truth_below(truth: DataFrame, n: int) -> DataFrame:
    """Ground truth for the first n vectors: ids from n on go, so rows may get shorter."""
    return truth.withColumn("gt", F.filter("gt", lambda x: x < n))


def load_dataset(spark: SparkSession, folder: str, n: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """meta.txt (total, queries, dim, k), vectors.bin, queries.bin, gt.bin -> vectors, queries, truth."""
    meta = " ".join(r[0] for r in spark.read.text(f"{folder}/meta.txt").collect())
    total, nq, dim, k = (int(x.split("=")[-1]) for x in meta.replace(",", " ").split()[:4])
    vectors = read_vectors(spark, f"{folder}/vectors.bin", dim, n=total)
    queries = read_vectors(spark, f"{folder}/queries.bin", dim, n=nq).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    truth = read_vectors(spark, f"{folder}/gt.bin", k, "<u4", n=nq).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("gt"))
    if n is not None and n < total:
        return vectors.where(F.col("vec_id") < n), queries, truth_below(truth, n)
    return vectors, queries, truth


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated measurements; lines that start with # are comments."""
    return spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("inferSchema", False).csv(path)
