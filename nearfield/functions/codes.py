"""Scalar codes: int8 (uniform and by dimension) and half precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import as_column


def _finite(x: Column) -> Column:
    """x, with an error where it is null, NaN or infinite."""
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.when(good, x).otherwise(F.raise_error(F.lit("not a finite number in a vector")))


def int8_code(vector: str | Column) -> Column:
    """Components times 127, rounded half away from zero and held within -127 and 127. Null, NaN and infinity are an error."""
    return F.transform(F.transform(as_column(vector), _finite), lambda x: F.greatest(F.least(F.round(x.cast("double") * 127), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def int8_scaled_code(vector: str | Column, scales: str | Column) -> Column:
    """As int8_code after division by each dimension's own scale."""
    return F.zip_with(as_column(vector), as_column(scales), lambda x, s: F.greatest(F.least(F.round(x.cast("double") / s * 127), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def int8_dot(a: str | Column, b: str | Column) -> Column:
    """The codes' negated inner product, in whole numbers."""
    terms = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("long") * y.cast("long"))
    return -F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x)


def dimension_scales(vectors: DataFrame, share: float = 0.999, least: float = 1e-6) -> DataFrame:
    """vectors(embedding) -> pos, scale: for each dimension the absolute value at rank floor(n * share)
    (from 0, n - 1 at most), never under `least`. percentile() counts equal values before the
    shuffle, and asked at rank / (n - 1) it lands on an element."""
    values = vectors.select(F.posexplode(F.transform("embedding", _finite)).alias("pos", "x")).select("pos", F.abs(F.col("x").cast("double")).alias("a"))
    n = vectors.count()
    at = min(int(n * share), n - 1) / (n - 1) if n > 1 else 0.0
    return values.groupBy("pos").agg(F.greatest(F.percentile("a", F.lit(at)), F.lit(least)).alias("scale"))


def half(vectors: DataFrame, column: str = "embedding", to: str = "half") -> DataFrame:
    """Adds the vector in half precision, rounded to even, as little-endian bytes."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: np.asarray(v, np.float32).astype("<f2").tobytes())

    return vectors.withColumn(to, encode(column))


def from_half(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2").astype(np.float32)


def set_index(vid: str | Column, bits: int) -> Column:
    """The cache set of a page by multiplicative hashing with the 32-bit golden ratio (a fixed value)."""
    product = (as_column(vid).cast("long") * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(product, 32 - bits).cast("int")


def aligned_bytes(row: str | Column, row_bytes: int, block: int = 512) -> Column:
    """Bytes that an aligned read of one fixed-size row takes."""
    inner = (as_column(row).cast("long") * row_bytes) % block
    return F.floor((inner + row_bytes + block - 1) / block) * block


def packed_record_bytes(degree: str | Column) -> Column:
    return 2 + 4 * as_column(degree)


def most_inline_degree(code_bytes: int, page: int = 4096, head: int = 8) -> int:
    """Neighbours that fit a page when each comes with its code."""
    return (page - head) // (4 + code_bytes)


def default_queue_depth(cores: int) -> int:
    return max(16, 4 * cores)
