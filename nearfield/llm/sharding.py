"""Sharding by sampled splitters: shards of nearly equal bytes from key ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import cut

LAW = "bytes"
KEYS = ["k1", "k2", "k3", "k4"]


def quantile_splitters(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Rows of keys (sample, 4) at which the sample's weight passes each of parts - 1 equal steps, in order, each once."""
    order = np.lexsort(keys.T[::-1])
    passed = np.cumsum(weights[order])
    if not len(passed):
        return keys[:0]
    steps = passed[-1] * np.arange(1, parts) / parts
    return np.unique(keys[order[np.minimum(np.searchsorted(passed, steps), len(order) - 1)]], axis=0)


def range_numbers(splitters: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at or below each key. The first column is a hash, so it nearly always decides; rows whose hash a
    splitter has as well are compared whole."""
    low, high = np.searchsorted(splitters[:, 0], columns[0], "left"), np.searchsorted(splitters[:, 0], columns[0], "right")
    out = low.copy()
    for k in np.flatnonzero(low != high):
        key = tuple(c[k] for c in columns)
        out[k] += sum(tuple(s) <= key for s in splitters[low[k] : high[k]])
    return out.astype(np.int32)


def _in_range(splitters: np.ndarray):
    @F.pandas_udf(T.IntegerType())
    def number(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(range_numbers(splitters, [c.to_numpy(np.int64) for c in columns]))

    return number(*KEYS)


def _draw(keys: DataFrame, size: int, weight: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About size keys, each with a chance in proportion to its row's size; a row so large that
    it is certain to be drawn keeps its weight beyond that."""
    step = max(1.0, weight / size)
    unit = F.xxhash64(F.lit(seed), *KEYS).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = keys.where(unit * step < F.col("size")).select(*KEYS, F.greatest("size", F.lit(step)).alias("w")).toPandas()
    return drawn[KEYS].to_numpy(np.int64).reshape(-1, len(KEYS)), drawn["w"].to_numpy(float)


def split_ranges(keys: DataFrame, parts: int, sample_size: int, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """keys(k1 to k4, size, ...), no two rows alike in k1 to k4 -> the splitters, and per range: range, n, bytes.

    Splitters are quantiles of a size-weighted sample of about sample_size keys, which is what the
    driver gets. The ranges are then measured over all rows. Overfull ones (over twice the
    mean) are drawn from again, as densely as their size asks, and subdivided, as often as that parts any of them.
    What stays overfull holds single documents of such a size.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    splitters = quantile_splitters(*_draw(keys, sample_size, total, seed), parts)
    while True:
        numbered = keys.withColumn("range", _in_range(splitters))
        ranges = cut(numbered.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest")))
        heavy = (F.col("bytes") > 2 * total / parts) & (F.col("n") > 1) & (F.col("bytes") > 2 * F.col("largest"))
        over = {r["range"]: r["bytes"] for r in ranges.where(heavy).collect()}  # parts / 2 of them at most
        if not over:
            return splitters, ranges
        seed += 1
        sample, weights = _draw(numbered.where(F.col("range").isin(list(over))), max(sample_size, 8 * len(over)), sum(over.values()), seed)
        place = range_numbers(splitters, list(sample.T))
        more = [splitters, *(quantile_splitters(sample[place == k], weights[place == k], 2 + int(size * parts / total)) for k, size in over.items())]
        more = np.unique(np.concatenate(more), axis=0)
        if len(more) == len(splitters):
            return splitters, ranges
        splitters = more


def shard_documents(docs: DataFrame, shards: int = 16, rows_per_range: int = 250_000, most_ranges: int = 1 << 16, sample_per_range: int = 32, seed: int = 42) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard: one
    row per row of docs.

    The law is `bytes`: all shards have nearly equal sizes (a document's UTF-8 bytes plus
    1; null counts as no bytes), apart by less than the largest document. The key is the text's hash, then
    doc_id, then the text's checksum, so equal texts stand together and only a boundary within their
    range parts them. slot counts a shard's rows from 0 in key order. Rows that repeat id and text
    are separate rows. Null ids sort first. grown_shard is null under this law. Other
    columns are ignored; an empty table gives no rows.

    Rows are never sorted all together: each of 64 ranges a shard, and more of them beyond rows_per_range rows
    each, sorts its own, and the sums before a range come from the measured ranges. There are about most_ranges of them at
    most, so ranges hold more than rows_per_range rows from the product of both on. So is the sample bounded, by sample_per_range
    keys for each range.
    """
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k2"),
    ).withColumn("k3", F.col("text_crc32"))
    keys = cut(keys.withColumn("k4", F.monotonically_increasing_id()))  # tells repeated rows apart
    parts = max(64 * shards, min(most_ranges, keys.count() // rows_per_range))
    splitters, ranges = split_ranges(keys, parts, sample_per_range * parts, seed=seed)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the measured ranges only
    starts = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    total = ranges.agg(F.sum("bytes")).first()[0] or 1
    order = Window.partitionBy("range").orderBy(*KEYS)
    placed = keys.withColumn("range", _in_range(splitters))
    placed = placed.withColumn("k", F.row_number().over(order) - 1).withColumn("b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(F.broadcast(starts), "range")  # a few times `parts` rows, whatever the input
    middle = F.col("bytes_before") + F.col("b") + F.expr("size div 2")
    placed = cut(placed.select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("k")).alias("rank"), F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int").alias("shard")))
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    placed = placed.join(F.broadcast(firsts), "shard")  # one row a shard
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
