"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import cut

#: Edges up to which one task finds the components: 16 bytes each, and no rounds of shuffles.
FEW_EDGES = 1 << 17


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and for each the smallest one that it reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, up = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))  # both are roots
        while (up[up] != up).any():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest(a, b)], names=["node", "label"])

    return cut(edges.coalesce(1).mapInArrow(solve, "node bigint, label bigint"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether any node has a smaller neighbour and another one besides: if none has, the edges are stars around
    the smallest node of each component."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return not both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).where("m < a AND n > 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b), in any direction and with repeats -> labels(node, label): for each node
    that has an edge to another, the smallest node that it reaches.

    Up to FEW_EDGES edges of long nodes are one task's work. With more, alternating large-star and small-star rounds (Kiveris et al., 2014): every round ties
    neighbours to the smallest one seen, so the number of edges never grows and the
    number of rounds follows the logarithm of the longest path. A node's smallest neighbour
    is an aggregate that combines before the shuffle, and joining it back is a join with a
    unique side, which adaptive execution can split where one node has very many edges. Each round is
    checkpointed; the last one is known by its edges' form. Null nodes and self-loops have no effect. An empty input gives no rows.
    """
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges = cut(edges.where(F.col("a") != F.col("b")).select(*pair).distinct())
    if edges.schema["a"].dataType == edges.schema["b"].dataType == T.LongType() and edges.count() <= FEW_EDGES:
        return _in_one_task(edges)
    for _ in range(max_rounds):
        if not _unsettled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = cut(small.where(F.col("a") != F.col("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
