"""Exact k-nearest neighbours, and re-ranking of candidates from cheaper distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import distance as D

#: Bytes of queries that one pass over the vectors takes along; more queries take more passes.
QUERY_BYTES = 16 << 20
FEW = 512
#: Numbers that a slice of exact distances holds, about; queries that a slice of a full matrix takes.
SLICE, SLICE_QUERIES = 1 << 20, 512
#: Distances that a scan holds of a batch at a time.
PANEL = 1 << 20
#: Rows of a scan's first block.
FIRST_ROWS = 512

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Handles, rough and exact distances, and how far the rough ones may be off.
Bound = tuple[np.ndarray, Kernel, Kernel, float]


def queries_from(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The stated query set: vectors whose id is divisible by `every`."""
    return vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def query_blocks(queries: DataFrame, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """queries(qid, qvec) as arrays in order of qid, in as many parts as the limit (QUERY_BYTES) asks for; none for no
    queries. A few queries come in one job."""
    asked = checked(queries.select("qid", "qvec"), None, "qvec", "qid")
    few = asked.limit(FEW + 1).toPandas()
    if not len(few):
        return
    parts = 1
    if len(few) > FEW:
        parts = -(-asked.count() * len(few["qvec"][0]) * 8 // (limit or QUERY_BYTES))
    for part in range(parts):
        rows = few
        if len(few) > FEW:
            rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).toPandas()
        rows = rows.sort_values("qid")
        if len(rows):
            yield rows["qid"].to_numpy(np.int64), np.stack(rows["qvec"].map(lambda v: np.asarray(v, np.float64)))


def top(found: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, distance) -> the k nearest of each query with their rank; ties go to the smaller id."""
    order = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _candidates(part: np.ndarray, block: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int, exact: Kernel, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Per query the rows whose rough distance lies within rounding of the k-th, ties too, with their exact distances. Where ties are
    many, a query's are scored in slices and its k best kept."""
    kth = np.partition(d, k - 1, axis=1)[:, [k - 1]]
    close = d <= kth + slack * (1 + np.abs(np.where(np.isinf(kth), 0, kth)))
    count = close.sum(1)
    few = 4 * k + 16
    m = int(count[count <= few].max(initial=k))
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    fine = np.empty(near.shape)
    step = max(1, SLICE // max(1, m * block.shape[1]))
    for a in range(0, len(part), step):
        some = near[a : a + step]
        fine[a : a + step] = exact(np.repeat(part[a : a + step], m, 0), block[some.ravel()]).reshape(some.shape)
    for q in np.flatnonzero(count > few):
        at, step = np.flatnonzero(close[q]), max(1, SLICE // block.shape[1])
        scored = np.concatenate([exact(np.repeat(part[[q]], len(x), 0), block[x]) for x in (at[a : a + step] for a in range(0, len(at), step))])
        best = np.lexsort((ids[at], scored))[:k]
        near[q], fine[q] = at[best[0]], np.inf
        near[q, : len(best)], fine[q, : len(best)] = at[best], scored[best]
    fine[np.isinf(np.take_along_axis(d, near, 1))] = np.inf
    return near, fine


def _sorted(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by distance and then id."""
    order = np.lexsort((ids, distances), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(distances, order, 1)


def keep_best(held: tuple[np.ndarray, np.ndarray], first: int, ids: np.ndarray, d: np.ndarray, k: int) -> None:
    """Merges final distances d of ids to the queries from `first` on into held: those of a query that lie beyond its k-th so far
    are passed over, and of the others the k best, ties by id, stay."""
    mine = held[0][first : first + len(d)], held[1][first : first + len(d)]
    worst = mine[1][:, -1].copy()
    if d.shape[1] > k:
        worst = np.minimum(worst, np.partition(d, k - 1, axis=1)[:, k - 1]) if np.isinf(worst).any() else worst
    close = d <= worst[:, None]
    for q in np.flatnonzero(close.any(1)).tolist():
        at = np.flatnonzero(close[q])
        both_ids, both = np.concatenate([mine[0][q], ids[at]]), np.concatenate([mine[1][q], d[q, at]])
        order = np.lexsort((both_ids, both))[:k]
        mine[0][q], mine[1][q] = both_ids[order], both[order]


def _below(handles: np.ndarray, block: np.ndarray, ids: np.ndarray, close: np.ndarray, held: tuple[np.ndarray, np.ndarray], k: int, exact: Kernel) -> None:
    """Scores the close pairs exactly, a bounded number at a time, and merges them into held."""
    at, cols = np.divmod(np.flatnonzero(close), close.shape[1])
    step = max(1, SLICE // max(1, block.shape[1]))
    for a in range(0, len(at), step):
        q, j = at[a : a + step], cols[a : a + step]
        some, first, count = np.unique(q, return_index=True, return_counts=True)
        place = np.arange(len(q)) - np.repeat(first, count)
        fine = exact(handles[q], block[j])
        # queries with about as many new pairs together, so that what is padded stays small
        size = 1 << np.ceil(np.log2(count)).astype(int)
        for width in np.unique(size).tolist():
            mine = np.flatnonzero(size == width)
            row = np.full(len(some), -1)
            row[mine] = np.arange(len(mine))
            part = np.repeat(row, count)
            own = part >= 0
            new_ids, new = np.zeros((len(mine), width), np.int64), np.full((len(mine), width), np.inf)
            new_ids[part[own], place[own]], new[part[own], place[own]] = ids[j[own]], fine[own]
            to = some[mine]
            held[0][to], held[1][to] = _sorted(np.concatenate([held[0][to], new_ids], 1), np.concatenate([held[1][to], new], 1), k)


def _growing(batches: Iterator[pd.DataFrame], first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and codes of batches in blocks, the first ones small and each twice as large as the one before: what they find bounds
    what the others have to score."""
    most = first
    for batch in batches:
        ids, codes, at = batch["vec_id"].to_numpy(np.int64), np.stack(batch["code"]), 0
        while at < len(ids):
            yield ids[at : at + most], codes[at : at + most]
            at, most = at + most, 2 * most


def scan_topk(codes: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int, bind: Callable[[np.ndarray], Bound], no_self: bool = False, bounds: np.ndarray | None = None) -> DataFrame:
    """codes(vec_id, code) against all queries, a block at a time. bind(some of queries) -> a handle for each of them, rough distances of handles
    by one matrix product, exact ones of paired rows, and how far rough ones may be off: rough ones choose the candidates (all that lie
    within rounding of the k-th so far, ties too), exact ones rank them. A partition sends its best k per query, with bounds only those within
    its bound. A worker holds k rows per query and about PANEL distances."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(qids), k), np.int64), np.full((len(qids), k), np.inf)
        for ids, block in _growing(batches, max(FIRST_ROWS, 2 * k)):
            step = max(1, min(SLICE_QUERIES, PANEL // len(ids)))
            for a in range(0, len(qids), step):
                handles, rough, exact, slack = bind(queries[a : a + step])
                mine = held[0][a : a + step], held[1][a : a + step]
                d = rough(handles, block)
                if no_self:
                    d[qids[a : a + step, None] == ids[None]] = np.inf
                worst = mine[1][:, -1] if bounds is None else np.minimum(mine[1][:, -1], bounds[a : a + step])
                if np.isinf(worst).any():
                    near, fine = _candidates(handles, block, ids, d, min(k, len(ids)), exact, slack)
                    mine[0][:], mine[1][:] = _sorted(np.concatenate([mine[0], ids[near]], 1), np.concatenate([mine[1], fine], 1), k)
                else:
                    most = np.nextafter((worst + slack * (1 + np.abs(worst))).astype(d.dtype), d.dtype.type(np.inf))
                    _below(handles, block, ids, d <= most[:, None], mine, k, exact)
        for a in range(0, len(qids), SLICE_QUERIES):
            some = held[0][a : a + SLICE_QUERIES], held[1][a : a + SLICE_QUERIES]
            keep = np.isfinite(some[1]) if bounds is None else np.isfinite(some[1]) & (some[1] <= bounds[a : a + SLICE_QUERIES, None])
            yield pd.DataFrame({"qid": np.broadcast_to(qids[a : a + SLICE_QUERIES, None], keep.shape)[keep], "vec_id": some[0][keep], "distance": some[1][keep]})

    return codes.mapInPandas(scan, "qid long, vec_id long, distance double")


def _metric(metric: str) -> Callable[[np.ndarray], Bound]:
    """What scan_topk binds for plain vectors. A block is prepared once for all queries. Products of unit vectors are in single precision, off by
    no more than its rounding (6e-8) for each dimension and a few more; the slack is over twice that."""
    ready: list = [None, None]
    form = (lambda v: _unit(v.astype(np.float64)).astype(np.float32)) if metric == "cosine" else lambda v: v.astype(np.float64)

    def rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if ready[0] is not b:
            ready[:] = b, form(b)
        if metric != "cosine":
            return D.block_distance(metric, form(a), ready[1])
        d = form(a) @ ready[1].T
        return np.subtract(1, d, out=d)

    return lambda part: (part, rough, lambda a, b: D.exact_distance(metric, a, b), 1e-6 + 2e-7 * part.shape[1] if metric == "cosine" else 1e-9)


def _lossless(qs: np.ndarray) -> np.ndarray:
    """In single precision where that changes nothing, which is what a task carries then."""
    half = qs.astype(np.float32)
    return half if (half == qs).all() else qs


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero stays zero, whose distance is 1."""
    sq = (v * v).sum(1)
    return v / np.sqrt(np.where(sq > 0, sq, 1))[:, None]


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", no_self: bool = False) -> DataFrame:
    """vectors(vec_id, embedding), queries(qid, qvec) -> qid, vec_id, distance, rank. Exact; ties go to the smaller id.

    The vectors are read once for every block of queries and never shuffled; k rows per query and
    partition are. Rows with null or NaN components are an error, as is a wrong length.
    """
    metric = D.metric_name(metric)

    def scan(qids: np.ndarray, qs: np.ndarray) -> DataFrame:
        codes = checked(vectors, qs.shape[1]).select("vec_id", F.col("embedding").alias("code"))
        return scan_topk(codes, qids, _lossless(qs), k, _metric(metric), no_self)

    return top(over_blocks(queries, scan), k)


def completed(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """found(qid, vec_id, distance) by an approximate search, with exact distances -> the k nearest of all. What the search has found
    bounds each query's distances; one pass over the vectors adds whatever lies within that bound and was missed."""
    metric = D.metric_name(metric)
    far = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("bound"))
    known = far.toPandas()  # a number a query
    known = dict(zip(known["qid"].tolist(), known["bound"].tolist(), strict=True))

    def scan(qids: np.ndarray, qs: np.ndarray) -> DataFrame:
        codes = checked(vectors, qs.shape[1]).select("vec_id", F.col("embedding").alias("code"))
        return scan_topk(codes, qids, _lossless(qs), k, _metric(metric), bounds=np.array([known.get(q, np.inf) for q in qids.tolist()]))

    every = over_blocks(queries, scan).unionByName(found.select("qid", "vec_id", "distance"))
    return top(every.dropDuplicates(["qid", "vec_id"]), k)


def over_blocks(queries: DataFrame, scan: Callable[[np.ndarray, np.ndarray], DataFrame], schema: str = "qid long, vec_id long, distance double") -> DataFrame:
    """The union of scan(qids, vectors) over the blocks of queries."""
    found = None
    for qids, qs in query_blocks(queries):
        part = scan(qids, qs)
        found = part if found is None else found.unionByName(part)
    return queries.sparkSession.createDataFrame([], schema) if found is None else found


def checked(vectors: DataFrame, dim: int | None = None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vectors, with an error where a row isn't a vector of that length (by default the first row's) with finite numbers."""
    if dim is None:
        first = vectors.select(column).first()
        dim = len(first[0]) if first and first[0] is not None else 0
    broken = F.raise_error(F.concat(F.lit("not a vector of the expected length: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return vectors.withColumn(column, F.when(D.valid(column, dim), F.col(column)).otherwise(broken))


def int8_knn(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """codes(vec_id, code tinyint array), queries(qid, qvec tinyint array): by the negated inner product of codes."""
    rough = lambda a, b: -(a.astype(np.float64) @ b.astype(np.float64).T)  # noqa: E731  whole numbers below 2^53
    exact = lambda a, b: -(a.astype(np.int64) * b.astype(np.int64)).sum(1).astype(np.float64)
    return top(over_blocks(queries, lambda qids, qs: scan_topk(codes, qids, qs, k, lambda part: (part, rough, exact, 1e-9))), k)


def refine(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, score: Callable[[Column, Column], Column], column: str = "embedding") -> DataFrame:
    """candidates(qid, vec_id, ...) scored anew by a dearer distance over column -> the k nearest. Both joins are
    on keys; only the candidates' vectors take part. A candidate without a vector is an error."""
    pairs = candidates.select("qid", "vec_id").join(vectors.select("vec_id", F.col(column).alias("v")), "vec_id", "left").join(queries, "qid")
    missing = F.raise_error(F.concat(F.lit("a candidate has no vector: "), F.col("vec_id").cast("string")))
    pairs = pairs.withColumn("v", F.when(F.col("v").isNotNull(), F.col("v")).otherwise(missing))
    return top(pairs.select("qid", "vec_id", score(F.col("qvec"), F.col("v")).alias("distance")), k)


def within(vectors: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """All (qid, vec_id, distance) at most radius apart, by blocks; only those pairs come out. Bad vectors are an error."""
    metric = D.metric_name(metric)

    def near(qids: np.ndarray, qs: np.ndarray) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                block, ids = np.stack(batch["embedding"]).astype(np.float64), batch["vec_id"].to_numpy()
                for at in range(0, len(qids), SLICE_QUERIES):
                    part, names = qs[at : at + SLICE_QUERIES], qids[at : at + SLICE_QUERIES]
                    a, b = np.nonzero(D.block_distance(metric, part, block) <= radius + 1e-9)
                    step = max(1, SLICE // block.shape[1])
                    for k in range(0, len(a), step):
                        x, y = a[k : k + step], b[k : k + step]
                        exact = D.exact_distance(metric, part[x], block[y])
                        keep = exact <= radius
                        yield pd.DataFrame({"qid": names[x][keep], "vec_id": ids[y][keep], "distance": exact[keep]})

        return checked(vectors, qs.shape[1]).select("vec_id", "embedding").mapInPandas(scan, "qid long, vec_id long, distance double")

    return over_blocks(queries, near)


def recall(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, vec_id) twice -> qid, hits, due, recall; 1 where nothing is due."""
    due = truth.groupBy("qid").agg(F.count("*").alias("due"))
    hits = truth.select("qid", "vec_id").join(result.select("qid", "vec_id").distinct(), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    every = due.join(result.select("qid").distinct(), "qid", "full_outer")
    out = every.join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("due", F.lit(0)).alias("due"))
    return out.withColumn("recall", F.when(F.col("due") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("due")))
