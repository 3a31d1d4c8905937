"""Navigable graphs: sharded building, beam search with all its budgets, and graph measures."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.operators.knn import checked, knn, over_blocks, top
from nearfield.operators.layout import PageCache
from nearfield.operators.pq import tables

#: Vectors of a shard: one task builds or searches it, in memory of about that many rows.
SHARD_ROWS = 50_000
#: Rows whose distances to all rows before them a build holds at a time.
BUILD_ROWS = 128
#: Links that a row gets beyond its due before a build chooses among them.
BUILD_LINKS = 96


@dataclass(frozen=True)
class Search:
    """Budgets of one beam search. 0 switches a budget off.

    ef: results held. max_expansions: nodes expanded. max_neighbors: of a node's neighbours only so many, the
    nearest. stall and drain: once ef results are held and `stall` expansions in a row brought none better, go on
    for `drain` more. gate_ratio, gate_min: of a node's new neighbours only the nearest part by the proxy
    are scored, at least gate_min; the others may be met again. prefer: among so many nearest
    candidates take the nearest one that `resident` holds, else the nearest.
    """

    ef: int = 64
    max_expansions: int = 0
    max_neighbors: int = 0
    stall: int = 0
    drain: int = 0
    gate_ratio: float = 1.0
    gate_min: int = 0
    prefer: int = 0


@dataclass
class Found:
    """Results as (distance, node), nearest first; expanded (node, parent) in order; counters."""

    results: list[tuple[float, int]]
    expanded: list[tuple[int, int]]
    computed: int = 0
    useful: int = 0
    stopped: bool = False
    redirected: int = 0


def beam_search(neighbors: Callable[[int], np.ndarray], distances: Callable[[np.ndarray], np.ndarray], entries: list[int], search: Search, n: int, proxy: Callable[[np.ndarray], np.ndarray] | None = None, resident: Callable[[int], bool] | None = None) -> Found:
    """Best first from the entries. The nearest candidate is expanded until it is farther than the worst of ef
    results; equal distances go by node number."""
    seen = np.zeros(n, bool)
    candidates: list[tuple[float, int, int]] = []
    held: list[tuple[float, int]] = []  # negated: the worst first
    found = Found([], [])

    def offer(d: float, v: int, parent: int, always: bool) -> bool:
        full = len(held) >= search.ef
        if full and d >= -held[0][0] and not always:
            return False
        heapq.heappush(candidates, (d, v, parent))
        if not full:
            heapq.heappush(held, (-d, -v))
        elif d < -held[0][0]:
            heapq.heapreplace(held, (-d, -v))
        return True

    first = np.array(list(dict.fromkeys(entries)), np.int64)
    seen[first] = True
    for d, v in zip(distances(first).tolist(), first.tolist(), strict=True):
        offer(d, v, -1, True)
    found.computed += len(first)
    stalls = drain = 0
    best_worst = math.inf
    while candidates:
        if candidates[0][0] > -held[0][0]:
            break
        if search.max_expansions and len(found.expanded) >= search.max_expansions:
            found.stopped = True
            break
        d, v, parent = heapq.heappop(candidates)
        if search.prefer > 1 and resident is not None and not resident(v):
            others = [heapq.heappop(candidates) for _ in range(min(search.prefer - 1, len(candidates)))]
            # the bound holds for what is taken, not only for the nearest
            pick = next((k for k, o in enumerate(others) if resident(o[1]) and o[0] <= -held[0][0]), None)
            if pick is not None:
                others[pick], (d, v, parent) = (d, v, parent), others[pick]
                found.redirected += 1
            for o in others:
                heapq.heappush(candidates, o)
        found.expanded.append((v, parent))
        near = neighbors(v)
        near = near[(near < n) & ~seen[near]] if len(near) else near
        if proxy is not None and search.gate_ratio < 1 and len(near):
            keep = min(len(near), max(math.ceil(len(near) * search.gate_ratio), search.gate_min))
            near = near[np.lexsort((near, proxy(near)))[:keep]]
        added = False
        if len(near):
            seen[near] = True
            scored = distances(near)
            found.computed += len(near)
            if search.max_neighbors:
                order = np.lexsort((near, scored))[: search.max_neighbors]
                near, scored = near[order], scored[order]
            if len(held) >= search.ef:
                closer = scored < -held[0][0]
                near, scored = near[closer], scored[closer]
            for d, u in zip(scored.tolist(), near.tolist(), strict=True):
                added |= offer(d, u, v, False)
        found.useful += added
        if search.stall and len(held) >= search.ef:
            worst = -held[0][0]
            if worst < best_worst:
                stalls, drain, best_worst = 0, 0, worst
            else:
                stalls += 1
            if drain:
                drain -= 1
                if not drain:
                    found.stopped = True
                    break
            elif stalls >= search.stall:
                drain = search.drain
                if not drain:
                    found.stopped = True
                    break
    found.results = sorted((-d, -v) for d, v in held)
    return found


def kernel(metric: str, data: np.ndarray) -> Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """query -> (rows -> their distances to it), with norms computed once."""
    if metric == "ip":
        return lambda q: lambda rows: -(data[rows] @ q)
    sq = (data * data).sum(1)
    if metric == "l2":
        return lambda q: lambda rows, qq=q @ q: np.maximum(sq[rows] + qq - 2 * (data[rows] @ q), 0)
    unit = data / np.sqrt(np.where(sq > 0, sq, 1))[:, None]

    def cosine(q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        size = math.sqrt(q @ q)
        q = q / size if size else q
        return lambda rows: 1 - unit[rows] @ q

    return cosine


def diverse(distances: np.ndarray, between: np.ndarray, m: int) -> list[int]:
    """Of candidates in order of their distance, those that no chosen one is nearer to than their centre is; m at most.
    between holds the candidates' distances among themselves."""
    kept: list[int] = []
    hidden = np.zeros(len(distances), bool)
    for k in range(len(distances)):
        if not hidden[k]:
            kept.append(k)
            if len(kept) == m:
                break
            hidden |= between[k] < distances
    return kept


def _scores(metric: str, data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(rows a, rows b) -> all distances between them by one matrix product, with norms computed once."""
    if metric == "l2":
        return lambda a, b: D.block_distance("l2", data[a], data[b])
    if metric == "ip":
        return lambda a, b: -(data[a] @ data[b].T)
    sq = (data * data).sum(1)
    unit = data / np.sqrt(np.where(sq > 0, sq, 1))[:, None]
    return lambda a, b: 1 - unit[a] @ unit[b].T


def build_shard(data: np.ndarray, metric: str, m_max: int, ef_construction: int) -> list[np.ndarray]:
    """Neighbour lists of a navigable small world, rows inserted in order: each is scored against all rows before it (a block of
    rows by one matrix product), tied to a diverse choice of the ef_construction nearest, and tied back; overfull lists are chosen anew,
    some links at a time. Every row can be reached from the first."""
    links: list[list[int]] = [[] for _ in data]
    scores = _scores(metric, data)

    def choose(ids: np.ndarray, d: np.ndarray) -> list[int]:
        order = np.lexsort((ids, d))
        ids, d = ids[order], d[order]
        return ids[diverse(d, scores(ids, ids), m_max)].tolist()

    def choose_anew(u: int) -> None:
        ids = np.array(links[u], np.int64)
        links[u] = choose(ids, scores(slice(u, u + 1), ids)[0])

    for first in range(0, len(data), BUILD_ROWS):
        last = min(first + BUILD_ROWS, len(data))
        block = scores(slice(first, last), slice(0, last))
        for v in range(max(first, 1), last):
            d = block[v - first, :v]
            near = np.argpartition(d, ef_construction - 1)[:ef_construction] if v > ef_construction else np.arange(v)
            links[v] = choose(near, d[near])
            for u in links[v]:
                links[u].append(v)
                if len(links[u]) > m_max + BUILD_LINKS:
                    choose_anew(u)
    for u in range(len(data)):
        if len(links[u]) > m_max:
            choose_anew(u)
    lists = [np.array(x, np.int64) for x in links]
    _tie_in(lists, lambda v: scores(slice(v, v + 1), slice(0, len(data)))[0], m_max)
    return lists


def _tie_in(links: list[np.ndarray], distances: Callable[[int], np.ndarray], m_max: int) -> None:
    """Gives each row that no walk from the first one reaches a link from the nearest reached row that has room, or a link
    by which nothing was reached first; its farthest such link then goes."""
    came = np.full(len(links), -1, np.int64)  # the row from which each one was reached first

    def walk(v: int) -> None:
        line = [v]
        while line:
            u = line.pop()
            for w in links[u][came[links[u]] < 0].tolist():
                came[w] = u
                line.append(w)

    if len(links):
        came[0] = 0
        walk(0)
    for v in range(1, len(links)):
        if came[v] >= 0:
            continue
        d = np.where(came >= 0, distances(v), np.inf)
        for u in np.argsort(d, kind="stable").tolist():
            if len(links[u]) < m_max:
                links[u] = np.append(links[u], v)
                break
            spare = np.flatnonzero(came[links[u]] != u)
            if len(spare):
                links[u] = links[u].copy()
                links[u][spare[distances(u)[links[u][spare]].argmax()]] = v
                break
        came[v] = u
        walk(v)


def with_shard(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors with a shard number by hash of the id, for shards of about shard_rows rows."""
    shards = max(1, -(-vectors.count() // shard_rows))
    return vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))


def nsw_build(vectors: DataFrame, metric: str = "cosine", m_max: int = 32, ef_construction: int = 100, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors(vec_id, embedding) -> graph(shard, vec_id, embedding, nbrs): every vector is in it, each shard a graph
    of its own, built in order of vec_id, so the result is the same each time. Bad vectors are an error."""
    metric = D.metric_name(metric)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id").reset_index(drop=True)
        ids = group["vec_id"].to_numpy(np.int64)
        if len(np.unique(ids)) != len(ids):
            raise ValueError("vec_id repeats")
        links = build_shard(np.stack(group["embedding"]).astype(np.float64), metric, m_max, ef_construction)
        return group[["shard", "vec_id", "embedding"]].assign(nbrs=[ids[x] for x in links])

    return with_shard(checked(vectors.select("vec_id", "embedding")), shard_rows).groupBy("shard").applyInPandas(build, "shard int, vec_id long, embedding array<float>, nbrs array<long>")


def hubs(degrees: np.ndarray, count: int = 64) -> list[int]:
    """Rows of the highest degrees, ties by number."""
    return np.lexsort((np.arange(len(degrees)), -degrees))[: min(count, len(degrees))].tolist()


RESULT = "qid long, vec_id long, distance double"
METRICS = "qid long, shard int, expansions long, useful long, wasted long, distance_computes long, redirected long, stopped_early boolean"
PAGE_METRICS = METRICS + ", hits long, misses long"
TRACE = "qid long, shard int, step int, vid long, parent long"


def search_graph(graph: DataFrame, queries: DataFrame, k: int, search: Search = Search(), metric: str = "cosine", entries: int = 64, output: str = "result", proxy: bool = False, resident_degree: int = 0, book: np.ndarray | None = None, cache_slots: int = 0) -> DataFrame:
    """graph as nsw_build gives it, queries(qid, qvec) -> by output: `result` (qid, vec_id, distance, rank), `metrics` (counters
    for each query and shard), `page_metrics` (with the cache's hits and misses) or `trace` (each expansion with its parent).

    A task searches one shard for all queries; the k nearest of each shard meet in a window. The three
    outputs come from the same search, so tracing changes no result. With proxy, gating goes by int8 codes, with book
    by the lookup of product codes in graph's column `code`. resident_degree: nodes with so many links count as resident for
    Search.prefer. cache_slots: expansions read graph's column `page_id` through a simulated cache of so many pages, cold for each query,
    and nodes whose page it holds are resident.
    """
    metric = D.metric_name(metric)
    schema = {"result": RESULT, "metrics": METRICS, "page_metrics": PAGE_METRICS, "trace": TRACE}[output]

    def scan(qids: np.ndarray, qs: np.ndarray) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("vec_id").reset_index(drop=True)
            ids, data = group["vec_id"].to_numpy(np.int64), np.stack(group["embedding"]).astype(np.float64)
            links = [np.searchsorted(ids, np.asarray(x, np.int64)) for x in group["nbrs"]]
            degrees = np.array([len(x) for x in links])
            start, codes, rows, score = hubs(degrees, entries), np.clip(np.round(data * 127), -127, 127), [], kernel(metric, data)
            coded = np.stack(group["code"]).astype(np.int64) if book is not None else None
            pages = group["page_id"].to_numpy(np.int64) if cache_slots else None
            for qid, q in zip(qids.tolist(), qs, strict=True):
                own, gate, resident, read, cache = np.clip(np.round(q * 127), -127, 127), None, None, links.__getitem__, None
                if book is not None:
                    lut = tables(q[None], book)[0]
                    gate = lambda at, lut=lut: lut[np.arange(len(lut)), coded[at]].sum(1)
                elif proxy:
                    gate = lambda at, own=own: -(codes[at] @ own)
                if cache_slots:
                    cache = PageCache(cache_slots)
                    resident = lambda v, cache=cache: cache.holds(int(pages[v]))

                    def read(v: int, cache: PageCache = cache) -> np.ndarray:
                        cache.read(int(pages[v]))
                        return links[v]
                elif resident_degree:
                    resident = lambda v: degrees[v] >= resident_degree
                f = beam_search(read, score(q), start, search, len(ids), gate, resident)
                if output == "result":
                    near = np.array([v for _, v in f.results[:k]], np.int64)
                    exact = D.exact_distance(metric, np.repeat(q[None], len(near), 0), data[near]) if len(near) else np.zeros(0)
                    rows += zip([qid] * len(near), ids[near].tolist(), exact.tolist(), strict=True)
                elif output in ("metrics", "page_metrics"):
                    seen = (cache.hits if cache else 0, cache.misses if cache else 0) if output == "page_metrics" else ()
                    rows.append((qid, int(group["shard"][0]), len(f.expanded), f.useful, len(f.expanded) - f.useful, f.computed, f.redirected, f.stopped, *seen))
                else:
                    rows += [(qid, int(group["shard"][0]), k_, int(ids[v]), int(ids[p]) if p >= 0 else -1) for k_, (v, p) in enumerate(f.expanded)]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        return graph.groupBy("shard").applyInPandas(run, schema)

    found = over_blocks(queries, scan, schema)
    return top(found, k) if output == "result" else found


def knn_graph(vectors: DataFrame, k: int = 16, metric: str = "cosine") -> DataFrame:
    """edges(src, dst, pos, distance): each vector's exact k nearest others, pos from 1. All vectors are queries, in blocks
    of bounded size."""
    queries = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return knn(vectors, queries, k, metric, no_self=True).select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), F.col("rank").alias("pos"), "distance")


def prune(edges: DataFrame, vectors: DataFrame, m: int = 8, metric: str = "cosine") -> DataFrame:
    """edges(src, dst, distance) -> the diverse choice of each source's neighbours, pos from 1."""
    metric = D.metric_name(metric)
    rich = edges.join(checked(vectors).select(F.col("vec_id").alias("dst"), "embedding"), "dst")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["distance", "dst"]).reset_index(drop=True)
        data = np.stack(group["embedding"]).astype(np.float64)
        at = diverse(group["distance"].to_numpy(), D.block_distance(metric, data, data), m)
        return group.loc[at, ["src", "dst", "distance"]].assign(pos=range(1, len(at) + 1))

    return rich.groupBy("src").applyInPandas(choose, "src long, dst long, distance double, pos int")


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("vec_id").alias("src"), F.posexplode("nbrs").alias("pos", "dst")).select("src", "dst", (F.col("pos") + 1).alias("pos"))


def degrees(edges: DataFrame, nodes: DataFrame, of: str = "src") -> DataFrame:
    """nodes(vec_id) with degree: edges that leave (src) or arrive (dst); 0 without any."""
    count = edges.groupBy(F.col(of).alias("vec_id")).agg(F.count("*").alias("degree"))
    return nodes.select("vec_id").join(count, "vec_id", "left").select("vec_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def entry_set(degree: DataFrame, count: int = 64) -> DataFrame:
    """The count nodes of highest degree, ties by id, with their rank from 1. A bounded sort."""
    chosen = degree.orderBy(F.desc("degree"), "vec_id").limit(count)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "vec_id")))


def bfs_levels(edges: DataFrame, start: DataFrame, cut: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """edges(src, dst), start(vec_id) -> vec_id, level for what is reached: a frontier join a level. Each level is written once and
    appended; a graph with more than `most` levels is an error."""
    levels = [cut(start.select("vec_id", F.lit(0).alias("level")).distinct())]
    while not levels[-1].isEmpty():
        if len(levels) > most:
            raise ValueError(f"more than {most} levels")
        near = levels[-1].join(edges, F.col("vec_id") == F.col("src")).select(F.col("dst").alias("vec_id")).distinct()
        seen = functools.reduce(DataFrame.unionByName, levels)
        levels.append(cut(near.join(seen, "vec_id", "left_anti").withColumn("level", F.lit(len(levels)))))
    return functools.reduce(DataFrame.unionByName, levels)


def with_neighbor_codes(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """graph(vec_id, nbrs), codes(vec_id, code) -> vec_id, nbrs, nbr_codes: each list beside its neighbours' codes, in order, so that
    gating needs no further reads. A neighbour without a code is an error."""
    edges = graph.select("vec_id", F.posexplode("nbrs").alias("pos", "dst"))
    found = edges.join(codes.select(F.col("vec_id").alias("dst"), "code"), "dst", "left")
    found = found.withColumn("code", F.when(F.col("code").isNotNull(), F.col("code")).otherwise(F.raise_error(F.lit("a neighbour has no code"))))
    lists = found.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "dst", "code"))).alias("l"))
    out = graph.select("vec_id").join(lists, "vec_id", "left")
    return out.select("vec_id", F.coalesce(F.transform("l", lambda x: x["dst"]), F.array().cast("array<bigint>")).alias("nbrs"), F.transform("l", lambda x: x["code"]).alias("nbr_codes"))


def entry_diagnostics(trace: DataFrame, results: DataFrame) -> DataFrame:
    """trace(qid, step, vid), results(qid, vec_id, rank) -> qid, best_at, first_top_at: the expansion at which the nearest result, and at
    which any result, was expanded; null if it never was."""
    hits = trace.join(results.select("qid", F.col("vec_id").alias("vid"), "rank"), ["qid", "vid"])
    steps = hits.groupBy("qid").agg(F.min(F.when(F.col("rank") == 1, F.col("step"))).alias("best_at"), F.min("step").alias("first_top_at"))
    return results.select("qid").distinct().join(steps, "qid", "left")
