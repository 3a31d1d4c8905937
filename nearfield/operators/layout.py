"""Page layouts of graphs: reorderings, packing, and what a search trace then reads."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 4096


def _inbound(links: list[np.ndarray]) -> list[list[int]]:
    into: list[list[int]] = [[] for _ in links]
    for u, near in enumerate(links):
        for v in near.tolist():
            into[v].append(u)
    return into


def bfs_order(links: list[np.ndarray], entries: list[int]) -> list[int]:
    """Breadth first from the entries, neighbours in stored order; what is not reached last, by number."""
    seen, order = np.zeros(len(links), bool), []
    line = deque(dict.fromkeys(entries))
    seen[list(line)] = True
    while line:
        order.append(u := line.popleft())
        for v in links[u].tolist():
            if not seen[v]:
                seen[v] = True
                line.append(v)
    return order + np.flatnonzero(~seen).tolist()


def greedy_order(links: list[np.ndarray], rank: np.ndarray, weight: Callable[[int, int], float], pull: list[list[int]], page: int = PAGE) -> list[int]:
    """Pages filled one at a time: the unplaced node of highest rank (ties by number) starts one; then joins, as long as it
    fits, the node with the largest sum of weights to what is on the page (ties by rank, then number).
    pull[v] holds the nodes that placing v makes candidates."""
    placed, order = np.zeros(len(links), bool), []
    size = [2 + 4 * len(x) for x in links]
    for seed in np.lexsort((np.arange(len(links)), -rank)).tolist():
        if placed[seed]:
            continue
        score: dict[int, float] = {}
        heap: list[tuple[float, float, int]] = []
        room, v = page, seed
        while v is not None:
            placed[v] = True
            order.append(v)
            room -= size[v]
            for u in pull[v]:
                if not placed[u]:
                    score[u] = score.get(u, 0.0) + weight(u, v)
                    heapq.heappush(heap, (-score[u], -rank[u], u))
            v, aside = None, []
            while heap:
                s, r, u = heapq.heappop(heap)
                if placed[u] or -s != score[u]:
                    continue
                if size[u] <= room:
                    v = u
                    break
                aside.append((s, r, u))
            for x in aside:
                heapq.heappush(heap, x)
    return order


def reorder(graph: DataFrame, method: str, trace: DataFrame | None = None, entries: int = 64) -> DataFrame:
    """graph(shard, vec_id, nbrs) -> shard, vec_id, new_vid: a permutation of each shard. bfs, neighbor_run (the same
    order), heavy_edge (pages by the sum of in-degrees along edges), affinity (by the number of edges) or twpp (by
    how often the trace(vid, parent) expands two nodes one after the other; needs that trace, of other queries
    than those it is judged on)."""
    if method not in ("bfs", "neighbor_run", "heavy_edge", "affinity", "twpp"):
        raise ValueError(f"unknown method {method!r}")

    def order(group: pd.DataFrame, pairs: pd.DataFrame | None = None) -> pd.DataFrame:
        group = group.sort_values("vec_id").reset_index(drop=True)
        ids = group["vec_id"].to_numpy(np.int64)
        links = [np.searchsorted(ids, np.asarray(x, np.int64)) for x in group["nbrs"]]
        degree = np.array([len(x) for x in links])
        into = _inbound(links)
        indegree = np.array([len(x) for x in into], float)
        if method in ("bfs", "neighbor_run"):
            found = bfs_order(links, np.lexsort((np.arange(len(ids)), -degree))[:entries].tolist())
        elif method == "heavy_edge":
            found = greedy_order(links, indegree, lambda u, v: indegree[u] + indegree[v], into)
        elif method == "affinity":
            found = greedy_order(links, degree.astype(float), lambda u, v: 1.0, into)
        else:
            count, pull, weights = np.zeros(len(ids)), [[] for _ in ids], {}
            a, b = np.searchsorted(ids, pairs["a"]), np.searchsorted(ids, pairs["b"])
            for x, y, n in zip(a.tolist(), b.tolist(), pairs["n"].tolist(), strict=True):
                count[x] += n
                if x != y:
                    weights[x, y] = weights[y, x] = float(n)
                    pull[x].append(y)
                    pull[y].append(x)
            found = greedy_order(links, count, lambda u, v: weights[u, v], pull)
        new = np.empty(len(ids), np.int64)
        new[found] = np.arange(len(ids))
        return pd.DataFrame({"shard": group["shard"].astype(np.int32), "vec_id": ids, "new_vid": new})

    schema = "shard int, vec_id long, new_vid long"
    graph = graph.select("shard", "vec_id", "nbrs")
    if method != "twpp":
        return graph.groupBy("shard").applyInPandas(lambda g: order(g), schema)
    pairs = co_expansions(trace).unionByName(node_counts(trace).select("shard", F.col("vid").alias("a"), F.col("vid").alias("b"), "n"))
    return graph.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInPandas(lambda g, p: order(g, p), schema)


def co_expansions(trace: DataFrame) -> DataFrame:
    """trace(shard, vid, parent) -> shard, a, b, n: how often two nodes are expanded as parent and child, a < b."""
    some = trace.where("parent >= 0 AND parent <> vid")
    return some.groupBy("shard", F.least("vid", "parent").alias("a"), F.greatest("vid", "parent").alias("b")).agg(F.count("*").alias("n"))


def node_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("shard", "vid").agg(F.count("*").alias("n"))


def is_permutation(order: DataFrame) -> DataFrame:
    """shard -> whether new_vid runs through 0 to n - 1."""
    every = order.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("new_vid").alias("d"), F.min("new_vid").alias("a"), F.max("new_vid").alias("b"))
    return every.select("shard", ((F.col("n") == F.col("d")) & (F.col("a") == 0) & (F.col("b") == F.col("n") - 1)).alias("valid"))


def pack_pages(order: DataFrame, page: int = PAGE, header: int = 0, slot: int = 0, long_records: bool = False) -> DataFrame:
    """order(shard, new_vid, vec_id, degree) -> with page_id and offset: records of 2 + 4 * degree bytes in order, a new page
    where the next doesn't fit. header and slot are bytes of a page and of each record's directory entry. A record larger than
    a page is an error, or with long_records alone on a page, beyond whose end it goes."""

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("new_vid").reset_index(drop=True)
        pages, offsets, at, number = [], [], header, 0
        for size in (2 + 4 * group["degree"]).tolist():
            if size + slot > page - header and not long_records:
                raise ValueError("a record exceeds a page")
            if at + size + slot > page and at > header:
                number, at = number + 1, header
            pages.append(number)
            offsets.append(at)
            at += size + slot
        return group[["shard", "vec_id", "new_vid", "degree"]].assign(page_id=pages, offset=offsets)

    schema = "shard int, vec_id long, new_vid long, degree long, page_id int, offset int"
    return order.groupBy("shard").applyInPandas(fill, schema)


def packing_stats(pages: DataFrame, page: int = PAGE) -> DataFrame:
    """Pages, records by page, and the part of their bytes in use."""
    each = pages.groupBy("shard", "page_id").agg(F.count("*").alias("records"), F.sum(2 + 4 * F.col("degree")).alias("bytes"))
    return each.agg(F.count("*").alias("pages"), F.min("records").alias("least"), F.max("records").alias("most"), F.avg("records").alias("mean_records"), (F.sum("bytes") / (F.count("*") * page)).alias("in_use"))


def page_reads(trace: DataFrame, pages: DataFrame) -> DataFrame:
    """trace(qid, shard, vid) -> qid, expansions, pages: how many different pages a query's expansions touch."""
    at = pages.select("shard", F.col("vec_id").alias("vid"), "page_id")
    return trace.join(at, ["shard", "vid"]).groupBy("qid").agg(F.count("*").alias("expansions"), F.countDistinct("shard", "page_id").alias("pages"))


def neighbor_coexpansion(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """qid -> the part of its expansions whose parent has an edge to them."""
    edge = edges.select(F.col("src").alias("parent"), F.col("dst").alias("vid")).distinct().withColumn("edge", F.lit(1))
    return trace.where("parent >= 0").join(edge, ["parent", "vid"], "left").groupBy("qid").agg(F.avg(F.coalesce("edge", F.lit(0))).alias("rate"))


def page_head_share(trace: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages by how often they are read, with the running share of all reads."""
    at = pages.select("shard", F.col("vec_id").alias("vid"), "page_id")
    reads = trace.join(at, ["shard", "vid"]).groupBy("shard", "page_id").agg(F.count("*").alias("reads"))
    order = Window.partitionBy("shard").orderBy(F.desc("reads"), "page_id").rowsBetween(Window.unboundedPreceding, 0)
    return reads.withColumn("share", F.sum("reads").over(order) / F.sum("reads").over(Window.partitionBy("shard")))


class PageCache:
    """A set-associative cache with clock eviction; pinned pages stay, at most half of a set."""

    def __init__(self, slots: int, ways: int = 8, pinned: list[int] | None = None) -> None:
        self.ways, self.sets = ways, max(1, 1 << (max(1, slots // ways).bit_length() - 1))
        self.bits = self.sets.bit_length() - 1
        self.slot: list[list[list]] = [[] for _ in range(self.sets)]  # [page, referenced, pinned]
        self.hand = [0] * self.sets
        self.hits = self.misses = self.bypasses = 0
        for page in dict.fromkeys(int(p) for p in pinned or []):
            s = self.slot[self._set(page)]
            if len(s) < ways // 2:
                s.append([page, True, True])

    def _set(self, page: int) -> int:
        return ((page * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - self.bits) if self.bits else 0

    def holds(self, page: int) -> bool:
        return any(entry[0] == page for entry in self.slot[self._set(page)])

    def read(self, page: int) -> bool:
        k = self._set(page)
        s = self.slot[k]
        for entry in s:
            if entry[0] == page:
                entry[1] = True
                self.hits += 1
                return True
        self.misses += 1
        if len(s) < self.ways:
            s.append([page, True, False])
            return False
        for _ in range(2 * self.ways):
            entry = s[self.hand[k]]
            self.hand[k] = (self.hand[k] + 1) % self.ways
            if entry[2]:
                continue
            if entry[1]:
                entry[1] = False
                continue
            entry[0], entry[1] = page, True
            return False
        self.bypasses += 1
        return False


def simulate_cache(trace: DataFrame, pages: DataFrame, slots: int = 256, cold: bool = True, pin: int = 0) -> DataFrame:
    """qid, hits, misses, bypasses of each query's expansions in order through a cache of that many pages: cold for each query, or warm
    over a shard's queries by qid. pin: so many of the most read pages stay in it."""
    at = pages.select("shard", F.col("vec_id").alias("vid"), "page_id")
    reads = trace.join(at, ["shard", "vid"]).select("qid", "shard", "step", "page_id")
    if pin:
        best = Window.partitionBy("shard").orderBy(F.desc("n"), "page_id")
        top = reads.groupBy("shard", "page_id").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= pin)
        reads = reads.join(top.groupBy("shard").agg(F.sort_array(F.collect_list("page_id")).alias("pins")), "shard", "left")
    else:
        reads = reads.withColumn("pins", F.array().cast("array<int>"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["qid", "step"])
        pins = list(group["pins"].iloc[0]) if group["pins"].iloc[0] is not None else []
        cache, out = None, []
        for qid, some in group.groupby("qid", sort=True):
            if cache is None or cold:
                cache = PageCache(slots, pinned=pins)
            before = cache.hits, cache.misses, cache.bypasses
            for p in some["page_id"].tolist():
                cache.read(p)
            out.append((qid, cache.hits - before[0], cache.misses - before[1], cache.bypasses - before[2]))
        return pd.DataFrame(out, columns=["qid", "hits", "misses", "bypasses"])

    keys = ["shard", "qid"] if cold else ["shard"]
    each = reads.groupBy(*keys).applyInPandas(run, "qid long, hits long, misses long, bypasses long")
    return each.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "bypasses")])
