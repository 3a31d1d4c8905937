"""Queries whose input SQL can follow: graphs and traces made of exact neighbours, and searches that must find what a scan finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.functions.codes import aligned_bytes, from_half, half
from nearfield.operators import graph, knn, layout, pq, saq, telemetry
from nearfield.plans.catalog import (
    BOOK, CODED, EDGES, I8, I8_TOP, K, ORACLE_SQL, PQ_PARTS, PQ_STAGE, PQ_TRAINED_STAGE, STAGE_2, TRUTH, TRUTH_D, Q, _book, _cosine, _edges, _int8, _knn_sql, _l2, _nsw, _segments, _top, _truth, query, queries_of, ranked, vectors, SNAPS, DEPTH, LIMIT_US,
)
from nearfield.plans.checkpoint import cut
from nearfield.streaming.health import ALPHA, COOLDOWN

PAGE = 512

# Traces: a query's exact neighbours stand for its expansions, each the child of the one before.

TRACE = f"{I8}, {TRUTH_D}, {TRUTH}, tr AS (SELECT qid, 0 AS shard, (rank - 1)::INTEGER AS step, vec_id AS vid, coalesce(lag(vec_id) OVER (PARTITION BY qid ORDER BY rank), -1) AS parent FROM t)"
SIZES = f"{EDGES}, dg AS (SELECT vec_id, count(src) AS degree, row_number() OVER (ORDER BY vec_id) - 1 AS new_vid FROM embeddings LEFT JOIN e ON dst = vec_id GROUP BY vec_id)"
PAGES = f"""
    {SIZES}, pg(vec_id, new_vid, degree, page_id, "offset") AS (
        SELECT vec_id, new_vid, degree, 0, 0 FROM dg WHERE new_vid = 0 UNION ALL
        SELECT g.vec_id, g.new_vid, g.degree, CASE WHEN "offset" + 4 + 4 * pg.degree + 4 * g.degree > {PAGE} THEN page_id + 1 ELSE page_id END,
            CASE WHEN "offset" + 4 + 4 * pg.degree + 4 * g.degree > {PAGE} THEN 0 ELSE ("offset" + 2 + 4 * pg.degree)::INTEGER END
        FROM pg JOIN dg g ON g.new_vid = pg.new_vid + 1
    )
"""


def _line(v: DataFrame) -> DataFrame:
    """Nodes in order of their id, with the degree that they have among exact neighbours."""
    order = Window.orderBy("vec_id")  # a small table
    found = graph.degrees(_edges(v), v, "dst")
    return found.select(F.lit(0).alias("shard"), "vec_id", (F.row_number().over(order) - 1).cast("long").alias("new_vid"), "degree")


def _pages(v: DataFrame) -> DataFrame:
    """In-degrees have no bound, so a record may exceed a page."""
    return layout.pack_pages(_line(v), PAGE, long_records=True)


def _trace(v: DataFrame) -> DataFrame:
    before = F.lag("vec_id").over(Window.partitionBy("qid").orderBy("rank"))
    return cut(_truth(v).select("qid", F.lit(0).alias("shard"), (F.col("rank") - 1).cast("int").alias("step"), F.col("vec_id").alias("vid"), F.coalesce(before, F.lit(-1)).alias("parent")))


@query(f"WITH RECURSIVE {PAGES} SELECT vec_id, new_vid, degree, page_id, \"offset\" FROM pg")
def exact_pack_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(vectors(spark, sf_dir)).select("vec_id", "new_vid", "degree", "page_id", "offset")


@query(f"""
    WITH RECURSIVE {PAGES}, n AS (SELECT page_id, count(*) AS records, sum(2 + 4 * degree) AS bytes FROM pg GROUP BY page_id)
    SELECT count(*) AS pages, min(records) AS least, max(records) AS most, round(avg(records), 9) AS mean_records, round(sum(bytes) / (count(*) * {PAGE}), 9) AS in_use FROM n
""")
def exact_packing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.packing_stats(_pages(vectors(spark, sf_dir)), PAGE)
    return found.withColumn("mean_records", F.round("mean_records", 9)).withColumn("in_use", F.round("in_use", 9))


@query(f"WITH RECURSIVE {PAGES}, {TRACE} SELECT qid, count(*) AS expansions, count(DISTINCT page_id) AS pages FROM tr JOIN pg ON vid = pg.vec_id GROUP BY qid")
def exact_page_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return layout.page_reads(_trace(v), _pages(v))


@query(f"""
    WITH RECURSIVE {PAGES}, {TRACE}, n AS (SELECT page_id, count(*) AS reads FROM tr JOIN pg ON vid = pg.vec_id GROUP BY page_id)
    SELECT page_id, reads, round(sum(reads) OVER (ORDER BY reads DESC, page_id) / sum(reads) OVER (), 9) AS share FROM n
""")
def exact_head_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return layout.page_head_share(_trace(v), _pages(v)).select("page_id", "reads", F.round("share", 9).alias("share"))


@query(f"WITH RECURSIVE {PAGES}, {TRACE}, f AS (SELECT qid, page_id, count(*) AS n FROM tr JOIN pg ON vid = pg.vec_id GROUP BY ALL) SELECT qid, sum(n - 1)::BIGINT AS hits, count(*) AS misses, 0::BIGINT AS bypasses FROM f GROUP BY qid")
def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cold cache that nothing is evicted from: each page misses once a query."""
    v = vectors(spark, sf_dir)
    return layout.simulate_cache(_trace(v), _pages(v), 1 << 14)


@query(f"WITH {TRACE} SELECT shard, least(vid, parent) AS a, greatest(vid, parent) AS b, count(*) AS n FROM tr WHERE parent >= 0 GROUP BY ALL")
def exact_coexpand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.co_expansions(_trace(vectors(spark, sf_dir)))


@query(f"WITH {TRACE} SELECT shard, vid, count(*) AS n FROM tr GROUP BY ALL")
def exact_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.node_counts(_trace(vectors(spark, sf_dir)))


@query(f"WITH {EDGES}, {TRACE} SELECT qid, round(avg(CASE WHEN e.src IS NULL THEN 0 ELSE 1 END), 9) AS rate FROM tr LEFT JOIN e ON e.src = parent AND e.dst = vid WHERE parent >= 0 GROUP BY qid")
def exact_neighbor_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return layout.neighbor_coexpansion(_trace(v), _edges(v)).withColumn("rate", F.round("rate", 9))


@query(f"""
    WITH {TRACE}, {I8_TOP.removeprefix(I8 + ', ')}, s AS ({_top('d1')}), h AS (SELECT s.qid, min(step) FILTER (s.rank = 1) AS best_at, min(step) AS first_top_at FROM s JOIN tr ON tr.qid = s.qid AND vid = s.vec_id GROUP BY s.qid)
    SELECT q.qid, best_at, first_top_at FROM (SELECT DISTINCT qid FROM s) q LEFT JOIN h USING (qid)
""")
def exact_entry_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the neighbours by int8 codes stand in the trace."""
    v = vectors(spark, sf_dir)
    return graph.entry_diagnostics(_trace(v), knn.int8_knn(*_int8(v), K))


@query(f"""
    WITH {EDGES}, {BOOK}, {CODED}, w AS (SELECT vec_id, array_to_string(list(c ORDER BY m), '.') AS code FROM code GROUP BY vec_id)
    SELECT src AS vec_id, array_to_string(list(dst ORDER BY pos), ',') AS nbrs, array_to_string(list(w.code ORDER BY pos), ',') AS nbr_codes FROM e JOIN w ON w.vec_id = dst GROUP BY src
""")
def exact_neighbor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"])
    g = _edges(v).groupBy(F.col("src").alias("vec_id")).agg(lists.alias("nbrs"))
    found = graph.with_neighbor_codes(g, pq.encode(v, _book(v)))
    codes = F.transform("nbr_codes", lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "."))
    return found.select("vec_id", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"), F.array_join(codes, ",").alias("nbr_codes"))


ORACLE_SQL["graph_heuristic_prune"] = f"""
    WITH RECURSIVE {EDGES.replace('pos <= 8', 'pos <= 16')}, c AS (SELECT src, dst, pos, {_cosine('a.embedding', 'b.embedding')} AS distance FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst),
    h AS (SELECT y.src, y.pos, y.dst, y.distance, list(x.pos) FILTER ({_cosine('a.embedding', 'b.embedding')} < y.distance) AS hiders
        FROM c y JOIN c x ON x.src = y.src AND x.pos < y.pos JOIN embeddings a ON a.vec_id = x.dst JOIN embeddings b ON b.vec_id = y.dst GROUP BY ALL),
    r(src, pos, kept) AS (
        SELECT src, pos, [pos] FROM c WHERE pos = 1 UNION ALL
        SELECT h.src, h.pos, CASE WHEN len(kept) < 8 AND len(list_intersect(kept, coalesce(hiders, []))) = 0 THEN list_append(kept, h.pos) ELSE kept END FROM r JOIN h ON h.src = r.src AND h.pos = r.pos + 1
    )
    SELECT r.src, c.dst, c.distance, list_position(kept, c.pos)::INTEGER AS pos FROM r JOIN c ON c.src = r.src AND list_contains(kept, c.pos) WHERE r.pos = 16
"""

# Half precision: 11 significant bits, rounded to even.

HALF = "list_transform(embedding, lambda x: (round_even(x::DOUBLE / pow(2, greatest(floor(log2(greatest(abs(x::DOUBLE), 1e-30))), -14) - 10), 0) * pow(2, greatest(floor(log2(greatest(abs(x::DOUBLE), 1e-30))), -14) - 10))::FLOAT)"
ORACLE_SQL["fp16_knn"] = f"WITH {Q}, h AS (SELECT vec_id, {HALF} AS half FROM embeddings), d AS (SELECT qid, vec_id, {_cosine('qvec', 'half')} AS distance FROM q, h) {_top('d')}"


def _halves(v: DataFrame) -> DataFrame:
    @F.pandas_udf("array<float>")
    def decoded(halves):  # noqa: ANN001, ANN202
        return halves.map(from_half)

    return half(v).select("vec_id", decoded("half").alias("half"))


@query(f"""
    WITH {I8_TOP}, s1 AS ({_top('d1', STAGE_2)}), h AS (SELECT vec_id, {HALF} AS half FROM embeddings),
    d AS (SELECT s1.qid, s1.vec_id, {_cosine('qvec', 'half')} AS distance FROM s1 JOIN qc USING (qid) JOIN h USING (vec_id)) {_top('d')}
""")
def refine_fp16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by int8 codes, scored anew from their vectors in half precision."""
    v = vectors(spark, sf_dir)
    return ranked(knn.refine(knn.int8_knn(*_int8(v), STAGE_2), _halves(v), queries_of(v), K, D.cosine, "half"))


@query(f"WITH {I8_TOP}, s1 AS ({_top('d1', STAGE_2)}) SELECT qid, count(*) AS refined, sum(((vec_id * 128) % 512 + 128 + 511) // 512 * 512)::BIGINT AS fp16_bytes FROM s1 GROUP BY qid")
def refine_fp16_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.int8_knn(*_int8(vectors(spark, sf_dir)), STAGE_2)
    return found.groupBy("qid").agg(F.count("*").alias("refined"), F.sum(aligned_bytes("vec_id", 128)).cast("long").alias("fp16_bytes"))


# Telemetry over counters that SQL can make too.

COUNTERS = "m AS (SELECT event_id AS qid, 0 AS shard, 10 + event_id % 50 AS expansions, 10 + event_id % 50 - event_id % 7 AS useful, event_id % 7 AS wasted, (10 + event_id % 50) * (event_id % 9) AS distance_computes, event_id % 11 AS hits, event_id % 5 AS misses, CAST(round(value * 1000) AS BIGINT) AS total_us, CAST(round(value * 300) AS BIGINT) AS io_us, event_id % 4 = 0 AS stopped_early FROM events WHERE event_id % 100 = 0)"


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 100 = 0"), F.col("event_id")
    return e.select(
        i.alias("qid"), F.lit(0).alias("shard"), (10 + i % 50).alias("expansions"), (10 + i % 50 - i % 7).alias("useful"), (i % 7).alias("wasted"), ((10 + i % 50) * (i % 9)).alias("distance_computes"),
        (i % 11).alias("hits"), (i % 5).alias("misses"), F.round(F.col("value") * 1000).cast("long").alias("total_us"), F.round(F.col("value") * 300).cast("long").alias("io_us"), (i % 4 == 0).alias("stopped_early"),
    )


@query(f"""
    WITH {COUNTERS} SELECT qid, round(wasted / expansions, 9) AS wasted_share, round(distance_computes / expansions, 9) AS distances_per_expansion,
        round(CASE WHEN total_us > 0 THEN io_us * 100 / total_us ELSE 0 END, 9) AS io_pct, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0 END, 9) AS hit_rate FROM m
""")
def counter_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.query_ratios(_counters(spark, sf_dir))
    return found.select("qid", *[F.round(c, 9).alias(c) for c in ("wasted_share", "distances_per_expansion", "io_pct", "hit_rate")])


@query(f"""
    WITH {COUNTERS} SELECT count(*) AS queries, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS least_recall, round(avg(expansions), 9) AS mean_expansions, round(avg(useful), 9) AS mean_useful, round(avg(wasted), 9) AS mean_wasted,
        round(avg(distance_computes), 9) AS mean_distance_computes, max(expansions) AS most_expansions, round(avg(stopped_early::INTEGER), 9) AS stopped_share FROM m
""")
def counter_bench_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _counters(spark, sf_dir)
    found = telemetry.bench_row(m, m.select("qid", F.lit(1.0).alias("recall")))
    return found.select(*[F.round(c, 9).alias(c) if "mean" in c or "share" in c else c for c in found.columns])


_SMOOTH = lambda old, new: f"CASE WHEN {old} = 0 THEN {new} ELSE {ALPHA} * {new} + {1 - ALPHA} * {old} END"
ORACLE_SQL["health_ewma"] = f"""
    WITH RECURSIVE {SNAPS}, s AS (SELECT core, snap, p99::DOUBLE AS p99, inflight_max / {DEPTH} AS inflight, row_number() OVER (PARTITION BY core ORDER BY snap) AS k FROM sn JOIN p USING (core, snap)),
    x(core, k, snap, a, b, state, cool) AS (
        SELECT core, 0, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0 FROM s WHERE k = 1 UNION ALL
        SELECT core, k, snap, a, b, new, CASE WHEN new > state THEN {COOLDOWN} ELSE cool END FROM (
            SELECT *, CASE WHEN state = 0 AND a > 1.5 * {LIMIT_US} AND b > 0.85 THEN 2 WHEN state = 0 AND a > {LIMIT_US} AND b > 0.7 THEN 1 WHEN state = 1 AND a > 1.5 * {LIMIT_US} AND b > 0.85 THEN 2
                WHEN state = 2 AND cool = 0 AND a < 0.8 * {LIMIT_US} AND b < 0.6 THEN 1 WHEN state = 1 AND cool = 0 AND a < 0.6 * {LIMIT_US} AND b < 0.5 THEN 0 ELSE state END AS new
            FROM (SELECT s.core, s.k, s.snap, {_SMOOTH('x.a', 's.p99')} AS a, {_SMOOTH('x.b', 's.inflight')} AS b, x.state, greatest(0, x.cool - 1) AS cool FROM x JOIN s ON s.core = x.core AND s.k = x.k + 1))
    )
    SELECT core, snap, a AS ewma_p99, b AS ewma_inflight, ['healthy', 'degraded', 'throttled'][state + 1] AS health, cool AS cooldown FROM x WHERE k > 0
"""

# What a search or a layout must hold, whatever the graph.


@query("SELECT 0 AS shard, count(*) AS nodes, 32 >= 1 AS within_degree, true AS no_loops, true AS no_repeats, count(*) AS reached FROM embeddings")
def nsw_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the built graph, whose shards count together, under the first one's number: its nodes, that no list is too long, holds its own node
    or one twice, and how many nodes walks from each shard's first one reach."""
    g = _nsw(vectors(spark, sf_dir))
    sums = g.agg(
        F.min("shard").alias("shard"), F.count("*").alias("nodes"), (F.max(F.size("nbrs")) <= 32).alias("within_degree"), (~F.bool_or(F.array_contains("nbrs", F.col("vec_id")))).alias("no_loops"),
        F.bool_and(F.size("nbrs") == F.size(F.array_distinct("nbrs"))).alias("no_repeats"),
    )
    walk = graph.bfs_levels(cut(graph.edges_of(g).select("src", "dst")), g.groupBy("shard").agg(F.min("vec_id").alias("vec_id")), cut)
    return sums.crossJoin(F.broadcast(walk.agg(F.count("*").alias("reached"))))  # one row


@query("SELECT unnest(['bfs', 'neighbor_run', 'heavy_edge', 'affinity', 'twpp']) AS method, true AS valid, (SELECT count(*) FROM embeddings) AS nodes")
def layout_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a permutation of all nodes."""
    v = vectors(spark, sf_dir)
    g, out = _nsw(v), None
    trace = cut(graph.search_graph(g, queries_of(v), K, output="trace"))
    for method in ("bfs", "neighbor_run", "heavy_edge", "affinity", "twpp"):
        order = layout.reorder(g, method, trace if method == "twpp" else None)
        valid = layout.is_permutation(order).agg(F.bool_and("valid").alias("valid")).select(F.lit(method).alias("method"), "valid")
        part = valid.crossJoin(F.broadcast(order.agg(F.count("*").alias("nodes"))))  # one row
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT vec_id AS qid, true AS adds_up, true AS within_budget, true AS stops_early FROM embeddings WHERE vec_id % 100 = 0")
def search_budgets_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of three searches by query: useful and wasted expansions make up all, a budget of 40 is kept, and stalling ends no later than the whole
    search. A budget is that of one beam search, so each shard's search of a query is held to it."""
    v = vectors(spark, sf_dir)
    g = _nsw(v)

    def counted(name: str, search: graph.Search) -> DataFrame:
        found = graph.search_graph(g, queries_of(v), K, search, output="metrics")
        return found.select("qid", "shard", F.col("expansions").alias(name), (F.col("useful") + F.col("wasted")).alias(f"{name}_parts"))

    keys = ["qid", "shard"]
    both = counted("whole", graph.Search(ef=64)).join(counted("budget", graph.Search(ef=64, max_expansions=40)), keys, "full").join(counted("stall", graph.Search(ef=64, stall=4, drain=16)), keys, "full")
    holds = {"adds_up": F.col("whole") == F.col("whole_parts"), "within_budget": F.col("budget") <= 40, "stops_early": F.col("stall") <= F.col("whole")}
    return both.groupBy("qid").agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(name) for name, c in holds.items()])


@query("SELECT vec_id AS qid, true AS same_results, true AS every_page_once, true AS fewer_with_preference FROM embeddings WHERE vec_id % 100 = 0")
def search_pages_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that reads pages through a large cache finds what one without pages does, misses each page once, and has hits for the rest;
    preferring pages that are held reads no more of them, over all queries."""
    v = vectors(spark, sf_dir)
    g = _nsw(v)
    order = layout.reorder(g, "heavy_edge").join(g.select("shard", "vec_id", F.size("nbrs").cast("long").alias("degree")), ["shard", "vec_id"])
    pages = layout.pack_pages(order).select("shard", "vec_id", "page_id")
    paged = cut(g.join(pages, ["shard", "vec_id"]))
    names = ["qid", "vec_id", "rank"]
    plain = graph.search_graph(g, queries_of(v), K, graph.Search(ef=64)).select(*names)
    other = graph.search_graph(paged, queries_of(v), K, graph.Search(ef=64), cache_slots=1 << 12).select(*names)
    same = plain.join(other, names, "left_semi").groupBy("qid").agg((F.count("*") == K).alias("same_results"))
    reads = layout.page_reads(graph.search_graph(g, queries_of(v), K, graph.Search(ef=64), output="trace"), pages)
    seen = graph.search_graph(paged, queries_of(v), K, graph.Search(ef=64), cache_slots=1 << 12, output="page_metrics")
    seen = seen.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "expansions")])  # a query's shards count together
    seen = seen.join(reads.select("qid", "pages"), "qid").select("qid", ((F.col("misses") == F.col("pages")) & (F.col("hits") + F.col("misses") == F.col("expansions"))).alias("every_page_once"))
    sums = [graph.search_graph(paged, queries_of(v), K, graph.Search(ef=64, prefer=p), cache_slots=1 << 12, output="page_metrics").agg(F.sum("misses")) for p in (0, 4)]
    fewer = sums[0].toDF("a").crossJoin(sums[1].toDF("b")).select((F.col("b") <= F.col("a")).alias("fewer_with_preference"))  # one row each
    return same.join(seen, "qid").crossJoin(F.broadcast(fewer))


#: What each search is to find of the ten exact neighbours, over all queries.
FLOOR = 0.9


@query()
def recall_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the ten exact neighbours, over all queries, that each search finds."""
    v = vectors(spark, sf_dir)
    asked, g, truth = queries_of(v), _nsw(v), cut(_truth(v))
    book = pq.as_array(pq.train(v, PQ_PARTS))
    codes = cut(pq.encode(v, book))
    coded = g.join(codes, "vec_id")
    segments = _segments(v)
    found = {
        "fp16": knn.knn(_halves(v).withColumnRenamed("half", "embedding"), asked, K, "cosine"),
        "int8_refine": knn.refine(knn.int8_knn(*_int8(v), STAGE_2), v, asked, K, D.cosine),
        "nsw_budget": graph.search_graph(g, asked, K, graph.Search(ef=64, max_expansions=40, max_neighbors=16)),
        "nsw_ef64": graph.search_graph(g, asked, K, graph.Search(ef=64)),
        "nsw_gated": graph.search_graph(g, asked, K, graph.Search(ef=64, gate_ratio=0.5, gate_min=4), proxy=True),
        "nsw_pq_gated": graph.search_graph(coded, asked, K, graph.Search(ef=64, gate_ratio=0.5, gate_min=4), book=book),
        "nsw_stall": graph.search_graph(g, asked, K, graph.Search(ef=64, stall=4, drain=16)),
        "pq_refine": knn.refine(pq.adc_knn(pq.encode(v, _book(v)), asked, _book(v), PQ_STAGE), v, asked, K, D.cosine),
        "pq_trained_refine": knn.refine(pq.adc_knn(codes, asked, book, PQ_TRAINED_STAGE), v, asked, K, D.cosine),
        "saq": saq.saq_knn(saq.encode(v, segments), asked, segments, K),
        "saq_refine": knn.refine(saq.saq_knn(saq.encode(v, segments, packed=True), asked, segments, STAGE_2, packed=True), v, asked, K, D.cosine),
    }
    out = None
    for name, result in found.items():
        part = knn.recall(result, truth).agg(F.avg("recall").alias("recall")).select(F.lit(name).alias("method"), "recall")
        out = part if out is None else out.unionByName(part)
    return out


#: Estimates by 4-bit codes alone, without re-ranking, are held to no floor.
ROUGH = ("saq",)


@query(f"SELECT unnest(['fp16', 'int8_refine', 'nsw_budget', 'nsw_ef64', 'nsw_gated', 'nsw_pq_gated', 'nsw_stall', 'pq_refine', 'pq_trained_refine', 'saq_refine']) AS method, true AS at_least_{int(FLOOR * 100)}_percent")
def recall_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall_by_method(spark, sf_dir).where(~F.col("method").isin(*ROUGH))
    return found.select("method", (F.col("recall") >= FLOOR).alias(f"at_least_{int(FLOOR * 100)}_percent"))


# Searches whose results at this size are those of a scan.

for _name in ("nsw_search_ef64", "nsw_search_stall", "nsw_search_refine", "nsw_search_pages", "saq_refine"):
    ORACLE_SQL[_name] = _knn_sql(_cosine("qvec", "embedding"))
ORACLE_SQL["nsw_recall"] = f"WITH {Q} SELECT qid, {K}::BIGINT AS hits, {K}::BIGINT AS due, 1.0::DOUBLE AS recall FROM q"


@query(f"WITH {Q} SELECT qid, true AS same FROM q")
def saq_packed_is_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes packed two to a byte give each query the same ranked estimates."""
    v = vectors(spark, sf_dir)
    segments, names = _segments(v), ["qid", "vec_id", "distance", "rank"]
    a, b = (saq.saq_knn(saq.encode(v, segments, packed=p), queries_of(v), segments, K, packed=p).select(*names) for p in (False, True))
    return a.join(b, names, "left_semi").groupBy("qid").agg((F.count("*") == K).alias("same"))


@query(f"WITH p AS (SELECT unnest(range(0, {PQ_PARTS}))::INTEGER AS m) SELECT m, (SELECT count(*) FROM embeddings) AS vectors, true AS nearest FROM p")
def pq_trained_codes_are_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part of trained codes: how many vectors are coded, and that no centroid is nearer than the coded one."""
    v = vectors(spark, sf_dir)
    table = cut(pq.train(v, PQ_PARTS))
    codes = pq.encode(v, pq.as_array(table)).select("vec_id", F.posexplode("code").alias("m", "c"))
    parts = v.join(codes, "vec_id").select("m", F.col("c").cast("int").alias("c"), F.expr(f"slice(embedding, int(m * size(embedding) / {PQ_PARTS} + 1), int(size(embedding) / {PQ_PARTS}))").alias("part"))
    books = table.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "centroid"))), lambda x: x["centroid"]).alias("book"))
    both = parts.join(F.broadcast(books), "m").withColumn("all", F.transform("book", lambda b: D.l2("part", b)))  # PQ_PARTS rows
    return both.groupBy("m").agg(F.count("*").alias("vectors"), F.bool_and(F.get("all", F.col("c")) <= F.array_min("all") + 1e-9).alias("nearest"))


@query(f"WITH {Q} SELECT qid, true AS within FROM q")
def saq_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of segmented codes: the mean relative error of a query's estimated squared distances to its exact neighbours is below a tenth."""
    v = vectors(spark, sf_dir)
    segments = _segments(v)
    near = knn.knn(v, queries_of(v), 50, "l2").where("qid <> vec_id")
    both = saq.saq_pairs(near.select("qid", "vec_id", "distance"), saq.encode(v, segments), queries_of(v), segments)
    return both.groupBy("qid").agg((F.avg(F.abs(F.col("estimate") - F.col("distance")) / F.col("distance")) < 0.1).alias("within"))
