import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.operators import adaptive, graph, layout, telemetry
from nearfield.streaming.health import Health, health_batch, health_stream
from tests.test_distance_codes import table
from tests.test_search import data, queries

LINKS = [[1, 2], [0, 2, 3], [0, 1], [1, 4], [3], []]


def small(spark):
    return spark.createDataFrame([(0, k, x) for k, x in enumerate(LINKS)], "shard int, vec_id long, nbrs array<long>")


def test_bfs_order():
    assert layout.bfs_order([np.array(x, int) for x in LINKS], [0]) == [0, 1, 2, 3, 4, 5]
    assert layout.bfs_order([np.array(x, int) for x in LINKS], [4]) == [4, 3, 1, 0, 2, 5]


@pytest.mark.parametrize("method", ["bfs", "neighbor_run", "heavy_edge", "affinity", "twpp"])
def test_reorders_are_permutations(spark, method):
    trace = spark.createDataFrame([(1, 0, 0, 3, -1), (1, 0, 1, 4, 3), (2, 0, 0, 4, -1), (2, 0, 1, 3, 4)], "qid long, shard int, step int, vid long, parent long")
    order = layout.reorder(small(spark), method, trace)
    assert layout.is_permutation(order).collect()[0].valid
    if method == "twpp":
        assert {r.vec_id for r in order.where("new_vid < 2").collect()} == {3, 4}
    with pytest.raises(ValueError):
        layout.reorder(small(spark), "other")


def test_greedy_follows_the_weights():
    rng = random.Random(1)
    links = [np.array(sorted({rng.randrange(60) for _ in range(6)} - {k}), int) for k in range(60)]
    into = layout._inbound(links)
    indegree = np.array([len(x) for x in into], float)
    page = 120
    got = layout.greedy_order(links, indegree, lambda u, v: indegree[u] + indegree[v], into, page)
    assert sorted(got) == list(range(60))
    left, want = set(range(60)), []
    while left:  # the same by looking at every node each time
        v = min(left, key=lambda x: (-indegree[x], x))
        members, room = [], page
        while v is not None:
            members.append(v)
            left.discard(v)
            room -= 2 + 4 * len(links[v])
            score = {u: sum(indegree[u] + indegree[m] for m in members if m in links[u]) for u in left}
            fits = [u for u in left if score[u] > 0 and 2 + 4 * len(links[u]) <= room]
            v = min(fits, key=lambda u: (-score[u], -indegree[u], u)) if fits else None
        want += members
    assert got == want


def test_packing(spark):
    order = layout.reorder(small(spark), "bfs").join(small(spark).select("vec_id", F.size("nbrs").cast("long").alias("degree")), "vec_id")
    one = layout.pack_pages(order).orderBy("new_vid").collect()
    assert {r.page_id for r in one} == {0} and one[4].offset + 2 + 4 * one[4].degree == 14 + 10 + 10 + 10 + 6
    several = layout.pack_pages(order, page=24).orderBy("new_vid").collect()
    assert [(r.page_id, r.offset) for r in several] == [(0, 0), (0, 14), (1, 0), (1, 10), (2, 0), (2, 6)]
    stats = layout.packing_stats(layout.pack_pages(order, page=24), 24).first()
    assert stats.pages == 3 and stats.in_use == pytest.approx(52 / 72)
    with pytest.raises(Exception, match="exceeds a page"):
        layout.pack_pages(order, page=12).collect()


def test_trace_measures(spark):
    trace = spark.createDataFrame([(1, 0, 0, 0, -1), (1, 0, 1, 1, 0), (1, 0, 2, 3, 0), (2, 0, 0, 1, -1), (2, 0, 1, 0, 1)], "qid long, shard int, step int, vid long, parent long")
    assert {(r.a, r.b): r.n for r in layout.co_expansions(trace).collect()} == {(0, 1): 2, (0, 3): 1}
    assert {r.vid: r.n for r in layout.node_counts(trace).collect()} == {0: 2, 1: 2, 3: 1}
    pages = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 3, 1)], "shard int, vec_id long, page_id int")
    assert {r.qid: (r.expansions, r.pages) for r in layout.page_reads(trace, pages).collect()} == {1: (3, 2), 2: (2, 1)}
    assert {r.qid: r.rate for r in layout.neighbor_coexpansion(trace, graph.edges_of(small(spark))).collect()} == {1: 0.5, 2: 1.0}
    head = layout.page_head_share(trace, pages).orderBy(F.desc("reads")).collect()
    assert head[0].share == 0.8 and head[1].share == 1
    cold = {r.qid: (r.hits, r.misses) for r in layout.simulate_cache(trace, pages, 16).collect()}
    warm = {r.qid: (r.hits, r.misses) for r in layout.simulate_cache(trace, pages, 16, cold=False).collect()}
    pinned = {r.qid: (r.hits, r.misses) for r in layout.simulate_cache(trace, pages, 16, pin=1).collect()}
    assert cold == {1: (1, 2), 2: (1, 1)} and warm == {1: (1, 2), 2: (2, 0)} and pinned == {1: (2, 1), 2: (2, 0)}


def test_cache_evicts_and_bypasses():
    cache = layout.PageCache(8, 8)
    for p in range(9):
        assert not cache.read(p)
    assert cache.misses == 9 and cache.read(8) and not cache.read(0)
    full = layout.PageCache(2, 2, pinned=[1])
    assert full.read(1) and not full.read(2) and not full.read(3) and full.read(1)


def test_heavy_edges_read_fewer_pages(spark):
    v = data(1200, 16)
    g = graph.nsw_build(table(spark, v), "cosine", 16, 60).cache()
    trace = graph.search_graph(g, queries(spark, data(20, 16, 3)), 10, graph.Search(ef=64), output="trace").cache()
    degree = g.select("shard", "vec_id", F.size("nbrs").cast("long").alias("degree"))
    reads = {m: layout.page_reads(trace, layout.pack_pages(layout.reorder(g, m).join(degree, ["shard", "vec_id"]), 1024)).agg(F.avg("pages")).first()[0] for m in ("bfs", "heavy_edge")}
    assert reads["heavy_edge"] <= reads["bfs"] * 1.05


def test_adaptive_golden_values(spark):
    stats = adaptive.dimension_stats(table(spark, [[1, 0], [0, 1], [-1, 0], [0, -1]]))
    rows = stats.orderBy("pos").collect()
    assert [r["mean"] for r in rows] == [0, 0] and [r.variance for r in rows] == pytest.approx([2 / 3, 2 / 3])
    params = {r.qid: (r.mu, r.sigma) for r in adaptive.distance_params(queries(spark, [[1, 0], [0, 0]]), stats).collect()}
    assert params[0] == pytest.approx((1, math.sqrt(2 / 3))) and params[1] == (1, 0.01)
    scores = spark.createDataFrame([(k, float(s)) for k, s in enumerate((15, 7, 3, 1))], "qid long, score double")
    found = adaptive.lookup(scores, [(10.0, 50, 1, 2), (5.0, 100, 3, 4), (2.0, 150, 5, 6)], (200, 0, 0)).orderBy("qid").collect()
    assert [r.ef for r in found] == [50, 100, 150, 200]
    with pytest.raises(Exception, match="two vectors"):
        adaptive.dimension_stats(table(spark, [[1, 0]])).collect()


def test_difficulty_by_brute_force(spark):
    v, q = data(500, 8), data(3, 8, 4)
    stats = adaptive.dimension_stats(table(spark, v))
    params = adaptive.distance_params(queries(spark, q), stats)
    got = {r.qid: r.score for r in adaptive.difficulty(table(spark, v).repartition(3), queries(spark, q), params).collect()}
    ends = {r.qid: [r[f"e{k}"] for k in range(5)] for r in params.select("qid", *[c.alias(f"e{k}") for k, c in enumerate(adaptive.thresholds(F.col("mu"), F.col("sigma")))]).collect()}
    for k in range(3):
        d = D.exact_distance("cosine", np.repeat(q[k][None], 500, 0), v)
        bins = [next((b for b, e in enumerate(ends[k]) if x <= e), None) for x in d]
        assert got[k] == pytest.approx(sum(100 * math.exp(-b) for b in bins if b is not None) / 500)


def test_histogram(spark):
    values = [0, 1, 2, 3, 4, 1000, 1023, 1024, 2**40]
    rows = spark.createDataFrame([("a", x) for x in values], "key string, v long")
    hist = telemetry.histogram(rows, "v", "key")
    assert {r.bucket: r.n for r in hist.collect()} == {0: 2, 1: 2, 2: 1, 9: 2, 10: 1, 40: 1}
    one = telemetry.histogram_percentiles(hist, "key", points=(1.0, 50.0, 99.0)).first()
    assert (one.p1, one.p50, one.p99, one["count"]) == (0, 4, 2**40, 9)
    parts = telemetry.histogram(rows.where("v < 4"), "v", "key").unionByName(telemetry.histogram(rows.where("v >= 4"), "v", "key"))
    assert sorted(map(tuple, telemetry.merge(parts, "key").collect())) == sorted(map(tuple, hist.collect()))


@pytest.mark.parametrize("rule", ["nearest", "floor"])
def test_percentiles(spark, rule):
    rng = random.Random(5)
    values = [rng.randint(0, 40) for _ in range(101)]
    got = telemetry.exact_percentiles(spark.createDataFrame([(1, x) for x in values], "k int, v long"), "v", "k", points=(0.0, 37.0, 99.0), rule=rule).first()
    rank = (lambda p: math.floor(p / 100 * 100 + 0.5)) if rule == "nearest" else (lambda p: min(math.floor(101 * p / 100), 100))
    assert [got.p0, got.p37, got.p99] == [sorted(values)[rank(p)] for p in (0, 37, 99)]


@pytest.mark.parametrize(("levels", "want"), [([(1, 100, 10), (2, 190, 12), (4, 200, 15), (8, 201, 50)], 4), ([(1, 10, 5), (2, 10, 6)], 2), ([(1, 100, 10), (2, 50, 10)], 1), ([], 1), ([(4, 9, 9)], 4), ([(1, 10, 10), (2, 100, 30)], 1)])
def test_knee(spark, levels, want):
    df = spark.createDataFrame([(q, float(i), float(p)) for q, i, p in levels], "qd int, iops double, p99_us double")
    assert telemetry.knee(df).first().qd == want


def test_admission():
    assert [telemetry.admitted(8, h) for h in ("healthy", "degraded", "throttled")] == [8, 6, 4] and telemetry.admitted(1, "throttled") == 1


def states(windows, limit=1000.0):
    health, out = Health(), []
    for p99, inflight in windows:
        health.update(p99, inflight, limit)
        out.append(health.state)
    return out


def test_health_scenarios():
    assert states([(500, 0.3)] * 5) == [0] * 5
    assert states([(1200, 0.8)]) == [1]
    assert states([(2000, 0.9)]) == [2]  # straight past degraded
    assert states([(1200, 0.8), (2000, 0.95), (2000, 0.95), (2000, 0.95)])[-1] == 2
    assert states([(2000, 0.3)] * 3) == [0] * 3  # slow but idle
    calm = states([(2000, 0.9)] + [(100, 0.1)] * 12)
    assert calm[1] == calm[2] == 2 and calm[-1] == 0 and calm == sorted(calm, reverse=True)
    swing = states([(1100, 0.75), (900, 0.65)] * 10)
    assert swing == sorted(swing)  # no going to and fro
    assert states([(9e9, 1.0)] * 3, 0.0) == [0, 0, 0]


def test_health_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(core, snap, float(rng.randint(1, 3000)), rng.random()) for snap in range(12) for core in range(3)]
    schema = "core long, snap long, p99 double, inflight double"
    for part in range(3):  # files arrive one after the other
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, health_batch(spark.createDataFrame(rows, schema), 1000.0).collect()))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = health_stream(stream, 1000.0).writeStream.format("memory").queryName("health_rows").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("health_rows").collect())) == want


def test_snapshots_and_stats(spark):
    rows = [(c, s, 100 * (s + 1), 10, s, 5, 15, 1) for c in range(2) for s in range(10)]
    snaps = telemetry.snapshots(spark.createDataFrame(rows, "core long, seq long, total_us long, io_wait_us long, inflight long, sem_ns long, device_ns long, io_count long"), 5)
    last = telemetry.latest_snapshots(snaps)
    assert {(r.core, r.snap) for r in last.collect()} == {(0, 1), (1, 1)}
    got = telemetry.engine_stats(last).first()
    assert (got.total_queries, got.max_p99, got.max_inflight, got.sem_wait_pct, got.device_ns_per_io) == (10, 512, 9, 25, 15)
    assert got.avg_io_wait_pct == pytest.approx(5 * 10 * 100 / (600 + 700 + 800 + 900 + 1000))


def test_ratios_and_bench_row(spark):
    metrics = spark.createDataFrame([(1, 0, 10, 6, 4, 100, False), (1, 1, 10, 5, 5, 50, True), (2, 0, 0, 0, 0, 1, False)], "qid long, shard int, expansions long, useful long, wasted long, distance_computes long, stopped_early boolean")
    ratios = {(r.qid, r.shard): (r.wasted_share, r.distances_per_expansion) for r in telemetry.query_ratios(metrics).collect()}
    assert ratios == {(1, 0): (0.4, 10), (1, 1): (0.5, 5), (2, 0): (0, 0)}
    row = telemetry.bench_row(metrics, spark.createDataFrame([(1, 0.9), (2, 0.7)], "qid long, recall double")).first()
    assert (row.queries, row.least_recall, row.mean_expansions, row.stopped_share) == (2, 0.7, 10, 0.5) and row.recall == pytest.approx(0.8)


def test_only_twpp_splits_its_queries(spark, monkeypatch):
    from nearfield.plans import catalog

    seen = []

    def searched(g, some, *rest, **more):
        seen.append(sorted(r.qid for r in some.collect()))
        raise InterruptedError

    v = spark.createDataFrame([(k, [1.0]) for k in range(0, 500, 50)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(catalog, "vectors", lambda *_: v)
    monkeypatch.setattr(catalog, "_nsw", lambda v: None)
    monkeypatch.setattr(catalog.graph, "search_graph", searched)
    whole = ["trace_coexpand", "trace_node_counts", "trace_neighbor_rate", "layout_cache", "layout_head_share", *[f"layout_page_reads_{m}" for m in ("bfs", "neighbor_run", "heavy_edge", "affinity")]]
    for name in [*whole, "layout_reorder_twpp", "layout_page_reads_twpp"]:
        with pytest.raises(InterruptedError):
            catalog.QUERIES[name](spark, "")
    assert seen == [[0, 100, 200, 300, 400]] * len(whole) + [[0, 200, 400], [100, 300]]


def test_a_record_larger_than_a_page_has_its_own(spark):
    """As the SQL of exact_pack_pages: such a record begins a page, the first one the first, and the next record another."""
    order = spark.createDataFrame([(0, k, k, d) for k, d in enumerate([9, 1, 1, 9, 9, 1])], "shard int, new_vid long, vec_id long, degree long")
    got = layout.pack_pages(order, page=12, long_records=True).orderBy("new_vid").collect()
    assert [(r.page_id, r.offset) for r in got] == [(0, 0), (1, 0), (1, 6), (2, 0), (3, 0), (4, 0)]


def test_exact_pages_with_hubs_by_sql(spark, tmp_path):
    """A vector that 199 others are near to has a record of more than a page; pages, statistics and reads are those of SQL."""
    import duckdb

    from nearfield.plans import catalog, exact

    rng = np.random.default_rng(3)
    far = rng.standard_normal((200, 256)) / 16
    far[:, 0] += 1
    far[7] = np.arange(256) == 0  # all are near to it
    spark.createDataFrame([(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(far)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("exact_pack_pages", "exact_packing_stats", "exact_page_reads", "exact_head_share", "exact_cache"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)), base.sql(catalog.ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()), name
    assert exact._pages(catalog.vectors(spark, str(tmp_path))).agg({"degree": "max"}).first()[0] > 127
