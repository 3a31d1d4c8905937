import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import codes as C
from nearfield.functions import distance as D
from nearfield.operators import adaptive, graph, knn, pq, saq
from tests.test_distance_codes import table


def data(n, dim, seed=1):
    v = np.random.default_rng(seed).uniform(-1, 1, (n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def queries(spark, rows, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in v]) for k, v in enumerate(rows)], "qid long, qvec array<float>")


def brute(v, q, k, metric):
    d = D.exact_distance(metric, np.repeat(q[None], len(v), 0), v)
    order = np.lexsort((np.arange(len(v)), d))[:k]
    return [(int(x), float(d[x])) for x in order]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_knn_by_brute_force(spark, metric, monkeypatch):
    v, q = data(300, 16), data(7, 16, 2)
    monkeypatch.setattr(knn, "QUERY_BYTES", 16 * 8 * 3)
    monkeypatch.setattr(knn, "FEW", 2)  # several passes
    got = knn.knn(table(spark, v).repartition(3), queries(spark, q), 12, metric).orderBy("qid", "rank").collect()
    assert [(r.qid, r.vec_id, r.distance) for r in got] == [(k, *x) for k in range(7) for x in brute(v, q[k], 12, metric)]


def test_knn_ties_and_ends(spark):
    v = np.repeat(data(3, 4), 20, 0)
    got = knn.knn(table(spark, v).repartition(4), queries(spark, v[:1]), 25, "l2").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [x for x, _ in brute(v, v[0], 25, "l2")]
    assert knn.knn(table(spark, v[:5]), queries(spark, v[:1]), 10).count() == 5
    assert knn.knn(table(spark, v), queries(spark, v[:0]), 10).count() == 0
    assert knn.knn(table(spark, v), queries(spark, v[:1]), 60, no_self=True).where("vec_id = 0").count() == 0


def test_bad_vectors_are_errors(spark):
    for bad in ([1.0], [1.0, float("nan")]):
        rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "vec_id long, embedding array<float>")
        with pytest.raises(Exception, match="not a vector"):
            knn.knn(rows, queries(spark, [[1, 2]]), 1).collect()


def test_within(spark):
    v = data(200, 8)
    got = {(r.qid, r.vec_id) for r in knn.within(table(spark, v), queries(spark, v[:5]), 0.5).collect()}
    assert got == {(k, i) for k in range(5) for i in range(200) if ((v[k].astype(float) - v[i]) ** 2).sum() <= 0.5}


def test_int8_and_refine(spark):
    v = data(400, 32)
    df = table(spark, v)
    coded = df.select("vec_id", C.int8_code("embedding").alias("code"))
    asked = coded.where("vec_id < 4").select(F.col("vec_id").alias("qid"), F.col("code").alias("qvec"))
    near = knn.int8_knn(coded, asked, 400)
    exact = knn.knn(df, queries(spark, v[:4]), 10, "cosine")
    full = knn.refine(near, df, queries(spark, v[:4]), 10, D.cosine)
    key = lambda x: sorted((r.qid, r.rank, r.vec_id, r.distance) for r in x.collect())
    assert key(full) == key(exact)  # all candidates refined is exact
    recalls = [knn.recall(knn.refine(near.where(F.col("rank") <= r), df, queries(spark, v[:4]), 10, D.cosine), exact).agg(F.avg("recall")).first()[0] for r in (10, 20, 40)]
    assert recalls == sorted(recalls) and recalls[-1] >= 0.95


def test_recall_edges(spark):
    a = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 1)], "qid long, vec_id long")
    t = spark.createDataFrame([(1, 5), (1, 9), (2, 8)], "qid long, vec_id long")
    assert {r.qid: r.recall for r in knn.recall(a, t).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}


def test_pq(spark):
    i, d = np.arange(512)[:, None], np.arange(8)[None]
    v = (np.where(i < 256, 1, -1) + 0.001 * i + 0.01 * d).astype(np.float32)
    book = pq.as_array(pq.train(table(spark, v), 4, 10))
    assert book.shape == (4, 256, 2)
    codes = pq.encode(table(spark, v), book)
    near = pq.adc_knn(codes, queries(spark, v[:1]), book, 100)
    assert near.where("vec_id >= 256").count() == 0
    (lut,) = pq.lookup_tables(queries(spark, v[:1]), book).collect()
    assert lut.lut[1 * 256 + 3] == pytest.approx(((v[0, 2:4] - book[1, 3]) ** 2).sum())
    w = data(400, 16, 3)
    book = pq.as_array(pq.train(table(spark, w), 4, 20))
    for metric in ("l2", "cosine", "ip"):
        found = pq.adc_knn(pq.encode(table(spark, w), book), queries(spark, w[:5]), book, 10, metric)
        exact = knn.knn(table(spark, w), queries(spark, w[:5]), 10, metric)
        assert knn.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.4
    with pytest.raises(ValueError, match="needs 256"):
        pq.train(table(spark, w[:100]), 4)
    with pytest.raises(ValueError, match="divide"):
        pq.train(table(spark, w), 5)


def test_kmeans():
    x = np.concatenate([np.zeros((50, 2)), np.ones((50, 2)) * 9])
    assert sorted(pq.kmeans(x, 2, 10, 1).round().tolist()) in ([[0, 0], [9, 9]], [[0, 0], [0, 0]], [[9, 9], [9, 9]])
    assert len(pq.kmeans(x, 5, 10, 1)) == 5


@pytest.mark.parametrize("count", [1, 3])
def test_saq(spark, count):
    v, q = data(300, 24), data(4, 24, 2)
    errors = []
    exact = ((q[:, None].astype(float) - v[None]) ** 2).sum(2)
    for bits in (2, 4, 8):
        segments = saq.Segments.even(24, count, bits)
        found = saq.encode_block(v.astype(float), segments)
        d = saq.estimate_block(q.astype(float), [c for c, _, _ in found], np.stack([r for _, r, _ in found], 1), np.stack([n for *_, n in found], 1), segments)
        errors.append(np.abs(d - exact).mean() / exact.mean())
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.05 and errors[2] < 0.005
    segments = saq.Segments.even(24, count, 4)
    plain = saq.saq_knn(saq.encode(table(spark, v), segments), queries(spark, q), segments, 10).collect()
    packed = saq.saq_knn(saq.encode(table(spark, v), segments, True), queries(spark, q), segments, 10, True).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, packed))
    assert saq.memory_bytes(10, segments, True) < saq.memory_bytes(10, segments)
    odd = np.arange(15, dtype=np.uint8).reshape(3, 5) % 16
    assert np.array_equal(saq.unpack(saq.pack(odd), 5), odd)


def beam(v, links, q, search, entries=(0,), **more):
    return graph.beam_search(links.__getitem__, lambda ids: D.block_distance("l2", q[None], v[ids])[0], list(entries), search, len(v), **more)


def test_graph_and_beam():
    v = data(500, 16).astype(float)
    links = graph.build_shard(v, "l2", 16, 80)
    assert all(len(set(x.tolist())) == len(x) <= 16 and k not in x for k, x in enumerate(links))
    hits, plain = 0, None
    for q in data(30, 16, 5).astype(float):
        plain = beam(v, links, q, graph.Search(ef=64))
        truth = {i for i, _ in brute(v, q, 10, "l2")}
        hits += len(truth & {i for _, i in plain.results[:10]})
        assert plain.results == sorted(plain.results) and len(plain.results) == 64 and not plain.stopped
        assert beam(v, links, q, graph.Search(ef=64, max_expansions=10**6)).results == plain.results
        assert beam(v, links, q, graph.Search(ef=64, gate_ratio=1.0), proxy=lambda ids: ids).results == plain.results
        short = beam(v, links, q, graph.Search(ef=64, max_expansions=10))
        assert len(short.expanded) == 10 and short.stopped
        stalled = beam(v, links, q, graph.Search(ef=64, stall=4, drain=0))
        assert len(stalled.expanded) <= len(plain.expanded)
        drained = beam(v, links, q, graph.Search(ef=64, stall=4, drain=16))
        assert len(stalled.expanded) <= len(drained.expanded) <= len(plain.expanded)
        kept = beam(v, links, q, graph.Search(ef=64, prefer=4), resident=lambda u: u % 2 == 0)
        assert {i for _, i in kept.results[:3]} & {i for _, i in plain.results[:10]}
    assert hits / 300 >= 0.85


def test_entries_beyond_ef():
    v = data(50, 8).astype(float)
    links = graph.build_shard(v, "l2", 8, 40)
    found = beam(v, links, v[7], graph.Search(ef=5), entries=range(20))
    assert found.results[0] == (pytest.approx(0, abs=1e-12), 7) and len(found.results) == 5


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_nsw_over_shards(spark, shard_rows):
    v = data(400, 16)
    g = graph.nsw_build(table(spark, v).repartition(3), "cosine", 16, 60, shard_rows).cache()
    assert g.count() == 400 and g.select("shard").distinct().count() == -(-400 // shard_rows)
    asked = queries(spark, data(10, 16, 9))
    exact = knn.knn(table(spark, v), asked, 10, "cosine")
    found = graph.search_graph(g, asked, 10)
    assert knn.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    trace = graph.search_graph(g, asked, 10, output="trace")
    metrics = graph.search_graph(g, asked, 10, output="metrics")
    assert trace.count() == metrics.agg(F.sum("expansions")).first()[0]
    again = graph.nsw_build(table(spark, v[::-1]).withColumn("vec_id", 399 - F.col("vec_id")), "cosine", 16, 60, shard_rows)
    assert sorted(map(str, again.select("vec_id", "nbrs").collect())) == sorted(map(str, g.select("vec_id", "nbrs").collect()))


def test_graph_measures(spark):
    nodes = spark.createDataFrame([(k,) for k in range(6)], "vec_id long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (4, 3)], "src long, dst long")
    assert {r.vec_id: r.degree for r in graph.degrees(edges, nodes).collect()} == {0: 2, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    indegree = graph.degrees(edges, nodes, "dst")
    assert [(r.vec_id, r["rank"]) for r in graph.entry_set(indegree, 3).orderBy("rank").collect()] == [(2, 1), (3, 2), (1, 3)]
    from nearfield.plans.checkpoint import cut

    levels = graph.bfs_levels(edges, nodes.where("vec_id = 0"), cut)
    assert {r.vec_id: r.level for r in levels.collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_prune_keeps_the_diverse(spark):
    v = [[0, 0], [1, 0], [1.1, 0], [0, 1]]
    edges = graph.knn_graph(table(spark, v), 3, "l2")
    kept = graph.prune(edges, table(spark, v), 2, "l2").where("src = 0").orderBy("pos").collect()
    assert [r.dst for r in kept] == [1, 3]


def test_neighbor_codes_and_entry_diagnostics(spark):
    g = spark.createDataFrame([(0, [2, 1]), (1, []), (2, [0])], "vec_id long, nbrs array<long>")
    codes = spark.createDataFrame([(k, [k, k]) for k in range(3)], "vec_id long, code array<smallint>")
    got = {r.vec_id: (r.nbrs, r.nbr_codes) for r in graph.with_neighbor_codes(g, codes).collect()}
    assert got == {0: ([2, 1], [[2, 2], [1, 1]]), 1: ([], None), 2: ([0], [[0, 0]])}
    with pytest.raises(Exception, match="no code"):
        graph.with_neighbor_codes(g, codes.where("vec_id < 2")).collect()
    trace = spark.createDataFrame([(1, 0, 9), (1, 1, 5), (1, 2, 4), (2, 0, 7)], "qid long, step int, vid long")
    results = spark.createDataFrame([(1, 4, 1), (1, 5, 2), (2, 8, 1)], "qid long, vec_id long, rank int")
    assert {r.qid: (r.best_at, r.first_top_at) for r in graph.entry_diagnostics(trace, results).collect()} == {1: (2, 1), 2: (None, None)}


def test_sql_functions(spark):
    from nearfield.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT vec_l2(array(0D, 0D), array(3D, 4D)) a, vec_ip(array(1D, 2D, 3D), array(4D, 5D, 6D)) b, vec_cosine(array(0D), array(1D)) c, vec_norm(array(3D, 4D)) d, vec_normalize(array(3D, 4D)) e, vec_int8(array(0.5D, -2D)) f").first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (25, -32, 1, 5, [0.6, 0.8], [64, -127])


BAD = {"null": None, "a null in it": [1.0, None, 0.5, 0.5], "NaN": [1.0, float("nan"), 0.5, 0.5], "infinity": [1.0, float("inf"), 0.5, 0.5], "length": [1.0, 2.0]}
GOOD = [(k, [float(k % 7), 1.0, 0.5, float(k % 3)]) for k in range(40)]
BOOK = np.random.default_rng(0).standard_normal((2, 4, 2))
TAKES = {
    "knn": lambda v, q: knn.knn(v, q), "within": lambda v, q: knn.within(v, q, 100.0), "difficulty": lambda v, q: adaptive.difficulty(v, q, q.select("qid", F.lit(1.0).alias("mu"), F.lit(0.1).alias("sigma"))),
    "stats": lambda v, q: adaptive.dimension_stats(v), "pq": lambda v, q: pq.encode(v, BOOK), "train": lambda v, q: pq.train(v, 2, k=4), "saq": lambda v, q: saq.encode(v, saq.Segments.even(4, 2)),
    "build": lambda v, q: graph.nsw_build(v), "prune": lambda v, q: graph.prune(v.select(F.lit(0).cast("long").alias("src"), F.col("vec_id").alias("dst"), F.lit(0.5).alias("distance")), v),
    "queries": lambda v, q: knn.knn(v.where("vec_id < 40"), v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))),
    "graph queries": lambda v, q: graph.search_graph(graph.nsw_build(v.where("vec_id < 40")), v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), 3),
}


@pytest.mark.parametrize("bad", list(BAD))
def test_bad_vectors_are_errors(spark, bad):
    v = spark.createDataFrame([*GOOD, (99, BAD[bad])], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    for name, take in TAKES.items():
        with pytest.raises(Exception, match="not a vector|not a finite"):
            take(v, q).collect()
            raise AssertionError(name)


@pytest.mark.parametrize("bad", ["a null in it", "NaN", "infinity"])
def test_bad_numbers_have_no_code(spark, bad):
    v = spark.createDataFrame([(99, BAD[bad])], "vec_id long, embedding array<float>")
    for take in (lambda: v.select(C.int8_code("embedding")), lambda: C.dimension_scales(v)):
        with pytest.raises(Exception, match="not a finite"):
            take().collect()


def test_a_candidate_without_a_vector_is_an_error(spark):
    v = spark.createDataFrame(GOOD, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    with pytest.raises(Exception, match="has no vector"):
        knn.refine(spark.createDataFrame([(1, 1000)], "qid long, vec_id long"), v, q, 3, D.l2).collect()


def test_many_ties_take_little_memory():
    """4,000 equal vectors of 256 dimensions and 300 queries: the k smallest ids, without queries times ties of vectors at once."""
    import tracemalloc

    block, part = np.ones((4000, 256)), np.random.default_rng(1).standard_normal((300, 256))
    ids = np.arange(4000)[::-1].copy()
    tracemalloc.start()
    near, fine = knn._candidates(part, block, ids, D.block_distance("l2", part, block), 5, lambda a, b: D.exact_distance("l2", a, b))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = np.take_along_axis(ids[near], np.lexsort((ids[near], fine), axis=1)[:, :5], 1)
    assert (best == np.arange(5)).all() and most < 400e6


def test_levels_beyond_the_bound_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "vec_id long")
    cut = lambda df: df.checkpoint()
    assert graph.bfs_levels(edges, start, cut).count() == 13
    with pytest.raises(ValueError, match="levels"):
        graph.bfs_levels(edges, start, cut, most=5)


def test_a_cache_of_pages_changes_no_result(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(k, rng.standard_normal(8).tolist()) for k in range(200)], "vec_id long, embedding array<float>")
    g = graph.nsw_build(v).withColumn("page_id", (F.col("vec_id") / 10).cast("int"))
    q = knn.queries_from(v, 20)
    plain = graph.search_graph(g, q, 5).collect()
    assert sorted(map(tuple, graph.search_graph(g, q, 5, cache_slots=64).collect())) == sorted(map(tuple, plain))
    for r in graph.search_graph(g, q, 5, cache_slots=64, output="page_metrics").collect():
        assert r.hits + r.misses == r.expansions and r.misses <= 20


def test_a_build_scores_rows_in_blocks(monkeypatch):
    """A build that searched for each row took 24 s for 4,000 rows, one in blocks 2 s; both find what a scan finds."""
    v = data(600, 16).astype(float)
    monkeypatch.setattr(graph, "beam_search", None)  # not called
    monkeypatch.setattr(graph, "BUILD_ROWS", 50)
    links = graph.build_shard(v, "cosine", 8, 40)
    monkeypatch.undo()
    assert all(len(set(x.tolist())) == len(x) <= 8 and k not in x for k, x in enumerate(links))
    score, hits = graph.kernel("cosine", v), 0
    for q in data(30, 16, 5).astype(float):
        found = graph.beam_search(links.__getitem__, score(q), [0], graph.Search(ef=64), len(v))
        hits += len({i for _, i in found.results[:10]} & {i for i, _ in brute(v, q, 10, "cosine")})
    assert hits / 300 >= 0.9


def walked(links):
    seen, line = {0}, [0]
    while line:
        near = [w for w in links[line.pop()].tolist() if w not in seen]
        seen.update(near)
        line += near
    return len(seen)


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_every_row_of_a_build_is_reached(metric):
    """Large groups of equal rows fill each other's lists; a link leads to each of them all the same."""
    v = np.repeat(data(6, 8), 90, 0).astype(float)
    for rows in (v, v[::-1].copy(), data(500, 48).astype(float), np.zeros((50, 8))):
        links = graph.build_shard(rows, metric, 4, 10)
        assert walked(links) == len(rows) and all(len(set(x.tolist())) == len(x) <= 4 and k not in x for k, x in enumerate(links))


def test_invariants_hold_over_shards(spark, tmp_path, monkeypatch):
    from nearfield.plans import exact

    table(spark, data(300, 16)).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(exact, "_nsw", lambda v: exact.cut(graph.nsw_build(v, shard_rows=100)))
    assert [tuple(r) for r in exact.nsw_invariants(spark, str(tmp_path)).collect()] == [(0, 300, True, True, True, 300)]


def test_budgets_and_pages_hold_over_shards(spark, tmp_path, monkeypatch):
    from nearfield.plans import exact

    table(spark, data(600, 16)).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(exact, "_nsw", lambda v: exact.cut(graph.nsw_build(v, shard_rows=200)))
    for query in (exact.search_budgets_hold, exact.search_pages_hold):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == [(q, True, True, True) for q in range(0, 600, 100)]


class Codes:
    """Stands in for a DataFrame: what its scan makes of one batch."""

    def __init__(self, rows):
        self.rows = rows

    def mapInPandas(self, scan, schema):
        import pandas as pd

        return pd.concat(list(scan(iter([self.rows]))))


def test_scans_hold_no_lookup_table_for_each_pair(monkeypatch):
    """400 candidates by product codes for 300 queries: a copy of a query's table for each pair were 2 GB."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(2)
    book, code, q = rng.standard_normal((8, 256, 8)), rng.integers(0, 256, (4000, 8)).astype(np.int16), rng.standard_normal((300, 64))
    monkeypatch.setattr(pq, "over_blocks", lambda queries, scan: scan(np.arange(300), queries))
    monkeypatch.setattr(pq, "top", lambda found, k: found)
    tracemalloc.start()
    got = pq.adc_knn(Codes(pd.DataFrame({"vec_id": np.arange(4000), "code": list(code)})), q, book, 400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6
    lut = pq.tables(q, book)
    for qid in (0, 299):
        total = D.exact_sum(lut[qid][np.arange(8), code.astype(int)])
        want = np.lexsort((np.arange(4000), total))[:400]
        mine = got[got["qid"] == qid].sort_values(["distance", "vec_id"])
        assert mine["vec_id"].tolist() == want.tolist() and mine["distance"].tolist() == total[want].tolist()


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_growing_blocks_give_what_a_scan_gives(monkeypatch, metric):
    """Small and then larger blocks, near ties, equal rows, bounds: ids and distances are those of brute force."""
    import pandas as pd

    v = np.concatenate([data(300, 16), np.repeat(data(3, 16, 7), 40, 0), np.nextafter(data(40, 16), np.float32(2)), np.zeros((3, 16), np.float32)])
    monkeypatch.setattr(knn, "FIRST_ROWS", 8)
    monkeypatch.setattr(knn, "PANEL", 300)
    monkeypatch.setattr(knn, "SLICE", 200)
    rows = Codes(pd.DataFrame({"vec_id": np.arange(len(v)), "code": list(v)}))
    got = knn.scan_topk(rows, np.arange(len(v)), v, 12, knn._metric(metric))
    want = [(q, *x) for q in range(len(v)) for x in brute(v, v[q], 12, metric)]
    assert list(got.sort_values(["qid", "distance", "vec_id"]).itertuples(index=False, name=None)) == want
    bounds = np.array([brute(v, x, 5, metric)[-1][1] for x in v])
    near = knn.scan_topk(rows, np.arange(len(v)), v, 12, knn._metric(metric), bounds=bounds)
    assert list(near.sort_values(["qid", "distance", "vec_id"]).itertuples(index=False, name=None)) == [x for x in want if x[2] <= bounds[x[0]]]


def test_a_check_completes_a_search(spark):
    """What a search has missed, and queries that it found nothing or too little for, come from one pass; the rest stays as found."""
    v, q = data(400, 8), data(6, 8, 2)
    vectors, asked = table(spark, v).repartition(3), queries(spark, q)
    exact = knn.knn(vectors, asked, 10, "cosine").select("qid", "vec_id", "distance", "rank")
    key = lambda x: sorted(map(tuple, x.select("qid", "vec_id", "distance", "rank").collect()))
    some = exact.where("(vec_id + qid) % 3 > 0 AND qid <> 4").unionByName(knn.knn(vectors.where("vec_id % 5 = 0"), asked, 10, "cosine").where("qid < 3").select(*exact.columns)).dropDuplicates(["qid", "vec_id"])
    assert key(some) != key(exact) and key(knn.completed(some, vectors, asked, 10)) == key(exact)


def test_searches_are_exact_where_a_graph_misses(spark, tmp_path, monkeypatch):
    """Graphs that hold a tenth of the vectors stand for bad ones: the queries that SQL holds to a scan's results still give them."""
    from nearfield.plans import catalog

    table(spark, data(300, 16)).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(catalog, "_nsw", lambda v: catalog.cut(graph.nsw_build(v.where("vec_id % 10 = 0"))))
    v = catalog.vectors(spark, str(tmp_path))
    want = sorted(map(tuple, catalog.ranked(catalog._truth(v)).collect()))
    for name in ("nsw_search_ef64", "nsw_search_stall", "nsw_search_pages", "nsw_search_refine"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == want, name
    assert {(r.hits, r.recall) for r in catalog.nsw_recall(spark, str(tmp_path)).collect()} == {(10, 1.0)}


def test_estimates_of_pairs_are_those_of_the_scan(spark):
    v, q = data(300, 24), data(5, 24, 2)
    segments = saq.Segments.even(24, 2, 4)
    for packed in (False, True):
        coded = saq.encode(table(spark, v).repartition(3), segments, packed)
        every = saq.saq_knn(coded, queries(spark, q), segments, 300, packed)
        assert every.count() == 1500
        ten = {(r.qid, r.vec_id, r["rank"]) for r in saq.saq_knn(coded, queries(spark, q), segments, 10, packed).collect()}
        assert ten == {(r.qid, r.vec_id, r["rank"]) for r in every.where("rank <= 10").collect()}
        for r in saq.saq_pairs(every.select("qid", "vec_id", "distance"), coded, queries(spark, q), segments, packed).collect():
            assert r.estimate == pytest.approx(r.distance, rel=1e-9, abs=1e-12)


def test_scans_of_estimates_hold_little(monkeypatch):
    """400 queries against 10,000 vectors: their k best and a panel, not a sort of all estimates."""
    import tracemalloc

    import pandas as pd

    v = data(10_000, 16).astype(float)
    segments = saq.Segments.even(16, 2, 4)
    found = saq.encode_block(v, segments, 1)
    rows = pd.DataFrame({"vec_id": np.arange(len(v)), "codes": [b"".join(c[i].tobytes() for c, _, _ in found) for i in range(len(v))], "rescale": list(np.stack([r for _, r, _ in found], 1)), "length": list(np.stack([n for *_, n in found], 1))})
    monkeypatch.setattr(saq, "over_blocks", lambda queries, scan: scan(np.arange(400), queries))
    monkeypatch.setattr(saq, "top", lambda found, k: found)
    tracemalloc.start()
    got = saq.saq_knn(Codes(rows), v[:400], segments, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6 and got.groupby("qid").size().tolist() == [10] * 400
