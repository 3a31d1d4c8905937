"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs once to warm up and then three times; the least time counts. Results are written to
the noop sink, so that every column of every row is computed. Beside times the line holds what makes
search engines comparable: recall at 10, queries a second in a batch, and work per query.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfield.operators import graph, knn, layout
from nearfield.plans import catalog

HEADLINE = (
    "knn_cosine_top10", "knn_l2_top10", "sq_int8_knn", "refine_int8_to_fp32", "pq_adc_knn", "pq_refine", "saq_refine", "graph_knn_edges", "graph_bfs_level",
    "recall_at_10", "ada_score", "hist_percentiles", "core_snapshots",
)


def timed(f, repeats: int = 3) -> float:  # noqa: ANN001
    f()
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        f()
        times.append(time.perf_counter() - began)
    return min(times)


def search_figures(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Every vector divisible by 10 as a query: recall, expansions, distances and pages by budget."""
    v = catalog.vectors(spark, sf_dir)
    queries = knn.queries_from(v, 10).cache()
    n, truth = queries.count(), knn.knn(v, queries, 10, "cosine").cache()
    began = time.perf_counter()
    g = graph.nsw_build(v).cache()
    g.count()
    out: dict[str, float] = {"build_s": round(time.perf_counter() - began, 2)}
    for name, search in {"ef64": graph.Search(ef=64), "ef200": graph.Search(ef=200), "ef64_stall4_drain16": graph.Search(ef=64, stall=4, drain=16)}.items():
        seconds = timed(lambda s=search: graph.search_graph(g, queries, 10, s).write.format("noop").mode("overwrite").save(), 1)
        out[f"{name}_recall"] = round(knn.recall(graph.search_graph(g, queries, 10, search), truth).agg(F.avg("recall")).first()[0], 4)
        out[f"{name}_queries_per_s"] = round(n / seconds, 1)
        work = graph.search_graph(g, queries, 10, search, output="metrics").agg(F.avg("expansions"), F.avg("distance_computes")).first()
        out[f"{name}_expansions"], out[f"{name}_distances"] = round(work[0], 1), round(work[1], 1)
    trace = graph.search_graph(g, queries, 10, graph.Search(ef=200), output="trace").cache()
    degree = g.select("shard", "vec_id", F.size("nbrs").cast("long").alias("degree"))
    for method in ("bfs", "heavy_edge"):
        pages = layout.pack_pages(layout.reorder(g, method).join(degree, ["shard", "vec_id"]))
        out[f"{method}_pages_per_query"] = round(layout.page_reads(trace, pages).agg(F.avg("pages")).first()[0], 1)
    out["exact_queries_per_s"] = round(n / timed(lambda: knn.knn(v, queries, 10, "cosine").write.format("noop").mode("overwrite").save(), 2), 1)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run = catalog.QUERIES[name]
        times[name] = round(timed(lambda f=run: f(spark, sf_dir).write.format("noop").mode("overwrite").save()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "search": search_figures(spark, sf_dir), "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
