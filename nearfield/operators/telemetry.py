"""Search telemetry: logarithmic histograms, percentiles, snapshots, engine statistics and device knees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def log2_bucket(value: str | Column) -> Column:
    """floor(log2(v)) of a whole number, 0 for 0, without rounding."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value <= 0, F.lit(0)).otherwise(F.length(F.bin(value)) - 1).cast("int")


def lower_bound(bucket: str | Column) -> Column:
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.when(bucket == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), bucket)).cast("long")


def histogram(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, bucket, n, total, low, high. Histograms of parts merge by adding n and total: see merge."""
    return rows.groupBy(*keys, log2_bucket(value).alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def merge(histograms: DataFrame, *keys: str) -> DataFrame:
    return histograms.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def histogram_percentiles(hist: DataFrame, *keys: str, points: tuple[float, ...] = (50.0, 99.0, 99.9)) -> DataFrame:
    """keys, count, mean and a column p50, p99, p99_9 ... each: the lower bound of the bucket in which the ceil(count * p / 100)-th
    value lies. A key has at most 64 rows here."""
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = hist.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    due = lambda p: F.greatest(F.ceil(F.col("all") * p / 100), F.lit(1))
    columns = [F.min(F.when(F.col("upto") >= due(p), lower_bound("bucket"))).alias("p" + f"{p:g}".replace(".", "_")) for p in points]
    return running.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum("total") / F.sum("n")).alias("mean"), *columns)


def exact_percentiles(rows: DataFrame, value: str, *keys: str, points: tuple[float, ...] = (50.0, 99.0), rule: str = "nearest") -> DataFrame:
    """Elements at rank round(p / 100 * (n - 1)) (`nearest`) or floor(n * p / 100), n - 1 at most (`floor`). Equal values are
    counted first, so a key's values are never gathered."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))

    def rank(p: float) -> Column:
        if rule == "nearest":
            return F.round(F.lit(p / 100) * (F.col("n") - 1))
        return F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)

    return running.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > rank(p), F.col(value))).alias("p" + f"{p:g}".replace(".", "_")) for p in points])


def snapshots(queries: DataFrame, window: int) -> DataFrame:
    """queries(core, seq, total_us, io_wait_us, inflight, sem_ns, device_ns, io_count) -> per core and run of `window` queries by seq
    from 0: how many, p50 and p99 by histogram, the part of time spent waiting, the largest inflight and sums. seq counts a core's queries,
    so a window is known from the row alone and no order is needed."""
    rows = queries.withColumn("snap", F.floor(F.col("seq") / window))
    latency = histogram_percentiles(histogram(rows, "total_us", "core", "snap"), "core", "snap", points=(50.0, 99.0)).select("core", "snap", "p50", "p99")
    sums = rows.groupBy("core", "snap").agg(
        F.count("*").alias("queries"), (F.sum("io_wait_us") * 100 / F.sum("total_us")).alias("io_wait_pct"), F.max("inflight").alias("inflight_max"),
        F.sum("sem_ns").alias("sem_ns"), F.sum("device_ns").alias("device_ns"), F.sum("io_count").alias("io_count"),
    )
    return sums.join(latency, ["core", "snap"])


def engine_stats(latest: DataFrame) -> DataFrame:
    """Snapshots, one a core -> one row: queries, largest p99, io_wait by query, largest inflight, and the ratios of sums."""
    q, sem, dev, io = (F.sum(c) for c in ("queries", "sem_ns", "device_ns", "io_count"))
    return latest.agg(
        q.alias("total_queries"), F.max("p99").alias("max_p99"), F.when(q > 0, F.sum(F.col("io_wait_pct") * F.col("queries")) / q).otherwise(0.0).alias("avg_io_wait_pct"), F.max("inflight_max").alias("max_inflight"),
        F.when(sem + dev > 0, sem / (sem + dev) * 100).otherwise(0.0).alias("sem_wait_pct"), F.when(io > 0, dev / io).otherwise(0.0).alias("device_ns_per_io"),
    )


def latest_snapshots(snaps: DataFrame) -> DataFrame:
    last = snaps.groupBy("core").agg(F.max("snap").alias("snap"))
    return snaps.join(last, ["core", "snap"], "left_semi")


def knee(levels: DataFrame) -> DataFrame:
    """levels(qd, iops, p99_us) -> qd: the deepest queue with at least 95 % of the peak rate and under twice the shallowest one's p99; the
    shallowest if none has; 1 for no levels."""
    ends = levels.agg(F.max("iops").alias("peak"), F.min_by("p99_us", "qd").alias("first_p99"), F.min("qd").alias("first_qd"))
    good = (F.col("iops") >= 0.95 * F.col("peak")) & ((F.col("first_p99") == 0) | (F.col("p99_us") < 2 * F.col("first_p99")))
    joined = levels.join(F.broadcast(ends))  # one row
    return joined.agg(F.coalesce(F.max(F.when(good, F.col("qd"))), F.min("first_qd"), F.lit(1)).alias("qd"))


def score_bucket(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    out = F.lit("<8")
    for least in (8, 12, 16, 20):
        out = F.when(score >= least, F.lit(f">={least}")).otherwise(out)
    return out


def simulated_latency(total: str | Column, misses: str | Column, per_miss: float) -> Column:
    total, misses = (F.col(c) if isinstance(c, str) else c for c in (total, misses))
    return total + misses * per_miss


def admitted(capacity: int, health: str) -> int:
    """Queries let in at once, by health: all, three quarters, half; at least one."""
    return max(1, capacity * {"healthy": 100, "degraded": 75, "throttled": 50}[health] // 100)


def query_ratios(metrics: DataFrame) -> DataFrame:
    """Per-query counters with the parts that are read from them: wasted expansions, distances per expansion, and, where times and page
    counts are among the columns, their shares of the total."""
    out = metrics.withColumn("wasted_share", F.when(F.col("expansions") > 0, F.col("wasted") / F.col("expansions")).otherwise(0.0))
    out = out.withColumn("distances_per_expansion", F.when(F.col("expansions") > 0, F.col("distance_computes") / F.col("expansions")).otherwise(0.0))
    for part in ("io_us", "distance_us"):
        if {part, "total_us"} <= set(metrics.columns):
            out = out.withColumn(part.replace("_us", "_pct"), F.when(F.col("total_us") > 0, F.col(part) * 100 / F.col("total_us")).otherwise(0.0))
    if {"hits", "misses"} <= set(metrics.columns):
        out = out.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))
    return out


def bench_row(metrics: DataFrame, recalls: DataFrame) -> DataFrame:
    """One row for a configuration: queries, recall (mean and least) and work per query. A query's shards count together."""
    counters = ("expansions", "useful", "wasted", "distance_computes")
    each = metrics.groupBy("qid").agg(*[F.sum(c).alias(c) for c in counters], F.max(F.col("stopped_early").cast("int")).alias("stopped"))
    both = each.join(recalls.select("qid", "recall"), "qid")
    means = [F.avg(c).alias(f"mean_{c}") for c in counters]
    return both.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.min("recall").alias("least_recall"), *means, F.max("expansions").alias("most_expansions"), F.avg("stopped").alias("stopped_share"))
