"""Mixing sources to target weights by temperature, realised as block permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import packing
from nearfield.llm.common import cut

#: Blocks of a mix, at least, and rows of a block over all sources, at most about.
BLOCKS, ROWS_PER_BLOCK = 1024, 100_000
UNNAMED = ""


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(sizes: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised. 1 leaves the shares, 0 makes all equal."""
    total = sum(sizes)
    raised = [(s / total) ** exponent if s else 0.0 for s in sizes]
    return [r / sum(raised) for r in raised]


def repetitions(sizes: list[float], weights: list[float], budget: float | None) -> list[float]:
    """How often each source is read for a budget of tokens. Without a budget it is the least one
    that reads every source whole: the least repeated source once."""
    ratios = [w / s if s else 0.0 for w, s in zip(weights, sizes, strict=True)]
    scale = budget if budget is not None else 1 / min((r for r in ratios if r), default=1.0)
    return [r * scale for r in ratios]


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for: the smallest one whose most repeated source is read
    max_repeats times at most, or the one whose weights have that part of the greatest entropy."""

    max_repeats: float | None = 2.0
    entropy_share: float | None = None
    budget: float | None = None

    def exponent(self, sizes: list[float], steps: int = 60) -> float:
        if self.entropy_share is not None:
            most = math.log(max(1, sum(s > 0 for s in sizes)))
            fits = lambda a: entropy(tempered(sizes, a)) <= self.entropy_share * most
        elif self.max_repeats is not None:
            fits = lambda a: max(repetitions(sizes, tempered(sizes, a), self.budget)) <= self.max_repeats * (1 + 1e-12)
        else:
            return 1.0
        low, high = 0.0, 1.0
        if not any(sizes) or fits(low):
            return low
        for _ in range(steps):  # entropy and repeats fall as the exponent rises to 1
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        return high


def plan(sizes: dict[str, int], target: Target) -> dict[str, tuple[float, float]]:
    """Source -> (weight, repeats)."""
    names = sorted(sizes)
    amounts = [float(sizes[n]) for n in names]
    if not any(amounts):
        return {n: (1 / len(names), 1.0) for n in names}
    weights = tempered(amounts, target.exponent(amounts))
    # a hair's breadth, so that 2 read as 1.9999999999 stays 2
    return {n: (w, round(r, 9)) for n, w, r in zip(names, weights, repetitions(amounts, weights, target.budget), strict=True)}


def _unit(*columns: Column | str) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(packing.VOCABULARY)


def token_count(text: str | Column, path: str) -> Column:
    """The text's tokens by the packing operator's encoder; at least 1, so that no document is free."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = packing.encoder(path).encode
        for texts in batches:
            yield pd.Series([max(1, len(encode(t or "")) // 4) for t in texts], dtype="int64")

    return count(text)


def mix(docs: DataFrame, target: Target = Target(), blocks: int = BLOCKS, max_sources: int = 100_000, seed: int = 42, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, tokens, weight, copies, row [, carry]: one row per row of docs,
    copies saying how often the mix reads it.

    A source's share of tokens, raised to the exponent that target asks for, is its weight, and weight
    times budget over its size how often it is read. Each reading is a permutation of the source's blocks.
    Whole readings hold every block. The last one takes blocks in that reading's order until its budget
    is spent, and of the block in which that happens the first documents in the reading's order,
    so that a source meets its budget to within one document. A null source is a source of its
    own, by the empty name. Rows that repeat an id are separate rows; null ids are rows as well. Empty
    texts count 1 token. Tokens are those of the tokenizer at path, by default the one that sequences are
    packed with. carry names columns that are returned as well; others are ignored. An empty table gives no rows.

    Gathered are one number per source (an error beyond max_sources) and, per source, its blocks' sizes.
    Only the one block in which a source's budget ends is ordered row by row. There are `blocks` of them at least, and more where that
    would make blocks of over ROWS_PER_BLOCK rows.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit(UNNAMED)).alias("source"), token_count("text", path or default_path()).alias("tokens"), F.xxhash64("text").alias("h"), *carry)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    blocks = max(blocks, rows.count() // ROWS_PER_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    totals = sizes.groupBy("source").agg(F.sum("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    spark, amounts = docs.sparkSession, {r[0]: r[1] for r in totals}
    planned = plan(amounts, target)
    schema = "source string, weight double, whole int, budget double"
    table = spark.createDataFrame([(s, w, int(r), (r - int(r)) * amounts[s]) for s, (w, r) in planned.items()], schema)
    table = F.broadcast(table)  # max_sources rows at most
    epoch = F.col("whole") + 1
    order = Window.partitionBy("source").orderBy("turn", "block")
    turns = sizes.join(table, "source").withColumn("turn", _unit(F.lit(seed), "source", epoch, "block"))
    turns = turns.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ends = turns.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("n") > F.col("budget")))
    ends = F.broadcast(ends.select("source", F.col("turn").alias("end_turn"), F.col("block").alias("end_block"), (F.col("budget") - F.col("before")).alias("rest")))  # one row per source
    read = rows.join(table, "source").join(ends, "source", "left").withColumn("turn", _unit(F.lit(seed), "source", epoch, "block"))
    earlier = F.struct("turn", "block") < F.struct("end_turn", "end_block")
    cut_block = F.col("block") == F.col("end_block")
    last = Window.partitionBy("source").orderBy(_unit(F.lit(seed), epoch, "doc_id", "h"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    partial = read.where(cut_block).withColumn("before", F.sum("tokens").over(last) - F.col("tokens"))
    partial = partial.withColumn("more", (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    # without an end block the budget is either nothing or everything
    others = read.where(F.coalesce(~cut_block, F.lit(True))).withColumn("more", F.coalesce(earlier, F.lit(False)).cast("int"))
    names = ["doc_id", "source", "tokens", "weight", (F.col("whole") + F.col("more")).alias("copies"), "row", *carry]
    return others.select(*names).unionByName(partial.select(*names))


def schedule(mixed: DataFrame, seed: int = 42) -> DataFrame:
    """mix()'s rows once for each reading -> doc_id, source, tokens, weight, copies, epoch, place: sorted
    by place (0 to 1), sources alternate in proportion to their weights."""
    read = mixed.withColumn("epoch", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))))
    place = (F.col("epoch") - 1 + _unit(F.lit(seed), "epoch", "doc_id", "row")) / F.col("copies")
    return read.select("doc_id", "source", "tokens", "weight", "copies", "epoch", place.alias("place"))


def mixed_documents(docs: DataFrame, target: Target = Target(), seed: int = 42) -> DataFrame:
    """The rows of docs, with their columns, as often as mix() reads them: decisions are made on ids and
    counts, and texts move once. Rows alike in every column are read as often as mix() reads all of them together."""
    marked = docs.withColumn("_alike", F.xxhash64(*docs.columns))
    chosen = mix(marked, target, seed=seed, carry=("_alike",)).groupBy("doc_id", "_alike").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("_alike").alias("chosen"), F.col("copies").alias("_copies"), F.col("rows").alias("_rows"))
    found = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("_alike") == F.col("chosen"))).where("_copies > 0")
    several = found.where("_rows > 1").dropDuplicates(["doc_id", "_alike"])
    read = found.where("_rows = 1").unionByName(several)
    return read.select(F.struct(*docs.columns).alias("document"), F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("document.*")
