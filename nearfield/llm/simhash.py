"""Near-duplicates by SimHash: a grid over the bit counts of fingerprint segments."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import cut, spread_join
from nearfield.llm.components import components

SEED = 42
#: Rows of cells that a task makes, at most about.
CELLS_PER_TASK = 2_000_000
#: Cells with more members than this are cut up further before members are compared with one another.
LARGE_CELL = 64
#: Cells to look members up for, up to which the cells are broadcast.
FEW_CELLS = 1 << 18
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, summed in bytes over 255 rows at a time."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return total


def simhash64(text: str, width: int = 4, seed: int = SEED, block: int = 1 << 17) -> int:
    """The fingerprint of one text, as an unsigned number. Long texts go through in blocks of
    shingles, so that memory stays small beside the text itself."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    joined = b" ".join(text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(joined)]))
    if len(starts) <= width:
        return digest(joined, seed)
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), block):
        near = zip(starts[k : k + block].tolist(), ends[k : k + block].tolist(), strict=True)
        total += _bit_counts(np.array([digest(joined[s:e], seed) for s, e in near], np.uint64))
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def simhash_column(text: str | Column, width: int = 4, seed: int = SEED) -> Column:
    """The fingerprint as a long (the same 64 bits, signed)."""

    @F.pandas_udf(T.LongType())
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([simhash64(t or "", width, seed) for t in texts], np.uint64)
            yield pd.Series(found.view(np.int64))

    return fingerprints(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def embedding(fp: Column) -> Column:
    """The 32 bit counts (0, 1 or 2) of the fingerprint's two-bit segments, each written as
    00, 01 or 11: the Manhattan distance of two embeddings is then the number of bits in
    which these differ. Counts differ by at most the bits that differ, so it never exceeds
    the Hamming distance of the fingerprints."""
    even = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(even), fp.bitwiseAND(high).bitwiseAND(even)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _embedding(fp: np.ndarray) -> np.ndarray:
    """embedding() of an array."""
    even, high = np.uint64(0x5555555555555555), fp >> np.uint64(1)
    return ((fp | high) & even) | ((fp & high & even) << np.uint64(1))


def cell_masks(limit: int, groups: int) -> list[int]:
    """Bit masks over the embedding. Its 32 coordinates form groups; a Manhattan distance of at
    most limit leaves at least groups - limit groups untouched, so two embeddings
    within limit agree on at least one of the masks."""
    if not limit < groups <= 32:
        raise ValueError("groups must exceed limit and be at most 32")
    edges = [round(k * 32 / groups) for k in range(groups + 1)]
    part = [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(part[i] for i in chosen)) for chosen in combinations(range(groups), groups - limit)]


def comb_masks(limit: int) -> list[int]:
    """Bit masks over the fingerprint itself. Its bits fall into 2 * limit combs, every so many bits one; limit
    differing bits leave at least limit combs untouched. Whatever part of the fingerprints a cell's members
    share, each mask also holds bits of the rest."""
    teeth = [sum(1 << b for b in range(k, 64, 2 * limit)) for k in range(2 * limit)]
    return [_signed(sum(teeth[k] for k in chosen)) for chosen in combinations(range(2 * limit), limit)]


def grid_groups(n: int, limit: int = 4, weight: float = 4.0) -> int:
    """The number of groups whose grid costs n fingerprints least: rows of cells, and `weight` for each chance
    meeting in them. Two unrelated embeddings agree on a coordinate with probability 3/8."""
    def cost(groups: int) -> float:
        return math.comb(groups, limit) * (1 + weight * n * 0.375 ** (32 * (groups - limit) / groups))

    return min(range(limit + 2, 4 * limit + 5), key=cost) if limit < 8 else 2 * limit


def _dealt(prints: DataFrame, rows_each: int, key: str) -> DataFrame:
    """A few bytes a row now, rows_each rows for each next: so many partitions that none makes too many."""
    least = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.repartition(max(least, prints.count() * rows_each // CELLS_PER_TASK), key)


def forest(cell: np.ndarray, node: np.ndarray, comp: np.ndarray, limit: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole cells, one cell behind the other -> pairs of their fingerprints (node, unsigned) that share a cell and differ in at most
    limit bits. The pairs tie whatever such pairs tie, comp being known to be tied, and there are fewer of them than rows.

    In cells of up to `large` rows each row is compared with the one k rows on, for each k; in larger ones each row outside the
    largest component with all rows."""
    up, root = np.unique(comp, return_inverse=True)
    up = np.arange(len(up))
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, len(cell)))
    grid, found = _embedding(node), []

    def tie(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal up, root
        i, j = (x[root[i] != root[j]] for x in (i, j))
        near = np.bitwise_count(grid[i] ^ grid[j]) <= limit  # the lower bound first, then the exact distance
        i, j = i[near], j[near]
        near = np.bitwise_count(node[i] ^ node[j]) <= limit
        before = len(found)
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            x, y = root[a], root[b]
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[x] = y
                found.append((a, b))
        if len(found) > before:
            while (up[up] != up).any():
                up = up[up]
            root = up[root]

    left = np.repeat(np.where(sizes <= large, starts + sizes, 0), sizes) - np.arange(len(cell))  # rows to the cell's end
    rows = np.flatnonzero(left > 1)
    for k in range(1, large):
        rows = rows[left[rows] > k]
        if not len(rows):
            break
        tie(rows, rows + k)
    for s, n in zip(starts[sizes > large].tolist(), sizes[sizes > large].tolist(), strict=True):
        kinds, where, counts = np.unique(root[s : s + n], return_inverse=True, return_counts=True)
        for a in (s + np.flatnonzero(where != counts.argmax())).tolist():
            tie(np.full(n, a), np.arange(s, s + n))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return node[pairs[:, 0]], node[pairs[:, 1]]


def _tied(small: DataFrame, limit: int) -> DataFrame:
    """small(cell, node, comp) -> pairs (a, b), by forest() over each cell. A task holds one cell's rows, and a batch besides."""
    large = LARGE_CELL

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cell, node, comp = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
            a, b = (x.view(np.int64) for x in forest(cell, node.view(np.uint64), comp, limit, large))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        held: list[np.ndarray] = []  # of the cell that the last batch ended in
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if not rows.shape[1]:
                continue
            at = int(np.flatnonzero(rows[0] == rows[0, -1])[0])
            if at or (held and held[-1][0, -1] != rows[0, 0]):
                yield from whole([*held, rows[:, :at]])
                held = []
            held.append(rows[:, at:])
        yield from whole(held)

    return small.select("cell", "node", "comp").repartition("cell").sortWithinPartitions("cell").mapInArrow(tie, "a bigint, b bigint")


def _links(cells: DataFrame, bits: Callable[[DataFrame, str], DataFrame], distance: Callable[[Column, Column], Column], limit: int, verify: Callable[[DataFrame], DataFrame] | None, refine: Callable[[DataFrame, int], DataFrame], known: DataFrame | None = None, only_stars: bool = False, gathered: DataFrame | None = None) -> DataFrame:
    """cells(cell, node, comp) -> labels(node, label) over links between nodes that share a cell, are close, and verified, and over
    those that known(node, label) stands for; comp is a node's label there, or else the node.

    bits(rows, x) adds to rows the fingerprint of the node in column x, as x_bits; two nodes are close whose fingerprints' distance is at most
    limit; verify keeps of close pairs (a, b) the links; where it is None, nodes are their fingerprints and all close pairs are links. gathered(cell, node),
    if given, are the same cells, each in one partition already, and each node its own comp.
    Cells whose members lie in one component already are passed over. The two members of a cell of two, the usual chance meeting, are
    compared on the spot. No larger cell's pairs are listed at first: each member is compared with the cell's smallest one, each node's closest
    pair is verified, and the components so far are found. What may still tie components together is compared then: close pairs not yet
    verified, and, in cells that still hold several components, the members outside the largest one with the members
    of other components. Large such cells are cut up by refine first. Pairs left out lie in one component
    already, so components are exact for what shares a cell. Where nothing is to be verified, a cell gives no more of these pairs than
    tie its components together. With only_stars that last step is left to a later call.
    """
    if gathered is not None:
        shared = gathered.groupBy("cell").agg(F.min("node").alias("rep"), F.max("node").alias("top"), F.count("*").alias("n")).where("rep < top")
        shared = cut(shared.select("cell", "n", "rep", F.col("rep").alias("rep_comp"), "top"))
        larger = shared.where("n > 2").select("cell", "rep", "rep_comp", "n")
        if larger.count() <= FEW_CELLS:
            members = cells.join(F.broadcast(larger.drop("n")), "cell")  # FEW_CELLS short rows at most
        else:
            members = spread_join(cells, larger, ["cell"], "n")
        members = cut(members)
        pairs = members.where("comp <> rep_comp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        pairs = pairs.unionByName(shared.where("n = 2").select(F.col("top").alias("a"), F.col("rep").alias("b")))
    else:
        first, whole = F.struct("comp", "node"), Window.partitionBy("cell")
        members = cells.repartition("cell").select("*", F.min(first).over(whole).alias("low"), F.max("comp").over(whole).alias("high"), F.count("*").over(whole).alias("n"))
        members = cut(members.where("low.comp < high").select("cell", "node", "comp", F.col("low.node").alias("rep"), F.col("low.comp").alias("rep_comp"), "n"))
        pairs = members.where("comp <> rep_comp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        members = members.where("n > 2")
    pairs = bits(bits(pairs.distinct(), "a"), "b")
    stars = cut(pairs.withColumn("d", distance(F.col("a_bits"), F.col("b_bits"))).where(F.col("d") <= limit).select("a", "b", "d"))
    if verify:
        links = verify(stars.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))).select("a", "b")
    else:
        links = stars.select("a", "b")
    if known is not None:
        links = links.unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = cut(links)
    first = components(links)
    if only_stars:
        return first
    named = first.select(F.col("node").alias("named"), "label")

    def across(found: DataFrame) -> DataFrame:
        for side in "ab":
            found = found.join(named, F.col(side) == F.col("named"), "left").withColumn(f"{side}_comp", F.coalesce("label", side)).drop("named", "label")
        return found.where("a_comp <> b_comp").select("a", "b")

    tagged = members.drop("comp").join(named, members.node == named.named, "left").select("cell", "node", F.coalesce("label", "node").alias("comp"))
    whole = _mixed(tagged)
    largest = whole.agg(F.max("n")).first()[0] or 0
    small = whole.where(F.col("n") <= LARGE_CELL)
    if largest > LARGE_CELL:
        finer = refine(whole.where(F.col("n") > LARGE_CELL).select("cell", "node", "comp"), largest)
        small = small.unionByName(_mixed(cut(finer)))
    if not verify:
        more = cut(_tied(small, limit))
        return first if more.isEmpty() else components(links.unionByName(more))
    small = bits(small, "node")
    outside = small.where("comp <> main").select("cell", F.col("node").alias("other"), F.col("comp").alias("other_comp"), F.col("node_bits").alias("other_bits"))
    rest = small.join(outside, "cell").where((F.col("comp") != F.col("other_comp")) & ((F.col("node") > F.col("other")) | (F.col("comp") == F.col("main"))) & (distance(F.col("node_bits"), F.col("other_bits")) <= limit))
    rest = rest.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    more = cut(across(stars).unionByName(rest.select("a", "b")).distinct())
    if more.isEmpty():
        return first
    return components(links.select("a", "b").unionByName(verify(more).select("a", "b")))


def _mixed(tagged: DataFrame) -> DataFrame:
    """tagged(cell, node, comp): the rows of cells with several components, and with them the cell's largest component, main, and
    number of rows, n."""
    whole = Window.partitionBy("cell")
    counted = tagged.repartition("cell").withColumn("c", F.count("*").over(Window.partitionBy("cell", "comp")))
    counted = counted.select("cell", "node", "comp", F.max(F.struct("c", "comp")).over(whole)["comp"].alias("main"), F.count("*").over(whole).alias("n"), F.min("comp").over(whole).alias("low"), F.max("comp").over(whole).alias("high"))
    return cut(counted.where("low < high").drop("low", "high"))


def fingerprint_components(prints: DataFrame, limit: int = 4, groups: int | None = None) -> DataFrame:
    """prints(fp), distinct -> labels(node, label) over the graph that links fingerprints at
    most limit bits apart; only fingerprints that have a link appear.

    A grid range-join: every fingerprint enters the cells given by cell_masks, and links can only
    be within a cell. The grid's groups follow the number of fingerprints, so that chance meetings stay
    about as many as rows. Cells that are large and still hold several components are cut up by a grid over the
    fingerprint's own bits, which by the same argument parts no link. The components are exact; see _links.
    """
    groups = groups or grid_groups(prints.count(), limit)
    masks = cell_masks(limit, groups)
    numbers = F.array(*map(F.lit, range(len(masks)))).cast("array<smallint>")
    entered = _dealt(prints, len(masks), "fp").select(F.col("fp").alias("node"), F.explode(numbers).alias("mask"))
    part = embedding(F.col("node")).bitwiseAND(F.array(*map(F.lit, masks))[F.col("mask")])
    cell = F.xxhash64("mask", part)  # a collision only adds a comparison
    cells = entered.select(cell.alias("cell"), "node", F.col("node").alias("comp"))
    gathered = entered.repartition(cell).select(cell.alias("cell"), "node")  # only the node and the mask's number move

    def bits(rows: DataFrame, x: str) -> DataFrame:
        return rows.withColumn(f"{x}_bits", F.col(x))

    def distance(a: Column, b: Column) -> Column:
        lower = F.bit_count(embedding(a).bitwiseXOR(embedding(b)))  # the lower bound first, then the exact distance
        return F.when(lower > limit, lower).otherwise(F.bit_count(a.bitwiseXOR(b)))

    def refine(large: DataFrame, largest: int) -> DataFrame:
        parts = large.select("cell", "node", "comp", F.posexplode(F.array(*[F.col("node").bitwiseAND(F.lit(m)) for m in comb_masks(limit)])).alias("mask", "part"))
        return parts.select(F.xxhash64("cell", "mask", "part").alias("cell"), "node", "comp")

    return _links(cells, bits, distance, limit, None, refine, gathered=gathered)


def near_duplicates(docs: DataFrame, limit: int = 4, width: int = 4, groups: int | None = None, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id: one row per
    row of docs.

    component_id is the smallest doc_id that links of at most limit differing bits reach. A null or
    empty text, and one of only white space, has fingerprint zero and links like any other. Texts with
    fewer than width words are one shingle. Rows that repeat an id each get a row. A null doc_id
    keeps its row and never becomes a component_id unless all of the component is null.
    Other columns are ignored; an empty table gives no rows.

    groups sets the grid, by default from the number of fingerprints: with more of them cells are finer (fewer
    chance meetings among very many documents) and each fingerprint enters more cells. Results do not depend on it.
    """
    keys = cut(docs.select("doc_id", simhash_column("text", width, seed).alias("fp")))
    prints = cut(keys.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    labels = fingerprint_components(prints.select("fp"), limit, groups)
    return spread_join(keys, _lowest(prints, labels, "fp"), ["fp"], "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _lowest(nodes: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """nodes(node, first_id, rows) -> with label and component_id, the component's smallest first_id; a node without links is
    its own."""
    tied = cut(nodes.join(labels.withColumnRenamed("node", node), node).select(node, "label", "first_id"))
    lowest = tied.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = tied.join(lowest, "label").select(node, "label", "component_id")
    found = nodes.join(named, node, "left")
    return cut(found.withColumn("component_id", F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("component_id"))).withColumn("label", F.coalesce("label", node)).drop("first_id"))


# Texts by the similarity of their shingles.

#: 64-bit words of the wide fingerprint. Cells are chosen among the bits of the first CELL_WORDS; pairs that meet are compared on all,
#: since the more bits there are, the nearer to the similarity itself are the pairs that need their sets.
WIDE, CELL_WORDS = 16, 4
#: Grids that come first.
EARLY = 12
#: Shingles that a worker gathers before it hands them on, about.
SET_SIZES = 200_000
#: The share of pairs at the similarity itself that meet in a cell; of closer pairs more do.
MEET = 0.98

#: A word's hash is the sum of its bytes' numbers times powers of BASE, so that sums over a block give those of all its words.
BLOCK = 1 << 17
BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(BLOCK - 1, base, np.uint64))), dtype=np.uint64)


POWERS, INVERSE_POWERS = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; its constants are fixed values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A number for each word between white space, a block of bytes at a time; a word may run over several."""
    out: list[np.ndarray] = []
    begun, size = np.zeros(1, np.uint64), 0  # of the word that the last block ended in
    for at in range(0, len(data), BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        inside = np.concatenate(([False], ~SPACES[block], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTES[block] * POWERS[: len(block)], dtype=np.uint64)))
        found = (sums[ends] - sums[starts]) * INVERSE_POWERS[np.minimum(starts, BLOCK - 1)]
        if size:
            if inside[1]:
                found[:1] = begun + found[:1] * np.uint64(pow(BASE, size, 1 << 64))
            else:
                out.append(begun)
        grown = size if size and inside[1] else 0
        size = 0
        if inside[-2]:
            size, begun, found = int(ends[-1] - starts[-1]) + (grown if len(found) == 1 else 0), found[-1:], found[:-1]
        out.append(found)
    if size:
        out.append(begun)
    return _mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingle_set(text: str, width: int = 5) -> tuple[bytes, np.ndarray]:
    """A key of the text's words (lower-case A-Z), and the sorted hashes of its different shingles of `width` words; fewer words
    are one shingle, none give no shingle."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER))
    n = max(len(w) - width + 1, min(len(w), 1))
    h = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(width, len(w))):
        h = h * np.uint64(BASE) + w[k : k + n]
    h = np.sort(_mix(h))
    return hashlib.sha256(w.tobytes()).digest(), h[np.concatenate((np.ones(min(n, 1), bool), h[1:] != h[:-1]))]


def wide_fingerprint(shingles: np.ndarray, words: int = WIDE) -> list[int]:
    """A SimHash of 64 bits for each of `words` differently mixed hashes, as signed numbers."""
    total = np.zeros(64 * words, np.int64)
    steps = np.arange(words, dtype=np.uint64) * np.uint64(BASE)
    for at in range(0, len(shingles), 255):  # as many as a byte can count
        mixed = _mix(shingles[at : at + 255, None] + steps)
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > len(shingles), bitorder="little").view("<i8").tolist()


def _differ(similarity: float) -> float:
    """The chance that a bit differs between two sets of one size and that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bit_tables(n: int, similarity: float, words: int = CELL_WORDS, seed: int = SEED, spare: int = 5, meet: float = MEET) -> list[list[int]]:
    """Masks over the words of a wide fingerprint: each takes so many bits that n unrelated fingerprints meet
    2^-spare others in its cell, and there are so many masks that a pair at the similarity meets in one with probability `meet`."""
    bits = min(48, max(6, math.ceil(math.log2(max(2, n))) + spare))
    count = max(2 * EARLY, math.ceil(math.log(1 - meet) / math.log1p(-((1 - _differ(similarity)) ** bits))))
    rng, out = random.Random(seed), []
    for _ in range(count):
        masks = [0] * words
        for b in rng.sample(range(64 * words), bits):
            masks[b // 64] |= 1 << (b % 64)
        out.append(list(map(_signed, masks)))
    return out


def _cells(bits: str, tables: list[list[int]], *more: Column) -> Column:
    """The cells of a wide fingerprint, one for each table."""
    masks = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(m).alias(f"m{i}") for i, m in enumerate(t)]) for k, t in enumerate(tables)])
    return F.transform(masks, lambda t: F.xxhash64(*more, t["k"], *[F.col(bits)[i].bitwiseAND(t[f"m{i}"]) for i in range(len(tables[0]))]))


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, carry: tuple[str, ...] = (), meet: float = MEET, broadcast_rows: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, component_id, label: one row per row of docs. Texts link whose sets of
    `width`-word shingles (A-Z in lower case) have a Jaccard similarity of at least `similarity`.

    A SimHash of 1024 bits embeds a text; segments here are single bits, so the Manhattan distance of two embeddings is the
    fingerprints' Hamming distance. Cells of a grid are chosen bits; their number and that of the grids follow the number of texts and
    the similarity, so that a pair at the similarity itself meets in some cell with probability `meet`, closer pairs more surely. Pairs that
    meet within the distance of three standard deviations are verified on their whole sets of shingle hashes. Links are thus never
    false, and a share 1 - meet of those at the very threshold may be missed unless others tie the texts.

    component_id is the smallest doc_id of a component, label a number that only its rows share. Texts of the same words are one node; a
    null text counts as empty, and texts without words are alike. Texts with fewer than width words are one shingle. Rows that repeat an
    id each get a row; a null doc_id becomes a component_id only where all of the component is null. carry
    names columns that are returned as well; others are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession

    @F.pandas_udf("key binary, bits array<bigint>")
    def wide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:  # no more than one text's shingles at a time
                key, shingles = shingle_set(text or "", width)
                rows.append((key, wide_fingerprint(shingles)))
            yield pd.DataFrame(rows, columns=["key", "bits"])

    keys = docs.select("doc_id", wide("text").alias("found"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("place"), *carry)
    keys = cut(keys.select("doc_id", F.col("found.key").alias("key"), F.col("found.bits").alias("bits"), "place", *carry))
    nodes = keys.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("place").alias("place"), F.any_value("bits").alias("bits"), F.count("*").alias("rows"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    prints = nodes.select("node", "bits")
    count = nodes.count()
    tables = bit_tables(count, similarity, meet=meet)

    def cells(some: list[list[int]], labels: DataFrame | None) -> DataFrame:
        rows = _dealt(prints, len(some), "node")
        if labels is not None:
            rows = rows.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
        else:
            rows = rows.withColumn("comp", F.col("node"))
        return rows.select("node", "comp", F.explode(_cells("bits", some)).alias("cell"))

    expected = _differ(similarity) * 64 * WIDE
    radius = math.ceil(expected + 3 * math.sqrt(expected * (1 - _differ(similarity))))

    def bits(rows: DataFrame, x: str) -> DataFrame:
        return rows.join(prints.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits")), x)

    def distance(a: Column, b: Column) -> Column:
        return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(WIDE)), F.lit(0))

    def refine(large: DataFrame, largest: int) -> DataFrame:
        finer = bit_tables(largest, similarity, seed=SEED + 1, meet=meet)
        return large.join(prints, "node").select("node", "comp", F.explode(_cells("bits", finer, F.col("cell"))).alias("cell"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                key, shingles = shingle_set(text, width)
                rows.append((key, shingles.view(np.int64)))
                size += len(shingles)
                if size > SET_SIZES:
                    yield pd.DataFrame(rows, columns=["key", "shingles"])
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["key", "shingles"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("a", "b"))
        wanted = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("pairs")))
        wanted = wanted.join(nodes.select("node", "key", "place"), "node")
        texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
        some = wanted.select("place").distinct()
        if wanted.count() <= broadcast_rows:
            some = F.broadcast(some)  # a number for each, broadcast_rows of them at most
        texts = texts.join(some, "place", "left_semi").groupBy("place", "text").agg(F.lit(1).alias("one"))
        found = texts.select("text").mapInPandas(sets, "key binary, shingles array<bigint>").dropDuplicates(["key"])
        found = cut(wanted.join(found, "key").select("node", "pairs", "shingles"))
        both = pairs
        for side in "ab":
            both = spread_join(both, found.select(F.col("node").alias(side), "pairs", F.col("shingles").alias(f"{side}_set")), [side], "pairs")
        common = F.size(F.array_intersect("a_set", "b_set"))
        return both.where(common >= similarity * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")

    # a few grids tie the groups of close copies together, so that the others need not look at these again
    early = cut(_links(cells(tables[:EARLY], None), bits, distance, radius, verify, refine, only_stars=True))
    labels = _links(cells(tables, early), bits, distance, radius, verify, refine, early)
    named = _lowest(nodes.select("node", "key", "first_id", "rows"), labels, "node").select("key", "label", "component_id", "rows")
    return spread_join(keys.drop("bits", "place"), named, ["key"], "rows").select("doc_id", "component_id", "label", *carry)
