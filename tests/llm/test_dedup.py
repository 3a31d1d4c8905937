import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import exact_dedup, simhash
from nearfield.llm.components import components
from tests.llm.common import ODD, empty, odd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_on_odd_rows(spark, weak):
    """With a hash of four values nearly all chunks collide, and numbers tell them apart."""
    hash_chunk = (lambda c: F.pmod(F.xxhash64(c), F.lit(4))) if weak else exact_dedup._hash
    got = exact_dedup.exact_duplicates(odd(spark), hash_chunk=hash_chunk)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact([(i, t) for i, t, _ in ODD])


def test_exact_random(spark):
    rng = random.Random(1)
    sentences = ["".join(rng.choice("abc DEF.\n") for _ in range(rng.randint(1, 900))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(sentences) for _ in range(rng.randint(0, 3)))) for k in range(150)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(rows)


def test_chunks_cover_texts_and_meet_again_after_an_edit():
    pattern = re.compile(exact_dedup.chunk_pattern(64, 256).replace("(?s)", ""), re.S)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh .") for _ in range(6000))
    edited = text[:1000] + "an insertion " + text[1000:]
    a, b = pattern.findall(text), pattern.findall(edited)
    assert "".join(a) == text and "".join(b) == edited
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_exact_empty(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def brute_components(prints, limit=4):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= limit:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def brute_simhash(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_jvm_hash_and_blocks(spark):
    text = " ".join(f"w{k * k % 97}" for k in range(3000))
    assert simhash.simhash64(text) == brute_simhash(text) == simhash.simhash64(text, block=100)
    assert simhash.simhash64("one two") == brute_simhash("one two")
    (h,) = spark.range(1).select(F.xxhash64(F.lit("one two"))).first()
    assert h & (2**64 - 1) == simhash.simhash64("ONE\ttwo ")


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63, (500, 2))]
    pairs += [(a, a ^ (1 << (k % 63)) ^ (1 << (k * 7 % 63))) for k, (a, _) in enumerate(pairs)]
    df = spark.createDataFrame(pairs, "a long, b long")
    both = df.select(F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("l1"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("hamming")).collect()
    assert all(r.l1 <= r.hamming for r in both)

    def counts(x):
        return [((x >> 2 * k) & 3).bit_count() for k in range(32)]

    assert [r.l1 for r in both] == [sum(abs(x - y) for x, y in zip(counts(a & (2**64 - 1)), counts(b & (2**64 - 1)), strict=True)) for a, b in pairs]


@pytest.mark.parametrize(("groups", "large"), [(6, 64), (8, 64), (None, 64), (6, 3)])
def test_components_of_clusters(spark, monkeypatch, groups, large):
    monkeypatch.setattr(simhash, "LARGE_CELL", large)  # with 3, most cells are cut up further
    rng = random.Random(4)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(30):
            p = base
            for _ in range(rng.randint(0, 7)):
                p ^= 1 << rng.randrange(64)
            prints.append(p)
    prints += [rng.getrandbits(64) for _ in range(200)] + [0, 15, 255, 2**64 - 1]
    signed = lambda x: x - 2**64 if x >> 63 else x
    want = brute_components(prints)
    df = spark.createDataFrame([(signed(p),) for p in sorted(set(prints))], "fp long")
    got = {r.node & (2**64 - 1): r.label & (2**64 - 1) for r in simhash.fingerprint_components(df, groups=groups).collect()}
    same = defaultdict(set)
    for p, root in want.items():
        same[root].add(p)
    mine = defaultdict(set)
    for p in want:
        mine[got.get(p, p)].add(p)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, mine.values()))


def test_chance_meetings_stay_in_proportion():
    """Rows of cells and expected chance pairs, per fingerprint, by the grid that a number of them gets."""
    import math

    def cost(n):
        g = simhash.grid_groups(n)
        return math.comb(g, 4) * (1 + 4 * n * 0.375 ** (32 * (g - 4) / g))

    assert cost(10**6) < 2.2 * cost(10**5) and cost(10**9) < 40 * cost(10**5)
    assert simhash.grid_groups(10) < simhash.grid_groups(10**9)


def test_large_unrelated_cells_are_cut_up(spark, monkeypatch):
    """Fingerprints that share the coordinates of a cell and are otherwise unrelated: joined rows grow with their number, not its square."""
    seen = []
    mixed = simhash._mixed
    monkeypatch.setattr(simhash, "_mixed", lambda tagged: seen.append(out := mixed(tagged)) or out)
    pairs = {}
    for n in (400, 1600):
        rng, seen[:] = random.Random(8), []
        prints = {rng.getrandbits(32) for _ in range(n)}  # the upper half of all is zero
        simhash.fingerprint_components(spark.createDataFrame([(p,) for p in prints], "fp long"), groups=8).count()
        finer = seen[-1]
        assert len(seen) == 2
        pairs[n] = finer.groupBy("cell").agg((F.count("*") * F.count_if(F.col("comp") != F.col("main"))).alias("p")).agg(F.sum("p")).first()[0] or 0
    assert pairs[1600] < 1600 * 16


@pytest.mark.parametrize("large", [64, 3])
def test_close_copies_in_a_cell_are_tied_by_fewer_pairs_than_rows(spark, monkeypatch, large):
    """Fingerprints around a few middles, most of them within the limit of many others and not of the cell's smallest: a cell gives
    a pair less than it has rows for each component, and components are those of all pairs."""
    rng, prints = random.Random(11), set()
    for middle in (0x0123456789ABCDEF, 0xFEDCBA9876543210):
        for _ in range(150):
            bits = rng.sample(range(64), 3)  # two of these are 6 bits apart, or 4 where they share one
            prints.add(middle ^ sum(1 << b for b in bits))
    monkeypatch.setattr(simhash, "LARGE_CELL", large)
    signed = [(p - 2**64 if p >> 63 else p,) for p in sorted(prints)]
    got = {r.node & (2**64 - 1): r.label for r in simhash.fingerprint_components(spark.createDataFrame(signed, "fp long"), groups=6).collect()}
    want = brute_components(list(prints))
    same, mine = defaultdict(set), defaultdict(set)
    for p in prints:
        same[want[p]].add(p)
        mine[got.get(p, p)].add(p)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, mine.values()))

    cell, node = np.zeros(len(prints), np.int64), np.array(sorted(prints), np.uint64)
    for most in (2, 1000):
        pairs = list(zip(*(x.tolist() for x in simhash.forest(cell, node, node.view(np.int64), 4, most)), strict=True))
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs) and len(pairs) == len(prints) - len(same)


def test_cells_of_a_task_that_end_between_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, 1000 * c + 8 * k, 1000 * c + 8 * k) for c in range(30) for k in range(c)]  # neighbours differ in few bits or in many
        got = simhash._tied(spark.createDataFrame(rows, "cell long, node long, comp long"), 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = defaultdict(set)
    for r in components(spark.createDataFrame(got, "a long, b long")).collect():
        mine[r.label].add(r.node)
    same = defaultdict(set)
    for c in range(30):
        nodes = [n for x, n, _ in rows if x == c]
        for p, root in brute_components(nodes).items():
            same[root].add(p)
    assert len(got) < len(rows) and sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in same.values() if len(g) > 1)


def test_only_nodes_and_mask_numbers_move_to_cells(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(simhash, "_links", lambda *_, **named: seen.update(named) or named["gathered"])
    simhash.fingerprint_components(spark.range(50).select(F.col("id").alias("fp")), groups=8)
    cells = seen["gathered"].groupBy("cell").count()
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # fingerprints to tasks, and those with a mask's number to cells
    assert cells.agg(F.sum("count")).first()[0] == 50 * 70


def brute_similar(rows, similarity=0.8, width=5):
    sets = {}
    for _, t in rows:
        words = tuple(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOWER).encode()))
        sets[words] = {words[k : k + width] for k in range(max(1, len(words) - width + 1))} if words else set()
    nodes = list(sets)
    root = {w: w for w in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = defaultdict(list)
    for i, t in rows:
        out[find(tuple(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOWER).encode())))].append(i)
    return out


def similar_rows():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8, 40])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


def test_similar_documents_against_all_pairs(spark):
    rows = similar_rows()
    want = brute_similar(rows)
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = defaultdict(list)
    for r in got:
        mine[r.label].append(r.doc_id)
    assert all(r.component_id == min(mine[r.label]) for r in got) and len(got) == len(rows)
    whole = {i: frozenset(g) for g in want.values() for i in g}
    assert all(len({whole[i] for i in g}) == 1 for g in mine.values())  # no link is false
    links = sum(len(g) - 1 for g in want.values())
    assert links > 60 and sum(len(g) - 1 for g in mine.values()) >= 0.95 * links


def test_similar_documents_when_cells_are_large(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_CELL", 4)
    rows = similar_rows()[:90] + [(1000 + k, "one common text of several words that many rows repeat " + "x" * (k % 2)) for k in range(400)]
    want = brute_similar(rows)
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=0)
    links = sum(len(g) - 1 for g in want.values())
    assert len(rows) - got.select("label").distinct().count() >= 0.95 * links


def test_similar_odd_rows(spark):
    got = simhash.similar_documents(odd(spark), carry=("text",))
    assert got.columns == ["doc_id", "component_id", "label", "text"]
    want = brute_similar([(i, t) for i, t, _ in ODD])
    lowest = {w: min((i for i in g if i is not None), default=None) for w, g in want.items()}
    due = sorted(((i, lowest[w]) for w, g in want.items() for i in g), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == due
    assert simhash.similar_documents(empty(spark)).count() == 0


def test_words_across_blocks(monkeypatch):
    """A word's hash does not depend on where blocks end."""
    rng = random.Random(10)
    for size in (1, 3, 7):
        texts = [bytes(rng.choice(b"ab \n") for _ in range(rng.randint(0, 30))) for _ in range(100)]
        want = [simhash.word_hashes(t).tolist() for t in texts]
        with monkeypatch.context() as m:
            m.setattr(simhash, "BLOCK", size)
            assert [simhash.word_hashes(t).tolist() for t in texts] == want
        assert [len(w) for w in want] == [len(t.split()) for t in texts]


def test_hot_groups_are_joined_whole(spark):
    from nearfield.llm.common import spread_join

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = spread_join(rows, groups, ["k"], "n")
    assert sorted(map(tuple, got.collect())) == sorted((r.k, r.id, r.k) for r in rows.collect())


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, 2000 + k) for k in range(300)] + [(5, 5), (7, 6)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(101)) and all(got[2000 + k] == 1000 for k in range(300)) and got[1000] == 1000


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    """Few edges are one task's work, without joins; both ways give the smallest node that each one reaches."""
    from nearfield.llm import components as module

    monkeypatch.setattr(module, "FEW_EDGES", few)
    cuts, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: cuts.append(df) or cut(df))
    rng = random.Random(12)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(220)] + [(2**62, 2**62 + 1), (5, None), (None, 6), (9, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [] if n in want else [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert got == want and (len(cuts) == 2) == bool(few)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_members_of_shared_cells_are_found_without_a_join(spark, monkeypatch):
    """Cells of wide fingerprints: what is kept are the rows of cells that hold several components, from one pass over all rows."""
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or cut(df))
    rows = [(k, f"common words that all texts of this table repeat in one order number {k % 40}") for k in range(120)]
    simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).count()
    found = [plan for columns, plan in plans if {"cell", "rep", "n"} <= set(columns)]
    assert len(found) == 2 and all("Window" in plan for plan in found) and "Join" not in found[0]


def test_mixed_cells_are_found_without_a_join(spark, monkeypatch):
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = [(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 4, 4), (2, 5, 4), (3, 6, 6), (3, 7, 7)]
    got = simhash._mixed(spark.createDataFrame(rows, "cell long, node long, comp long"))
    assert got.columns == ["cell", "node", "comp", "main", "n"] and "Join" not in plans[0]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 1, 3), (1, 2, 1, 1, 3), (1, 3, 3, 1, 3), (3, 6, 6, 7, 2), (3, 7, 7, 7, 2)]


def test_near_on_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [(i, brute_simhash(t)) for i, t, _ in ODD]
    label = brute_components([p for _, p in rows])
    lowest = {}
    for i, p in rows:
        if i is not None:
            lowest[label[p]] = min(i, lowest.get(label[p], i))
    want = [(i, f"{p:016x}", lowest.get(label[p])) for i, p in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_masks_need_room():
    with pytest.raises(ValueError):
        simhash.cell_masks(4, 4)


def test_wide_fingerprint_bits_are_majorities():
    for n in (0, 1, 2, 254, 255, 256, 700):
        shingles = np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64, endpoint=False)
        want = []
        for k in range(simhash.WIDE):
            mixed = [int(h) for h in simhash._mix(shingles + np.uint64(k * simhash.BASE % (1 << 64)))]
            word = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > n)
            want.append(word - (1 << 64) if word >> 63 else word)
        assert simhash.wide_fingerprint(shingles) == want
