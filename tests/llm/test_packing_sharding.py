import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import packing, sharding
from nearfield.llm.queries import tokenizer_path
from tests.llm.common import ODD, empty, odd

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = packing.encoder(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_give_the_tokenizers_ids(text):
    assert WORDS.encode(text) == WORDS.whole(text)


@pytest.mark.parametrize("text", ["It's we'll I'd 'S", "ΣΑΣ Σ", "áb é", "x\x1cy", "<|endoftext|> x", "ﬁ Å K", "١٢ 12", "a b　c", "Dzsǅ ß ẞ", "don''t !!! ... a1b2"])
def test_words_of_hard_texts(text):
    assert WORDS.encode(text) == WORDS.whole(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>", "A<|ENDOFTEXT|>b", "é <|endoftext|>", "plain words", "x<|endoftext|><|startoftext|>y 日本"])
def test_ids_are_those_of_the_tokenizer_as_given(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WORDS.encode(text), "<u4").tolist() == ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_packs_hold_everything(histogram):
    packs = packing.shortest_pack_first(histogram, 64)
    placed = defaultdict(int)
    for count, pattern in packs:
        assert count > 0 and sum(length * n for length, n in pattern) <= 64
        for length, n in pattern:
            placed[length] += count * n
    assert placed == histogram
    places, seen = packing.Places(packs), defaultdict(set)
    for length, n in histogram.items():
        for rank in range(n):
            sequence, offset = places.find(length, rank)
            assert not seen[sequence] & set(range(offset, offset + length))
            seen[sequence] |= set(range(offset, offset + length))
    assert all(x == set(range(len(x))) for x in seen.values())


@pytest.mark.parametrize("length", [10, 40, 300, 700])
def test_a_third_of_one_length_pads_little(length):
    rng = random.Random(7)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1)] += 1
    histogram[length] += 10000
    packs = packing.shortest_pack_first(histogram)
    assert sum(count for count, _ in packs) * 2048 * 0.97 < sum(k * n for k, n in histogram.items())


def test_one_length_alone_fills_its_packs():
    assert sum(count for count, _ in packing.shortest_pack_first({300: 100_000})) == 16_667  # six to a pack
    assert packing.shortest_pack_first({300: 13}, 2048) == [(1, ((300, 5),)), (2, ((300, 4),))]


def packed_rows(spark, docs):
    return packing.pack_documents(docs, tokenizer_path()).collect()


def check_packing(rows, texts):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    want = []
    for i, t in texts:
        ids = WORDS.whole(t or "") + np.array([1], "<u4").tobytes()
        want += [(i, s // 4, len(ids[s : s + 8192]) // 4, zlib.crc32(ids[s : s + 8192]), len(ids) // 4) for s in range(0, len(ids), 8192)]
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows], key=repr) == sorted(want, key=repr)


def test_pack_odd_rows(spark):
    check_packing(packed_rows(spark, odd(spark)), [(i, t) for i, t, _ in ODD])
    assert packed_rows(spark, empty(spark)) == []


def test_pack_many_alike(spark):
    rng = random.Random(5)
    texts = [(k, "same words here" if k % 3 else " ".join(["w"] * rng.randint(1, 5000))) for k in range(400)]
    rows = packed_rows(spark, spark.createDataFrame(texts, "doc_id long, text string"))
    check_packing(rows, texts)
    used = sum(r.length for r in rows)
    assert used / (2048 * len({r.sequence_id for r in rows})) > 0.98


def test_pieces_can_carry_ids(spark):
    rows = packing.token_pieces(odd(spark), tokenizer_path(), capacity=16, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def check_shards(rows, texts, shards=16):
    sized = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows if r.doc_id is not None) == sized
    assert len(rows) == len(texts)
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(r["size"] for r in rows)
    mean = sum(total.values()) / shards
    assert all(abs(total[k] - mean) <= largest for k in range(shards))


def test_shard_odd_rows(spark):
    check_shards(sharding.shard_documents(odd(spark)).collect(), [(i, t) for i, t, _ in ODD])
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_shard_hot_group_and_small_sample(spark):
    """A third of all rows is one text, and the sample is so small that ranges must be subdivided."""
    texts = [(k, "one hot text" if k % 3 == 0 else f"text {k * k} " * (k % 40)) for k in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check_shards(sharding.shard_documents(docs, sample_per_range=1).collect(), texts)
    cold = defaultdict(set)
    for r in sharding.shard_documents(docs).collect():
        cold[r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in cold.values()) <= 16  # only a boundary parts equal texts


def test_shard_repeated_rows(spark):
    """Rows alike in everything are told apart, so their ranges can be subdivided too."""
    texts = [(None, "the same row")] * 2000 + [(k, f"text {k}") for k in range(500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check_shards(sharding.shard_documents(docs).collect(), texts)
    keys = docs.select(F.xxhash64("text").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.monotonically_increasing_id().alias("k4"), F.lit(10).alias("size"))
    _, ranges = sharding.split_ranges(keys.cache(), 20, 10)
    assert ranges.agg(F.max("n")).first()[0] <= 2 * 2500 / 20


def test_quantiles():
    keys = np.array([(k, 0, 0, 0) for k in range(100)])
    assert sharding.quantile_splitters(keys, np.ones(100), 4).tolist() == [[24, 0, 0, 0], [49, 0, 0, 0], [74, 0, 0, 0]]


def test_range_numbers_by_bisection():
    import bisect

    rng = random.Random(6)
    splitters = sorted({tuple(rng.randint(0, 3) for _ in range(4)) for _ in range(40)})
    rows = [tuple(rng.randint(0, 3) for _ in range(4)) for _ in range(300)]
    got = sharding.range_numbers(np.array(splitters), list(np.array(rows).T))
    assert got.tolist() == [bisect.bisect_right(splitters, r) for r in rows]
