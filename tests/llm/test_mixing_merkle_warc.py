import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfield.llm import merkle, mixing, warc
from tests.llm.common import ODD, empty, odd


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    return [(k, " ".join(["w"] * rng.randint(1, 60)), "big" if rng.random() < 0.6 else rng.choice(["a", "b", "c"])) for k in range(n)]


@pytest.mark.parametrize("target", [mixing.Target(2.0), mixing.Target(1.3), mixing.Target(None, 0.9), mixing.Target(None, 0.8, 9000.0), mixing.Target(None, None, 4000.0)])
def test_mix_meets_budgets(spark, target):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, target).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = mixing.plan(dict(sizes), target)
    read, copies = Counter(), defaultdict(set)
    for r in got:
        read[r.source] += r.tokens * r.copies
        copies[r.source].add(r.copies)
        assert r.weight == want[r.source][0]
    for source, (weight, repeats) in want.items():
        assert abs(read[source] - repeats * sizes[source]) <= 60
        assert max(copies[source]) - min(copies[source]) <= 1  # a reading ends before the next begins
    if target.max_repeats:
        assert max(r for _, r in want.values()) <= target.max_repeats + 1e-6 and min(min(c) for c in copies.values()) >= 1
    if target.entropy_share:
        assert abs(mixing.entropy([w for w, _ in want.values()]) - target.entropy_share * math.log(4)) < 1e-6
    assert abs(sum(w for w, _ in want.values()) - 1) < 1e-12


def test_mix_is_the_same_each_time(spark):
    rows = corpus(2)
    a = mixing.schedule(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    b = mixing.schedule(mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)))
    take = lambda df: sorted((r.doc_id, r.epoch, r.copies) for r in df.collect())
    assert take(a) == take(b)
    assert all(0 <= r.place <= 1 for r in a.collect())


def spark_hash(*values):
    """XXH64 of values one after the other, each seeded by the one before: what Spark's xxhash64 gives for 4-byte and 8-byte numbers and strings."""
    import struct

    import xxhash

    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v), h)
    return h if h < 2**63 else h - 2**64


def unit(*values):
    return (spark_hash(*values) & (2**53 - 1)) / 2**53


def test_readings_by_brute_force(spark, monkeypatch):
    """Weights in closed form, blocks in their permuted order, and rows of the last block, recomputed without the operator."""
    rows = corpus(5, 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, mixing.Target(2.0), blocks=8).collect()}
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    most, least = max(sizes.values()), min(sizes.values())
    exponent = max(0.0, 1 - math.log(2) / math.log(most / least))  # the least source is read twice, the largest once
    powers = {s: n**exponent for s, n in sizes.items()}
    for source in sizes:
        mine = [(i, len(t.split()), spark_hash(("s", t))) for i, t, s in rows if s == source]
        repeats = round((most / sizes[source]) ** (1 - exponent), 9)
        whole, budget = int(repeats), (repeats - int(repeats)) * sizes[source]
        blocks = defaultdict(list)
        for i, n, h in mine:
            blocks[spark_hash(("i", 42), ("l", i), ("l", h)) % 8].append((i, n, h))
        extra, before = set(), 0
        for _, b in sorted((unit(("i", 42), ("s", source), ("i", whole + 1), ("i", b)), b) for b in blocks):
            size = sum(n for _, n, _ in blocks[b])
            if before + size <= budget:
                extra |= {i for i, _, _ in blocks[b]}
            elif before < budget:
                at = 0
                for _, i, n in sorted((unit(("i", 42), ("i", whole + 1), ("l", i), ("l", h)), i, n) for i, n, h in blocks[b]):
                    if at + n / 2 <= budget - before:
                        extra.add(i)
                    at += n
            before += size
        assert {i: got[i].copies for i, _, _ in mine} == {i: whole + (i in extra) for i, _, _ in mine}
        assert all(abs(got[i].weight - powers[source] / sum(powers.values())) < 1e-9 for i, _, _ in mine)


def test_blocks_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 10)
    docs = spark.createDataFrame(corpus(6, 300), "doc_id long, text string, source string")
    assert sum(r.copies for r in mixing.mix(docs, blocks=1).collect()) >= 300


def test_alike_rows_are_read_as_often_as_planned(spark):
    rows = [(1, "a b c", "s")] * 7 + [(k, "a b c d e f", "t") for k in range(2, 40)] + [(None, "x", "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = sum(r.copies for r in mixing.mix(docs, mixing.Target(1.7)).collect())
    assert mixing.mixed_documents(docs, mixing.Target(1.7)).count() == planned


def test_mix_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.copies >= 1 for r in got)
    again = mixing.mixed_documents(odd(spark))
    assert again.columns == odd(spark).columns and {r.text for r in again.collect()} == {t for _, t, _ in ODD}
    assert mixing.mix(empty(spark)).count() == mixing.mixed_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd(spark), max_sources=1)


def test_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = ["日本語のテキスト" * 40, "x" * 500, "don't stop, el niño", "", None]
    got = mixing.mix(spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    tokenizer = Tokenizer.from_file(mixing.default_path())
    assert {r.doc_id: r.tokens for r in got} == {k: max(1, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}


def test_tempered_ends():
    assert mixing.tempered([3.0, 1.0], 1.0) == [0.75, 0.25] and mixing.tempered([3.0, 1.0], 0.0) == [0.5, 0.5]


# Merkle trees.


def brute_edit(rows):
    line = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(line):
        t, after = t or "", line[(k + 1) % len(line)][1] or ""
        n = len(t) // 3
        out[i] = (len(t), t[: len(t) - n] + after[:n], after)
    return out


def test_edits_of_random_texts(spark):
    rng = random.Random(3)
    rows = [(k * k, "".join(rng.choice("abcd e.\né😀") for _ in range(rng.randint(0, 400)))) for k in range(120)] + [(-5, None), (10**12, "")]
    want = brute_edit(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    nexts = {r.doc_id: r.next_text for r in merkle.with_next(docs, rows_per_bucket=7).collect()}
    assert nexts == {i: w[2] for i, w in want.items()}
    got = {r.doc_id: r for r in merkle.edit_report(docs).collect()}
    assert len(got) == len(rows)
    for i, (n, edited, _) in want.items():
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    texts = {i: t or "" for i, t in rows}
    prints = {(got[i].fingerprint, texts[i]) for i in texts} | {(got[i].edited_fingerprint, w[1]) for i, w in want.items()}
    assert len({p for p, _ in prints}) == len({t for _, t in prints}) == len(prints)  # one to one


@pytest.mark.parametrize("most_cuts", [1, 3, 2048])
def test_next_in_few_and_many_ranges(spark, most_cuts):
    """Skewed ids, a hot id, and rows without one, in every division into ranges and buckets."""
    rows = [(2**k, f"text {k}") for k in range(60)] + [(77, f"hot {k}") for k in range(150)] + [(None, f"unnamed {k}") for k in range(90)] + [(-(3**k), f"below {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.text, r.next_text) for r in merkle.with_next(docs, rows_per_bucket=7, most_cuts=most_cuts).collect()]
    assert sorted(r[1] for r in got) == sorted(r[1] for r in rows) == sorted(r[2] for r in got)
    ids = dict((t, i) for i, t in rows)
    low = float("-inf")
    wraps = sum((low if i is None else i) < (low if ids[after] is None else ids[after]) for i, _, after in got)
    assert wraps == 1  # one line through all rows, by descending id
    follow = {t: after for _, t, after in got}
    seen, at = set(), rows[0][1]
    while at not in seen:
        seen.add(at)
        at = follow[at]
    assert len(seen) == len(rows)


def test_trees_against_sql(spark):
    rows = [(k, ("Paragraph number %d of some text. " % (k % 7)) * (k % 9) + "\n" * (k % 3) + "tail") for k in range(60)]
    duckdb.sql("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duckdb.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(duckdb.sql(merkle.EDIT_REPORT_SQL).fetchall())
    got = merkle.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == want


def test_differing_branches_locate_an_edit(spark):
    before = "\n".join(f"This is paragraph number {k} with a few more words." for k in range(200))
    after = before.replace("number 100 ", "number one hundred ")
    rows = {r.doc_id: r for r in merkle.fingerprints(spark.createDataFrame([(1, before), (2, after)], "doc_id long, text string")).collect()}
    both = spark.createDataFrame([(rows[1].sections, rows[2].sections)], "a array<string>, b array<string>")
    (changed,) = both.select(merkle.changed_sections(F.col("a"), F.col("b"))).first()
    assert 1 <= len(changed) <= 2 < len(rows[2].sections)
    assert rows[1].fingerprint.split(":")[0] != rows[2].fingerprint.split(":")[0]


def test_merkle_odd_rows(spark):
    got = merkle.edit_report(odd(spark)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _, _ in ODD), key=repr)
    assert merkle.edit_report(empty(spark)).count() == 0
    (alone,) = merkle.edit_report(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1


# Archives.


def test_chunked_framing():
    rng = random.Random(4)
    for size in (0, 1, 7, 8, 9, 1000):
        payload = rng.randbytes(size)
        assert warc.dechunked(warc.chunked(payload, 8)) == payload
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_segments_must_be_whole():
    assert warc.reassemble([(2, b"c"), (1, b"ab")], 3) == b"abc"
    for parts, total in ([(1, b"ab"), (3, b"c")], 3), ([(1, b"ab")], 3), ([(1, b"ab"), (2, b"c")], None), ([(1, b"a"), (1, b"a")], 2):
        with pytest.raises(ValueError):
            warc.reassemble(parts, total)


PAGES = [
    (1, "http://a/x y", "<p>é</p>" * 40), (2, "http://b\r\nX: y", "<p>é</p>" * 40), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30000),
    (8, "u", "x" * 300_000), (9, "u", "x" * 300_000), (None, "u", "x" * 300_000), (10, "u", "repeated " * 20), (10, "u", "repeated " * 20), (None, "u", "no id " * 30), (11, "u", "y" * 99), (12, "u", "y" * 99), (13, "u", "z" * 100), (14, "u", "z" * 100),
]


def brute_archive(pages):
    first = {}
    for i, _, html in pages:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        again = b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "c") for p in PAGES], "page_id long, url string, html string, digest int, payload string").repartition(3)
    got = warc.archive_report(pages, str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_archive(PAGES)
    payloads = Counter(bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path / "w")).where("type = 'response'").collect())
    assert payloads[("x" * 300_000).encode()] == 1 and payloads[PAGES[6][2].encode()] == 1
    kinds = Counter(r.type for r in warc.raw_records(spark, str(tmp_path / "w")).select("type").collect())
    assert kinds["continuation"] > 5
    for path in (tmp_path / "w").glob("*.gz"):
        assert gzip.open(path).read(8) == b"WARC/1.1"


def test_archive_of_nothing(spark):
    assert warc.archive_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_other_records_are_passed_over(spark, tmp_path):
    info = warc._record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>")], b"software: x") + b"\r\n\r\n"
    request = warc._record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:r>"), ("WARC-Segment-Number", 1)], b"GET / HTTP/1.1\r\n\r\n") + b"\r\n\r\n"
    (page,) = warc.page_records(1, 0, "u", b"hello", "0" * 64, None, "2024-01-01T00:00:00Z", 1 << 16)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info + request) + gzip.compress(page + b"\r\n\r\n"))  # a member for each is read as well
    assert [(r.type, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()] == [("response", b"hello")]


def test_broken_archives_are_errors():
    good = warc._record([("WARC-Type", "response")], b"abc") + b"\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(good * 2))] == [b"abc", b"abc"]
    for bad in (good[:-6], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))
