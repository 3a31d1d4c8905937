import struct

import numpy as np
import pytest

from nearfield.operators import graph
from nearfield.sources import formats
from nearfield.sources import index as index_files
from nearfield.sources import vectors as files
from tests.test_distance_codes import table
from tests.test_search import data, queries


def test_adjacency_blocks():
    block = formats.adjacency_block([1, 2, 70000])
    assert len(block) == 4096 and block[:2] == b"\x03\x00" and formats.read_adjacency_block(block)[0] == [1, 2, 70000]
    codes = np.arange(12, dtype=np.uint8).reshape(3, 4)
    ids, back = formats.read_adjacency_block(formats.adjacency_block([5, 6, 7], codes))
    assert ids == [5, 6, 7] and np.array_equal(back, codes)
    assert len(formats.read_adjacency_block(formats.adjacency_block(list(range(1022))))[0]) == 1022
    with pytest.raises(ValueError):
        formats.adjacency_block(list(range(1023)))
    assert formats.read_page_record(b"xx" + formats.page_record([3, 4]), 2) == [3, 4]
    assert formats.read_index(formats.index_entry(1, 2, 3) * 2, 2) == [(1, 2, 3)] * 2
    with pytest.raises(ValueError):
        formats.read_index(b"1234", 1)


def test_codebook_and_saq_files():
    book = np.random.default_rng(1).random((2, 256, 3)).astype(np.float32)
    assert np.array_equal(formats.read_codebook(formats.codebook_file(book)), book)
    for bad in (struct.pack("<6I", 1, 1, 1, 1, 1, 1), struct.pack("<6I", formats.MAGIC_PQ, 9, 1, 1, 1, 1)):
        with pytest.raises(ValueError):
            formats.read_codebook(bad)
    codes = [np.arange(24, dtype=np.uint8).reshape(3, 8) % 16, np.ones((3, 4), np.uint8)]
    factors = np.arange(18, dtype=np.float32).reshape(3, 2, 3)
    turn = np.eye(4, dtype=np.float32)
    back = formats.read_saq(formats.saq_file([(8, 4), (4, 2)], [None, turn], codes, factors))
    assert back["n"] == 3 and back["dim"] == 12 and back["parts"] == [(8, 4), (4, 2)] and np.array_equal(back["rotations"][1], turn)
    assert np.array_equal(back["codes"][0], codes[0]) and np.array_equal(back["factors"], factors)
    packed = np.arange(12, dtype=np.uint8).reshape(3, 4)
    again = formats.read_packed_saq(formats.packed_saq_file(packed, 8, factors[:, 0], np.eye(8, dtype=np.float32)))
    assert np.array_equal(again["packed"], packed) and np.array_equal(again["factors"], factors[:, 0]) and again["rotation"].shape == (8, 8)
    with pytest.raises(ValueError):
        formats.read_packed_saq(formats.saq_file([(8, 4)], [None], codes[:1], factors[:, :1]))
    m = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert np.array_equal(formats.read_matrix(formats.matrix_file(m)), m)
    assert len(formats.truth_file(np.zeros((2, 3)), m)) == 8 + 24 + 24


def test_int8_file_pads():
    raw = formats.int8_file(np.array([[0.5, -1.5, 2.5 / 127]]))
    assert len(raw) == 512 and np.frombuffer(raw, np.int8, 3).tolist() == [64, -127, 3]


@pytest.mark.parametrize(("dtype", "header"), [("<f4", False), ("<f4", True), ("<f2", False), ("i1", False)])
def test_vector_files(spark, tmp_path, dtype, header):
    v = data(37, 8)
    path = str(tmp_path / "v.bin")
    digest = files.write_vectors(table(spark, v).repartition(3), path, dtype, header)
    assert len(digest) == 64
    back = files.read_vectors(spark, path, 8, dtype, 37, 8 if header else 0).orderBy("vec_id").collect()
    got = np.array([r.embedding for r in back])
    want = v if dtype == "<f4" else v.astype(np.float16) if dtype == "<f2" else np.round(v * 127)
    assert np.allclose(got, want, atol=0.51 if dtype == "i1" else 1e-6) and [r.vec_id for r in back] == list(range(37))
    with pytest.raises(Exception, match="don't hold"):
        files.read_vectors(spark, path, 8, dtype, 9999, 8 if header else 0).collect()


def test_dataset(spark, tmp_path):
    v = data(30, 4)
    truth = np.array([[0, 25, 1], [29, 2, 3]], "<u4")
    (tmp_path / "meta.txt").write_text("30 2 4 3")
    for name, raw in (("vectors", v.tobytes()), ("queries", v[:2].tobytes()), ("gt", truth.tobytes())):
        (tmp_path / f"{name}.bin").write_bytes(raw)
    vectors, asked, gt = files.load_dataset(spark, str(tmp_path), 20)
    assert vectors.count() == 20 and asked.count() == 2
    assert [r.gt for r in gt.orderBy("qid").collect()] == [[0, 1], [2, 3]]
    found = files.ground_truth(files.load_dataset(spark, str(tmp_path))[0], asked, 3).orderBy("qid").collect()
    assert [r.gt[0] for r in found] == [0, 1]


def test_checks_and_preparation(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (1, [1.0, None]), (2, None)], "vec_id long, embedding array<float>")
    got = files.check_vectors(rows, 2).first()
    assert (got["rows"], got.bad, got.repeated, got.least_norm, got.most_norm) == (4, 2, 1, 0, 5)
    unit = files.prepare(rows.where("vec_id < 2"), "embedding", 1).collect()
    assert len(unit) == 1 and np.allclose(unit[0].embedding, [0.6, 0.8])


def test_results_file(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("# comment\nname\tqps\na\t1.5\n")
    assert files.read_results(spark, str(tmp_path / "r.tsv")).collect()[0].qps == "1.5"


def test_index_folder(spark, tmp_path):
    v = data(120, 8)
    g = graph.nsw_build(table(spark, v), "cosine", 8, 40)
    folder = str(tmp_path / "index")
    meta = index_files.IndexMeta(8, "cosine", 120, 8, 40, entry_set=[1, 2], adj_reorder="bfs")
    index_files.save_index(folder, meta, graph=g)
    assert index_files.load_meta(spark, folder) == meta
    asked = queries(spark, v[:3])
    take = lambda x: sorted(map(tuple, graph.search_graph(x, asked, 5).collect()))
    assert take(index_files.load_table(spark, folder, "graph")) == take(g)
    with pytest.raises(ValueError):
        index_files.IndexMeta(8, "hamming", 1, 1, 1)
    with pytest.raises(Exception, match="exists"):
        index_files.save_index(folder, meta, graph=g)


def test_foreign_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from nearfield.operators import layout, saq
    from nearfield.sources import foreign

    lists = [[1, 2], [0, 2, 3], [0], [], [3]]
    codes = [[bytes([v, v + 1]) for v in x] for x in lists]
    plain = spark.createDataFrame([(0, k, x) for k, x in enumerate(lists)], "shard int, vec_id long, nbrs array<long>")
    coded = spark.createDataFrame([(k, x, c) for k, (x, c) in enumerate(zip(lists, codes, strict=True))], "vec_id long, nbrs array<long>, nbr_codes array<binary>")
    for name, g in (("plain", plain), ("coded", coded)):
        (tmp_path / name).write_bytes(b"".join(bytes(r.block) for r in foreign.adjacency_blocks(g).orderBy("vec_id").collect()))
        back = foreign.read_adjacency(spark, str(tmp_path / name)).orderBy("vec_id").collect()
        assert [r.nbrs for r in back] == lists
    assert [bytes(x) for x in back[1].nbr_codes] == codes[1]
    assert foreign.read_adjacency(spark, str(tmp_path / "coded"), 2).orderBy("vec_id").collect()[1].nbrs == [0]
    (tmp_path / "short").write_bytes(b"x" * 5000)
    with pytest.raises(Exception, match="not whole"):
        foreign.read_adjacency(spark, str(tmp_path / "short")).collect()
    order = layout.reorder(plain, "bfs").join(plain.select("vec_id", F.size("nbrs").cast("long").alias("degree")), "vec_id")
    pages = layout.pack_pages(order, page=24)
    raw = {r.page_id: bytes(r.page) for r in foreign.page_bytes(pages, plain).collect()}
    for r in pages.collect():
        assert formats.read_page_record(raw[r.page_id], r.offset) == lists[r.vec_id]
    entries = {r.vec_id: (r.page_id, r.offset, r.degree) for r in pages.collect()}
    (tmp_path / "index").write_bytes(b"".join(formats.index_entry(*entries[k]) for k in range(5)))
    assert {r.vec_id: (r.page_id, r.offset, r.degree) for r in foreign.read_page_index(spark, str(tmp_path / "index")).collect()} == entries
    book = np.random.default_rng(1).random((2, 4, 3)).astype(np.float32)
    (tmp_path / "book").write_bytes(formats.codebook_file(book))
    assert np.allclose([r.centroid for r in foreign.read_codebook(spark, str(tmp_path / "book")).orderBy("m", "c").collect()], book.reshape(8, 3))
    v, q = data(40, 8), data(3, 8, 2)
    for packed in (False, True):
        segments = saq.Segments.even(8, 1, 4)
        ((c, rescale, length),) = saq.encode_block(v.astype(float), segments)
        factors = np.stack([rescale, np.zeros(40), length], 1).astype(np.float32)
        raw = formats.packed_saq_file(saq.pack(c), 8, factors) if packed else formats.saq_file([(8, 4)], [None], [c], factors[:, None])
        (tmp_path / f"saq{packed}").write_bytes(raw)
        got = saq.saq_knn(foreign.read_saq(spark, str(tmp_path / f"saq{packed}"), packed), queries(spark, q), segments, 5, packed)
        want = saq.saq_knn(saq.encode(table(spark, v), segments, packed), queries(spark, q), segments, 5, packed)
        assert [(r.qid, r.vec_id) for r in got.orderBy("qid", "rank").collect()] == [(r.qid, r.vec_id) for r in want.orderBy("qid", "rank").collect()]
    (tmp_path / "d").write_bytes(formats.matrix_file(np.arange(6, dtype=np.float32).reshape(2, 3)))
    assert [r.distance for r in foreign.read_distances(spark, str(tmp_path / "d")).orderBy("qid", "vec_id").collect()] == [0, 1, 2, 3, 4, 5]
    digest = files.write_vectors(table(spark, v), str(tmp_path / "v.bin"), "<f4", True)
    assert foreign.payload_digest(spark, str(tmp_path / "v.bin")) == digest
