import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import codes as C
from nearfield.functions import distance as D


def table(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("metric", "a", "b", "want"), [("l2", [0, 0], [3, 4], 25), ("ip", [1, 2, 3], [4, 5, 6], -32), ("cosine", [1, 2], [2, 4], 0), ("cosine", [1, 0], [0, 1], 1), ("cosine", [0, 0], [1, 1], 1), ("cosine", [1, 0], [-1, 0], 2)])
def test_known_distances(spark, metric, a, b, want):
    assert one(spark, D.distance(metric)(D.as_column(a), D.as_column(b))) == pytest.approx(want, abs=1e-12)
    assert D.exact_distance(metric, np.array([a]), np.array([b]))[0] == pytest.approx(want, abs=1e-12)
    assert D.block_distance(metric, np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(want, abs=1e-12)


def test_metric_names():
    assert D.metric_name("inner_product") == "ip"
    with pytest.raises(ValueError):
        D.metric_name("manhattan")


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_both_forms_give_the_same_bits(spark, metric):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 33)).astype(np.float32)
    df = table(spark, v)
    got = df.select("vec_id", D.distance(metric)(D.as_column(v[0].astype(float)), "embedding").alias("d")).orderBy("vec_id").collect()
    assert [r.d for r in got] == D.exact_distance(metric, np.repeat(v[:1], 60, 0), v).tolist()
    assert np.allclose([r.d for r in got], D.block_distance(metric, v[:1].astype(float), v.astype(float))[0])


def test_normalized(spark):
    rows = table(spark, [[3, 4], [0, 0]]).select(D.normalized("embedding").alias("u")).collect()
    assert rows[0].u == [0.6, 0.8] and rows[1].u == [0, 0]


def test_valid(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0, None],), ([1.0, math.nan],), ([1.0],), (None,)], "v array<double>")
    assert [r.ok for r in rows.select(D.valid("v", 2).alias("ok")).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize(("p", "want"), [(0.5, 0), (0.001, -3.09), (0.999, 3.09), (0.025, -1.96), (0, -6), (1, 6), (-1, -6)])
def test_probit(spark, p, want):
    assert one(spark, D.probit(F.lit(float(p)))) == pytest.approx(want, abs=0.01)


def test_int8(spark):
    rows = table(spark, [[0.6, 0.8, 0, 0], [0, 0, 0.6, 0.8], [-2.5 / 127, 2.5 / 127, 2, -2]])
    got = [r.c for r in rows.select(C.int8_code("embedding").alias("c")).collect()]
    assert got[0] == [76, 102, 0, 0] and got[2][2:] == [127, -127]
    pair = spark.createDataFrame([(got[0], got[0], got[1])], "a array<tinyint>, b array<tinyint>, c array<tinyint>")
    same, other = pair.select(C.int8_dot("a", "b"), C.int8_dot("a", "c")).first()
    assert same < -5000 and other == 0


def test_scales(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 3)).astype(np.float32)
    got = [r.scale for r in C.dimension_scales(table(spark, v)).orderBy("pos").collect()]
    assert np.allclose(got, np.sort(np.abs(v), axis=0)[2997])
    assert [r.scale for r in C.dimension_scales(table(spark, [[0, 0]])).collect()] == [1e-6, 1e-6]


def test_half(spark):
    v = np.array([[1 / 3, 1e-7, 65504, -0.1]], np.float32)
    (row,) = C.half(table(spark, v)).collect()
    assert np.array_equal(C.from_half(bytes(row.half)), v[0].astype(np.float16).astype(np.float32))


def test_sizes(spark):
    assert [C.most_inline_degree(m) for m in (48, 32, 16)] == [78, 113, 204]
    assert C.default_queue_depth(2) == 16 and C.default_queue_depth(8) == 32
    assert one(spark, C.aligned_bytes(F.lit(1), 400)) == 1024 and one(spark, C.aligned_bytes(F.lit(0), 512)) == 512
    assert one(spark, C.packed_record_bytes(F.lit(3))) == 14
    assert 0 <= one(spark, C.set_index(F.lit(12345), 4)) < 16
