import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import topk


def value(spark, column, **arrays):
    row = spark.range(1).select(*[F.array(*[F.lit(float(x)).cast("float") for x in v]).alias(k) if isinstance(v, (list, tuple)) else F.lit(v).alias(k) for k, v in arrays.items()])
    return row.select(column.alias("x")).first()["x"]


def test_squared_distance(spark):
    for v, want in (((0, 0), 0), ((3, 4), 25), ((1, 1), 2)):
        assert value(spark, V.l2_squared("a", "b"), a=v, b=(0, 0)) == want


def test_cosine_distance(spark):
    for v, want in (((1, 0), 0), ((0, 1), 1), ((1, 1), 1 - 1 / math.sqrt(2))):
        assert value(spark, V.cosine_distance("a", "b"), a=v, b=(1, 0)) == pytest.approx(want, abs=1e-9)
    assert value(spark, V.cosine_distance("a", "b"), a=(0, 0), b=(1, 0)) == 1


def test_normalize_keeps_zero(spark):
    assert value(spark, V.normalize("a"), a=(0, 0)) == [0, 0]
    assert value(spark, V.normalize("a"), a=(3, 4)) == pytest.approx([0.6, 0.8])


def test_lower_bound_inside_and_outside(spark):
    assert value(spark, V.l2_lower_bound("q", "c", "r"), q=(0.5, 0, 0, 0), c=(0, 0, 0, 0), r=1.0) == 0
    assert value(spark, V.l2_lower_bound("q", "c", "r"), q=(3, 0, 0, 0), c=(0, 0, 0, 0), r=1.0) == pytest.approx(4.0)
    assert value(spark, V.cosine_lower_bound("q", "c", "r"), q=(1, 0), c=(0, 1), r=0.25) == pytest.approx(0.75)


def test_metric_names():
    assert V.metric("euclidean")[0] is V.l2_squared
    with pytest.raises(ValueError):
        V.metric("manhattan")


def test_chunk_id(spark):
    df = spark.sql("SELECT 'u' AS url, array(named_struct('dim','y','start',0L,'stop',2L), named_struct('dim','x','start',2L,'stop',4L)) AS slice")
    assert df.select(V.chunk_id()).first()[0] == "u#y=0:2/x=2:4"


def test_kernel_names():
    assert topk.kernel_of("numpy") == "arrow" and topk.kernel_of("faiss_cpu") == "matrix"
    with pytest.raises(NotImplementedError):
        topk.kernel_of("faiss_gpu")
    with pytest.raises(ValueError):
        topk.kernel_of("other")


def test_local_knn_matches_brute_force():
    rng = np.random.default_rng(0)
    v, q = rng.standard_normal((100, 16)), rng.standard_normal((3, 16))
    d, at = topk.local_knn(v, q, 5)
    want = ((q[:, None] - v[None]) ** 2).sum(-1)
    assert d.shape == at.shape == (3, 5)
    assert (np.diff(d, axis=1) >= 0).all()
    assert (at == np.argsort(want, axis=1)[:, :5]).all()
    assert topk.local_knn(np.eye(4), np.eye(4)[1:2], 1)[1].tolist() == [[1]]


def test_local_knn_edges():
    assert topk.local_knn(np.empty((0, 2)), np.zeros((2, 2)), 3)[0].shape == (2, 0)
    assert topk.local_knn(np.eye(2), np.zeros((2, 2)), 0)[0].shape == (2, 0)
    assert topk.local_knn(np.eye(2), np.zeros((1, 2)), 9)[0].shape == (1, 2)
    assert topk.local_knn(np.ones((3, 2)), np.zeros((1, 2)), 2)[1].tolist() == [[0, 1]]  # ties by row
    with pytest.raises(ValueError):
        topk.local_knn(np.eye(2), np.zeros(2), 1)
    with pytest.raises(ValueError):
        topk.pairwise(np.eye(2), np.zeros((1, 3)))
