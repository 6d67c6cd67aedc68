import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery import registry
from orrery.functions import vectors as V
from orrery.operators import bounds, topk
from orrery.operators import manifest as M
from orrery.plans import search


def frame(spark, data, chunk):
    """Vectors in chunks of `chunk` rows."""
    rows = [("u", [("row", i // chunk * chunk, i // chunk * chunk + chunk)], i % chunk, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "url string, slice array<struct<dim:string,start:bigint,stop:bigint>>, offset bigint, embedding array<float>").withColumn("chunk_id", V.chunk_id())


def brute(data, queries, k):
    d = ((np.asarray(queries, dtype=np.float64)[:, None] - np.asarray(data, dtype=np.float64)[None]) ** 2).sum(-1)
    return np.sort(d, axis=1)[:, :k]


def distances(found, nq):
    rows = found.orderBy("query_id", "distance", "chunk_id", "offset").collect()
    return [[r["distance"] for r in rows if r["query_id"] == i] for i in range(nq)]


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(1)
    centers = rng.uniform(-50, 50, (12, 6))
    data = (centers[:, None] + rng.standard_normal((12, 10, 6)) * 0.1).reshape(-1, 6).astype(np.float32)
    data[10:20] = data[10]  # a chunk of radius zero
    queries = np.concatenate([centers[:3], data[10:11]]).astype(np.float32)
    vectors = frame(spark, data, 10)
    manifest = M.summarize(vectors).cache()
    q = search.query_frame(spark, queries)
    for k in (1, 5, 15, 500):
        pairs = bounds.lower_bound_pairs(manifest, q)
        found = bounds.candidates(pairs, k)
        np.testing.assert_allclose(distances(search.knn_search(vectors, manifest, q, k), 4), brute(data, queries, k), rtol=1e-4, atol=1e-5)
        if k <= 5:
            assert found.count() <= 8
        if k == 500:
            assert found.count() == 48


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 4))
def test_pruned_equals_brute_force(spark, seed, k, d):
    rng = np.random.default_rng(seed)
    data = np.round(rng.standard_normal((30, d)) * rng.choice([0.0, 1, 20], size=(30, 1)), 1).astype(np.float32)
    queries = rng.standard_normal((2, d)).astype(np.float32)
    vectors = frame(spark, data, 7)
    np.testing.assert_allclose(distances(search.knn_search(vectors, M.summarize(vectors), search.query_frame(spark, queries), k), 2), brute(data, queries, k), rtol=1e-4, atol=1e-5)


def test_nan_vectors_take_no_part(spark):
    data = np.array([[0, 0], [np.nan, 0], [1, 1], [np.inf, 2]], dtype=np.float32)
    vectors = frame(spark, data, 2)
    manifest = M.summarize(vectors)
    assert {r["count"] for r in manifest.collect()} == {1}
    assert distances(search.knn_search(vectors, manifest, search.query_frame(spark, [[0, 0]]), 9), 1) == [[0, 2]]


def test_ties_go_by_place(spark):
    vectors = frame(spark, np.ones((6, 2)), 2)
    for backend in ("numpy", "native"):
        rows = search.to_rows(search.knn_search(vectors, M.summarize(vectors), search.query_frame(spark, [[0, 0]]), 3, backend=backend))
        assert [(r["chunk_id"], r["offset"]) for r in rows] == [("u#row=0:2", 0), ("u#row=0:2", 1), ("u#row=2:4", 0)]


def test_guards(spark):
    vectors = frame(spark, np.ones((2, 2)), 2)
    manifest, q = M.summarize(vectors), search.query_frame(spark, [[0, 0]])
    with pytest.raises(NotImplementedError, match="pruning"):
        search.knn_search(vectors, manifest, q, 1, metric="cosine")
    with pytest.raises(ValueError):
        search.knn_search(vectors, manifest, q, 1, metric="other")
    with pytest.raises(ValueError):
        search.knn_search(vectors, manifest, q, 0)
    with pytest.raises(ValueError, match="nq, d"):
        search.query_frame(spark, [1, 2])
    with pytest.raises(NotImplementedError):
        search.knn_cog_search(spark, "m", [[0.0]], 1)
    with pytest.raises(NotImplementedError):
        search.build_manifest(spark, ["a.tif"], "m")
    with pytest.raises(TypeError):
        search.filter_manifest(manifest, filter_expr=5)
    with pytest.raises(Exception, match="dimension"):
        topk.radius_search(vectors, search.query_frame(spark, [[0, 0, 0]]), 1.0).collect()


def test_filter_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "value int")
    assert [r[0] for r in search.filter_manifest(df, F.col("value") >= 2).collect()] == [2, 3]


def test_radius_is_inclusive_and_squared(spark):
    vectors = frame(spark, [[0], [1], [2], [5]], 4)
    found = topk.radius_search(vectors, search.query_frame(spark, [[0]]), 4.0)
    assert sorted(r["offset"] for r in found.collect()) == [0, 1, 2]


def test_partial_lists_merge(spark):
    lists = spark.createDataFrame([(0, "a", 0, 4.0), (0, "a", 1, 1.5), (0, "b", 0, 0.75), (0, "b", 1, 2.0)], "query_id bigint, chunk_id string, offset bigint, distance double")
    assert [r["distance"] for r in topk.merge_top_k(lists, 2).orderBy("rank").collect()] == [0.75, 1.5]
    assert topk.current_tau(lists, 2).first()["tau"] == 1.5
    assert topk.current_tau(lists, 9).first()["tau"] == float("inf")


def test_lower_bound_table(spark):
    manifest = spark.createDataFrame([("u", [("r", 0, 1)], 1, [1.0, 0.0], 0.1), ("u", [("r", 1, 2)], 1, [0.0, 1.0], 0.1)], "url string, slice array<struct<dim:string,start:bigint,stop:bigint>>, count int, centroid array<float>, radius float").withColumn("chunk_id", V.chunk_id())
    got = {r["slice"][0]["start"]: r for r in bounds.lower_bounds(manifest, search.query_frame(spark, [[1, 0], [0, 1]])).collect()}
    far = (2**0.5 - 0.1) ** 2
    assert got[0]["lower_bounds"] == pytest.approx([0, far], rel=1e-5) and got[1]["lower_bounds"] == pytest.approx([far, 0], rel=1e-5)
    assert got[0]["min_lower_bound"] == 0


def test_unsummarised_chunk_is_never_dropped(spark):
    manifest = spark.createDataFrame([("c", 1, [0.0], float("nan"))], "chunk_id string, count int, centroid array<float>, radius float")
    row = bounds.lower_bound_pairs(manifest, search.query_frame(spark, [[9]])).first()
    assert row["lower_bound"] == 0 and row["upper_bound"] == float("inf")


def test_chunk_grid_clips(spark):
    rows = M.chunk_grid(spark, [4, 5], [2, 2], ["y", "x"], "u").orderBy("ordinal").collect()
    assert [[(p["start"], p["stop"]) for p in r["slice"]] for r in rows] == [[(y, y + 2), (x, min(x + 2, 5))] for y in (0, 2) for x in (0, 2, 4)]
    with pytest.raises(ValueError):
        M.chunk_grid(spark, [], [], [], "u")


def test_registry_agrees_with_its_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_blocks_spread_and_agree(spark, monkeypatch):
    """Small blocks of queries give the rows that one block gives, nothing gathers on one key, and no side is broadcast by its size."""
    rng = np.random.default_rng(5)
    data, asked = rng.standard_normal((60, 3)).astype(np.float32), rng.standard_normal((40, 3)).astype(np.float32)
    vectors, queries = frame(spark, data, 10).repartition(4, "chunk_id"), search.query_frame(spark, asked)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = {tuple(r) for r in topk.radius_search(vectors, queries, 1.0).collect()}
        monkeypatch.setattr(bounds, "BLOCK_BYTES", 400)
        assert len(bounds.block_frames(queries)) > 1
        found = topk.radius_search(vectors, queries, 1.0)
        assert {tuple(r) for r in found.collect()} == whole
        plan = found._jdf.queryExecution().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan
        sizes = found.rdd.glom().map(len).collect()
        assert sum(s > 0 for s in sizes) > 4
        np.testing.assert_allclose(distances(search.knn_search(vectors, M.summarize(vectors), queries, 4), 40), brute(data, asked, 4), rtol=1e-4, atol=1e-5)
        assert bounds.lower_bound_pairs(M.summarize(vectors), queries).count() == 240
        assert bounds.lower_bound_pairs(M.summarize(vectors), queries.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_chunks_are_split(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_VECTORS", 7)
    data = np.random.default_rng(6).standard_normal((50, 3)).astype(np.float32)
    vectors, queries = frame(spark, data, 50), search.query_frame(spark, data[:3])
    for backend in ("numpy", "native", "faiss_cpu"):
        np.testing.assert_allclose(distances(search.knn_search(vectors, M.summarize(vectors), queries, 5, backend=backend), 3), brute(data, data[:3], 5), rtol=1e-4, atol=1e-5)


def test_reduced_pairs_keep_the_threshold(spark):
    rng = np.random.default_rng(8)
    data = (rng.uniform(-20, 20, (30, 1, 2)) + rng.standard_normal((30, 5, 2))).reshape(-1, 2).astype(np.float32)
    vectors, queries = frame(spark, data, 5), search.query_frame(spark, data[::30])
    manifest = M.summarize(vectors).cache()
    every, few = bounds.lower_bound_pairs(manifest, queries), bounds.lower_bound_pairs(manifest, queries, k=3)
    assert few.count() < every.count()
    assert {tuple(r) for r in bounds.tau(few, 3).collect()} == {tuple(r) for r in bounds.tau(every, 3).collect()}
    assert {tuple(r) for r in bounds.candidates(few, 3).collect()} == {tuple(r) for r in bounds.candidates(every, 3).collect()}


def test_filter_and_area_together(spark):
    from orrery.operators.geo import Area

    rows = [("u", [("y", 0, 2), ("x", x, x + 2)], n) for x, n in ((0, 1), (2, 5), (4, 9))]
    manifest = spark.createDataFrame(rows, "url string, slice array<struct<dim:string,start:bigint,stop:bigint>>, count int").withColumn("chunk_id", V.chunk_id())
    placed = spark.createDataFrame([("u", 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "url string, ox double, pw double, rr double, oy double, cr double, ph double")
    kept = search.filter_manifest(manifest, "count < 9", Area.box(3.0, 0.0, 6.0, 1.0), placed)
    assert [r["count"] for r in kept.collect()] == [5]


def test_matrix_kernel_and_registration():
    rng = np.random.default_rng(9)
    v = np.repeat(rng.standard_normal((40, 5)) + 1000, 2, axis=0)  # far from zero, where products cancel, and with ties
    q = v[:7] + 1e-3
    for k in (1, 4, 200):
        a, b = topk.local_knn(v, q, k), topk.matrix_knn(v, q, k)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    topk.register_kernel("own", lambda *x: topk.local_knn(*x))
    try:
        assert topk.kernel_of("own") == "own"
    finally:
        del topk.KERNELS["own"], topk.BACKENDS["own"]


def test_search_makes_no_table_of_pairs(spark, monkeypatch):
    """Thresholds and needs are those of all pairs of query and chunk, and a search by either kernel does without them."""
    rng = np.random.default_rng(12)
    data = (rng.uniform(-20, 20, (30, 1, 2)) + rng.standard_normal((30, 5, 2))).reshape(-1, 2).astype(np.float32)
    vectors, queries = frame(spark, data, 5), search.query_frame(spark, data[::15])
    manifest = M.summarize(vectors).cache()
    for k in (1, 7, 999):
        pairs = bounds.lower_bound_pairs(manifest, queries)
        assert {tuple(r) for r in bounds.thresholds(manifest, queries, k).collect()} <= {tuple(r) for r in bounds.tau(pairs, k).collect()}
        needs = {r["chunk_id"]: r["n"] for r in bounds.chunk_needs(manifest, queries, k).collect()}
        assert len(needs) == 30 and {c: n for c, n in needs.items() if n} == {r["chunk_id"]: r["count"] for r in bounds.candidates(pairs, k).groupBy("chunk_id").count().collect()}
    monkeypatch.setattr(bounds, "lower_bound_pairs", None)
    monkeypatch.setattr(topk, "partial_top_k", None)
    for backend in ("numpy", "native", "faiss_cpu"):
        for monkey in (8_192, 4):
            monkeypatch.setattr(topk, "SCAN_ROWS", monkey)
            np.testing.assert_allclose(distances(search.knn_search(vectors, manifest, queries, 4, backend=backend), 10), brute(data, data[::15], 4), rtol=1e-5, atol=1e-5)


def test_all_distances(spark, monkeypatch):
    """Arrays at once give what the column expressions give, rounding at ties and odd vectors included."""
    rng = np.random.default_rng(13)
    data = [[float(x) for x in v] for v in np.concatenate([rng.standard_normal((40, 4)), rng.integers(0, 64, (40, 4)) / 1024, [[0] * 4, [3e4, -3e4, 1, 0]]]).astype(np.float32)]
    data += [None, [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 1.0], [1.0, 2.0]]
    rows = spark.createDataFrame(list(enumerate(data)), "vec_id bigint, embedding array<float>")
    queries = rows.where("vec_id % 5 = 0 or vec_id > 80").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(topk, "TASK_PAIRS", 500)
    for metric, measure in (("euclidean", V.l2_squared), ("cosine", V.cosine_distance)):
        every = rows.join(F.broadcast(queries)).select("query_id", "vec_id", registry.six(measure("embedding", "q")).alias("distance"))
        found = topk.all_distances(rows, queries, metric)
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, every.collect()))


def test_long_lists(spark, monkeypatch):
    """Lists longer than LONG are ranked by tasks that have whole queries: no pair is shuffled, ties go by place, rows of one id are one query."""
    rng = np.random.default_rng(14)
    data = np.round(rng.standard_normal((30, 3)), 1).astype(np.float32)
    data[20:24] = data[3]
    vectors, queries = frame(spark, data, 7), search.query_frame(spark, data[:4])
    monkeypatch.setattr(topk, "HELD_PAIRS", 70)
    for k in (7, 999):
        monkeypatch.setattr(topk, "LONG", 999)
        short = search.knn_search(vectors, M.summarize(vectors), queries, k)
        monkeypatch.setattr(topk, "LONG", 3)
        long = search.knn_search(vectors, M.summarize(vectors), queries, k)
        assert "Window" not in long._jdf.queryExecution().toString()
        assert [tuple(r) for r in search.ordered(long).collect()] == [tuple(r) for r in search.ordered(short).collect()]
    twice = topk.long_lists(vectors, queries.union(queries.where("query_id = 1")), 5, digits=6).where("query_id = 1").orderBy("rank").collect()
    assert [(r["rank"], round(r["distance"], 6)) for r in twice[:2]] == [(1, 0), (2, 0)] and len(twice) == 5


def no_pairs(spark, monkeypatch, name):
    for f in ("lower_bound_pairs", "candidates"):
        monkeypatch.setattr(bounds, f, None)
    monkeypatch.setattr(topk, "partial_top_k", None)
    return registry.queries()[name](spark, "/root/testdata/sf0.001")


def test_result_rows_without_pairs(spark, monkeypatch):
    assert no_pairs(spark, monkeypatch, "result_rows").groupBy("query_id").count().where("count = 3").count() == 10


def test_knn_without_pairs(spark, monkeypatch):
    assert no_pairs(spark, monkeypatch, "knn_l2").where("rank = 1 and vec_id = query_id and distance = 0").count() == 10


def test_stats_without_pairs(spark, monkeypatch):
    assert tuple(no_pairs(spark, monkeypatch, "search_stats").first()) == (10, 10, 100, 100)
