"""Registered queries of the vector engine over the embeddings table, and their SQL.

Conventions: a chunk is 50 consecutive rows (`vec_id div 50`), the offset is `vec_id % 50`. The grid view lays
rows out on 25 columns (y = vec_id div 25, x = vec_id % 25) in cells of 10 by 10, clipped at the edge. Queries
are the rows whose vec_id is divisible by 50. Distances are rounded to six places for comparison alone.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import bounds, geo, topk
from orrery.operators import manifest as M
from orrery.plans import search
from orrery.shared import shared_dir
from orrery.sources import zarr

CHUNK, STRIDE, K, WIDTH, CELL, CELLS = 50, 50, 10, 25, 10, 12
RADIUS_L2, RADIUS_COSINE = 1.6, 0.8


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as vectors of chunks of CHUNK rows."""
    start = F.floor(F.col("vec_id") / CHUNK) * CHUNK
    part = F.struct(F.lit("row").alias("dim"), start.alias("start"), (start + CHUNK).alias("stop"))
    table = embeddings(spark, sf_dir).select(F.lit("embeddings").alias("url"), F.array(part).alias("slice"), (F.col("vec_id") % CHUNK).alias("offset"), "embedding")
    return table.withColumn("chunk_id", V.chunk_id())


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a grid of rows of WIDTH, in cells of CELL by CELL; offsets are row-major in a cell."""
    y, x = F.floor(F.col("vec_id") / WIDTH), F.col("vec_id") % WIDTH
    y0, x0 = F.floor(y / CELL) * CELL, F.floor(x / CELL) * CELL
    x1 = F.least(x0 + CELL, F.lit(WIDTH))
    part = F.array(F.struct(F.lit("y").alias("dim"), y0.alias("start"), (y0 + CELL).alias("stop")), F.struct(F.lit("x").alias("dim"), x0.alias("start"), x1.alias("stop")))
    table = embeddings(spark, sf_dir).select(F.lit("grid").alias("url"), part.alias("slice"), ((y - y0) * (x1 - x0) + x - x0).alias("offset"), "embedding")
    return table.withColumn("chunk_id", V.chunk_id())


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).where(F.col("vec_id") % STRIDE == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def six(x: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double"), 6) + F.lit(0.0)


def _vec(chunk: str = "chunk_id") -> Column:
    """vec_id from the id of a chunk of rows, and the offset."""
    return F.regexp_extract(chunk, r"row=(\d+):", 1).cast("bigint") + F.col("offset")


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", _vec().alias("vec_id"), six("distance").alias("distance"))


def _brute(spark: SparkSession, sf_dir: str, k: int, metric: str = "euclidean", kernel: str = "arrow") -> DataFrame:
    """Nearest neighbours without any bound: every query needs every chunk."""
    blocks = topk.search_blocks(asked(spark, sf_dir), k)
    return _ranked(topk.merge_top_k(topk.scan_top_k(M.finite(chunked(spark, sf_dir)), blocks, k, metric, kernel), k))


def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, K)


def _pruned(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors, queries = chunked(spark, sf_dir), asked(spark, sf_dir)
    if k > topk.LONG:
        return topk.long_lists(M.finite(embeddings(spark, sf_dir)), queries, k, place=("vec_id",), digits=6).select("query_id", "rank", "vec_id", "distance")
    return _ranked(search.nearest(vectors, M.summarize(vectors), queries, k))


def l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.all_distances(embeddings(spark, sf_dir), asked(spark, sf_dir))


def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.all_distances(embeddings(spark, sf_dir), asked(spark, sf_dir), "cosine")


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.normalize(doubled)).alias("i", "v")).select("vec_id", "i", six("v").alias("v"))


def radius_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.radius_search(chunked(spark, sf_dir), asked(spark, sf_dir), RADIUS_L2)
    return found.select("query_id", _vec().alias("vec_id"), six("distance").alias("distance"))


def radius_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.radius_search(chunked(spark, sf_dir), asked(spark, sf_dir), RADIUS_COSINE, "cosine")
    return found.select("query_id", _vec().alias("vec_id"), six("distance").alias("distance"))


def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = embeddings(spark, sf_dir).count()
    grid = M.chunk_grid(spark, [-(-n // WIDTH), WIDTH], [CELL, CELL], ["y", "x"], "grid")
    return grid.select("ordinal", V.chunk_id().alias("chunk_id"))


def manifest_count_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summarize(chunked(spark, sf_dir)).select("chunk_id", "count", F.round(F.col("radius").cast("double"), 4).alias("radius"))


def manifest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = M.summarize(chunked(spark, sf_dir)).select("chunk_id", F.posexplode("centroid").alias("i", "v"))
    return flat.select("chunk_id", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.lower_bound_pairs(M.summarize(chunked(spark, sf_dir)), asked(spark, sf_dir))


def lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir).select("query_id", "chunk_id", F.round("lower_bound", 4).alias("lower_bound"))


def min_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = bounds.lower_bounds(M.summarize(chunked(spark, sf_dir)), asked(spark, sf_dir))
    return listed.select(V.chunk_id().alias("chunk_id"), F.size("lower_bounds").cast("bigint").alias("nq"), F.round(F.col("min_lower_bound").cast("double"), 4).alias("min_lower_bound"))


def tau_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.thresholds(M.summarize(chunked(spark, sf_dir)), asked(spark, sf_dir), K).select("query_id", F.round("tau", 4).alias("tau"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.candidates(_bounds(spark, sf_dir), K).select("query_id", "chunk_id")


def active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.active_chunks(bounds.chunk_needs(M.summarize(chunked(spark, sf_dir)), asked(spark, sf_dir), K).where("n > 0"))


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components of each vector, in chunks that are cells of their plane; the offset is the row's id. Here bounds rule out most chunks."""
    flat = embeddings(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    axis = lambda i: F.floor(F.col("embedding")[i].cast("double") * CELLS).cast("bigint")
    part = lambda name, i: F.struct(F.lit(name).alias("dim"), axis(i).alias("start"), (axis(i) + 1).alias("stop"))
    table = flat.select(F.lit("cells").alias("url"), F.array(part("y", 0), part("x", 1)).alias("slice"), F.col("vec_id").alias("offset"), "embedding")
    return table.withColumn("chunk_id", V.chunk_id())


def asked_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.slice("q", 1, 2).alias("q"))


def _cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.lower_bound_pairs(M.summarize(celled(spark, sf_dir)), asked_flat(spark, sf_dir), k=K)


def cells_knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search that reads only the cells that bounds leave."""
    vectors, queries = celled(spark, sf_dir), asked_flat(spark, sf_dir)
    found = topk.partial_top_k(vectors, queries, bounds.candidates(_cell_bounds(spark, sf_dir), K), K, kernel="matrix")
    nearest = topk.merge_top_k(found.withColumn("chunk_id", F.lit("")), K)  # ties by row, as in the SQL
    return nearest.select("query_id", "rank", F.col("offset").alias("vec_id"), six("distance").alias("distance"))


def cells_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.candidates(_cell_bounds(spark, sf_dir), K).select("query_id", "chunk_id")


def cells_active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells needed by the queries of one corner of the plane."""
    pairs = bounds.lower_bound_pairs(M.summarize(celled(spark, sf_dir)), asked_flat(spark, sf_dir).where("q[0] > 0 and q[1] > 0"), k=K)
    return bounds.active_chunks(bounds.candidates(pairs, K))


def cells_search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = celled(spark, sf_dir), asked_flat(spark, sf_dir)
    manifest = M.summarize(vectors)
    return bounds.search_stats(bounds.chunk_needs(manifest, queries, K), search.knn_search(vectors, manifest, queries, K))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among the chunks that end within the first half of a hundred rows."""
    vectors, queries = chunked(spark, sf_dir), asked(spark, sf_dir)
    kept = search.filter_manifest(M.summarize(vectors), "slice[0].start % 100 = 0")
    found = search.knn_search(vectors, kept, queries, K)
    order = F.row_number().over(topk.Window.partitionBy("query_id").orderBy("distance", "chunk_id", "offset"))
    return found.select("query_id", order.alias("rank"), _vec().alias("vec_id"), F.round(F.col("distance").cast("double"), 4).alias("distance"))


def _area_manifest(spark: SparkSession, sf_dir: str, area: geo.Area) -> DataFrame:
    placed = spark.createDataFrame([("grid", 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "url string, ox double, pw double, rr double, oy double, cr double, ph double")
    return search.filter_manifest(M.summarize(gridded(spark, sf_dir)), None, area, placed)


def manifest_aoi_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _area_manifest(spark, sf_dir, geo.Area.box(10.0, 3.5, 18.5, 12.0)).select("chunk_id", "count")


def manifest_aoi_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = geo.Area.polygon([(0.0, 0.0), (24.0, 0.0), (0.0, 24.0)], [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]])
    return _area_manifest(spark, sf_dir, area).select("chunk_id", "count")


def knn_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _area_manifest(spark, sf_dir, geo.Area.box(10.0, 3.5, 18.5, 12.0))
    found = search.knn_search(gridded(spark, sf_dir), kept, asked(spark, sf_dir), K)
    order = F.row_number().over(topk.Window.partitionBy("query_id").orderBy("distance", "chunk_id", "offset"))
    return found.select("query_id", order.alias("rank"), "chunk_id", "offset", F.round(F.col("distance").cast("double"), 4).alias("distance"))


def chunk_id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("n"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = chunked(spark, sf_dir)
    found = search.knn_search(vectors, M.summarize(vectors), asked(spark, sf_dir), 3, backend="native")
    return found.select("query_id", "chunk_id", "url", F.col("slice")[0]["start"].alias("start"), F.col("slice")[0]["stop"].alias("stop"), "offset", F.round(F.col("distance").cast("double"), 4).alias("distance"))


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = chunked(spark, sf_dir), asked(spark, sf_dir)
    manifest = M.summarize(vectors)
    return bounds.search_stats(bounds.chunk_needs(manifest, queries, K), search.knn_search(vectors, manifest, queries, K))


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget_stores() -> None:
    """Stores go when the process ends; results that read them are lazy, so not before."""
    for spark, url in _written:
        with contextlib.suppress(Exception):  # the session may have ended
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _store(spark: SparkSession, sf_dir: str) -> str:
    """The table as a Zarr store (y, x, embedding) in the folder that executors share. Whole cells are laid out; places without a vector hold NaN, which no search counts."""
    table = embeddings(spark, sf_dir)
    last, size = table.agg(F.max("vec_id"), F.max(F.size("embedding"))).first()
    height = 0 if last is None else (last // (WIDTH * CELL) + 1) * CELL
    url = f"{shared_dir(spark)}/orrery-zarr-{uuid.uuid4().hex}"
    _written.append((spark, url))
    cells = table.where(F.col("vec_id").isNotNull()).select(F.floor(F.col("vec_id") / WIDTH).alias("y"), (F.col("vec_id") % WIDTH).alias("x"), "embedding")
    zarr.write_vectors(cells, url, "embeddings", [height, WIDTH], [CELL, CELL], ["y", "x"], size or 1, spatial="0 1 0 0 0 1", fill=float("nan"))
    return url


def zarr_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _store(spark, sf_dir)
    search.build_manifest(spark, url, url + "/manifest.parquet", n_blocks=8, skip_empty=True)
    found = M.read_manifest(spark, url + "/manifest.parquet")
    return found.select(F.regexp_extract("chunk_id", "#(.*)$", 1).alias("chunk"), "count", F.round(F.col("radius").cast("double"), 4).alias("radius"))


def zarr_roundtrip_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _store(spark, sf_dir)
    search.build_manifest(spark, url, url + "/manifest.parquet", n_blocks=8, skip_empty=True)
    queries = asked(spark, sf_dir)
    found = search.knn_zarr_search(spark, url + "/manifest.parquet", queries, K)
    order = F.row_number().over(topk.Window.partitionBy("query_id").orderBy("distance", "chunk_id", "offset"))
    return found.select("query_id", order.alias("rank"), F.round(F.col("distance").cast("double"), 4).alias("distance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        knn_l2, l2_distance, cosine_distance, normalize, radius_l2, radius_cosine, chunk_grid, manifest_count_radius, manifest_centroid, lower_bounds,
        min_lower_bound, tau_bound, candidate_pairs, active_chunks, knn_filtered, manifest_aoi_bbox, manifest_aoi_polygon, knn_aoi, chunk_id_format,
        result_rows, search_stats, zarr_manifest, zarr_roundtrip_knn, cells_knn_pruned, cells_candidate_pairs, cells_active_chunks, cells_search_stats,
    ]
    return {f.__name__: f for f in named} | {
        "knn_l2_k1": lambda s, d: _pruned(s, d, 1),
        "knn_l2_k_exceeds_n": lambda s, d: _pruned(s, d, 1_000_000),
        "knn_l2_unpruned": lambda s, d: _brute(s, d, K),
        "knn_l2_native_kernel": lambda s, d: _brute(s, d, K, kernel="native"),
        "knn_cosine": lambda s, d: _brute(s, d, K, "cosine"),
    }


_Q = "q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
_L2 = "list_sum(list_transform(list_zip(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_DOT = "list_sum(list_transform(list_zip(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), lambda p: p[1] * p[2]))"
_NORM = "greatest(sqrt(list_sum(list_transform(CAST({0} AS DOUBLE[]), lambda x: x * x))), 1.1920929e-07)"
_COS = f"(1 - {_DOT.format('e.embedding', 'q.q')} / ({_NORM.format('e.embedding')} * {_NORM.format('q.q')}))"
_DIST = _L2.format("e.embedding", "q.q")
_CHUNK_ID = "'embeddings#row=' || (vec_id // 50 * 50) || ':' || (vec_id // 50 * 50 + 50)"
_GRID_ID = "'grid#y=' || (vec_id // 25 // 10 * 10) || ':' || (vec_id // 25 // 10 * 10 + 10) || '/x=' || (vec_id % 25 // 10 * 10) || ':' || least(vec_id % 25 // 10 * 10 + 10, 25)"
_MANIFEST = f"""c AS (
  SELECT {{id}} AS chunk_id, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS m, count(*) AS n
  FROM embeddings, unnest(range(0, len(embedding))) AS u(i) GROUP BY ALL
), ce AS (SELECT chunk_id, list(CAST(m AS FLOAT) ORDER BY i) AS centroid, CAST(max(n) AS INTEGER) AS count FROM c GROUP BY chunk_id),
man AS (
  SELECT ce.chunk_id, any_value(ce.count) AS count, any_value(centroid) AS centroid,
         CAST(CAST(sqrt(max({_L2.format('e.embedding', 'ce.centroid')})) AS FLOAT) AS DOUBLE) AS radius
  FROM ce JOIN (SELECT {{id}} AS chunk_id, embedding FROM embeddings) e USING (chunk_id) GROUP BY ce.chunk_id
)"""
_ROWS = _MANIFEST.format(id=_CHUNK_ID)
_PAIRS = f"""{_Q}, {_ROWS}, pr AS (
  SELECT query_id, chunk_id, count, pow(greatest(0, d - radius), 2) AS lb, pow(d + radius, 2) AS ub
  FROM (SELECT query_id, chunk_id, count, radius, sqrt({_L2.format('centroid', 'q.q')}) AS d FROM man, q)
), cum AS (SELECT *, sum(count) OVER (PARTITION BY query_id ORDER BY ub, chunk_id) AS held FROM pr),
tau AS (SELECT query_id, coalesce(min(CASE WHEN held >= 10 THEN ub END), CAST('inf' AS DOUBLE)) AS tau FROM cum GROUP BY query_id),
cand AS (SELECT query_id, chunk_id FROM pr JOIN tau USING (query_id) WHERE lb <= tau * (1 + 1e-6) + 1e-12)"""


_CELL_ID = "'cells#y=' || CAST(floor(CAST(embedding[1] AS DOUBLE) * 12) AS BIGINT) || ':' || (CAST(floor(CAST(embedding[1] AS DOUBLE) * 12) AS BIGINT) + 1) || '/x=' || CAST(floor(CAST(embedding[2] AS DOUBLE) * 12) AS BIGINT) || ':' || (CAST(floor(CAST(embedding[2] AS DOUBLE) * 12) AS BIGINT) + 1)"


def _flat(sql: str) -> str:
    """SQL over the whole vectors turned into SQL over their first two components."""
    return "WITH flat AS (SELECT vec_id, embedding[1:2] AS embedding FROM embeddings), " + sql.replace("FROM embeddings", "FROM flat").removeprefix("WITH ")


def _knn(k: int, distance: str = _DIST, where: str = "TRUE", places: int = 6, order: str = "e.vec_id") -> str:
    return f"""WITH {_Q}, d AS (SELECT query_id, e.vec_id, {distance} AS d FROM embeddings e, q WHERE {where}),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, {order.replace('e.', '')}) AS INTEGER) AS rank, vec_id, round(d, {places}) + 0.0 AS distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {k}"""


def oracle_sql() -> dict[str, str]:
    pairs = lambda d, where="TRUE": f"WITH {_Q} SELECT query_id, vec_id, round({d}, 6) + 0.0 AS distance FROM embeddings e, q WHERE {where}"
    in_box = "vec_id % 25 // 10 * 10 <= 18.5 AND least(vec_id % 25 // 10 * 10 + 10, 25) >= 10 AND vec_id // 25 // 10 * 10 <= 12 AND vec_id // 25 // 10 * 10 + 10 >= 3.5"
    knn = _knn(K)
    grid = f"SELECT {_GRID_ID} AS chunk_id, (vec_id // 25 % 10) * (least(vec_id % 25 // 10 * 10 + 10, 25) - vec_id % 25 // 10 * 10) + vec_id % 25 % 10 AS \"offset\", embedding FROM embeddings WHERE {in_box}"
    cells = _PAIRS.replace(_CHUNK_ID, _CELL_ID)
    corner = cells.replace("vec_id % 50 = 0", "vec_id % 50 = 0 AND embedding[1] > 0 AND embedding[2] > 0")
    stats = "SELECT (SELECT count(DISTINCT chunk_id) FROM pr) AS rows_seen, (SELECT count(DISTINCT chunk_id) FROM cand) AS rows_searched, (SELECT count(*) FROM cand) AS query_evaluations, (SELECT sum(least(n, 10)) FROM (SELECT query_id, sum(count) AS n FROM pr GROUP BY query_id))::BIGINT AS results_added"
    y0, x0 = "vec_id // 25 // 10 * 10", "vec_id % 25 // 10 * 10"
    in_triangle = f"{x0} + {y0} <= 24 AND NOT ({x0} > 1 AND {y0} > 1 AND {y0} + 10 < 9 AND least({x0} + 10, 25) < 9)"
    return {
        "cells_knn_pruned": _flat(_knn(K)), "cells_candidate_pairs": _flat(f"WITH {cells} SELECT query_id, chunk_id FROM cand"),
        "cells_active_chunks": _flat(f"WITH {corner} SELECT DISTINCT chunk_id FROM cand"), "cells_search_stats": _flat(f"WITH {cells} {stats}"),
        "manifest_aoi_polygon": f"SELECT {_GRID_ID} AS chunk_id, CAST(count(*) AS INTEGER) AS count FROM embeddings WHERE {in_triangle} GROUP BY 1",
        "knn_l2": knn, "knn_l2_unpruned": knn, "knn_l2_native_kernel": knn,
        "knn_l2_k1": _knn(1), "knn_l2_k_exceeds_n": _knn(1_000_000), "knn_cosine": _knn(K, _COS),
        "l2_distance": pairs(_DIST), "cosine_distance": pairs(_COS),
        "radius_l2": pairs(_DIST, f"{_DIST} <= {RADIUS_L2}"), "radius_cosine": pairs(_COS, f"{_COS} <= {RADIUS_COSINE}"),
        "normalize": f"SELECT vec_id, CAST(i AS INTEGER) AS i, round(3 * CAST(embedding[i + 1] AS DOUBLE) / greatest(3 * {_NORM.format('embedding')}, 1.1920929e-07), 6) + 0.0 AS v FROM embeddings, unnest(range(0, len(embedding))) AS u(i)",
        "chunk_grid": "SELECT (y * 3 + x) AS ordinal, 'grid#y=' || (10 * y) || ':' || least(10 * y + 10, h) || '/x=' || (10 * x) || ':' || least(10 * x + 10, 25) AS chunk_id FROM (SELECT (count(*) + 24) // 25 AS h FROM embeddings), unnest(range(0, (h + 9) // 10)) AS a(y), unnest(range(0, 3)) AS b(x)",
        "manifest_count_radius": f"WITH {_ROWS} SELECT chunk_id, count, round(radius, 4) AS radius FROM man",
        "manifest_centroid": f"WITH {_ROWS} SELECT chunk_id, CAST(i AS INTEGER) AS i, round(CAST(CAST(m AS FLOAT) AS DOUBLE), 5) AS v FROM c",
        "lower_bounds": f"WITH {_PAIRS} SELECT query_id, chunk_id, round(lb, 4) AS lower_bound FROM pr",
        "min_lower_bound": f"WITH {_PAIRS} SELECT chunk_id, count(*) AS nq, round(CAST(CAST(min(lb) AS FLOAT) AS DOUBLE), 4) AS min_lower_bound FROM pr GROUP BY chunk_id",
        "tau_bound": f"WITH {_PAIRS} SELECT query_id, round(tau, 4) AS tau FROM tau",
        "candidate_pairs": f"WITH {_PAIRS} SELECT query_id, chunk_id FROM cand",
        "active_chunks": f"WITH {_PAIRS} SELECT DISTINCT chunk_id FROM cand",
        "knn_filtered": _knn(K, where="e.vec_id // 50 % 2 = 0", places=4),
        "manifest_aoi_bbox": f"SELECT {_GRID_ID} AS chunk_id, CAST(count(*) AS INTEGER) AS count FROM embeddings WHERE {in_box} GROUP BY 1",
        "knn_aoi": f"WITH {_Q}, g AS ({grid}), d AS (SELECT query_id, chunk_id, \"offset\", {_L2.format('g.embedding', 'q.q')} AS d FROM g, q), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id, \"offset\") AS INTEGER) AS rank FROM d) SELECT query_id, rank, chunk_id, \"offset\", round(CAST(CAST(d AS FLOAT) AS DOUBLE), 4) AS distance FROM r WHERE rank <= 10",
        "zarr_manifest": f"WITH {_MANIFEST.format(id=_GRID_ID)} SELECT substr(chunk_id, 6) AS chunk, count, round(radius, 4) AS radius FROM man",
        "zarr_roundtrip_knn": f"SELECT query_id, rank, distance FROM ({_knn(K, places=4)})",
        "chunk_id_format": f"SELECT {_GRID_ID} AS chunk_id, count(*) AS n FROM embeddings GROUP BY 1",
        "result_rows": f"WITH r AS ({_knn(3, places=4)}) SELECT query_id, {_CHUNK_ID} AS chunk_id, 'embeddings' AS url, vec_id // 50 * 50 AS \"start\", vec_id // 50 * 50 + 50 AS \"stop\", vec_id % 50 AS \"offset\", distance FROM r",
        "search_stats": f"WITH {_PAIRS} {stats}",
    }
