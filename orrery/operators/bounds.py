"""Bounds of (query, chunk) pairs, and the threshold beyond which a chunk holds no neighbour.

The manifest stays where it lies. Queries come to it in blocks of at most BLOCK_BYTES, each sent to the workers by
itself, and a batch of chunks meets a block in array operations; so no key gathers rows, and what is sent is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V

QUERY_BLOCK, BLOCK_BYTES = 1_024, 32 << 20
#: Looseness that covers rounding of 32-bit summaries.
RELATIVE, ABSOLUTE = 1e-6, 1e-12
#: Numbers in one block of pairwise differences.
BLOCK = 1 << 21
#: Rows of pairs in one batch.
PAIR_ROWS = 1 << 17


def pairwise(vectors: np.ndarray, queries: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances (queries, vectors) in double, by direct differences in blocks, so that nothing cancels."""
    if queries.ndim != 2:
        raise ValueError(f"queries must have the shape (nq, d), not {queries.shape}")
    if vectors.size and vectors.shape[1] != queries.shape[1]:
        raise ValueError(f"vectors have dimension {vectors.shape[1]}, queries {queries.shape[1]}")
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.FLOAT_EPS)
        return 1 - unit(q) @ unit(v).T
    V.metric(metric)
    out = np.empty((len(q), len(v)))
    rows = max(1, BLOCK // max(1, v.size))
    for i in range(0, len(q), rows):
        d = q[i : i + rows, None, :] - v[None, :, :]
        out[i : i + rows] = np.einsum("qvd,qvd->qv", d, d)
    return out


def stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = np.concatenate([np.empty(0, np.int64), *(pyarrow.compute.list_value_length(x).to_numpy(zero_copy_only=False) for x in chunks)])
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in dimension")
    flat = np.concatenate([np.empty(0, np.float32), *(x.flatten().to_numpy(zero_copy_only=False) for x in chunks)])
    return flat.reshape(len(sizes), -1) if len(sizes) else np.empty((0, 0))


def block_frames(queries: DataFrame, rows: int | None = None) -> list[DataFrame]:
    """The queries (query_id, q) in blocks of BLOCK_BYTES, or of as many rows if given, or so, by a hash of their ids. Without queries, no block."""
    n, d = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    count = max(-(-n * (d + 1) * 8 // BLOCK_BYTES), -(-n // rows) if rows else 0)
    named = queries.select("query_id", "q")
    return [named.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i) if count > 1 else named for i in range(count)]


def query_blocks(queries: DataFrame, rows: int | None = None, limits: DataFrame | None = None) -> list[Broadcast]:
    """Each block of the queries as (ids, matrix), sent to the workers; with limits (query_id, tau) as (ids, matrix, tau), infinity where there is none."""
    out = []
    if limits is not None:
        known = limits.select("query_id", "tau").toArrow().sort_by("query_id")
        of, tau_of = known.column("query_id").to_numpy(), known.column("tau").to_numpy()
    for part in block_frames(queries, rows):
        table = part.orderBy("query_id").toArrow()
        block = table.column("query_id").to_numpy(), stack(table.column("q")).astype(np.float64)
        if limits is not None:
            at = np.searchsorted(of, block[0])
            found = at < len(of)
            found[found] = of[at[found]] == block[0][found]
            tau_here = np.full(len(at), np.inf)
            tau_here[found] = tau_of[at[found]]
            block = *block, tau_here
        out.append(queries.sparkSession.sparkContext.broadcast(block))
    return out


def over_blocks(df: DataFrame, queries: DataFrame | list[Broadcast], work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work makes of the batches of df and of each block of queries (or those made already); df is read once for each block and never moved."""
    made: DataFrame | None = None
    for sent in queries if isinstance(queries, list) else query_blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], sent: Any = sent) -> Iterator[pa.RecordBatch]:
            yield from work(batches, *sent.value)

        part = df.mapInArrow(run, schema)
        made = part if made is None else made.union(part)
    return df.sparkSession.createDataFrame([], schema) if made is None else made


def ball_bounds(centroids: np.ndarray, radius: np.ndarray, queries: np.ndarray, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries, chunks) on the distance to anything in each ball. A ball that is not finite has bounds of zero and infinity."""
    d = pairwise(centroids, queries, "euclidean")
    reach = np.sqrt(d)
    low = np.maximum(0.0, pairwise(centroids, queries, metric) - radius) if metric == "cosine" else np.maximum(0.0, reach - radius) ** 2
    high = (reach + radius) ** 2
    odd = ~(np.isfinite(low) & np.isfinite(high))
    low[odd], high[odd] = 0.0, np.inf
    return low, high


def _filled(high: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Of each query the least upper bound such that chunks up to it hold k vectors, or infinity."""
    order = np.argsort(high, axis=1, kind="stable")
    enough = np.cumsum(counts[order], axis=1) >= k
    first = enough.argmax(axis=1)
    at = order[np.arange(len(high)), first]
    return np.where(enough.any(axis=1), high[np.arange(len(high)), at], np.inf)


def lower_bound_pairs(manifest: DataFrame, queries: DataFrame, metric: str = "euclidean", k: int | None = None) -> DataFrame:
    """query_id, chunk_id, count, lower_bound, upper_bound of every query and chunk.

    manifest: chunk_id, count, centroid, radius. queries: query_id, q. A chunk whose summary is not finite has
    bounds of zero and infinity, so it is never dropped. With k, a task leaves out the pairs that the chunks it has seen
    rule out already for the k nearest, so that chunks times queries never becomes a table; the threshold of what is
    left is that of all pairs.
    """
    V.metric(metric)

    def work(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        limit = np.full(len(ids), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column("count").to_numpy(zero_copy_only=False).astype(np.int64)
            radius = batch.column("radius").to_numpy(zero_copy_only=False).astype(np.float64)
            centroids = stack(batch.column("centroid"))
            step = max(1, PAIR_ROWS // batch.num_rows)
            for i in range(0, len(ids), step):
                low, high = ball_bounds(centroids, radius, q[i : i + step], metric)
                near = np.ones(low.shape, dtype=bool)
                if k is not None:
                    limit[i : i + step] = np.minimum(limit[i : i + step], _filled(high, counts, k))
                    near = low <= (limit[i : i + step] * (1 + RELATIVE) + ABSOLUTE)[:, None]
                row, at = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + step][row]), batch.column("chunk_id").take(pa.array(at)), pa.array(counts[at]), pa.array(low[near]), pa.array(high[near])], names=["query_id", "chunk_id", "count", "lower_bound", "upper_bound"])

    return over_blocks(_summary(manifest), queries, work, "query_id bigint, chunk_id string, count bigint, lower_bound double, upper_bound double")


def _summary(manifest: DataFrame) -> DataFrame:
    return manifest.select("chunk_id", F.col("count").cast("bigint").alias("count"), "centroid", F.coalesce(F.col("radius").cast("double"), F.lit(float("nan"))).alias("radius"))


def _balls(batches: Iterator[pa.RecordBatch], n_queries: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of a summary in pieces whose pairs with the queries are about PAIR_ROWS, with counts, centroids and radii."""
    rows = max(1, PAIR_ROWS // max(1, n_queries))
    for whole in batches:
        for a in range(0, whole.num_rows, rows):
            batch = whole.slice(a, rows)
            counts = batch.column("count").to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch, counts, stack(batch.column("centroid")), batch.column("radius").to_numpy(zero_copy_only=False).astype(np.float64)


def thresholds(manifest: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """tau() of all pairs of query and chunk, without a table of them: a task hands on of each query only the chunks with the smallest upper bounds, up to k vectors."""
    V.metric(metric)

    def work(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        high, held = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)

        def rows() -> pa.RecordBatch:
            row, at = np.nonzero(held)
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(held[row, at]), pa.array(high[row, at])], names=["query_id", "count", "upper_bound"])

        for _, counts, centroids, radius in _balls(batches, len(ids)):
            new = ball_bounds(centroids, radius, q, metric)[1]
            high, held = np.concatenate([high, new], axis=1), np.concatenate([held, np.broadcast_to(counts, new.shape)], axis=1)
            order = np.argsort(high, axis=1, kind="stable")
            high, held = np.take_along_axis(high, order, axis=1), np.take_along_axis(held, order, axis=1)
            held = np.where((np.cumsum(held, axis=1) - held < k) & np.isfinite(high), held, 0)  # an infinite bound says what no bound says
            wide = int(np.count_nonzero(held, axis=1).max(initial=0))
            high, held = high[:, :wide], held[:, :wide]
            if held.size > BLOCK:
                yield rows()
                high, held = high[:, :0], held[:, :0]
        yield rows()

    lists = over_blocks(_summary(manifest), queries, work, "query_id bigint, count bigint, upper_bound double")
    return tau(lists.withColumn("chunk_id", F.lit("")), k)


def chunk_needs(manifest: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """chunk_id, n: how many queries need the chunk, as candidates() has it, counted where the manifest lies. Without queries, no row."""

    def work(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch, _, centroids, radius in _balls(batches, len(ids)):
            near = ball_bounds(centroids, radius, q, metric)[0] <= (limit * (1 + RELATIVE) + ABSOLUTE)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(near.sum(axis=0))], names=["chunk_id", "n"])

    blocks = query_blocks(queries, limits=thresholds(manifest, queries, k, metric))
    return over_blocks(_summary(manifest), blocks, work, "chunk_id string, n bigint").groupBy("chunk_id").agg(F.sum("n").alias("n"))


def lower_bounds(manifest: DataFrame, queries: DataFrame, metric: str = "euclidean") -> DataFrame:
    """The manifest in its fixed columns with lower_bounds (by query_id) and min_lower_bound."""
    pairs = lower_bound_pairs(manifest, queries, metric)
    lists = pairs.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("query_id", "lower_bound"))).alias("b"), F.min("lower_bound").cast("float").alias("min_lower_bound"))
    lists = lists.select("chunk_id", F.transform("b", lambda x: x["lower_bound"].cast("float")).alias("lower_bounds"), "min_lower_bound")
    return manifest.select("url", "slice", "count", "centroid", "radius", "chunk_id").join(lists, "chunk_id").drop("chunk_id")


def tau(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, tau: the least upper bound such that chunks up to it hold k vectors; infinity if all hold fewer.

    A chunk holds one vector at least, so the k chunks with the smallest upper bounds are enough to look at.
    """
    order = Window.partitionBy("query_id").orderBy("upper_bound", "chunk_id")
    near = pairs.select("query_id", "chunk_id", "count", "upper_bound", F.row_number().over(order).alias("r")).where(F.col("r") <= k)
    filled = near.withColumn("held", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("held") >= k, F.col("upper_bound"))), F.lit(float("inf"))).alias("tau"))


def within(bound: Column, limit: Column) -> Column:
    """bound <= limit, with room for rounding. Equality must pass: a ball of radius zero has its bound at its distance."""
    return bound <= limit * (1 + RELATIVE) + ABSOLUTE


def candidates(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (query_id, chunk_id, count, lower_bound, tau) whose chunk may hold one of the query's k nearest."""
    joined = pairs.join(tau(pairs, k), "query_id")
    return joined.where(within(F.col("lower_bound"), F.col("tau"))).select("query_id", "chunk_id", "count", "lower_bound", "tau")


def active_chunks(found: DataFrame) -> DataFrame:
    """Chunks that at least one query needs."""
    return found.select("chunk_id").distinct()


def search_stats(needs: DataFrame, results: DataFrame) -> DataFrame:
    """One row: chunks seen and searched, (query, chunk) pairs evaluated, rows returned. needs: of chunk_needs()."""
    done = needs.agg(F.count("*").alias("rows_seen"), F.count_if(F.col("n") > 0).alias("rows_searched"), F.coalesce(F.sum("n"), F.lit(0)).alias("query_evaluations"))
    return done.join(results.agg(F.count("*").alias("results_added")))
