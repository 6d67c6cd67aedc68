"""Exact top-k search by integer inner product: tiled matrix products, then tree merging.

Vectors and queries are dealt to a grid of cells: a vector goes to every column of its row group, a query
to every row group of its column. A cell holds a bounded number of both. In a cell, tiles of queries and
vectors are multiplied, each tile keeps a partial selection, and the cell returns k per query. The lists of
the row groups then merge level by level, FAN_IN at a time, so no task meets more than FAN_IN * (k + 1) of a query.
A query's own row is searched like any other; it leaves the merged list of k + 1, if it is in there.

Defined results: vectors that are null, or hold null or non-finite components, take no part, neither as
queries nor as candidates; nor do rows with a null id. A query finds every row but its own, so also others of
its id. Of repeated rows each counts, and each has a list of its own as a query. Ties go to the smaller id. If there
are fewer than k rows, all return. Vectors whose length differs from a query's are not comparable and raise
ValueError. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_VECTORS, CELL_QUERIES, FAN_IN = 32_768, 4_096, 32
TILE_VECTORS, TILE_QUERIES = 8_192, 256
LEAST_GROUPS = 64


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each component as long; rows that take no part are gone."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(v, bad))
    return good.select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    n = len(flat)
    lengths = np.unique(pyarrow.compute.list_value_length(flat).to_numpy(zero_copy_only=False)) if n else np.array([0])
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths[:5].tolist()}")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, int(lengths[0]))


def best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, vector ids and scores of each tile of queries, the best k of a query first."""
    if queries.shape[1] != vectors.shape[1]:
        raise ValueError(f"vectors of lengths {queries.shape[1]} and {vectors.shape[1]}")
    order = np.argsort(ids, kind="stable")  # of equal scores the smaller id comes first
    vectors, ids = vectors[order], ids[order]
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if limit < 2**53 else np.int64  # sums below 2**53 are exact in doubles
    held = vectors.astype(kind)
    for a in range(0, len(queries), TILE_QUERIES):
        q = queries[a : a + TILE_QUERIES].astype(kind)
        rows, found, scores = [], [], []
        for b in range(0, len(held), TILE_VECTORS):
            product = q @ held[b : b + TILE_VECTORS].T
            bound = -np.partition(-product, k - 1, axis=1)[:, k - 1 : k] if product.shape[1] > k else product.min()
            at = np.nonzero(product >= bound)  # ties at the bound are all kept until the merge
            rows.append(at[0]), found.append(ids[b + at[1]]), scores.append(product[at].astype(np.int64))
        row, vec, score = map(np.concatenate, (rows, found, scores))
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        keep = rank < k
        yield a + row[keep], vec[keep], score[keep]


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each row of df that is_query chooses, against all rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = df.sparkSession
    base = quantised(df, id_col, vector_col, scale)
    queries = quantised(df.where(is_query), id_col, vector_col, scale)
    # Repeated rows have the same list, which is found once; q tells a query from others of its id.
    queries = queries.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("q", F.xxhash64("v"))
    n, nq = base.count(), queries.count()
    groups = max(LEAST_GROUPS, -(-n // CELL_VECTORS))
    columns = max(1, -(-nq // CELL_QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int")
    vectors = base.select("id", "v", dealt(groups).alias("g")).select("*", every(columns).alias("c"))
    asked = queries.select("id", "v", "q", "times", dealt(columns).alias("c")).select("*", every(groups).alias("g"))
    kept = {"query_id": pa.int64(), "q": pa.int64(), "times": pa.int64(), "own": pa.int64(), "g": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({c: pa.array([], t) for c, t in kept.items()})]
        if left.num_rows and right.num_rows:
            g, asking = left.column("g")[0].as_py(), _matrix(right.column("v"))
            own = (asking * asking).sum(axis=1)
            for at, vec, score in best(asking, _matrix(left.column("v")), left.column("id").to_numpy(), k + 1):
                made = [*(right.column(c).to_numpy()[at] for c in ("id", "q", "times")), own[at], np.full(len(at), g), vec, score]
                out.append(pa.table({c: pa.array(x, t) for x, (c, t) in zip(made, kept.items())}))
        return pa.concat_tables(out)

    schema = "query_id bigint, q bigint, times bigint, own bigint, g int, vec_id bigint, score bigint"
    lists = vectors.groupBy("g", "c").cogroup(asked.groupBy("g", "c")).applyInArrow(cell, schema)
    while True:
        groups = -(-groups // FAN_IN)
        lists = lists.withColumn("g", F.floor(F.col("g") / FAN_IN).cast("int"))
        keys = ["query_id", "q", "g"] if groups > 1 else ["query_id", "q"]
        lists = lists.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
        if groups <= 1:
            break
        lists = lists.drop("r")
    # Rows of one id and score look alike in a list, so that the first one stands for the query's own.
    itself = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("r"))
    lists = lists.withColumn("self", F.min(itself).over(Window.partitionBy("query_id", "q"))).where(F.col("self").isNull() | (F.col("r") != F.col("self")))
    lists = lists.withColumn("rank", F.when(F.col("r") > F.col("self"), F.col("r") - 1).otherwise(F.col("r"))).where(F.col("rank") <= k)
    return lists.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("query_id", "rank", "vec_id", "score")
