"""Nearest neighbours of vectors to queries: kernels for a cell of both, partial lists, and their merging."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import bounds
from orrery.operators.bounds import pairwise, stack
from orrery.shared import shared_dir

#: Vectors of a chunk, and queries, in one cell of work.
CELL_VECTORS, CELL_QUERIES = 16_384, bounds.QUERY_BLOCK
#: Of a scan: vectors met at once, queries in a block and places that a task holds for them, pairs measured at once.
SCAN_ROWS, SCAN_QUERIES, SCAN_HELD, SCAN_PAIRS = 8_192, 2_048, 1 << 21, 1 << 16
#: Pairs of query and vector in one task, or so.
TASK_PAIRS = 1 << 25
#: Neighbours of a query from which lists go by long_lists, and distances that a task holds there.
LONG, HELD_PAIRS = 4_096, 1 << 24
#: Room for every digit of a double.
WIDE = Context(prec=800)
#: Share of the pairs of query and chunk from which a scan no longer goes chunk by chunk.
DENSE = 0.25
#: A kernel takes vectors (n, d), queries (nq, d), k and the metric, and returns distances and row numbers (nq, min(k, n)), ties by row number.
Kernel = Callable[[np.ndarray, np.ndarray, int, str], tuple[np.ndarray, np.ndarray]]


def kernel_of(backend: str) -> str:
    """The kernel that serves a search backend."""
    if backend == "faiss_gpu":
        raise NotImplementedError("there is no GPU backend; the exact CPU kernels return the same rows")
    if backend not in BACKENDS:
        raise ValueError(f"unknown search backend {backend!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[backend]


def register_kernel(name: str, kernel: Kernel) -> None:
    """Make a kernel of the caller's known as a backend. It must be exact, as pruning and merging rely on it."""
    KERNELS[name], BACKENDS[name] = kernel, name


def local_knn(vectors: np.ndarray, queries: np.ndarray, k: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """Distances and row numbers (nq, min(k, n)) of the nearest vectors, ties by row number."""
    if queries.ndim != 2:
        raise ValueError(f"queries must have the shape (nq, d), not {queries.shape}")
    size = min(k, len(vectors))
    if size <= 0:
        return np.empty((len(queries), 0)), np.empty((len(queries), 0), dtype=np.int64)
    d = pairwise(vectors, queries, metric)
    at = np.argsort(d, axis=1, kind="stable")[:, :size]
    return np.take_along_axis(d, at, axis=1), at


def matrix_knn(vectors: np.ndarray, queries: np.ndarray, k: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """As local_knn, through one matrix product: it chooses what can be among the k nearest, rounding considered, and only that is measured by differences."""
    size = min(k, len(vectors))
    if metric != "euclidean" or queries.ndim != 2 or size <= 0 or size == len(vectors):
        return local_knn(vectors, queries, k, metric)
    if vectors.shape[1] != queries.shape[1]:
        raise ValueError(f"vectors have dimension {vectors.shape[1]}, queries {queries.shape[1]}")
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    vv, qq = np.einsum("vd,vd->v", v, v), np.einsum("qd,qd->q", q, q)
    d, at = np.empty((len(q), size)), np.empty((len(q), size), dtype=np.int64)
    rows = max(1, bounds.BLOCK // len(v))
    for i in range(0, len(q), rows):
        near = qq[i : i + rows, None] + vv[None, :] - 2 * (q[i : i + rows] @ v.T)
        slack = 8 * v.shape[1] * np.finfo(np.float64).eps * (qq[i : i + rows] + vv.max())
        limit = np.partition(near, size - 1, axis=1)[:, size - 1] + 2 * slack
        for j, chosen in enumerate(near <= limit[:, None]):
            found = np.flatnonzero(chosen)
            exact = pairwise(v[found], q[i + j : i + j + 1])[0]
            best = np.argsort(exact, kind="stable")[:size]
            d[i + j], at[i + j] = exact[best], found[best]
    return d, at


KERNELS: dict[str, Kernel | None] = {"arrow": local_knn, "matrix": matrix_knn, "native": None}
#: Names of search backends and the kernels that serve them; all are exact and run on a CPU.
BACKENDS = {"numpy": "arrow", "faiss_cpu": "matrix", "arrow": "arrow", "matrix": "matrix", "native": "native"}


def partial_top_k(vectors: DataFrame, queries: DataFrame, found: DataFrame, k: int, metric: str = "euclidean", kernel: str = "arrow") -> DataFrame:
    """query_id, chunk_id, offset, distance: of each candidate pair (query_id, chunk_id) the chunk's k nearest.

    found may have the count of vectors in the chunk. A cell of work is a part of a chunk, of CELL_VECTORS or so, and a
    block of the queries that need it, so neither a large chunk nor many queries meet in one task.
    """
    measure, _ = V.metric(metric)
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; there are {sorted(KERNELS)}")
    blocks = max(1, -(-queries.count() // CELL_QUERIES))
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / CELL_VECTORS).cast("int") if "count" in found.columns else F.lit(1)
    need = found.select("query_id", "chunk_id", F.greatest(parts, F.lit(1)).alias("parts")).join(queries, "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    cells = need.groupBy(F.col("chunk_id").alias("chunk_id"), F.col("block").alias("block")).agg(F.max("parts").alias("parts"))
    data = vectors.select("chunk_id", "offset", "embedding").join(cells, "chunk_id").withColumn("part", F.pmod(F.xxhash64("offset"), F.col("parts")).cast("int"))
    need = need.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    order = Window.partitionBy("query_id", "chunk_id").orderBy("distance", "offset")
    if kernel == "native":
        both = data.drop("parts").join(need, ["chunk_id", "block", "part"]).select("query_id", "chunk_id", "offset", V.same_size("embedding", "q").alias("checked"), measure("embedding", "q").alias("distance"))
        return both.where(F.col("checked").isNull()).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r", "checked")
    nearest = KERNELS[kernel]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.string()), "offset": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        offsets = left.column("offset").to_numpy()
        by = np.argsort(offsets, kind="stable")
        d, at = nearest(stack(left.column("embedding"))[by], stack(right.column("q")), k, metric)
        ids, size = right.column("query_id").to_numpy(), d.shape[1]
        return pa.table({"query_id": pa.array(np.repeat(ids, size), pa.int64()), "chunk_id": pa.array([left.column("chunk_id")[0].as_py()] * d.size, pa.string()), "offset": pa.array(offsets[by][at].ravel(), pa.int64()), "distance": pa.array(d.ravel(), pa.float64())})

    keys = ["chunk_id", "block", "part"]
    return data.groupBy(*keys).cogroup(need.groupBy(*keys)).applyInArrow(cell, "query_id bigint, chunk_id string, offset bigint, distance double")


class _Held:
    """The k nearest so far of each query of a block, ties by chunk id, then offset."""

    def __init__(self, n: int, k: int, size: int | None) -> None:
        self.k, self.names, self.codes, self.rank = k, [], {}, np.array([np.iinfo(np.int64).max])
        self.d, self.chunk, self.offset = np.full((n, k), np.inf), np.full((n, k), -1), np.full((n, k), -1)
        self.vectors = None if size is None else np.zeros((n, k, size), dtype=np.float32)

    def code(self, names: list[str]) -> np.ndarray:
        """Numbers of chunk ids, the same for the whole task."""
        for name in names:
            if name not in self.codes:
                self.codes[name] = len(self.names)
                self.names.append(name)
        if len(self.rank) != len(self.names) + 1:
            self.rank = np.full(len(self.names) + 1, np.iinfo(np.int64).max)  # the last is that of an empty place
            self.rank[np.array(sorted(range(len(self.names)), key=self.names.__getitem__), dtype=np.int64)] = np.arange(len(self.names))
        return np.array([self.codes[name] for name in names], dtype=np.int64)

    def add(self, at: np.ndarray, d: np.ndarray, chunk: np.ndarray, offset: np.ndarray, vectors: np.ndarray) -> None:
        """Candidates of the queries at."""
        rows, slot = np.unique(at, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), slot])
        put = lambda kept, new: np.concatenate([kept[rows].reshape(-1, *kept.shape[2:]), new])
        d, chunk, offset = put(self.d, d), put(self.chunk, chunk), put(self.offset, offset)
        order = np.lexsort((offset, self.rank[chunk], d, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(rows)))[of]
        order, to = order[place < self.k], (rows[of[place < self.k]], place[place < self.k])
        if self.vectors is not None:
            self.vectors[to] = put(self.vectors, vectors)[order]
        self.d[to], self.chunk[to], self.offset[to] = d[order], chunk[order], offset[order]


def _measured(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, added up in the order that functions.vectors and SQL have."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    if metric == "cosine":
        norm = lambda x: np.maximum(np.sqrt(total(x * x)), V.FLOAT_EPS)
        return 1 - total(v * q) / (norm(v) * norm(q))
    return total((v - q) ** 2)


def _floor(v: np.ndarray, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """By one matrix product a number (queries, vectors) that no distance is below, and for each query how much a distance may be above."""
    loose = 8 * (v.shape[1] + 2) * np.finfo(np.float64).eps
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.FLOAT_EPS)
        return (1 - 2 * loose) - unit(q) @ unit(v).T, np.full(len(q), 4 * loose)
    vv, qq = np.einsum("vd,vd->v", v, v), np.einsum("qd,qd->q", q, q)
    out = q @ (-2 * v.T)
    out += (qq * (1 - loose))[:, None]
    out += vv * (1 - loose)
    return out, 2 * loose * (qq + vv.max(initial=0.0))


def scan_top_k(vectors: DataFrame, blocks: list, k: int, metric: str = "euclidean", kernel: str = "arrow") -> DataFrame:
    """query_id, chunk_id, offset, distance: of each task the k nearest of each query among the vectors that it reads, for merge_top_k.

    Vectors stay where they lie and meet each block of queries, as bounds.query_blocks() makes them with limits. vectors: chunk_id,
    offset, embedding; with centroid and radius of the chunk, queries beyond its lower bound leave the chunk out. A task keeps the k nearest
    of a block alone, so that pairs never become a table. A matrix product chooses what can be among them, rounding considered, and that is
    measured by differences: in the task, or for the native kernel by Spark's expressions. A caller's own kernel does both.
    """
    measure, _ = V.metric(metric)
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; there are {sorted(KERNELS)}")
    own = None if KERNELS[kernel] in (local_knn, matrix_knn, None) else KERNELS[kernel]
    native = kernel == "native"
    bounded = "centroid" in vectors.columns
    names = ["query_id", "chunk_id", "offset", "distance", *(("embedding", "q") if native else ())]

    def choose(v: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, vector) that can be among the k nearest and within the limit, and their distances."""
        if own is not None:
            d, at = own(v, q, k, metric)
            return np.repeat(np.arange(len(q)), d.shape[1]), at.ravel(), d.ravel()
        low, room = _floor(v, q, metric)
        near = low <= limit[:, None]
        many = np.flatnonzero(near.sum(axis=1) > 4 * k) if len(v) > 4 * k else []
        if len(many):
            near[many] = low[many] <= np.minimum(limit[many], np.partition(low[many], k - 1, axis=1)[:, k - 1] + room[many])[:, None]
        row, at = np.nonzero(near)
        parts = range(0, len(row), SCAN_PAIRS)
        return row, at, np.concatenate([np.empty(0), *(_measured(v[at[a : a + SCAN_PAIRS]], q[row[a : a + SCAN_PAIRS]], metric) for a in parts)])

    def work(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = _Held(len(ids), k, q.shape[1] if native else None)
        limit = limit * (1 + bounds.RELATIVE) + bounds.ABSOLUTE
        for whole in batches:
            for a in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(a, SCAN_ROWS)
                v = stack(batch.column("embedding")).astype(np.float64)
                if v.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors have dimension {v.shape[1]}, queries {q.shape[1]}")
                found = batch.column("chunk_id").dictionary_encode()
                code, offset = found.indices.to_numpy(), batch.column("offset").to_numpy()
                chunk = held.code(found.dictionary.to_pylist())
                every = np.arange(len(v))
                cells = [(np.arange(len(ids)), every)]
                if bounded:
                    first = pa.array(np.unique(code, return_index=True)[1])
                    radius = batch.column("radius").take(first).to_numpy(zero_copy_only=False).astype(np.float64)
                    low = bounds.ball_bounds(stack(batch.column("centroid").take(first)), radius, q, metric)[0]
                    need = low <= np.minimum(limit, held.d[:, -1])[:, None]
                    if need.mean() < DENSE:
                        order = np.argsort(code, kind="stable")
                        cells = [(np.flatnonzero(need[:, c]), rows) for c, rows in enumerate(np.split(order, np.searchsorted(code[order], np.arange(1, len(chunk))))) if need[:, c].any()]
                for asked, rows in cells:
                    step = max(1, bounds.BLOCK // len(rows))
                    for i in range(0, len(asked), step):
                        some = asked[i : i + step]
                        row, at, d = choose(v[rows] if len(rows) < len(v) else v, q[some], np.minimum(limit, held.d[:, -1])[some])
                        if len(row):
                            at = rows[at]
                            held.add(some[row], d, chunk[code[at]], offset[at], v[at] if native else v[:0])
        for i in range(0, len(ids), max(1, SCAN_PAIRS // k)):
            part = slice(i, i + max(1, SCAN_PAIRS // k))
            row, at = np.nonzero(held.d[part] < np.inf)
            row = row + i
            columns = [pa.array(ids[row], pa.int64()), pa.array(np.array([*held.names, ""], dtype=object)[held.chunk[row, at]], pa.string()), pa.array(held.offset[row, at], pa.int64()), pa.array(held.d[row, at])]
            if native:
                ends = pa.array(np.arange(len(row) + 1) * q.shape[1], pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.float32).ravel())) for x in (held.vectors[row, at], q[row])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = ["chunk_id", F.col("offset").cast("bigint").alias("offset"), "embedding", *(("centroid", F.coalesce(F.col("radius").cast("double"), F.lit(float("nan"))).alias("radius")) if bounded else ())]
    found = bounds.over_blocks(vectors.select(*columns), blocks, work, "query_id bigint, chunk_id string, offset bigint, distance double" + ", embedding array<float>, q array<float>" * native)
    return found.select("query_id", "chunk_id", "offset", measure("embedding", "q").alias("distance")) if native else found


def spread(pairs: int, blocks: int) -> int:
    """Tasks for each of some blocks of queries, so that one has about TASK_PAIRS of all pairs."""
    return max(1, -(-pairs // (TASK_PAIRS * max(1, blocks))))


def _half_up(d: np.ndarray, digits: int) -> np.ndarray:
    """d rounded half up in decimal, as Spark and SQL round."""
    y = d * 10.0**digits + 0.5
    out = np.floor(y)
    near = np.flatnonzero(np.abs(y - np.rint(y)) <= 1e-6 + 1e-15 * np.abs(y))
    out /= 10.0**digits
    out[near] = _decimal(d[near], digits)
    return out + 0.0  # no negative zero


def _decimal(d: np.ndarray, digits: int) -> list[float]:
    unit = Decimal(1).scaleb(-digits)
    return [float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP, WIDE)) + 0.0 for x in d.tolist()]


def rounded(v: np.ndarray, q: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Distances (queries, vectors) rounded half up in decimal. One matrix product serves all that its own rounding cannot sway; the rest is measured by itself."""
    low, room = _floor(v, q, metric)
    low *= 10.0**digits
    low += 0.5
    sure = 1e-6 + 1e-15 * np.abs(low).max(initial=0.0)
    out = np.floor(low - sure)
    low += (room * 10.0**digits + sure)[:, None]
    row, at = np.nonzero(np.floor(low, out=low) != out)
    out /= 10.0**digits
    out += 0.0  # no negative zero
    for a in range(0, len(row), SCAN_PAIRS):
        r, c = row[a : a + SCAN_PAIRS], at[a : a + SCAN_PAIRS]
        out[r, c] = _decimal(_measured(v[c], q[r], metric), digits)
    return out


def all_distances(vectors: DataFrame, queries: DataFrame, metric: str = "euclidean", digits: int = 6) -> DataFrame:
    """query_id, vec_id, distance of every query and vector, rounded. The vectors are dealt out once, and meet each block of queries in their tasks.

    vectors: vec_id, embedding. A distance from or to a vector that is null, of another size than the queries or has a component that is
    null or not finite is what functions.vectors makes of it.
    """
    measure, _ = V.metric(metric)
    size = queries.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    plain = lambda c: F.coalesce((F.size(c) == size) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))
    blocks = bounds.query_blocks(queries.where(plain("q")), SCAN_QUERIES)
    asked = sum(len(b.value[0]) for b in blocks)
    tasks = spread(vectors.count() * asked, len(blocks))

    def work(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(a, SCAN_ROWS)
                v, rows = stack(batch.column("embedding")).astype(np.float64), batch.column("vec_id").to_numpy(zero_copy_only=False)
                step = max(1, bounds.PAIR_ROWS // len(v))
                for i in range(0, len(ids), step):
                    d = rounded(v, q[i : i + step], metric, digits)
                    names = pa.array(np.tile(rows, len(d)), pa.int64(), from_pandas=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + step], len(v))), names, pa.array(d.ravel())], names=["query_id", "vec_id", "distance"])

    dealt = vectors.where(plain("embedding")).select("vec_id", "embedding")
    out = bounds.over_blocks(dealt.repartition(tasks) if tasks > 1 else dealt, blocks, work, "query_id bigint, vec_id bigint, distance double")
    for rows, few in ((vectors.where(~plain("embedding")), queries), (vectors.where(plain("embedding")), queries.where(~plain("q")))):
        for block in bounds.block_frames(few):
            odd = rows.join(F.broadcast(block)).select("query_id", "vec_id", (F.round(measure("embedding", "q"), digits) + F.lit(0.0)).alias("distance"))
            out = out.union(odd)
    return out


def long_lists(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", place: Sequence[str] = ("chunk_id", "offset"), digits: int | None = None) -> DataFrame:
    """query_id, the columns of place, distance, rank of the k nearest of each query, for k of any size; ties by place. Distances may be rounded at last.

    Lists of thousands are no summary that a task could hand on for merging. So the vectors, finite ones, are written to the shared folder in
    the order of place, and a task has some queries, reads all vectors and ranks them: no pair is shuffled. At a time it holds distances
    of HELD_PAIRS pairs, or of one query to all vectors if these are more.
    """
    V.metric(metric)
    spark = vectors.sparkSession
    path = f"{shared_dir(spark)}/orrery/{uuid.uuid4().hex}"
    vectors.select(*place, "embedding").sort(*place).write.option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path)
    total, kinds = written.count(), written.select(*place).dtypes
    tasks = spread(max(1, total) * queries.count(), 1)

    def pieces() -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path) if ":" in path else (pa.fs.LocalFileSystem(), path)
        for name in sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(root)) if f.path.endswith(".parquet")):
            with fs.open_input_file(name) as f:
                yield from pq.ParquetFile(f).iter_batches(SCAN_ROWS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.Table.from_batches(list(batches)) if total else None
        if asked is None or not asked.num_rows:
            return
        asked = asked.sort_by("query_id")  # rows of one id are one query
        ids, q = asked.column("query_id").to_numpy(), stack(asked.column("q"))
        size, i = max(1, HELD_PAIRS // total), 0
        while i < len(ids):
            j = int(np.searchsorted(ids, ids[min(i + size, len(ids)) - 1], side="right"))
            d, places, n = np.empty((j - i, total)), [], 0
            for batch in pieces():
                d[:, n : n + batch.num_rows] = pairwise(stack(batch.column("embedding")), q[i:j], metric)
                places.append(batch.select(list(place)))
                n += batch.num_rows
            known = pa.Table.from_batches(places).combine_chunks()
            while i < j:
                same = int(np.searchsorted(ids[:j], ids[i], side="right")) - i
                own = d[len(d) - (j - i) : len(d) - (j - i) + same].T.ravel()  # by place, then by row of the id
                order = np.argsort(own)
                if (own[order[1:]] == own[order[:-1]]).any():
                    order = np.argsort(own, kind="stable")
                for a in range(0, min(k, len(order)), bounds.PAIR_ROWS):
                    some = order[a : min(k, a + bounds.PAIR_ROWS)]
                    far = own[some] if digits is None else _half_up(own[some], digits)
                    at = known.take(pa.array(some // same)).combine_chunks()
                    columns = [pa.array(np.full(len(some), ids[i])), *(at.column(c).combine_chunks() for c in place), pa.array(far), pa.array(np.arange(a + 1, a + 1 + len(some)), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", *place, "distance", "rank"])
                i += same

    dealt = queries.select("query_id", "q").repartition(tasks, "query_id")
    return dealt.mapInArrow(work, f"query_id bigint, {', '.join(f'{c} {t}' for c, t in kinds)}, distance double, rank int")


def search_blocks(queries: DataFrame, k: int, limits: DataFrame | None = None) -> list:
    """Blocks of queries for scan_top_k; without limits (query_id, tau) nothing is ruled out beforehand."""
    none = queries.select("query_id", F.lit(float("inf")).alias("tau")).limit(0)
    return bounds.query_blocks(queries, max(1, min(SCAN_QUERIES, SCAN_HELD // max(1, k))), none if limits is None else limits)


def merge_top_k(lists: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query in partial lists, with rank from 1; ties go by chunk_id, then offset."""
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id", "offset")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def current_tau(results: DataFrame, k: int) -> DataFrame:
    """query_id, tau: the k-th distance held so far, infinity with fewer than k."""
    kept = merge_top_k(results, k)
    return kept.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("tau"))


def radius_search(vectors: DataFrame, queries: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """query_id, chunk_id, offset, distance of all vectors at a distance of at most radius. Vectors stay where they lie.

    The Euclidean radius is held against squared distances. vectors: chunk_id, offset, embedding.
    """
    V.metric(metric)

    def work(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, bounds.PAIR_ROWS // batch.num_rows)
            v = stack(batch.column("embedding"))
            for i in range(0, len(ids), step):
                d = pairwise(v, q[i : i + step], metric)
                row, at = np.nonzero(d <= radius)
                places = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + step][row]), batch.column("chunk_id").take(places), batch.column("offset").take(places), pa.array(d[row, at])], names=["query_id", "chunk_id", "offset", "distance"])

    return bounds.over_blocks(vectors.select("chunk_id", F.col("offset").cast("bigint").alias("offset"), "embedding"), queries, work, "query_id bigint, chunk_id string, offset bigint, distance double")
