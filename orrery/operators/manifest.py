"""Chunk summaries: count, centroid and radius of the vectors of each chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import schema
from orrery.functions import vectors as V
from orrery.operators.bounds import stack

#: Chunks whose partial sums a task holds before it hands them on.
HELD_CHUNKS = 4_096


def finite(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Without null vectors and those with a null, NaN or infinite component, which no distance can order."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~F.exists(F.col(column), bad))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[int, np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], names=["chunk_id", "n", "sums"])
        held.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        names, codes = np.unique(np.array(batch.column("chunk_id").to_pylist(), dtype=object), return_inverse=True)
        m = stack(batch.column("embedding")).astype(np.float64)
        sums = np.zeros((len(names), m.shape[1]))
        np.add.at(sums, codes, m)
        counts = np.bincount(codes, minlength=len(names))
        for name, n, s in zip(names, counts, sums):
            before = held.get(name)
            held[name] = (int(n), s) if before is None else (before[0] + int(n), before[1] + s)
        if len(held) > HELD_CHUNKS:
            yield flush()
    if held:
        yield flush()


def summarize(vectors: DataFrame) -> DataFrame:
    """The manifest, with chunk_id, of vectors (url, slice, chunk_id, embedding).

    Tasks add up what they hold of a chunk before anything is shuffled, so a chunk with many vectors does not
    weigh on one task. The radius is measured from the centroid as it is stored, in 32-bit floats.
    """
    good = finite(vectors)
    partial = good.select("chunk_id", "embedding").mapInArrow(_partial_sums, "chunk_id string, n bigint, sums array<double>")
    flat = partial.select("chunk_id", "n", F.posexplode("sums").alias("i", "s"))
    total = flat.groupBy("chunk_id", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    centroids = total.groupBy("chunk_id").agg(F.max("n").cast("int").alias("count"), F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).cast("float").alias("v")))).alias("c"))
    centroids = centroids.select("chunk_id", "count", F.transform("c", lambda x: x["v"]).alias("centroid"))
    far = good.join(centroids, "chunk_id").groupBy("chunk_id").agg(F.sqrt(F.max(V.l2_squared("embedding", "centroid"))).cast("float").alias("radius"), F.any_value("url").alias("url"), F.any_value("slice").alias("slice"))
    return centroids.join(far, "chunk_id").select("url", "slice", "count", "centroid", "radius", "chunk_id")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Write the manifest, in place of an older one. With no chunks the files still carry the schema."""
    names = [f.name for f in schema.MANIFEST.fields]
    manifest.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.MANIFEST.fields], *[c for c in manifest.columns if c not in (*names, "chunk_id")]).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A written manifest, extra columns included, with chunk_id. The fixed columns must have the types of the schema."""
    found = spark.read.parquet(path)
    types = dict(found.dtypes)
    for f in schema.MANIFEST.fields:
        if types.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"the manifest's column {f.name!r} must be {f.dataType.simpleString()}, not {types.get(f.name)}")
    return found.withColumn("chunk_id", V.chunk_id())


def chunk_grid(spark: SparkSession, shape: list[int], chunks: list[int], dims: list[str], url: str) -> DataFrame:
    """url, slice of every chunk over the given index axes, row-major by `ordinal`; edge chunks are clipped."""
    if not shape:
        raise ValueError("an array needs at least one index axis besides the embedding axis")
    counts = [-(-n // c) for n, c in zip(shape, chunks)]
    total = int(np.prod(counts, dtype=np.int64))
    grid = spark.range(total).withColumnRenamed("id", "ordinal")
    parts, after = [], total
    for dim, size, step, count in zip(dims, shape, chunks, counts):
        after //= max(1, count)
        at = F.floor(F.col("ordinal") / F.lit(after)) % F.lit(count) * F.lit(step)
        parts.append(F.struct(F.lit(dim).alias("dim"), at.cast("bigint").alias("start"), F.least(at + step, F.lit(size)).cast("bigint").alias("stop")))
    return grid.select("ordinal", F.lit(url).alias("url"), F.array(*parts).alias("slice"))
