"""Helpers shared by the text operators: reading tables, cutting lineage, batch slicing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.shared import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside go at the end, but for those it is asked to keep."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has a column of that name already, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The job's shuffle files go when it is done, so that a chain of jobs needs the disk of one. keep: the table
    outlives the innermost scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery/{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)  # snappy would take memory beside the heap
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once all that was made of it is written as well."""
    _delete(df.sparkSession, df._written)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches to at most `rows` rows, and about `size` bytes of `column` unless one row alone is larger."""
    for batch in batches:
        lengths = pyarrow.compute.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
        start, total = 0, 0
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and (i - start >= rows or total + n > size):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if lengths:
            yield batch.slice(start)


def release() -> None:
    """Hand freed memory back to the system: workers stay for later tasks, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library keeps what it keeps
        ctypes.CDLL(None).malloc_trim(0)


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow, with release() once it is through and its variables are gone."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run
