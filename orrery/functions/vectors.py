"""Vector functions as column expressions. Sums run in double; float inputs are widened first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spacing of 32-bit floats at 1, below which a norm counts as zero.
FLOAT_EPS = 1.1920929e-07


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _wide(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def same_size(a: Column | str, b: Column | str) -> Column:
    """Null if the sizes agree, else an error; padded sums would be wrong without notice."""
    return F.assert_true(F.size(_col(a)) == F.size(_col(b)), F.lit("vectors differ in dimension"))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """The squared Euclidean distance; never rooted."""
    return _total(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_wide(a), lambda x: x * x)))


def normalize(a: Column | str) -> Column:
    """a over its norm; a vector of (nearly) zero length keeps its direction but is not blown up."""
    return F.transform(_wide(a), lambda x: x / F.greatest(norm(a), F.lit(FLOAT_EPS)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 minus the cosine of the angle. Rounding may carry it slightly below zero."""
    return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(FLOAT_EPS)) * F.greatest(norm(b), F.lit(FLOAT_EPS)))


def l2_lower_bound(query: Column | str, centroid: Column | str, radius: Column | str) -> Column:
    """The least squared distance of the query to anything in the ball; zero inside it."""
    gap = F.greatest(F.lit(0.0), F.sqrt(l2_squared(query, centroid)) - _col(radius).cast("double"))
    return gap * gap


def l2_upper_bound(query: Column | str, centroid: Column | str, radius: Column | str) -> Column:
    reach = F.sqrt(l2_squared(query, centroid)) + _col(radius).cast("double")
    return reach * reach


def cosine_lower_bound(query: Column | str, centroid: Column | str, radius: Column | str) -> Column:
    """Cosine distance to the centroid less the radius. No valid bound, so nothing is pruned by it."""
    return F.greatest(F.lit(0.0), cosine_distance(query, centroid) - _col(radius).cast("double"))


def chunk_id(url: Column | str = "url", slice_: Column | str = "slice") -> Column:
    """url#dim=start:stop/dim=start:stop of a chunk."""
    parts = F.transform(_col(slice_), lambda p: F.concat(p["dim"], F.lit("="), p["start"].cast("string"), F.lit(":"), p["stop"].cast("string")))
    return F.concat(_col(url), F.lit("#"), F.array_join(parts, "/"))


#: Distance of two vectors, and lower bound of a ball, for each metric.
METRICS: dict[str, tuple[Callable[..., Column], Callable[..., Column]]] = {
    "euclidean": (l2_squared, l2_lower_bound),
    "cosine": (cosine_distance, cosine_lower_bound),
}


def metric(name: str) -> tuple[Callable[..., Column], Callable[..., Column]]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {sorted(METRICS)}")
    return METRICS[name]
