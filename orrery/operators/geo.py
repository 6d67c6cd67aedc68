"""Areas of interest: which chunks touch an area, by their corners under an affine transform.

Touching counts as meeting. Areas may have holes and several parts; transforms may rotate or be singular.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
#: origin x, pixel width, row rotation, origin y, column rotation, pixel height
GeoTransform = tuple[float, float, float, float, float, float]
TRANSFORM_FIELDS = ("ox", "pw", "rr", "oy", "cr", "ph")


def parse_transform(value: str | Sequence[float]) -> GeoTransform:
    if isinstance(value, str):
        parts: list = value.split()
    elif isinstance(value, Sequence):
        parts = list(value)
    else:
        raise TypeError(f"a GeoTransform is text or a sequence, not {type(value).__name__}")
    if len(parts) != 6:
        raise ValueError(f"a GeoTransform has 6 numbers, not {len(parts)}")
    return tuple(float(x) for x in parts)  # type: ignore[return-value]


@dataclass(frozen=True)
class Area:
    """Polygons, lines and points, any of which a chunk may touch.

    parts: polygons, each an outer ring and its holes; rings are points without the closing one. paths: lines as
    points in order.
    """

    parts: tuple[tuple[tuple[Point, ...], tuple[tuple[Point, ...], ...]], ...] = ()
    paths: tuple[tuple[Point, ...], ...] = ()
    points: tuple[Point, ...] = ()

    @staticmethod
    def box(x0: float, y0: float, x1: float, y1: float) -> Area:
        return Area.polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])

    @staticmethod
    def polygon(outer: Sequence[Point], holes: Sequence[Sequence[Point]] = ()) -> Area:
        return Area(((_ring(outer), tuple(_ring(h) for h in holes)),))

    @staticmethod
    def union(areas: Sequence[Area]) -> Area:
        return Area(*(tuple(x for a in areas for x in getattr(a, name)) for name in ("parts", "paths", "points")))

    @staticmethod
    def of(kind: str, nested: Any) -> Area:
        """An area from the name of a geometry type, in any case, and its nested coordinates; those beyond x and y are ignored."""
        kind = kind.upper()
        if kind.startswith("MULTI"):
            return Area.union([Area.of(kind[5:], x) for x in nested])
        flat = lambda points: tuple((float(p[0]), float(p[1])) for p in points)
        if kind == "POINT":
            return Area(points=flat([nested])) if len(nested) else Area()
        if kind == "LINESTRING":
            return Area(paths=(flat(nested),)) if len(nested) else Area()
        if kind == "LINEARRING":
            return Area(paths=((*flat(nested), flat(nested)[0]),)) if len(nested) else Area()
        if kind == "POLYGON":
            return Area(((_ring(nested[0]), tuple(_ring(h) for h in nested[1:])),)) if len(nested) and len(nested[0]) else Area()
        raise ValueError(f"unknown geometry type {kind!r}")

    @staticmethod
    def wkt(text: str) -> Area:
        """An area from well-known text of any type; a leading SRID is ignored."""
        tokens = re.findall(r"[A-Za-z]+|[(),]|[^\s(),A-Za-z](?:[^\s(),]*)", re.sub(r"^\s*SRID=\d+;", "", text))
        area, rest = _read_wkt(tokens)
        if rest:
            raise ValueError(f"WKT goes on with {rest[0]!r}")
        return area

    @staticmethod
    def wkb(data: bytes) -> Area:
        """An area from well-known binary of any type, of either byte order, plain or extended."""
        area, end = _read_wkb(bytes(data), 0)
        if end != len(data):
            raise ValueError("WKB goes on behind the geometry")
        return area

    @staticmethod
    def mapping(value: Any) -> Area:
        """An area from a GeoJSON-like mapping, or an object that offers one as __geo_interface__."""
        found = getattr(value, "__geo_interface__", value)
        if not isinstance(found, Mapping) or "type" not in found:
            raise TypeError(f"an area of interest must be a geometry, not {type(value).__name__}")
        if found["type"] == "Feature":
            return Area.mapping(found["geometry"])
        if found["type"] in ("FeatureCollection", "GeometryCollection"):
            return Area.union([Area.mapping(x) for x in found.get("features", found.get("geometries", ()))])
        return Area.of(found["type"], found["coordinates"])

    @property
    def empty(self) -> bool:
        return not (self.points or any(self.paths) or any(outer for outer, _ in self.parts))

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        every = [*self.points, *(p for path in self.paths for p in path), *(p for outer, _ in self.parts for p in outer)]
        return min(x for x, _ in every), min(y for _, y in every), max(x for x, _ in every), max(y for _, y in every)

    def meets(self, corners: Sequence[Point]) -> bool:
        """Whether the (possibly flat) parallelogram of four corners in order touches the area."""
        own = list(zip(corners, [*corners[1:], corners[0]]))
        held = lambda p: _inside(p, tuple(corners)) or any(_cross(a, b, p, p) for a, b in own)
        for outer, holes in self.parts:
            rings = (outer, *holes)
            if any(_cross(a, b, c, d) for r in rings for a, b in zip(r, (*r[1:], r[0])) for c, d in own):
                return True
            if _inside(corners[0], outer) and not any(_inside(corners[0], h) for h in holes):
                return True
            if _inside(outer[0], tuple(corners)):
                return True
        for path in self.paths:
            if held(path[0]) or any(_cross(a, b, c, d) for a, b in zip(path, path[1:]) for c, d in own):
                return True
        return any(map(held, self.points))


_WKT_TYPES = ("POINT", "LINESTRING", "LINEARRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")


def _read_wkt(tokens: list[str]) -> tuple[Area, list[str]]:
    """The first geometry of the tokens, and the tokens behind it."""
    if not tokens or (kind := tokens[0].upper()) not in _WKT_TYPES:
        raise ValueError(f"no geometry type at {tokens[:1]}")
    at = 1
    while at < len(tokens) and tokens[at].upper() in ("Z", "M", "ZM"):
        at += 1
    if at < len(tokens) and tokens[at].upper() == "EMPTY":
        return Area(), tokens[at + 1 :]
    if at >= len(tokens) or tokens[at] != "(":
        raise ValueError("WKT lacks an opening bracket")
    if kind == "GEOMETRYCOLLECTION":
        found, rest = [], tokens[at:]
        while rest and rest[0] in "(,":
            one, rest = _read_wkt(rest[1:])
            found.append(one)
        if not rest or rest[0] != ")":
            raise ValueError("WKT lacks a closing bracket")
        return Area.union(found), rest[1:]
    nested, rest = _read_list(tokens[at:])
    if kind == "POINT":
        nested = nested[0]
    elif kind == "MULTIPOINT":  # its points may stand in brackets of their own
        nested = [p[0] if isinstance(p[0], list) else p for p in nested]
    return Area.of(kind, nested), rest


def _read_list(tokens: list[str]) -> tuple[list, list[str]]:
    """Nested lists of points from the bracket that the tokens begin with."""
    out: list[list] = [[]]
    numbers: list[float] = []
    for i, t in enumerate(tokens):
        if t in "),":
            if numbers:
                out[-1].append(numbers)
                numbers = []
            if t == ")":
                done = out.pop()
                if len(out) == 1:
                    return done, tokens[i + 1 :]
                out[-1].append(done)
        elif t == "(":
            out.append([])
        elif t.upper() == "EMPTY":
            out[-1].append([])
        else:
            numbers.append(float(t))
    raise ValueError("WKT lacks a closing bracket")


def _read_wkb(data: bytes, at: int) -> tuple[Area, int]:
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4  # a reference system
    kind = code & 0x0FFFFFFF
    size = {0: size, 1: 3, 2: 3, 3: 4}[kind // 1000]
    kind %= 1000

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def points(n: int) -> list[tuple[float, ...]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * size}d", data, at)
        at += 8 * n * size
        return [flat[i : i + size] for i in range(0, len(flat), size)]

    if kind == 1:
        p = points(1)[0]
        return Area() if p[0] != p[0] else Area.of("POINT", p), at
    if kind == 2:
        return Area.of("LINESTRING", points(count())), at
    if kind == 3:
        return Area.of("POLYGON", [points(count()) for _ in range(count())]), at
    if kind in (4, 5, 6, 7):
        found = []
        for _ in range(count()):
            one, at = _read_wkb(data, at)
            found.append(one)
        return Area.union(found), at
    raise ValueError(f"unknown geometry code {kind}")


def _ring(points: Sequence[Point]) -> tuple[Point, ...]:
    out = tuple((float(x), float(y)) for x, y in points)
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a: Point, b: Point, c: Point) -> bool:
    return min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])


def _cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two closed segments share a point."""
    s, t, u, v = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if ((s > 0 > t) or (s < 0 < t)) and ((u > 0 > v) or (u < 0 < v)):
        return True
    return (s == 0 and _on(a, b, c)) or (t == 0 and _on(a, b, d)) or (u == 0 and _on(c, d, a)) or (v == 0 and _on(c, d, b))


def _inside(p: Point, ring: tuple[Point, ...]) -> bool:
    """Whether a point lies within a ring, by the crossings of a ray. Points on the ring are found by _cross before."""
    odd = False
    for a, b in zip(ring, (*ring[1:], ring[0])):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def validated(area: Any) -> Area:
    """An Area, or any object with a __geo_interface__, as a non-empty Area."""
    if not isinstance(area, Area):
        area = Area.mapping(area)
    if area.empty:
        raise ValueError("the area of interest is empty")
    return area


def interval(slice_: Column, dim: str) -> Column:
    """start and stop of a dimension of a slice; an error if the chunk lacks it."""
    found = F.get(F.filter(slice_, lambda p: p["dim"] == dim), 0)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"KeyError: the chunk has no dimension {dim!r}: "), F.to_json(slice_)))).otherwise(found)


def to_world(x: Column, y: Column) -> tuple[Column, Column]:
    """World coordinates of a pixel corner, by the columns of its transform."""
    t = {n: F.col(n) for n in TRANSFORM_FIELDS}
    return t["ox"] + x * t["pw"] + y * t["rr"], t["oy"] + x * t["cr"] + y * t["ph"]


def with_corners(manifest: DataFrame, transforms: DataFrame) -> DataFrame:
    """manifest with corners, an array of four (x, y) in world coordinates. transforms: url and the six numbers."""
    x, y = interval(F.col("slice"), "x"), interval(F.col("slice"), "y")
    joined = manifest.withColumn("_x", x).withColumn("_y", y).join(transforms, "url")
    at = [("start", "start"), ("stop", "start"), ("stop", "stop"), ("start", "stop")]
    corners = [F.struct(*(c.cast("double").alias(n) for c, n in zip(to_world(F.col(f"_x.{a}"), F.col(f"_y.{b}")), "xy"))) for a, b in at]
    return joined.withColumn("corners", F.array(*corners)).drop("_x", "_y", *TRANSFORM_FIELDS)


def filter_area(manifest: DataFrame, transforms: DataFrame, area: Area) -> DataFrame:
    """The chunks that touch the area. Their bounding boxes are compared natively before the exact test."""
    area = validated(area)
    placed = with_corners(manifest, transforms)
    x0, y0, x1, y1 = area.bounds
    xs, ys = F.transform("corners", lambda c: c["x"]), F.transform("corners", lambda c: c["y"])
    near = placed.where((F.array_min(xs) <= x1) & (F.array_max(xs) >= x0) & (F.array_min(ys) <= y1) & (F.array_max(ys) >= y0))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [area.meets([(c["x"], c["y"]) for c in four]) for four in batch.column("corners").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return near.mapInArrow(exact, near.schema).drop("corners")
