import pytest

from orrery.operators import geo
from orrery.operators.geo import Area


def test_transform_parsing():
    assert geo.parse_transform("0 1 0 4 0 -1") == (0, 1, 0, 4, 0, -1)
    assert geo.parse_transform([0, 1, 0, 4, 0, -1])[3] == 4
    with pytest.raises(ValueError):
        geo.parse_transform("0 1 0")
    with pytest.raises(TypeError):
        geo.parse_transform(5)


def corners(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.mark.parametrize(
    ("area", "rect", "meets"),
    [
        (Area.box(0, 0, 1, 1), (2, 2, 3, 3), False),
        (Area.box(0, 0, 1, 1), (1, 1, 2, 2), True),  # a shared corner
        (Area.box(0, 0, 1, 1), (1, 0, 2, 1), True),  # a shared edge
        (Area.box(0, 0, 9, 9), (2, 2, 3, 3), True),  # chunk inside
        (Area.box(2, 2, 3, 3), (0, 0, 9, 9), True),  # area inside
        (Area.polygon([(0, 0), (10, 0), (10, 10), (0, 10)], [[(2, 2), (8, 2), (8, 8), (2, 8)]]), (3, 3, 4, 4), False),  # in the hole
        (Area.polygon([(0, 0), (10, 0), (10, 10), (0, 10)], [[(2, 2), (8, 2), (8, 8), (2, 8)]]), (7, 7, 9, 9), True),
        (Area.wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"), (5.5, 5.5, 7, 7), True),
        (Area.wkt("POLYGON ((0 0, 4 0, 0 4, 0 0))"), (3, 3, 4, 4), False),
        (Area.box(0, 0, 1, 1), (0.5, -1, 0.5, 5), True),  # a flat chunk
    ],
)
def test_meets(area, rect, meets):
    assert area.meets(corners(*rect)) is meets


def test_validation():
    with pytest.raises(TypeError):
        geo.validated("POLYGON")
    with pytest.raises(ValueError):
        geo.validated(Area.wkt("POLYGON EMPTY"))


def test_rotated_transform(spark):
    chunk = spark.sql("SELECT 'u' AS url, array(named_struct('dim','y','start',0L,'stop',2L), named_struct('dim','x','start',0L,'stop',2L)) AS slice")
    turned = spark.createDataFrame([("u", 0.0, 0.0, 1.0, 0.0, 1.0, 0.0)], "url string, ox double, pw double, rr double, oy double, cr double, ph double")
    got = geo.with_corners(chunk, turned).first()["corners"]
    assert [(c["x"], c["y"]) for c in got] == [(0, 0), (0, 2), (2, 2), (2, 0)]
    assert geo.filter_area(chunk, turned, Area.box(1.5, 1.5, 3, 3)).count() == 1
    assert geo.filter_area(chunk, turned, Area.box(2.5, 2.5, 3, 3)).count() == 0


def test_missing_axis(spark):
    chunk = spark.sql("SELECT 'u' AS url, array(named_struct('dim','y','start',0L,'stop',2L)) AS slice")
    flat = spark.createDataFrame([("u", 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "url string, ox double, pw double, rr double, oy double, cr double, ph double")
    with pytest.raises(Exception, match="KeyError"):
        geo.filter_area(chunk, flat, Area.box(0, 0, 1, 1)).collect()


@pytest.mark.parametrize(
    ("area", "rect", "meets"),
    [
        (Area.wkt("POINT (1 1)"), (0, 0, 2, 2), True),
        (Area.wkt("POINT Z (2 2 7)"), (0, 0, 2, 2), True),  # on a corner
        (Area.wkt("POINT (3 1)"), (0, 0, 2, 2), False),
        (Area.wkt("MULTIPOINT ((5 5), (1 1))"), (0, 0, 2, 2), True),
        (Area.wkt("MULTIPOINT (5 5, 6 6)"), (0, 0, 2, 2), False),
        (Area.wkt("LINESTRING (-1 1, 3 1)"), (0, 0, 2, 2), True),  # through it
        (Area.wkt("LINESTRING (0.5 0.5, 1 1)"), (0, 0, 2, 2), True),  # within it
        (Area.wkt("LINESTRING (3 0, 3 5)"), (0, 0, 2, 2), False),
        (Area.wkt("SRID=4326;MULTILINESTRING ((9 9, 8 8), (2 0, 2 5))"), (0, 0, 2, 2), True),  # along an edge
        (Area.wkt("GEOMETRYCOLLECTION (POINT (9 9), POLYGON ((1 1, 3 1, 3 3, 1 1)))"), (0, 0, 2, 2), True),
        (Area.wkt("GEOMETRYCOLLECTION (POINT (9 9), LINESTRING EMPTY)"), (0, 0, 2, 2), False),
    ],
)
def test_every_type_of_geometry(area, rect, meets):
    assert area.meets(corners(*rect)) is meets


def test_geometry_sources():
    import struct

    class Shape:
        __geo_interface__ = {"type": "Polygon", "coordinates": [[(0, 0), (4, 0), (0, 4), (0, 0)], [(1, 1), (2, 1), (1, 2), (1, 1)]]}

    want = Area.wkt("POLYGON ((0 0, 4 0, 0 4, 0 0), (1 1, 2 1, 1 2, 1 1))")
    assert geo.validated(Shape()) == want
    rings = [[(0, 0), (4, 0), (0, 4), (0, 0)], [(1, 1), (2, 1), (1, 2), (1, 1)]]
    body = struct.pack("<I", 2) + b"".join(struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
    one = b"\x01" + struct.pack("<I", 3) + body
    assert Area.wkb(one) == want
    assert Area.wkb(b"\x01" + struct.pack("<I", 3 | 0x20000000) + struct.pack("<I", 4326) + body) == want
    assert Area.wkb(b"\x01" + struct.pack("<II", 6, 1) + one) == want
    assert Area.wkb(b"\x00" + struct.pack(">I", 1001) + struct.pack(">3d", 1, 2, 3)) == Area.wkt("POINT (1 2)")
    assert Area.mapping({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]}) == Area.wkt("POINT (1 2)")
    for bad in ("CIRCLE (1 2)", "POINT 1 2", "POINT (1 2", "POINT (1 2) x"):
        with pytest.raises(ValueError):
            Area.wkt(bad)
    for empty in ("POINT EMPTY", "GEOMETRYCOLLECTION EMPTY", "MULTILINESTRING EMPTY"):
        with pytest.raises(ValueError):
            geo.validated(Area.wkt(empty))
