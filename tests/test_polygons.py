"""Polygons by tiles against counting all edges."""

import numpy as np
import pytest

from gridloom.operators.polygons import cut_at_date_line, inside


def ring(*points):
    return [(*map(float, a), *map(float, b)) for a, b in zip(points, [*points[1:], points[0]])]


def star(rng, x, y, r, n):
    turn, out = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1, n) * r
    return ring(*zip(x + out * np.cos(turn), y + out * np.sin(turn)))


def brute(points, edges):
    """Even and odd counts in the plane, with the polygons also a turn to the west and to the east."""
    hit = set()
    for k, px, py in points:
        n = 0
        for x1, y1, x2, y2 in edges:
            if (y1 > py) != (y2 > py):
                at = (x2 - x1) * (py - y1) / (y2 - y1) + x1
                n += sum(px < min(max(x1, x2), max(min(x1, x2), at)) + shift for shift in (-720, -360, 0, 360, 720))
        if n % 2:
            hit.add(k)
    return hit


EDGES, POINTS = "x1 double, y1 double, x2 double, y2 double", "point_id long, x double, y double"


@pytest.mark.parametrize("tile", [0.5, 1.0, 16.0])
def test_against_all_edges(spark, tile):
    """Stars with holes and islands over the date line and the zero meridian, vertices and points on tile corners, points in any frame."""
    rng = np.random.default_rng(5)
    edges = star(rng, 180, 10, 30, 40) + star(rng, 180, 10, 4, 9) + star(rng, 2, -40, 20, 25) + star(rng, 90, 45, 0.7, 12)
    edges += ring((-100, -10), (-90, -10), (-90, 0), (-95, 5), (-100, 0)) + ring((-97, -7), (-93, -7), (-93, -3), (-97, -3))
    points = [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 360, 1500), rng.uniform(-80, 80, 1500))]
    points += [(float(x), float(y)) for x in range(-104, -86) for y in range(-12, 8)] + [(180.0, 10.5), (-180.0, 20.0), (179.9, 9.0), (540.0, 12.0)]
    points += [(float(x), float(y)) for x, y in zip(rng.normal(90, 0.6, 200), rng.normal(45, 0.6, 200))]
    rows = [(k, *p) for k, p in enumerate(points)]
    got = {r.point_id for r in inside(spark.createDataFrame([*rows, (9999, None, 1.0)], POINTS), spark.createDataFrame(edges, EDGES), tile=tile).collect()}
    assert got == brute([(k, (x + 180) % 360 - 180, y) for k, x, y in rows], edges) and len(got) > 150


def test_frames(spark):
    """One polygon given from 170 to 190, from 170 to -170, and from -190 to -170."""
    points = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate((169, 171, 179, 180, -180, -179, -171, -169, 0))], POINTS)
    for west, east in ((170, 190), (170, -170), (-190, -170), (530, 550)):
        edges = spark.createDataFrame(ring((west, -5), (east, -5), (east, 5), (west, 5)), EDGES)
        assert {r.point_id for r in inside(points, edges).collect()} == {1, 2, 3, 4, 5, 6}


def test_poles_and_bounds(spark):
    """A box round the earth, a ring round the south pole, edges within bounds; no edges, no points, odd tiles."""
    points = spark.createDataFrame([(0, 0.0, -89.0), (1, 179.0, -70.0), (2, -180.0, -61.0), (3, 10.0, -59.0), (4, 10.0, 80.0)], POINTS)
    box = spark.createDataFrame(ring((-180, -90), (180, -90), (180, -60), (-180, -60)), EDGES)
    assert {r.point_id for r in inside(points, box).collect()} == {0, 1, 2}
    polar = spark.createDataFrame(ring((-120, -65), (0, -60), (120, -65)), EDGES)
    assert {r.point_id for r in inside(points, polar).collect()} == {0, 1}
    assert all(-180 <= v <= 180 for r in cut_at_date_line(polar).collect() for v in (r.x1, r.x2))
    assert inside(points, box.limit(0)).count() == 0 and inside(points.limit(0), box).count() == 0
    with pytest.raises(ValueError):
        inside(points, box, tile=0.3)
