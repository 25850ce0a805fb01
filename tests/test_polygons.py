"""Polygons as edge tables against plain Python: areas within boxes, unions, validity, footprints."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import polygons as P

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PARTS = "array<array<array<struct<x:double,y:double>>>>"


def ngon(x, y, r, n, turn=0.0, inner=None):
    """Corners of a convex polygon, or of a star with an inner radius."""
    return [(x + (r if inner is None or k % 2 == 0 else inner) * math.cos(turn + 2 * math.pi * k / n), y + (r if inner is None or k % 2 == 0 else inner) * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def crossings(shape, x):
    """Heights at which the rings of a shape (a list of polygons) cross a line of one x, ascending."""
    out = []
    for ring in (r for part in shape for r in part):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ax > x) != (bx > x):
                out.append(ay + (by - ay) * (x - ax) / (bx - ax))
    return sorted(out)


def covered(shapes, box):
    """Area of the union within a box, slab by slab."""
    x0, y0, x1, y1 = map(float, box)
    exact = [[[[(float(x), float(y)) for x, y in ring] for ring in part] for part in shape] for shape in shapes]
    edges = [e for s in exact for part in s for ring in part for e in zip(ring, ring[1:] + ring[:1], strict=True)] + [((x0, y), (x1, y)) for y in (y0, y1)]
    places = {x0, x1} | {p[0] for e in edges for p in e}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            t = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if t:
                places.add(a[0] + (b[0] - a[0]) * ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / t)
    places = sorted(p for p in places if x0 <= p <= x1)
    total = 0.0
    for a, b in zip(places, places[1:], strict=False):
        spans = []
        for s in exact:
            ys = [min(max(y, y0), y1) for y in crossings(s, (a + b) / 2)]
            spans += list(zip(ys[::2], ys[1::2], strict=True))
        top = y0
        for low, high in sorted(spans):
            total += (b - a) * max(high - max(low, top), 0)
            top = max(top, high)
    return total


def as_parts(shape):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in shape]


def shapes_of(spark, shapes):
    return spark.createDataFrame([(i, as_parts(s)) for i, s in enumerate(shapes)], f"id long, parts {PARTS}")


@pytest.fixture(scope="module")
def many():
    rng = random.Random(2)
    out = []
    for _ in range(40):
        x, y, r = rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.2, 3)
        ring = ngon(x, y, r, rng.choice([3, 4, 8]), rng.random()) if rng.random() < 0.5 else ngon(x, y, r, 10, rng.random(), r / 3)
        if rng.random() < 0.5:
            ring = ring[::-1]
        part = [ring + ring[:1] * (rng.random() < 0.5)]
        if rng.random() < 0.4:
            part.append(ngon(x, y, r / 8, 5, rng.random()))
        out.append([part] + ([[ngon(x + 20, y, 1, 4)]] if rng.random() < 0.2 else []))
    return [*out, [[square(1, 1, 4, 4)]], [[square(4, 1, 6, 4)]], [[square(1, 1, 4, 4)]]]


def test_areas_within_boxes(spark, many):
    boxes = [(2.0, 2.0, 6.0, 5.0), (0.0, 0.0, 30.0, 30.0), (4.0, 4.0, 4.5, 4.25), (-9.0, -9.0, -8.0, -8.0)]
    edges = P.edge_rows(shapes_of(spark, many), "parts", "id")
    pairs = spark.createDataFrame([(b, box, i) for b, box in enumerate(boxes) for i in range(len(many))], f"b int, box {BOX}, id long")
    got = {(r["b"], r["id"]): r["area"] for r in P.areas_within(pairs, edges, "id", "box", ["b", "id"]).collect()}
    for b, box in enumerate(boxes):
        for i, s in enumerate(many):
            assert got.get((b, i), 0.0) == pytest.approx(covered([s], box), abs=1e-9)


@pytest.mark.parametrize("per, most", [(16, 1024), (2, 7)])
def test_areas_of_unions(spark, many, monkeypatch, per, most):
    monkeypatch.setattr(P, "STRIP_EDGES", per)
    monkeypatch.setattr(P, "STRIPS", most)
    boxes = [(0.0, 0.0, 10.0, 10.0), (2.5, 1.0, 4.0, 9.0), (1.0, 1.0, 6.0, 4.0), (50.0, 50.0, 51.0, 51.0)]
    edges = P.edge_rows(shapes_of(spark, many), "parts", "id").crossJoin(spark.createDataFrame([(b, box) for b, box in enumerate(boxes)], f"b int, box {BOX}"))
    got = {r["b"]: r["covered"] for r in P.union_areas(edges, "b", "id", "box").collect()}
    for b, box in enumerate(boxes):
        assert got.get(b, 0.0) == pytest.approx(covered(many, box), rel=1e-9, abs=1e-9)


def test_facts_of_shapes(spark):
    ring, hole = square(10.0, 20.0, 14.0, 22.0), square(10.5, 20.5, 11.5, 21.5)
    rows = {r["id"]: r for r in P.shape_facts(P.edge_rows(shapes_of(spark, [[[ring, hole]], [[ring[::-1], hole]], [[[(1.0, 1.0), (3.0, 1.0)]]], [[ring], [square(30.0, 20.0, 31.0, 22.0)]]]), "parts", "id"), "id").collect()}
    for i in (0, 1):
        assert rows[i]["area"] == pytest.approx(7) and rows[i]["lon"] == pytest.approx((8 * 12 - 11) / 7) and rows[i]["lat"] == pytest.approx(21)
        assert tuple(rows[i]["box"]) == (10, 20, 14, 22)
    assert (rows[2]["area"], rows[2]["lat"], rows[2]["lon"]) == (0, 1, 2)
    assert rows[3]["area"] == pytest.approx(10) and rows[3]["lon"] == pytest.approx((8 * 12 + 2 * 30.5) / 10)


OUTER = square(0.0, 0.0, 10.0, 10.0)
VALIDITY = {
    "square": ([[OUTER]], set()),
    "closed, turned round": ([[[*OUTER[::-1], OUTER[-1]]]], set()),
    "repeated corner": ([[[OUTER[0], *OUTER]]], set()),
    "hole": ([[OUTER, square(2.0, 2.0, 3.0, 3.0)]], set()),
    "hole that touches in a point": ([[OUTER, [(0.0, 5.0), (2.0, 4.0), (2.0, 6.0)]]], set()),
    "corner of a hole at a corner": ([[OUTER, [(0.0, 0.0), (2.0, 1.0), (1.0, 2.0)]]], set()),
    "holes that touch each other": ([[OUTER, square(1.0, 1.0, 2.0, 2.0), square(2.0, 2.0, 3.0, 3.0)]], set()),
    "two polygons that touch in a corner": ([[square(0.0, 0.0, 1.0, 1.0)], [square(1.0, 1.0, 2.0, 2.0)]], set()),
    "a polygon in a hole": ([[OUTER, square(2.0, 2.0, 8.0, 8.0)], [square(3.0, 3.0, 4.0, 4.0)]], set()),
    "star": ([[ngon(0, 0, 5, 40, 0.1, 2)]], set()),
    "two corners": ([[[(0.0, 0.0), (1.0, 1.0)]]], {"ring"}),
    "one of two parts has no area": ([[OUTER], [[(20.0, 0.0), (21.0, 0.0), (22.0, 0.0)]]], {"ring", "crossing"}),
    "bow tie": ([[[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 3.0)]]], {"crossing"}),
    "spike": ([[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 7.0), (4.0, 4.0), (0.0, 4.0)]]], {"crossing"}),
    "ring through its own corner": ([[[(0.0, 0.0), (4.0, 0.0), (2.0, 2.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0)]]], {"crossing"}),
    "hole along an edge": ([[OUTER, square(0.0, 2.0, 3.0, 3.0)]], {"crossing"}),
    "hole across": ([[OUTER, square(-1.0, 2.0, 3.0, 3.0)]], {"crossing"}),
    "hole that touches twice": ([[OUTER, [(0.0, 5.0), (5.0, 0.0), (4.0, 4.0)]]], {"touching"}),
    "ring of holes": ([[OUTER, [(0.0, 5.0), (2.0, 4.0), (2.0, 6.0)], [(2.0, 4.0), (5.0, 0.0), (5.0, 3.0)]]], {"touching"}),
    "hole outside": ([[OUTER, square(12.0, 2.0, 13.0, 3.0)]], {"nesting"}),
    "hole around": ([[square(2.0, 2.0, 3.0, 3.0), OUTER]], {"nesting"}),
    "hole in a hole": ([[OUTER, square(2.0, 2.0, 8.0, 8.0), square(3.0, 3.0, 4.0, 4.0)]], {"nesting"}),
    "polygon in a polygon": ([[OUTER], [square(2.0, 2.0, 3.0, 3.0)]], {"nesting"}),
    "polygon in a polygon, from its corner": ([[OUTER], [[(0.0, 0.0), (3.0, 1.0), (1.0, 3.0)]]], {"nesting"}),
    "two polygons along an edge": ([[square(0.0, 0.0, 1.0, 1.0)], [square(1.0, 0.0, 2.0, 1.0)]], {"crossing"}),
    "the same polygon twice": ([[OUTER], [OUTER]], {"crossing"}),
}


def test_invalid_shapes(spark):
    names = list(VALIDITY)
    got = {n: set() for n in names}
    for r in P.invalid_shapes(P.edge_rows(shapes_of(spark, [VALIDITY[n][0] for n in names]), "parts", "id"), "id").collect():
        assert r["reason"] not in got[names[r["id"]]]
        got[names[r["id"]]].add(r["reason"])
    for n in names:
        want = VALIDITY[n][1]
        assert bool(got[n]) == bool(want) and want <= got[n], (n, got[n])


def test_random_rings_against_all_pairs(spark):
    """Rings of random corners: valid exactly if no two edges that don't follow each other meet."""
    rng = random.Random(9)
    rings = [[(rng.randrange(12) / 1.0, rng.randrange(12) / 1.0) for _ in range(rng.choice([3, 4, 5, 6]))] for _ in range(150)] + [ngon(0, 0, 1, 300, 0.3, 0.5)]

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def on(p, a, b):
        return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])

    def valid(ring):
        ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
        n = len(ring)
        if n < 3 or sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) == 0:
            return False
        edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
        for i in range(n):
            for j in range(i):
                (a, b), (c, d) = edges[i], edges[j]
                shared = {a, b} & {c, d} if i - j in (1, n - 1) else set()
                met = {p for p, s in ((a, (c, d)), (b, (c, d)), (c, (a, b)), (d, (a, b))) if on(p, *s)}
                if met - shared or len(met) > 1 or turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                    return False
        return True

    bad = {r["id"] for r in P.invalid_shapes(P.edge_rows(shapes_of(spark, [[[r]] for r in rings]), "parts", "id"), "id").collect()}
    assert bad == {i for i, r in enumerate(rings) if not valid(r)}


def test_footprints(spark):
    """An L with a hole, two squares that share an edge, overlapping shapes, and boxes in, on, across and off them."""
    ell = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (4.0, 4.0), (4.0, 10.0), (0.0, 10.0)]
    shapes = [[[ell, square(1.0, 1.0, 2.0, 2.0)]], [[square(20.0, 0.0, 22.0, 3.0)], [square(30.0, 0.0, 31.0, 1.0)]], [[square(22.0, 0.0, 24.0, 3.0)]], [[ngon(22.0, 1.0, 0.5, 6)]]]
    boxes = [(0.0, 0.0, 10.0, 4.0), (0.0, 2.0, 4.0, 10.0), (2.0, 2.0, 4.0, 4.0), (3.0, 3.0, 5.0, 5.0), (5.0, 5.0, 6.0, 6.0), (4.0, 4.0, 5.0, 5.0), (1.2, 1.2, 1.8, 1.8), (1.0, 1.0, 2.0, 2.0), (0.5, 0.5, 0.9, 0.9), (21.0, 0.5, 23.0, 2.0), (21.5, 0.9, 22.5, 1.1), (21.0, 0.5, 24.5, 2.0), (24.0, 3.0, 25.0, 4.0), (24.1, 3.0, 25.0, 4.0), (-50.0, -50.0, 50.0, 50.0), (30.2, 0.2, 30.4, 0.4), (10.0, 1.0, 12.0, 2.0)]
    rng = random.Random(3)
    boxes += [(x, y, x + rng.uniform(0.1, 3), y + rng.uniform(0.1, 3)) for x, y in ((rng.uniform(-1, 25), rng.uniform(-1, 11)) for _ in range(80))]
    foot = shapes_of(spark, shapes).select("parts")
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(boxes)], f"k int, box {BOX}")
    got = {r["k"]: (r["within"], r["meets"]) for r in P.footprint_test(frame, "k", "box", foot).collect()}

    def meets(box):
        x0, y0, x1, y1 = box
        if covered(shapes, box) > 0:
            return True
        for ring in (r for s in shapes for part in s for r in part):  # shared boundaries: all sides of these shapes are axis-parallel but the hexagon's
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if min(ax, bx) <= x1 and max(ax, bx) >= x0 and min(ay, by) <= y1 and max(ay, by) >= y0 and (ax == bx or ay == by):
                    return True
        return False

    for i, b in enumerate(boxes):
        area = (b[2] - b[0]) * (b[3] - b[1])
        assert got[i] == (covered(shapes, b) >= area * (1 - 1e-9), meets(b)), (b, got[i])
    assert P.footprint_test(frame, "k", "box", foot.limit(0)).where(F.col("within") | F.col("meets")).count() == 0
    assert P.footprint_test(frame.limit(0), "k", "box", foot).count() == 0
