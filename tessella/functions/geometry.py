"""Planar geometry in columns: boxes, rings clipped to boxes, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_DEGREE = 111_320.0


def let(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it; an expression that is written out in several places would grow with every nesting."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def box_around(lat: Column, lon: Column, halfwidth: float, unit: str = "degrees", scale: float = 1.0) -> Column:
    """struct(x0, y0, x1, y1) around a centre."""
    h = halfwidth * scale
    if unit == "degrees":
        dx = dy = F.lit(h)
    elif unit == "meters":
        dy = F.lit(h / METERS_PER_DEGREE)
        dx = F.lit(h / METERS_PER_DEGREE) / F.cos(F.radians(lat))
    else:
        raise ValueError(f"unknown unit {unit}")
    return F.struct((lon - dx).alias("x0"), (lat - dy).alias("y0"), (lon + dx).alias("x1"), (lat + dy).alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two boxes share; 0 where they touch or are apart."""
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def covers(outer: Column, inner: Column) -> Column:
    """Boundaries count as inside."""
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def intersects(a: Column, b: Column) -> Column:
    """Boundaries that touch count."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def footprint_keeps(footprint: Column, box: Column, predicate: str) -> Column:
    """covers, contains or intersects; a null footprint keeps everything."""
    fit = intersects(footprint, box) if predicate == "intersects" else covers(footprint, box)
    return footprint.isNull() | fit


def cell(x: Column, spacing: float, rounding: str = "floor") -> Column:
    """Grid cell of a coordinate: by floor, or by truncation toward 0."""
    return F.floor(x / spacing).cast("long") if rounding == "floor" else (x / spacing).cast("long")


def tile_box(box: Column, tile: Column, grid: int = 10) -> Column:
    """Box of tile row * grid + column; row 0 is the northern edge."""
    row, col = F.floor(tile / grid), tile % grid
    w, h = (box["x1"] - box["x0"]) / grid, (box["y1"] - box["y0"]) / grid
    return F.struct((box["x0"] + col * w).alias("x0"), (box["y1"] - (row + 1) * h).alias("y0"), (box["x0"] + (col + 1) * w).alias("x1"), (box["y1"] - row * h).alias("y1"))


def _half_plane(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """The part of a ring on one side of an axis-parallel line (Sutherland-Hodgman)."""
    other = "y" if axis == "x" else "x"
    n = F.size(ring)

    def inside(p: Column) -> Column:
        return p[axis] >= bound if above else p[axis] <= bound

    def step(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        t = (bound - q[axis]) / (p[axis] - q[axis])
        cut = (q[other] + t * (p[other] - q[other])).alias(other)
        on = bound.alias(axis)
        meet = F.struct(on, cut) if axis == "x" else F.struct(cut, on)
        same = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        none = F.expr("cast(array() as array<struct<x:double,y:double>>)")
        return F.when(inside(p) & inside(q), F.array(same)).when(inside(p), F.array(meet, same)).when(inside(q), F.array(meet)).otherwise(none)

    return F.flatten(F.transform(ring, step))


def _cut(axis: str, bound: Column, above: bool):
    return lambda ring: _half_plane(ring, axis, bound, above)


def clip_ring(ring: Column, box: Column) -> Column:
    """A ring (array<struct<x,y>>, not closed) clipped to a box."""
    for axis, name, above in (("x", "x0", True), ("x", "x1", False), ("y", "y0", True), ("y", "y1", False)):
        ring = let(ring, _cut(axis, box[name], above))
    return ring


def _signed_parts(ring: Column) -> Column:
    """array<struct<x,y,a>>: for each edge the cross product a, and a times the sums of its ends' coordinates."""
    n = F.size(ring)

    def part(p: Column, i: Column) -> Column:
        def edge(q: Column) -> Column:
            a = p["x"] * q["y"] - q["x"] * p["y"]
            return F.struct(((p["x"] + q["x"]) * a).alias("x"), ((p["y"] + q["y"]) * a).alias("y"), a.alias("a"))

        return let(F.get(ring, F.when(i == n - 1, 0).otherwise(i + 1)), edge)

    return F.transform(ring, part)


def ring_area(ring: Column) -> Column:
    """Shoelace area, never negative."""
    total = lambda r: F.abs(F.aggregate(_signed_parts(r), F.lit(0.0), lambda s, e: s + e["a"])) / 2
    return let(ring, lambda r: F.when(F.size(r) >= 3, total(r)).otherwise(F.lit(0.0)))


def polygon_overlap(rings: Column, box: Column) -> Column:
    """Area of a polygon within a box: the first ring less the others, which are holes."""
    areas = F.transform(rings, lambda r: ring_area(clip_ring(r, box)))
    return let(areas, lambda a: F.greatest(F.coalesce(F.get(a, F.lit(0)), F.lit(0.0)) * 2 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def multipolygon_overlap(parts: Column, box: Column) -> Column:
    """Area of a multipolygon (array of polygons, each an array of rings as in polygon_overlap) within a box."""
    return F.aggregate(F.transform(parts, lambda rings: polygon_overlap(rings, box)), F.lit(0.0), lambda s, x: s + x)


def multipolygon_centroid(parts: Column) -> Column:
    """struct(lat, lon): the centroids of the outer rings, weighted by their areas; that of the first where all areas are 0."""
    each = F.transform(parts, lambda rings: let(F.get(rings, F.lit(0)), lambda r: F.struct(ring_centroid(r).alias("c"), ring_area(r).alias("a"))))

    def mean(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x["a"])
        of = lambda k: F.aggregate(e, F.lit(0.0), lambda s, x: s + x["c"][k] * x["a"]) / total
        return F.when((total > 0) & (F.size(e) > 1), F.struct(of("lat").alias("lat"), of("lon").alias("lon"))).otherwise(F.get(e, F.lit(0))["c"])

    return let(each, mean)


def ring_centroid(ring: Column) -> Column:
    """struct(lat, lon) of the area's centroid; the mean of the corners where the area is 0."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a"))
    sums = F.aggregate(_signed_parts(ring), zero, lambda t, e: F.struct((t["x"] + e["x"]).alias("x"), (t["y"] + e["y"]).alias("y"), (t["a"] + e["a"]).alias("a")))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / F.size(ring)
    return let(sums, lambda s: F.when(s["a"] != 0, F.struct((s["y"] / (3 * s["a"])).alias("lat"), (s["x"] / (3 * s["a"])).alias("lon"))).otherwise(F.struct(mean("y").alias("lat"), mean("x").alias("lon"))))
