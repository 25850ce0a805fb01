"""Polygons as tables of edges: areas within boxes, unions, validity and footprints.

A polygon is an array of rings, the outer one first, a ring an array of corners struct<x,y>; a multipolygon is an array of polygons. Each edge is a row, so that a shape of any
size is many rows, and sums over edges replace clipped rings: the area of a polygon within a box is the sum of what lies between each edge and the lower side of the box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of edges that a strip of a union is made for, on average, and the most strips of one union.
STRIP_EDGES, STRIPS = 16, 1024
#: The most cells along a side of the grid in which a shape's edges are paired.
CELLS = 4096


def clean_ring(ring: Column) -> Column:
    """A ring without corners that repeat the one before, and without the last if it closes the ring."""
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])
    lone = F.filter(ring, lambda p, i: (i == 0) | ~same(p, F.get(ring, i - 1)))
    n = F.size(lone)
    return F.when((n > 1) & same(F.get(lone, F.lit(0)), F.get(lone, n - 1)), F.slice(lone, 1, F.greatest(n - 1, F.lit(1)))).otherwise(lone)


def edge_rows(shapes: DataFrame, parts: str, *keep: str) -> DataFrame:
    """keep, part, ring, i, n, ax, ay, bx, by, sign, ox, oy for every edge: its place in a ring of n corners, its ends, and 1 or -1 so that outer rings turn left and holes right.

    (ox, oy) is the first corner of the shape, for sums that don't lose digits. Repeated corners and the closing one are left out; a ring of no area has sign 0.
    """
    first = F.get(F.get(F.get(F.col(parts), F.lit(0)), F.lit(0)), F.lit(0))
    each = shapes.select(*keep, first["x"].alias("ox"), first["y"].alias("oy"), F.posexplode(parts).alias("part", "_rings"))
    each = each.select(*keep, "ox", "oy", "part", F.posexplode("_rings").alias("ring", "_ring")).withColumn("_ring", clean_ring(F.col("_ring")))
    each = each.where(F.size("_ring") > 0).withColumn("_next", F.concat(F.slice("_ring", 2, F.size("_ring")), F.slice("_ring", 1, 1)))
    each = each.withColumn("_edges", F.arrays_zip("_ring", "_next"))
    turn = F.aggregate("_edges", F.lit(0.0), lambda s, e: s + (e["_ring"]["x"] - F.col("ox")) * (e["_next"]["y"] - F.col("oy")) - (e["_next"]["x"] - F.col("ox")) * (e["_ring"]["y"] - F.col("oy")))
    each = each.select(*keep, "part", "ring", F.size("_ring").alias("n"), (F.signum(turn) * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)).alias("sign"), "ox", "oy", F.posexplode("_edges").alias("i", "e"))
    return each.select(*keep, "part", "ring", "i", "n", F.col("e._ring.x").alias("ax"), F.col("e._ring.y").alias("ay"), F.col("e._next.x").alias("bx"), F.col("e._next.y").alias("by"), "sign", "ox", "oy")


def shape_facts(edges: DataFrame, key: str) -> DataFrame:
    """(key, box, area, lat, lon): bounds, area, and the centroid of each shape, holes left out; the mean of the corners where there is no area."""
    a = ((F.col("ax") - F.col("ox")) * (F.col("by") - F.col("oy")) - (F.col("bx") - F.col("ox")) * (F.col("ay") - F.col("oy"))) * F.col("sign")
    sums = edges.groupBy(key).agg(
        *(f(c).alias(n) for f, c, n in ((F.min, "ax", "x0"), (F.min, "ay", "y0"), (F.max, "ax", "x1"), (F.max, "ay", "y1"), (F.avg, "ax", "mx"), (F.avg, "ay", "my"), (F.first, "ox", "ox"), (F.first, "oy", "oy"))),
        F.sum(a).alias("a"), F.sum(a * (F.col("ax") + F.col("bx") - 2 * F.col("ox"))).alias("sx"), F.sum(a * (F.col("ay") + F.col("by") - 2 * F.col("oy"))).alias("sy"))
    at = lambda s, o, mean: F.when(F.col("a") != 0, F.col(o) + F.col(s) / (3 * F.col("a"))).otherwise(F.col(mean))
    return sums.select(key, F.struct("x0", "y0", "x1", "y1").alias("box"), (F.col("a") / 2).alias("area"), at("sy", "oy", "my").alias("lat"), at("sx", "ox", "mx").alias("lon"))


def edge_share(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """What an edge (ax, ay, bx, by, sign) adds to the area of its shape within a box; the sum over all edges of a shape is that area."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    left, right = F.greatest(F.least(ax, bx), x0), F.least(F.greatest(ax, bx), x1)
    slope = (by - ay) / F.when(bx != ax, bx - ax)
    u, v = (ay - y0 + (x - ax) * slope for x in (left, right))
    height = y1 - y0
    low, high = F.least(u, v), F.greatest(u, v)
    cut = lambda t: F.least(F.greatest(t, F.lit(0.0)), height)
    # The mean over [left, right] of the height above the lower side, cut to the box: a part below it, one within, and one above.
    within = (cut(high) - cut(low)) / F.when(high > low, high - low)
    above = F.greatest(high - F.greatest(low, height), F.lit(0.0)) / F.when(high > low, high - low)
    mean = F.when(high > low, within * (cut(low) + cut(high)) / 2 + above * height).otherwise(cut(low))
    return F.when(right > left, F.col("sign") * F.signum(ax - bx) * (right - left) * mean).otherwise(0.0)


def areas_within(pairs: DataFrame, edges: DataFrame, shape: str, box: str, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """(keys, area, carry) of pairs of a box and a shape (keys tell them apart) that share an area. Edges meet pairs by shape, and their shares are added up before anything else is shuffled."""
    held = edges.select(F.col(shape).alias("_shape"), "ax", "ay", "bx", "by", "sign")
    met = pairs.select(*keys, *(F.col(c).alias(f"_with{i}") for i, c in enumerate(carry or [])), F.col(shape).alias("_of"), *(F.col(f"{box}.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1"))).join(held, F.col("_of") == F.col("_shape"))
    share = edge_share(*(F.col(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    return met.groupBy(*keys).agg(F.sum(share).alias("area"), *(F.first(f"_with{i}").alias(c) for i, c in enumerate(carry or []))).where("area > 0")


def _y(at: Column, p: str = "") -> Column:
    """The height of the piece or edge with columns l, r, u, v (u at l, v at r) at a place in between."""
    left, right, u, v = (F.col(f"{p}{c}") for c in ("l", "r", "u", "v"))
    return u + (v - u) * ((at - left) / (right - left))


def union_areas(edges: DataFrame, key: str, shape: str, box: str) -> DataFrame:
    """(key, covered): the area of the union of all shapes of a key within the key's box. edges: key, shape, box, ax, ay, bx, by of whole shapes.

    The box is cut into strips, as many as there are edges for, and strips where ends of edges lie, where edges cross each other, and where they cross the
    upper or lower side. Between two such places nothing crosses, so each shape is a few trapezoids, and the union is as long at the middle as on average. Edges that
    cross are found in cells of a strip. A shape is inside between its first and second edge, third and fourth, and so on; a null or empty box covers nothing.
    """
    b = F.col(box)
    flat = edges.select(key, shape, *(b[c].alias(c) for c in ("x0", "y0", "x1", "y1")), *(F.when(F.col("ax") < F.col("bx"), F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("ax", "bx", "l"), ("bx", "ax", "r"), ("ay", "by", "u"), ("by", "ay", "v"))))
    flat = flat.where("l < r AND l < x1 AND r > x0 AND y1 > y0")
    strips = flat.groupBy(F.col(key).alias("_of")).agg(F.least(F.greatest(F.ceil(F.count("*") / STRIP_EDGES), F.lit(1)), F.lit(STRIPS)).cast("int").alias("strips"))
    flat = flat.join(strips, F.col(key).eqNullSafe(F.col("_of"))).drop("_of").withColumn("w", (F.col("x1") - F.col("x0")) / F.col("strips"))
    at = lambda x: F.least(F.greatest(F.floor((F.greatest(x, F.col("x0")) - F.col("x0")) / F.col("w")).cast("int"), F.lit(0)), F.col("strips") - 1)
    flat = flat.withColumn("strip", F.explode(F.sequence(at(F.col("l")), at(F.col("r")))))
    left, right = F.col("x0") + F.col("strip") * F.col("w"), F.when(F.col("strip") < F.col("strips") - 1, F.col("x0") + (F.col("strip") + 1) * F.col("w")).otherwise(F.col("x1"))
    flat = flat.withColumn("pl", F.greatest("l", left)).withColumn("pr", F.least("r", right)).where("pl < pr")
    pieces = flat.select(key, "strip", shape, "y0", "y1", F.col("pl").alias("l"), F.col("pr").alias("r"), F.when(F.col("pl") == F.col("l"), F.col("u")).otherwise(_y(F.col("pl"))).alias("u"), F.when(F.col("pr") == F.col("r"), F.col("v")).otherwise(_y(F.col("pr"))).alias("v"))

    # Places where the order of edges, or what is cut, changes.
    meets = lambda y: F.when((F.col("u") - y) * (F.col("v") - y) < 0, F.col("l") + (F.col("r") - F.col("l")) * ((y - F.col("u")) / (F.col("v") - F.col("u"))))
    ends = pieces.select(key, "strip", F.explode(F.array("l", "r", meets(F.col("y0")), meets(F.col("y1")))).alias("x")).where("x IS NOT NULL")
    band = lambda y: F.floor((y - F.col("y0")) / (F.col("y1") - F.col("y0")) * 16).cast("int")
    low, high = F.greatest(F.least("u", "v"), F.col("y0")), F.least(F.greatest("u", "v"), F.col("y1"))
    banded = pieces.where(low <= high).withColumn("band", F.explode(F.sequence(band(low), band(high)))).select(key, "strip", "band", "l", "r", "u", "v")
    one, two = (banded.select(F.col(key).alias(f"{p}k"), F.col("strip").alias(f"{p}s"), F.col("band").alias(f"{p}b"), *(F.col(c).alias(f"{p}{c}") for c in "lruv")) for p in ("a_", "b_"))
    met = one.join(two, F.col("a_k").eqNullSafe(F.col("b_k")) & (F.col("a_s") == F.col("b_s")) & (F.col("a_b") == F.col("b_b")) & (F.col("a_l") < F.col("b_r")) & (F.col("b_l") < F.col("a_r")) & (F.struct("a_l", "a_r", "a_u", "a_v") < F.struct("b_l", "b_r", "b_u", "b_v")))
    met = met.withColumn("_l", F.greatest("a_l", "b_l")).withColumn("_r", F.least("a_r", "b_r"))
    met = met.withColumn("_p", _y(F.col("_l"), "a_") - _y(F.col("_l"), "b_")).withColumn("_q", _y(F.col("_r"), "a_") - _y(F.col("_r"), "b_")).where("_p * _q < 0")
    crossings = met.select(F.col("a_k").alias(key), F.col("a_s").alias("strip"), (F.col("_l") + (F.col("_r") - F.col("_l")) * (F.col("_p") / (F.col("_p") - F.col("_q")))).alias("x"))
    places = ends.unionByName(crossings).distinct()
    slabs = places.withColumn("x2", F.lead("x").over(Window.partitionBy(key, "strip").orderBy("x"))).where("x2 > x")

    slabs = slabs.select(F.col(key).alias("_of"), F.col("strip").alias("_in"), "x", "x2", ((F.col("x") + F.col("x2")) / 2).alias("m"))
    held = slabs.join(pieces, F.col(key).eqNullSafe(F.col("_of")) & (F.col("strip") == F.col("_in")) & (F.col("l") < F.col("m")) & (F.col("r") > F.col("m")))
    held = held.withColumn("y", F.least(F.greatest(_y(F.col("m")), F.col("y0")), F.col("y1")))
    up = Window.partitionBy(key, "strip", "x", shape).orderBy("y")
    spans = held.withColumn("k", F.row_number().over(up)).withColumn("top", F.lead("y").over(up)).where("k % 2 = 1 AND top > y")
    below = F.max("top").over(Window.partitionBy(key, "strip", "x").orderBy("y", "top").rowsBetween(Window.unboundedPreceding, -1))
    lengths = spans.withColumn("_below", below).select(key, ((F.col("x2") - F.col("x")) * F.greatest(F.col("top") - F.greatest("y", F.coalesce("_below", "y")), F.lit(0.0))).alias("a"))
    return lengths.groupBy(key).agg(F.sum("a").alias("covered"))


def _turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Above 0 if r lies to the left of the way from p to q, 0 if on the line."""
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def invalid_shapes(edges: DataFrame, key: str) -> DataFrame:
    """(key, reason) of shapes that aren't valid, each reason once: "ring" (a ring of fewer than three corners or no area), "crossing" (edges that cross or overlap, a ring that
    touches itself), "touching" (rings of one polygon that touch so often that they cut it), "nesting" (a hole outside its outer ring or within another hole, a polygon within another one).

    Rings may touch other rings in single points. edges are those of edge_rows. Edges of one shape that may meet are found in cells of a grid over its bounds, whose number
    goes with its edges; which ring holds which follows from counting, along a line through corners of each ring, the edges of the others.
    """
    few = edges.where("n < 3 OR sign = 0").select(key, F.lit("ring").alias("reason")).distinct()
    bounds = edges.groupBy(F.col(key).alias("_key")).agg(F.min("ax").alias("x0"), F.min("ay").alias("y0"), (F.max("ax") - F.min("ax")).alias("w"), (F.max("ay") - F.min("ay")).alias("h"), F.least(F.ceil(F.sqrt(F.count("*"))), F.lit(CELLS)).cast("int").alias("g"), F.countDistinct("part", "ring").alias("rings"))
    held = edges.join(bounds, F.col(key) == F.col("_key")).drop("_key").where("w > 0 AND h > 0")
    at = lambda v, low, size: F.least(F.greatest(F.floor((v - F.col(low)) / F.col(size) * F.col("g")).cast("int"), F.lit(0)), F.col("g") - 1)
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    cells = held.withColumn("cx", F.explode(F.sequence(at(F.least(ax, bx), "x0", "w"), at(F.greatest(ax, bx), "x0", "w"))))
    # Of a column, the rows between the edge's heights at its sides, and one more on either side for what rounding may do.
    side = lambda k: F.least(F.greatest(F.col("x0") + (F.col("cx") + k) * F.col("w") / F.col("g"), F.least(ax, bx)), F.greatest(ax, bx))
    height = lambda x: F.when(ax == bx, ay).otherwise(ay + (by - ay) * ((x - ax) / (bx - ax)))
    p, q = F.when(ax == bx, ay).otherwise(height(side(0))), F.when(ax == bx, by).otherwise(height(side(1)))
    cells = cells.withColumn("cy", F.explode(F.sequence(F.greatest(at(F.least(p, q), "y0", "h") - 1, F.lit(0)), F.least(at(F.greatest(p, q), "y0", "h") + 1, F.col("g") - 1))))
    names = ["part", "ring", "i", "n", "ax", "ay", "bx", "by"]
    one, two = (cells.select(F.col(key).alias(f"{k}k"), F.col("cx").alias(f"{k}cx"), F.col("cy").alias(f"{k}cy"), *(F.col(c).alias(f"{k}{c}") for c in names)) for k in ("a_", "b_"))
    c = F.col
    pairs = one.join(two, (c("a_k") == c("b_k")) & (c("a_cx") == c("b_cx")) & (c("a_cy") == c("b_cy")) & (F.struct("a_part", "a_ring", "a_i") < F.struct("b_part", "b_ring", "b_i")))
    a1, b1, a2, b2 = ((c(f"{k}{e}x"), c(f"{k}{e}y")) for k, e in (("a_", "a"), ("a_", "b"), ("b_", "a"), ("b_", "b")))
    pairs = pairs.withColumns({"d1": _turn(*a1, *b1, *a2), "d2": _turn(*a1, *b1, *b2), "d3": _turn(*a2, *b2, *a1), "d4": _turn(*a2, *b2, *b1)})
    between = lambda p, s, e: (p[0] >= F.least(s[0], e[0])) & (p[0] <= F.greatest(s[0], e[0])) & (p[1] >= F.least(s[1], e[1])) & (p[1] <= F.greatest(s[1], e[1]))
    on = [(c("d1") == 0) & between(a2, a1, b1), (c("d2") == 0) & between(b2, a1, b1), (c("d3") == 0) & between(a1, a2, b2), (c("d4") == 0) & between(b1, a2, b2)]
    crosses = (c("d1") * c("d2") < 0) & (c("d3") * c("d4") < 0)
    # On one line, edges overlap if the inner two of their four ends differ.
    inner = lambda k: F.least(F.greatest(a1[k], b1[k]), F.greatest(a2[k], b2[k])) - F.greatest(F.least(a1[k], b1[k]), F.least(a2[k], b2[k]))
    overlaps = (c("d1") == 0) & (c("d2") == 0) & (inner(0) >= 0) & (inner(1) >= 0) & ((inner(0) > 0) | (inner(1) > 0))
    same = (c("a_part") == c("b_part")) & (c("a_ring") == c("b_ring"))
    follows = same & ((c("b_i") - c("a_i") == 1) | (c("b_i") - c("a_i") == c("a_n") - 1))
    touches = on[0] | on[1] | on[2] | on[3]
    point = F.when(on[0], F.struct(a2[0].alias("x"), a2[1].alias("y"))).when(on[1], F.struct(b2[0].alias("x"), b2[1].alias("y"))).when(on[2], F.struct(a1[0].alias("x"), a1[1].alias("y"))).otherwise(F.struct(b1[0].alias("x"), b1[1].alias("y")))
    met = pairs.where(crosses | touches).select(c("a_k").alias(key), "a_part", "a_ring", "b_part", "b_ring", (crosses | overlaps | (same & ~follows)).alias("bad"), same.alias("same"), point.alias("p"))
    crossing = met.where("bad").select(key, F.lit("crossing").alias("reason")).distinct()

    # Rings of a polygon and the points where they touch, as a graph: a ring of touches cuts the polygon. A shape's touches are as few as its corners.
    touched = met.where("NOT bad AND NOT same AND a_part = b_part").select(key, c("a_part").alias("part"), "a_ring", "b_ring", "p.x", "p.y").distinct()
    kind = dict(edges.dtypes)[key]

    def cut(rows):
        import pandas as pd

        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        cyclic = False
        links = {(("r", r), ("p", x, y)) for a, b, x, y in zip(rows.a_ring, rows.b_ring, rows.x, rows.y, strict=True) for r in (a, b)}
        for u, v in sorted(links, key=repr):
            u, v = find(u), find(v)
            cyclic |= u == v
            root[u] = v
        return pd.DataFrame({key: [rows[key].iloc[0]], "reason": ["touching"]}) if cyclic else pd.DataFrame({key: rows[key].iloc[:0], "reason": pd.Series([], dtype=object)})

    touching = touched.groupBy(key, "part").applyInPandas(cut, f"{key} {kind}, reason string").distinct()

    # Of every ring two corners and a point between them, of which one at least isn't on another ring; lines go from them to the left.
    several = held.where("rings > 1 AND n >= 3")
    middle = F.struct(((ax + bx) / 2).alias("x"), ((ay + by) / 2).alias("y"))
    points = several.where("i = 0").select(c(key).alias("k"), c("part").alias("of_part"), c("ring").alias("of_ring"), "y0", "h", "g", F.explode(F.array(F.struct(ax.alias("x"), ay.alias("y")), F.struct(bx.alias("x"), by.alias("y")), middle)).alias("p"))
    points = points.select("k", "of_part", "of_ring", "p", at(c("p.y"), "y0", "h").alias("row"))
    lines = several.withColumn("row", F.explode(F.sequence(at(F.least(ay, by), "y0", "h"), at(F.greatest(ay, by), "y0", "h")))).select(key, "part", "ring", "ax", "ay", "bx", "by", c("row").alias("_row"))
    x, y = c("p.x"), c("p.y")
    seen = points.join(lines, (c("k") == c(key)) & (c("row") == c("_row")) & ~((c("part") == c("of_part")) & (c("ring") == c("of_ring"))))
    straddles = (ay > y) != (by > y)
    lies = (_turn(ax, ay, bx, by, x, y) == 0) & between((x, y), (ax, ay), (bx, by))
    crossed = straddles & (ax + (bx - ax) * ((y - ay) / F.when(by != ay, by - ay)) < x)
    counts = seen.groupBy("k", "of_part", "of_ring", "part", "ring", "p").agg(F.sum(crossed.cast("int")).alias("m"), F.max(lies).alias("on"))
    inside = counts.where("m % 2 = 1 AND NOT on").select("k", "of_part", "of_ring", "part", "ring").distinct()
    by_part = inside.groupBy("k", "of_part", "of_ring").agg(F.sum(((c("part") == c("of_part")) & (c("ring") == 0)).cast("int")).alias("shell"), F.sum(((c("part") == c("of_part")) & (c("ring") > 0)).cast("int")).alias("holes"))
    rings = several.where("i = 0").select(c(key).alias("k"), c("part").alias("of_part"), c("ring").alias("of_ring"))
    wrong = rings.join(by_part, ["k", "of_part", "of_ring"], "left").fillna(0, ["shell", "holes"]).where("(of_ring > 0 AND shell = 0) OR holes > 0").select("k")
    odd = inside.where("of_ring = 0 AND part <> of_part").groupBy("k", "of_part", "part").agg(F.count("*").alias("m")).where("m % 2 = 1").select("k")
    nesting = wrong.union(odd).distinct().select(c("k").alias(key), F.lit("nesting").alias("reason"))
    return few.unionByName(crossing).unionByName(touching).unionByName(nesting)


def footprint_test(boxes: DataFrame, key: str, box: str, footprint: DataFrame) -> DataFrame:
    """(key, within, meets): whether the union of the footprint's shapes holds each box, and whether it shares a point with it; boundaries count as inside. No row, no box.

    footprint: rows (parts). Where no edge passes through a box, its middle decides, by the edges to its left: they are counted in strips across all boxes. A box that edges
    pass through is only held if several shapes hold it together: if the area of their union in it is the box's, to a part in 10**9.
    """
    from ..storage import staged

    spark = boxes.sparkSession
    shapes = footprint.select("parts").withColumn("shape", F.monotonically_increasing_id())
    edges = staged(spark, edge_rows(shapes, "parts", "shape"), "footprint")
    b = F.col(box)
    flat = boxes.select(F.col(key).alias("_key"), *(b[c].alias(c) for c in ("x0", "y0", "x1", "y1"))).where("x1 > x0 AND y1 > y0")
    span = edges.agg(F.min("ay").alias("low"), F.max("ay").alias("high")).first()
    tall = flat.agg(F.max(F.col("y1") - F.col("y0")).alias("h")).first()["h"]
    if span["low"] is None or tall is None:
        return flat.select(F.col("_key").alias(key), F.lit(False).alias("within"), F.lit(False).alias("meets"))
    height = max(tall, (span["high"] - span["low"]) / CELLS)
    strip = lambda y: F.floor((y - F.lit(span["low"])) / F.lit(height)).cast("long")
    near = flat.withColumn("strip", F.explode(F.sequence(strip(F.col("y0")), strip(F.col("y1")))))
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    lines = edges.select("shape", "ax", "ay", "bx", "by", F.explode(F.sequence(strip(F.least(ay, by)), strip(F.greatest(ay, by)))).alias("_strip"))
    met = near.join(lines, (F.col("strip") == F.col("_strip")) & (F.least(ax, bx) <= F.col("x1")) & (F.least(ay, by) <= F.col("y1")) & (F.greatest(ay, by) >= F.col("y0")))
    # The part of an edge within the box's columns and rows, from 0 to 1 along it.
    along = lambda low, high, s, e: (F.when(s == e, F.when((s >= low) & (s <= high), 0.0).otherwise(2.0)).otherwise(F.least((low - s) / F.when(s != e, e - s), (high - s) / F.when(s != e, e - s))), F.when(s == e, F.when((s >= low) & (s <= high), 1.0).otherwise(-1.0)).otherwise(F.greatest((low - s) / F.when(s != e, e - s), (high - s) / F.when(s != e, e - s))))
    (p0, p1), (q0, q1) = along(F.col("x0"), F.col("x1"), ax, bx), along(F.col("y0"), F.col("y1"), ay, by)
    start, end = F.greatest(p0, q0, F.lit(0.0)), F.least(p1, q1, F.lit(1.0))
    touch = start <= end
    mid = (start + end) / 2
    mx, my = ax + (bx - ax) * mid, ay + (by - ay) * mid
    through = (start < end) & (mx > F.col("x0")) & (mx < F.col("x1")) & (my > F.col("y0")) & (my < F.col("y1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    counted = (F.col("strip") == strip(cy)) & ((ay > cy) != (by > cy)) & (ax + (bx - ax) * ((cy - ay) / F.when(by != ay, by - ay)) < cx)
    each = met.groupBy("_key", "shape").agg(F.max(touch).alias("touch"), F.max(through).alias("through"), (F.sum(F.coalesce(counted, F.lit(False)).cast("int")) % 2).alias("odd"))
    sums = each.groupBy("_key").agg(F.max("touch").alias("touch"), F.max("through").alias("through"), F.max("odd").alias("odd"))
    found = staged(spark, flat.join(sums, "_key", "left").fillna(False, ["touch", "through"]).fillna(0, ["odd"]), "footprint")
    crossed = found.where("through").select("_key", F.struct("x0", "y0", "x1", "y1").alias("_box"), "x0", "y0", "x1", "y1", strip(F.col("y0")).alias("s0"), strip(F.col("y1")).alias("s1"))
    # Of the shapes near a box that edges cross, all edges in its columns; those far below or above it only tell what is inside.
    marked = crossed.withColumn("strip", F.explode(F.sequence("s0", "s1"))).join(lines.select("shape", "_strip").distinct(), F.col("strip") == F.col("_strip")).select("_key", "_box", "shape", "x0", "x1").distinct()
    parted = marked.join(edges.select(F.col("shape").alias("_shape"), "ax", "ay", "bx", "by"), (F.col("shape") == F.col("_shape")) & (F.least(ax, bx) < F.col("x1")) & (F.greatest(ax, bx) > F.col("x0")))
    covered = union_areas(parted.select("_key", "shape", "_box", "ax", "ay", "bx", "by"), "_key", "shape", "_box")
    out = found.join(covered, "_key", "left")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    within = F.when(F.col("through"), F.coalesce(F.col("covered") >= area * (1 - 1e-9), F.lit(False))).otherwise(F.col("odd") == 1)
    return out.select(F.col("_key").alias(key), within.alias("within"), (F.col("touch") | (F.col("odd") == 1)).alias("meets"))
