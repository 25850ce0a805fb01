"""Registered queries over polygons: unions, validity, footprints, and whole indices of octagons, with SQL that cuts shapes into slabs or tries all pairs of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import polygons, spatial
from ..storage import staged
from . import pipelines
from .queries import box_features, of_scenes, polygon_features, query, supplier_scenes, table

#: The sides of an octagon that aren't upright, from its middle: left, right, height at the left and at the right.
_SIDES = ", ".join(f"({a}, {b}, {s}{u}, {s}{v})" for a, b, u, v in ((-0.05, -0.02, 0.02, 0.05), (-0.02, 0.02, 0.05, 0.05), (0.02, 0.05, 0.05, 0.02)) for s in ("", "-"))
_OCTAGONS = """SELECT c_custkey AS f, (c_custkey * 37 % 1000) / 100.0::DOUBLE + {shift}::DOUBLE AS lat, (c_custkey * 91 % 1000) / 100.0::DOUBLE + {shift}::DOUBLE AS lon,
    CASE c_custkey % 3 WHEN 0 THEN [28] WHEN 1 THEN [29, 32] ELSE [48] END AS cl, (1 + c_custkey % {sizes})::DOUBLE AS z FROM customer"""


def _cut(octagons: str, boxes: str, key: str) -> str:
    """Sides of octagons, z times as large, within the columns of boxes (x0, y0, x1, y1) that they come near: rows (k, s, l, r, u, v, y0, y1)."""
    at = lambda x: f"(o.lat + du + (dv - du) * (({x}) - o.lon - dl) / (dr - dl))"
    return f"""SELECT k, s, l, r, {at("l")} AS u, {at("r")} AS v, y0, y1
    FROM (SELECT {key} AS k, o.f AS s, o.lat, o.lon, greatest(o.lon + o.z * dl, b.x0) AS l, least(o.lon + o.z * dr, b.x1) AS r, o.z * dl AS dl, o.z * dr AS dr, o.z * du AS du, o.z * dv AS dv, b.y0, b.y1
      FROM {octagons} o JOIN {boxes} b ON o.lon + 0.05 * o.z > b.x0 AND o.lon - 0.05 * o.z < b.x1 AND o.lat + 0.05 * o.z > b.y0 AND o.lat - 0.05 * o.z < b.y1,
        (VALUES {_SIDES}) sides(dl, dr, du, dv)) o WHERE l < r"""


def _slabs(name: str, sides: str, crossing: bool) -> str:
    """CTEs that end in one of that name: (k, area) of the union of convex shapes whose sides are given, cut to y0 and y1. crossing: several shapes share a k."""
    y = lambda t, x: f"({t}.u + ({t}.v - {t}.u) * ({x} - {t}.l) / ({t}.r - {t}.l))"
    low, high = "greatest(a.l, b.l)", "least(a.r, b.r)"
    cross = f"""
      UNION ALL SELECT k, l + (r - l) * p / (p - q) FROM (SELECT a.k, {low} AS l, {high} AS r, {y("a", low)} - {y("b", low)} AS p, {y("a", high)} - {y("b", high)} AS q
        FROM {sides} a JOIN {sides} b ON a.k = b.k AND a.s < b.s AND a.l < b.r AND b.l < a.r) WHERE p * q < 0""" if crossing else ""
    return f"""{name}_x AS (SELECT DISTINCT k, x FROM (
      SELECT k, unnest([l, r]) AS x FROM {sides}
      UNION ALL SELECT k, l + (r - l) * (y - u) / (v - u) FROM (SELECT *, unnest([y0, y1]) AS y FROM {sides}) WHERE (u - y) * (v - y) < 0{cross})),
  {name}_s AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS x2 FROM {name}_x),
  {name}_p AS (SELECT k, x, x2, s, min(y) AS lo, max(y) AS hi FROM (SELECT t.k, x, x2, s, least(greatest({y("t", "(x + x2) / 2")}, y0), y1) AS y
      FROM {name}_s JOIN {sides} t ON t.k = {name}_s.k AND l < (x + x2) / 2 AND r > (x + x2) / 2) GROUP BY ALL),
  {name} AS (SELECT k, sum((x2 - x) * greatest(hi - greatest(lo, coalesce(top, lo)), 0)) AS area
    FROM (SELECT *, max(hi) OVER (PARTITION BY k, x ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {name}_p) GROUP BY k)"""


@query(f"""WITH o AS ({_OCTAGONS.format(shift=0.0, sizes=4)}),
  b AS (SELECT s_suppkey, lon - 0.12::DOUBLE AS x0, lat - 0.12::DOUBLE AS y0, lon + 0.12::DOUBLE AS x1, lat + 0.12::DOUBLE AS y1
    FROM (SELECT s_suppkey, (s_suppkey * 53 % 1000) / 100.0::DOUBLE AS lat, (s_suppkey * 29 % 1000) / 100.0::DOUBLE AS lon FROM supplier)),
  e AS ({_cut("o", "b", "b.s_suppkey")}), {_slabs("a", "e", True)}
  SELECT k AS s_suppkey, round(area, 7) AS covered FROM a WHERE area > 1e-9""")
def coverage_union(spark, sf_dir):
    """What overlapping octagons cover of each scene. Different octagons and boxes of scenes meet once: a copy covers no more, and scenes of one box have the same cover."""
    shapes = polygon_features(spark, sf_dir, sizes=4).groupBy(F.array("rings").alias("parts")).agg(F.min("feature_id").alias("feature_id"))
    scenes = supplier_scenes(spark, sf_dir).groupBy("box").agg(F.min("s_suppkey").alias("scene"))
    edges = staged(spark, polygons.edge_rows(shapes, "parts", "feature_id"), "edges")
    boxes = polygons.shape_facts(edges, "feature_id").withColumnRenamed("box", "fbox")
    pairs = spatial.box_pairs(scenes, boxes.select("feature_id", "fbox"), 0.24, "box", "fbox").select("scene", "box", "feature_id")
    covered = polygons.union_areas(pairs.join(edges, "feature_id"), "scene", "feature_id", "box").where("covered > 1e-9")
    return of_scenes(spark, sf_dir, scenes.join(covered, "scene").select("box", F.round("covered", 7).alias("covered")))


#: A footprint of three rectangles, of which the first two share a side with a part of each other, and of a hole in the first: rows (x0, y0, x1, y1, sign).
_RECTANGLES = ((0.5005, 0.0005, 5.0005, 9.9005, 1), (5.0005, 0.0005, 9.4005, 4.5005, 1), (7.0005, 6.0005, 9.0005, 8.0005, 1), (2.0005, 2.0005, 3.0005, 3.0005, -1))
_FOOT = ", ".join(f"({', '.join(f'{v}::DOUBLE' for v in r)})" for r in _RECTANGLES)
_LEAST_COVER = 0.5
#: Half of a scene's side; no side of an octagon lies on one of a scene.
_REACH = 0.1213


def rectangles(spark) -> DataFrame:
    ring = lambda r: [{"x": x, "y": y} for x, y in ((r[0], r[1]), (r[2], r[1]), (r[2], r[3]), (r[0], r[3]))]
    first, second, third, hole = map(ring, _RECTANGLES)
    return spark.createDataFrame([([[first, hole], [third]],), ([[second]],)], "parts array<array<array<struct<x:double,y:double>>>>")


def _index(cover: float, foot: bool, sizes: int = 1) -> str:
    """CTEs of an index of octagons: fr (center, class_id, relative, absolute), id (center, patch_id), pa (center, box)."""
    held = f""" WHERE (SELECT sum(sign * greatest(least(q.x1, b.x1) - greatest(q.x0, b.x0), 0) * greatest(least(q.y1, b.y1) - greatest(q.y0, b.y0), 0)) FROM (VALUES {_FOOT}) q(x0, y0, x1, y1, sign)) >= {4 * _REACH**2}::DOUBLE * (1 - 1e-9)""" if foot else ""
    enough = f" JOIN u ON u.k = center WHERE u.area / {4 * _REACH**2}::DOUBLE >= {cover}::DOUBLE" if cover else ""
    return f"""o AS ({_OCTAGONS.format(shift=0.003, sizes=sizes)}),
  ce AS (SELECT f AS center, lat, lon FROM o QUALIFY row_number() OVER (PARTITION BY floor(lat / 0.5::DOUBLE), floor(lon / 0.5::DOUBLE) ORDER BY f) = 1),
  pa AS (SELECT * FROM (SELECT center, lat, lon, lon - {_REACH}::DOUBLE AS x0, lat - {_REACH}::DOUBLE AS y0, lon + {_REACH}::DOUBLE AS x1, lat + {_REACH}::DOUBLE AS y1 FROM ce) b{held}),
  e AS ({_cut("o", "pa", "b.center")}), {_slabs("u", "e", True)},
  ef AS (SELECT {{'c': k, 'f': s}} AS k, s, l, r, u, v, y0, y1 FROM e), {_slabs("w", "ef", False)},
  ca AS (SELECT center, class_id, sum(area) AS area FROM (SELECT k.c AS center, unnest(cl) AS class_id, area FROM w JOIN o ON o.f = k.f WHERE area > 0) GROUP BY ALL),
  fr AS (SELECT *, area / sum(area) OVER (PARTITION BY center) AS relative, area / {4 * _REACH**2}::DOUBLE AS absolute
    FROM (SELECT ca.* FROM ca{enough}) QUALIFY count(*) OVER (PARTITION BY center) >= 2),
  id AS (SELECT center, row_number() OVER (ORDER BY center) AS patch_id FROM (SELECT DISTINCT center FROM fr))"""


_CLASSES = "SELECT patch_id, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(class_id AS INTEGER) AS class_id, round(relative, 6) AS relative, round(absolute, 6) AS absolute FROM fr JOIN id USING (center) JOIN pa USING (center)"


def scene_classes(scenes: DataFrame) -> DataFrame:
    each = scenes.select("patch_id", "center_lat", "center_lon", "class_fracs_abs", F.explode("class_fracs").alias("class_id", "relative"))
    return each.select("patch_id", F.round("center_lat", 6).alias("lat"), F.round("center_lon", 6).alias("lon"), "class_id", F.round("relative", 6).alias("relative"), F.round(F.try_element_at("class_fracs_abs", F.col("class_id")), 6).alias("absolute"))


@query(f"WITH {_index(0, False)} {_CLASSES}")
def index_scene_classes(spark, sf_dir):
    """Scenes of an index of octagons, one row for each class."""
    return scene_classes(pipelines.build_index(polygon_features(spark, sf_dir, 0.003), "all", halfwidth=_REACH / 10, spacing=0.5)[0])


@query(f"WITH {_index(_LEAST_COVER, True, 4)} {_CLASSES}")
def index_coverage(spark, sf_dir):
    """Scenes within a footprint of several polygons of which octagons of four sizes cover half at least."""
    return scene_classes(pipelines.build_index(polygon_features(spark, sf_dir, 0.003, 4), "all", rectangles(spark), halfwidth=_REACH / 10, spacing=0.5, coverage_min=_LEAST_COVER)[0])


_TILE = _REACH / 5


@query(f"""WITH {_index(0, False)},
  ti AS (SELECT patch_id, center, t, x0 + t % 10 * {_TILE}::DOUBLE AS x0, y1 - (t // 10 + 1) * {_TILE}::DOUBLE AS y0, x0 + (t % 10 + 1) * {_TILE}::DOUBLE AS x1, y1 - (t // 10) * {_TILE}::DOUBLE AS y1
    FROM id JOIN pa USING (center), range(0, 100) r(t)),
  near AS (SELECT DISTINCT center, f FROM (SELECT k.c AS center, k.f AS f FROM w WHERE area > 0)),
  te AS (SELECT {{'p': k.p, 't': k.t, 'f': s}} AS k, s, l, r, u, v, y0, y1 FROM ({_cut("(SELECT * FROM o SEMI JOIN near USING (f))", "ti", "{'p': b.patch_id, 't': b.t}")})), {_slabs("tw", "te", False)},
  tc AS (SELECT patch_id, t, class_id, sum(area) AS a FROM (SELECT k.p AS patch_id, k.t AS t, unnest(cl) AS class_id, area FROM tw JOIN o ON o.f = k.f WHERE area > 1e-9) GROUP BY ALL)
  SELECT patch_id, CAST(t AS INTEGER) AS tile_index, CAST(class_id AS INTEGER) AS class_id, round(a / sum(a) OVER (PARTITION BY patch_id, t), 4) AS fraction FROM tc""")
def index_tile_classes(spark, sf_dir):
    """Tiles of index_scene_classes: the fractions of classes that cover more than a billionth of a square degree, one row for each."""
    tiles = pipelines.build_index(polygon_features(spark, sf_dir, 0.003), "all", halfwidth=_REACH / 10, spacing=0.5)[1]
    each = tiles.select("patch_id", "tile_index", F.explode("tile_class_fracs").alias("class_id", "fraction"))
    return each.where("fraction > 1e-6").select("patch_id", "tile_index", "class_id", F.round("fraction", 4).alias("fraction"))


#: Shapes around a point, by kind: polygons of rings of corners. Kinds 0, 2, 5 and 7 are valid.
SHAPES = (
    (((0.05, 0.02), (0.02, 0.05), (-0.02, 0.05), (-0.05, 0.02), (-0.05, -0.02), (-0.02, -0.05), (0.02, -0.05), (0.05, -0.02)),),
    (((0.0, 0.0), (0.03, 0.03), (0.03, 0.0), (0.0, 0.04)),),
    (((-0.04, -0.04), (0.04, -0.04), (0.04, 0.04), (-0.04, 0.04)), ((-0.01, -0.01), (0.01, -0.01), (0.01, 0.01), (-0.01, 0.01))),
    (((-0.04, -0.04), (0.04, -0.04), (0.04, 0.04), (-0.04, 0.04)), ((-0.05, -0.01), (0.01, -0.01), (0.01, 0.01), (-0.05, 0.01))),
    (((-0.04, -0.04), (0.04, -0.04), (0.04, 0.04), (-0.04, 0.04)), ((-0.04, -0.01), (0.01, -0.01), (0.01, 0.01), (-0.04, 0.01))),
    (((-0.04, -0.04), (-0.01, -0.04), (-0.01, 0.04)), None, ((0.01, -0.04), (0.04, -0.04), (0.04, 0.04))),
    (((-0.04, -0.04), (0.04, -0.04), (0.04, 0.04), (-0.04, 0.04)), None, ((-0.01, -0.01), (0.01, -0.01), (0.01, 0.01))),
    (((-0.04, -0.04), (0.04, -0.04), (0.04, 0.04), (-0.04, 0.04)), ((-0.04, 0.0), (0.01, -0.01), (0.01, 0.01))),
)


def _rings():
    """(kind, part, ring, corners): None in a shape begins another polygon."""
    for kind, shape in enumerate(SHAPES):
        part = ring = 0
        for corners in shape:
            if corners is None:
                part, ring = part + 1, 0
            else:
                yield kind, part, ring, corners
                ring += 1


def shapes(spark, sf_dir) -> DataFrame:
    """(c_custkey, parts): a shape of one of the kinds around each customer."""
    lat, lon = F.col("c_custkey") * 37 % 1000 / F.lit(100.0), F.col("c_custkey") * 91 % 1000 / F.lit(100.0)
    by_kind: dict[int, dict[int, list]] = {}
    for kind, part, _, corners in _rings():
        by_kind.setdefault(kind, {}).setdefault(part, []).append(F.array(*(F.struct((lon + x).alias("x"), (lat + y).alias("y")) for x, y in corners)))
    parts = F.get(F.array(*(F.array(*(F.array(*rings) for rings in parts.values())) for parts in by_kind.values())), (F.col("c_custkey") % len(SHAPES)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", parts.alias("parts"))


_CORNERS = ", ".join(f"({kind}, {part}, {ring}, {i}, {len(corners)}, {x}, {y})" for kind, part, ring, corners in _rings() for i, (x, y) in enumerate(corners))


def _turn(p: str, q: str, r: str) -> str:
    (px, py), (qx, qy), (rx, ry) = (v.split() for v in (p, q, r))
    return f"(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


_A, _B, _C, _D = "a.ax a.ay", "a.bx a.by_", "b.ax b.ay", "b.bx b.by_"


def _on(p: str, s: str, e: str) -> str:
    (x, y), (sx, sy), (ex, ey) = (v.split() for v in (p, s, e))
    return f"({_turn(s, e, p)} = 0 AND {x} BETWEEN least({sx}, {ex}) AND greatest({sx}, {ex}) AND {y} BETWEEN least({sy}, {ey}) AND greatest({sy}, {ey}))"


_INNER = [f"(least(greatest(a.a{k}, a.b{k}{e}), greatest(b.a{k}, b.b{k}{e})) - greatest(least(a.a{k}, a.b{k}{e}), least(b.a{k}, b.b{k}{e})))" for k, e in (("x", ""), ("y", "_"))]


@query(f"""WITH c AS (SELECT c_custkey, part, ring, i, n, (c_custkey * 91 % 1000) / 100.0::DOUBLE + dx::DOUBLE AS x, (c_custkey * 37 % 1000) / 100.0::DOUBLE + dy::DOUBLE AS y
    FROM customer JOIN (VALUES {_CORNERS}) v(kind, part, ring, i, n, dx, dy) ON kind = c_custkey % {len(SHAPES)}),
  e AS (SELECT p.c_custkey, p.part, p.ring, p.i, p.n, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM c p JOIN c q ON p.c_custkey = q.c_custkey AND p.part = q.part AND p.ring = q.ring AND q.i = (p.i + 1) % p.n),
  pr AS (SELECT a.c_custkey, a.part = b.part AND a.ring = b.ring AS same, b.i - a.i IN (1, a.n - 1) AS follows,
      {_turn(_A, _B, _C)} * {_turn(_A, _B, _D)} < 0 AND {_turn(_C, _D, _A)} * {_turn(_C, _D, _B)} < 0 AS crosses,
      {_turn(_A, _B, _C)} = 0 AND {_turn(_A, _B, _D)} = 0 AND {_INNER[0]} >= 0 AND {_INNER[1]} >= 0 AND {_INNER[0]} + {_INNER[1]} > 0 AS lapped,
      {" OR ".join((_on(_C, _A, _B), _on(_D, _A, _B), _on(_A, _C, _D), _on(_B, _C, _D)))} AS touches
    FROM e a JOIN e b ON a.c_custkey = b.c_custkey AND (a.part, a.ring, a.i) < (b.part, b.ring, b.i)),
  bad AS (SELECT DISTINCT c_custkey FROM pr WHERE crosses OR lapped OR same AND touches AND NOT follows),
  cr AS (SELECT p.c_custkey, p.part, p.ring, p.i, b.part AS in_part, b.ring AS in_ring,
      sum(CASE WHEN (b.ay > p.y) <> (b.by_ > p.y) AND b.ax + (b.bx - b.ax) * ((p.y - b.ay) / nullif(b.by_ - b.ay, 0)) < p.x THEN 1 ELSE 0 END) % 2 AS odd, bool_or({_on("p.x p.y", _C, _D)}) AS edge
    FROM c p JOIN e b ON p.c_custkey = b.c_custkey AND (p.part, p.ring) <> (b.part, b.ring) GROUP BY ALL),
  ins AS (SELECT DISTINCT c_custkey, part, ring, in_part, in_ring FROM cr WHERE odd = 1 AND NOT edge),
  hol AS (SELECT DISTINCT r.c_custkey FROM c r WHERE ring > 0 AND NOT EXISTS (SELECT 1 FROM ins WHERE ins.c_custkey = r.c_custkey AND ins.part = r.part AND ins.ring = r.ring AND in_part = r.part AND in_ring = 0)),
  nst AS (SELECT DISTINCT c_custkey FROM (SELECT c_custkey, part, in_part, count(*) AS m FROM ins WHERE ring = 0 AND part <> in_part GROUP BY ALL) WHERE m % 2 = 1
    UNION SELECT c_custkey FROM ins WHERE part = in_part AND in_ring > 0)
  SELECT c_custkey, c_custkey NOT IN (SELECT * FROM bad UNION SELECT * FROM hol UNION SELECT * FROM nst) AS valid FROM customer""")
def shape_validity(spark, sf_dir):
    """Whether each customer's shape is valid."""
    held = shapes(spark, sf_dir)
    # Shapes of the same corners are tested once.
    kinds = staged(spark, held.groupBy("parts").agg(F.min("c_custkey").alias("shape")), "shapes")
    bad = polygons.invalid_shapes(polygons.edge_rows(kinds, "parts", "shape"), "shape").select("shape").distinct()
    tested = kinds.join(bad.withColumn("bad", F.lit(True)), "shape", "left").select("parts", F.col("bad").isNull().alias("valid"))
    # Shapes are made of keys, so their size isn't known from the file: neither side is broadcast.
    return held.hint("merge").join(tested, "parts").select("c_custkey", "valid")


#: A footprint with slanted sides and a hole, and a triangle apart from it: rings of corners, by polygon.
_SLANTED = ((((0.5005, 0.2005), (9.4005, 1.0005), (9.0005, 4.5005), (5.0005, 5.5005), (4.0005, 9.9005), (0.7005, 8.0005)), ((2.0005, 2.0005), (3.5005, 2.2005), (2.5005, 4.0005))), (((6.0005, 7.0005), (9.5005, 7.5005), (7.5005, 9.8005)),))
_LINES = ", ".join(f"({s}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for s, rings in enumerate(_SLANTED) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _along(low: str, high: str, s: str, e: str) -> tuple[str, str]:
    return tuple(f"{f}(({low} - {s}) / ({e} - {s}), ({high} - {s}) / ({e} - {s}))" for f in ("least", "greatest"))


_P, _Q = _along("x0", "x1", "ax", "bx"), _along("y0", "y1", "ay", "by_")


@query(f"""WITH b AS (SELECT s_suppkey, lon - 0.12::DOUBLE AS x0, lat - 0.12::DOUBLE AS y0, lon + 0.12::DOUBLE AS x1, lat + 0.12::DOUBLE AS y1, lat, lon
    FROM (SELECT s_suppkey, (s_suppkey * 53 % 1000) / 100.0::DOUBLE AS lat, (s_suppkey * 29 % 1000) / 100.0::DOUBLE AS lon FROM supplier)),
  t AS (SELECT s_suppkey, shape, bool_or(greatest({_P[0]}, {_Q[0]}, 0) <= least({_P[1]}, {_Q[1]}, 1)) AS touch,
      sum(CASE WHEN (ay > lat) <> (by_ > lat) AND ax + (bx - ax) * (lat - ay) / (by_ - ay) < lon THEN 1 ELSE 0 END) % 2 AS odd
    FROM b, (VALUES {_LINES}) l(shape, ax, ay, bx, by_) GROUP BY ALL),
  m AS (SELECT s_suppkey, bool_or(touch) AS touch, bool_or(odd = 1) AS inside FROM t GROUP BY ALL)
  SELECT s_suppkey, inside AND NOT touch AS within, inside OR touch AS meets FROM m""")
def footprint_shape(spark, sf_dir):
    """Which scenes lie within a footprint of slanted sides with a hole, and which meet it."""
    ring = lambda corners: [{"x": x, "y": y} for x, y in corners]
    foot = spark.createDataFrame([([[ring(r) for r in rings]],) for rings in _SLANTED], "parts array<array<array<struct<x:double,y:double>>>>")
    return polygons.footprint_test(supplier_scenes(spark, sf_dir).select("s_suppkey", "box"), "s_suppkey", "box", foot)


@query("SELECT c_custkey AS feature_id FROM customer WHERE c_custkey % 5 <> 0")
def index_valid_features(spark, sf_dir):
    """The features that an index is made of: of the squares, those that aren't two halves with a side in common."""
    return pipelines.feature_edges(box_features(spark, sf_dir))[0].select("feature_id")
