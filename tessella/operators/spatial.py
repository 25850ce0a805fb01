"""Spatial index: overlap joins by grid cells, class areas, tiles, thinning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import staged

#: Grid levels: cells of level l are 2**l times the spacing. A box beyond the last one goes to as many cells of it as it touches.
LEVELS = 40
#: Pairs of rows that may meet in a cell before it is quartered, and how often at most.
DENSE, DEPTH = 1 << 24, 20


def box_level(box: Column, spacing: float) -> Column:
    """The level whose cells are as large as a box, so that it touches four of them at most."""
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(spacing)) / spacing) - 1e-9).cast("int"), F.lit(0)), F.lit(LEVELS))


def overlap_join(left: DataFrame, right: DataFrame, spacing: float, left_box: str = "box", right_box: str = "rbox") -> DataFrame:
    """Pairs of rows whose boxes share an area, with column overlap: those of box_pairs, which are found once for boxes that many rows have alike.

    Rows of a box are dealt to blocks of BLOCK, and blocks of both sides meet in as many tasks as their pairs ask for, however few rows come in.
    """
    spark = left.sparkSession
    left, right = left.drop("overlap"), right.drop("overlap")

    def dealt(df: DataFrame, box: str, at: str, block: str) -> tuple[DataFrame, DataFrame]:
        kinds = df.groupBy(box).agg(F.count("*").alias(f"{at}n")).withColumn(at, F.monotonically_increasing_id())
        kinds = staged(spark, kinds, "boxes")
        held = df.withColumn("_id", F.monotonically_increasing_id()).join(kinds.withColumnRenamed(box, "_box"), F.col(box) == F.col("_box"))
        held = held.withColumn(block, F.pmod(F.hash("_id"), F.ceil(F.col(f"{at}n") / BLOCK)).cast("int"))
        return kinds, staged(spark, held.drop("_id", "_box", f"{at}n"), "dealt")

    (boxes, one), (others, two) = dealt(left, left_box, "_p", "_i"), dealt(right, right_box, "_q", "_j")
    met = staged(spark, box_pairs(boxes, others, spacing, left_box, right_box).select("_p", "_q", "_pn", "_qn", "overlap"), "met")
    pairs = met.agg(F.sum(F.col("_pn").cast("double") * F.col("_qn"))).first()[0] or 0
    parts = int(min(pairs // TASK_PAIRS + 1, 1 << 14)) if pairs > TASK_PAIRS else None
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1))
    met = met.withColumn("_i", blocks("_pn")).withColumn("_j", blocks("_qn")).drop("_pn", "_qn")
    one = one.join(met, ["_p", "_i"])
    if parts:
        one, two = one.repartition(parts, "_q", "_j"), two.repartition(parts, "_q", "_j")
    return one.join(two, ["_q", "_j"]).select(*left.columns, *right.columns, "overlap")


#: Rows of one box that stay together, and pairs of a task, where there are more.
BLOCK, TASK_PAIRS = 1 << 10, 1 << 22


def box_pairs(left: DataFrame, right: DataFrame, spacing: float, left_box: str = "box", right_box: str = "rbox") -> DataFrame:
    """overlap_join for tables in which few rows have the same box: every row of a side is met by itself.

    Each box goes to the cells that it touches in the grid of its size, and in the coarser grids that the other side's boxes need; cells meet by an equi-join. Two boxes meet in
    the grid of the larger one, and their pair is kept in the one cell that holds the lower left corner of their overlap, so pairs come once. No box goes to more than four cells
    of a grid. spacing is the size of the smallest cells. Cells are counted first; those in which more than DENSE pairs would meet are quartered, again and again, like a quadtree,
    and where that doesn't help, as the boxes lie on top of each other, their rows are dealt to blocks that meet each other once.
    """
    # The levels that occur, LEVELS + 1 numbers at most.
    at = lambda df, box: sorted(r["l"] for r in df.select(box_level(F.col(box), spacing).alias("l")).distinct().collect() if r["l"] is not None)
    levels = {left_box: at(left, left_box), right_box: at(right, right_box)}

    def binned(df: DataFrame, box: str, other: str, own: str) -> DataFrame:
        df = df.withColumn(own, box_level(F.col(box), spacing))
        if max([*levels[box], *levels[other], 0]) == 0:
            df = df.withColumn("_level", F.lit(0))
        else:
            coarser = F.filter(F.array(*map(F.lit, levels[other])).cast("array<int>"), lambda x: x > F.col(own))
            df = df.withColumn("_level", F.explode(F.concat(F.array(own), coarser)))
        b, size = F.col(box), _cell_size(spacing)
        x = F.sequence(F.floor(b["x0"] / size), F.floor(b["x1"] / size))
        y = F.sequence(F.floor(b["y0"] / size), F.floor(b["y1"] / size))
        return df.withColumn("_cx", F.explode(x)).withColumn("_cy", F.explode(y))

    one, two = binned(left, left_box, right_box, "_ll"), binned(right, right_box, left_box, "_lr")
    one, two, size = _thinned(one, two, spacing, left_box, right_box)
    pairs = one.join(two, [c for c in [*_CELL, "_i", "_j"] if c in one.columns])
    a, b = F.col(left_box), F.col(right_box)
    first = (F.col("_cx") == F.floor(F.greatest(a["x0"], b["x0"]) / size)) & (F.col("_cy") == F.floor(F.greatest(a["y0"], b["y0"]) / size)) & (F.col("_level") == F.greatest("_ll", "_lr"))
    return pairs.where(first).withColumn("overlap", G.overlap_area(a, b)).where("overlap > 0").drop(*_CELL, "_i", "_j", "_ll", "_lr")


#: A cell: the level of its grid, how often it was quartered, and its place among cells of its size.
_CELL = ["_level", "_depth", "_cx", "_cy"]


def _cell_size(spacing: float, depth: bool = False) -> Column:
    return F.lit(spacing) * F.pow(F.lit(2.0), F.col("_level") - F.col("_depth") if depth else F.col("_level"))


def _thinned(one: DataFrame, two: DataFrame, spacing: float, left_box: str, right_box: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with cells in which no more than DENSE pairs meet, and the size of a row's cell. Of dense cells, only their rows are read again."""

    def crowded(one: DataFrame, two: DataFrame, cell: list[str]) -> DataFrame:
        rows = one.select(*cell, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(two.select(*cell, F.lit(0).alias("l"), F.lit(1).alias("r")))
        counts = rows.groupBy(*cell).agg(F.sum("l").alias("_l"), F.sum("r").alias("_r"))
        return counts.where(F.col("_l") * F.col("_r") > DENSE)

    flat = [c for c in _CELL if c != "_depth"]
    hot = crowded(one, two, flat)
    if hot.isEmpty():
        return one, two, _cell_size(spacing)
    spark = one.sparkSession
    hot = staged(spark, hot.withColumn("_depth", F.lit(0)), "crowded")
    one, two = one.withColumn("_depth", F.lit(0)), two.withColumn("_depth", F.lit(0))
    alone = lambda df, hot: df.join(hot.select(*_CELL), _CELL, "left_anti")
    done = [(alone(one, hot), alone(two, hot))]
    one, two = (staged(spark, df.join(hot.select(*_CELL), _CELL, "left_semi"), "crowded") for df in (one, two))

    def quartered(df: DataFrame, box: str) -> DataFrame:
        b, half = F.col(box), _cell_size(spacing, True) / 2
        low = lambda v, c: F.greatest(F.floor(v / half), 2 * F.col(c))
        high = lambda v, c: F.least(F.floor(v / half), 2 * F.col(c) + 1)
        df = df.withColumn("_x", F.explode(F.sequence(low(b["x0"], "_cx"), high(b["x1"], "_cx")))).withColumn("_y", F.explode(F.sequence(low(b["y0"], "_cy"), high(b["y1"], "_cy"))))
        return df.withColumns({"_cx": F.col("_x"), "_cy": F.col("_y"), "_depth": F.col("_depth") + 1}).drop("_x", "_y")

    for _ in range(DEPTH):
        fours = staged(spark, quartered(one, left_box), "crowded"), staged(spark, quartered(two, right_box), "crowded")
        above = hot.select("_level", (F.col("_depth") + 1).alias("_depth"), F.col("_cx").alias("_px"), F.col("_cy").alias("_py"), (F.col("_l") * F.col("_r")).alias("_pairs"))
        dense = crowded(*fours, _CELL).withColumn("_px", F.floor(F.col("_cx") / 2)).withColumn("_py", F.floor(F.col("_cy") / 2)).join(above, ["_level", "_depth", "_px", "_py"])
        # Quarters that hold nearly as many pairs as the whole are of boxes on top of each other.
        dense = staged(spark, dense.select(*_CELL, "_l", "_r", (F.col("_l") * F.col("_r") <= F.col("_pairs") * 0.9).alias("_better")), "crowded")
        hot, stuck = dense.where("_better"), dense.where("NOT _better")
        done.append(tuple(alone(df, dense) for df in fours))
        done.append(_dealt(*(df.join(stuck.select(*_CELL), _CELL, "left_semi") for df in fours), stuck))
        one, two = (df.join(hot.select(*_CELL), _CELL, "left_semi") for df in fours)
        if hot.isEmpty():
            break
        one, two = staged(spark, one, "crowded"), staged(spark, two, "crowded")
    else:
        done.append(_dealt(one, two, hot))
    fill = lambda df: df if "_i" in df.columns else df.withColumn("_i", F.lit(0)).withColumn("_j", F.lit(0))
    one, two = (reduce(DataFrame.unionByName, map(fill, side)) for side in zip(*done, strict=True))
    return one, two, _cell_size(spacing, True)


def _dealt(one: DataFrame, two: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of crowded cells dealt to blocks of about sqrt(DENSE): a row of the left side's block i goes to (i, j) for every block j of the right side, and the other way round."""
    side = int(DENSE**0.5)
    blocks = cells.select(*_CELL, F.ceil(F.col("_l") / side).cast("int").alias("_m"), F.ceil(F.col("_r") / side).cast("int").alias("_n"))

    def deal(df: DataFrame, own: str, other: str, count: str, others: str) -> DataFrame:
        df = df.join(blocks, _CELL).withColumn(own, F.floor(F.rand(7) * F.col(count)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_m", "_n")

    return deal(one, "_i", "_j", "_m", "_n"), deal(two, "_j", "_i", "_n", "_m")


def class_areas(pairs: DataFrame, patch: str, classes: str, patch_area: Column) -> DataFrame:
    """(patch, class_id, area, relative, absolute): a feature adds its area to each of its classes; relative sums to 1 over classes, absolute is by the patch's area."""
    each = pairs.select(patch, F.explode(classes).alias("class_id"), "overlap", patch_area.alias("patch_area"))
    sums = each.groupBy(patch, "class_id").agg(F.sum("overlap").alias("area"), F.first("patch_area").alias("patch_area"))
    whole = F.sum("area").over(Window.partitionBy(patch))
    return sums.select(patch, "class_id", "area", (F.col("area") / whole).alias("relative"), (F.col("area") / F.col("patch_area")).alias("absolute"))


def enough_classes(areas: DataFrame, patch: str, least: int) -> DataFrame:
    """Rows of the patches that have that many classes."""
    return areas.join(areas.groupBy(patch).agg(F.count("*").alias("c")).where(F.col("c") >= least).select(patch), patch, "left_semi")


def tile_overlaps(pairs: DataFrame, patch_box: str, feature_box: str, grid: int = 10) -> DataFrame:
    """pairs with tile and tile_overlap, for each tile that a feature's box shares an area with. The range of tiles follows from the bounds, so no tile is tried in vain."""
    p, f = F.col(patch_box), F.col(feature_box)
    w, h = (p["x1"] - p["x0"]) / grid, (p["y1"] - p["y0"]) / grid
    at = lambda v: F.least(F.greatest(F.floor(v).cast("int"), F.lit(0)), F.lit(grid - 1))
    cols = F.sequence(at((f["x0"] - p["x0"]) / w), at((f["x1"] - p["x0"]) / w))
    rows = F.sequence(at((p["y1"] - f["y1"]) / h), at((p["y1"] - f["y0"]) / h))
    out = pairs.withColumn("tile_row", F.explode(rows)).withColumn("tile_col", F.explode(cols)).withColumn("tile", F.col("tile_row") * grid + F.col("tile_col"))
    return out.withColumn("tile_overlap", G.overlap_area(G.tile_box(p, F.col("tile"), grid), f)).where("tile_overlap > 0")


def dominant_class(areas: DataFrame, keys: list[str], fractions: str | None = None) -> DataFrame:
    """(keys, tile_class, fraction): the class with the largest relative fraction, the lower id of equal ones; with fractions, a map of all of them under that name."""
    every = [F.map_from_entries(F.collect_list(F.struct("class_id", "relative"))).alias(fractions)] if fractions else []
    best = areas.groupBy(*keys).agg(F.max(F.struct(F.round("relative", 12).alias("r"), (-F.col("class_id")).alias("c"))).alias("b"), *every)
    return best.select(*keys, (-F.col("b.c")).alias("tile_class"), F.col("b.r").alias("fraction"), *([fractions] if fractions else []))


def tile_frame(patches: DataFrame, grid: int = 10) -> DataFrame:
    """patches with a row for each tile."""
    return patches.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))))


def thin_centers(centers: DataFrame, spacing: float, most: int = 1, rounding: str = "floor", order: str = "ord", keys: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of each grid cell, in order. A spacing of 0 or less keeps all."""
    if spacing <= 0:
        return centers
    w = Window.partitionBy(*keys, G.cell(F.col("lat"), spacing, rounding), G.cell(F.col("lon"), spacing, rounding)).orderBy(order)
    return centers.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def dense_ids(rows: DataFrame, region: str, order: str, out: str = "patch_id", ranges: int = 64, ties: list[str] | None = None) -> DataFrame:
    """out: 1, 2, ... by order, then ties, within each region.

    Rows are numbered within hash-free ranges of order (its quantiles), and ranges are offset by what comes before them, so a region of any size takes many tasks.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("_range", at)
    counts = dealt.groupBy(region, "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(region).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(region).alias("_region"), F.col("_range").alias("_at"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy(region, "_range").orderBy(order, *(ties or [])))
    joined = dealt.join(counts, dealt[region].eqNullSafe(F.col("_region")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(out, (n + F.col("_before")).cast("long")).drop("_range", "_region", "_at", "_before")


def box_union_area(boxes: DataFrame, key: str, box: str, cells: int = 16) -> DataFrame:
    """(key, covered): area of the union of each key's boxes.

    Each key's bounds are cut into cells x cells; boxes are clipped to the cells that they meet, so what overlaps stays with few others even where a key has very many boxes, and
    a key is many groups. In a cell, coordinates are compressed: slabs between neighbouring x bounds, and in each the union of y intervals.
    """
    b = F.col(box)
    # A box that a key has several times covers no more.
    flat = boxes.where((b["x1"] > b["x0"]) & (b["y1"] > b["y0"])).select(key, *(b[k].alias(k) for k in ("x0", "y0", "x1", "y1"))).distinct()
    bounds = flat.groupBy(F.col(key).alias("_k")).agg(F.min("x0").alias("l"), F.min("y0").alias("b"), ((F.max("x1") - F.min("x0")) / cells).alias("w"), ((F.max("y1") - F.min("y0")) / cells).alias("h"))
    at = lambda v, low, size: F.least(F.greatest(F.floor((F.col(v) - F.col(low)) / F.col(size)), F.lit(0)), F.lit(cells - 1))
    cut = flat.join(bounds, F.col(key).eqNullSafe(F.col("_k"))).withColumn("cx", F.explode(F.sequence(at("x0", "l", "w"), at("x1", "l", "w")))).withColumn("cy", F.explode(F.sequence(at("y0", "b", "h"), at("y1", "b", "h"))))
    low = lambda v, low, size, c: F.greatest(F.col(v), F.col(low) + F.col(c) * F.col(size))
    high = lambda v, low, size, c: F.least(F.col(v), F.when(F.col(c) < cells - 1, F.col(low) + (F.col(c) + 1) * F.col(size)).otherwise(F.col(v)))
    cut = cut.select(key, "cx", "cy", low("x0", "l", "w", "cx").alias("x0"), low("y0", "b", "h", "cy").alias("y0"), high("x1", "l", "w", "cx").alias("x1"), high("y1", "b", "h", "cy").alias("y1")).where("x1 > x0 AND y1 > y0")
    cell = [key, "cx", "cy"]
    edges = cut.select(*cell, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = edges.withColumn("x2", F.lead("x").over(Window.partitionBy(*cell).orderBy("x"))).where("x2 IS NOT NULL")
    held = cut.select(F.col(key).alias("_k"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), "y0", "y1")
    within = slabs.join(held, F.col(key).eqNullSafe(F.col("_k")) & (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")) & (F.col("bx0") <= F.col("x")) & (F.col("bx1") >= F.col("x2")))
    top = F.max("y1").over(Window.partitionBy(*cell, "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    lengths = within.withColumn("top", top).select(key, "x", "x2", F.greatest(F.col("y1") - F.greatest("y0", F.coalesce("top", "y0")), F.lit(0.0)).alias("height"))
    return lengths.groupBy(key).agg(F.sum(F.col("height") * (F.col("x2") - F.col("x"))).alias("covered"))
