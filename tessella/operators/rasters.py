"""Pixels as tables: resizing by separable filters, and tiles cut from mosaics that are kept by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half the width of each filter, in pixels of the coarser grid.
SUPPORT = {"bilinear": 1.0, "bicubic": 2.0}


def _filter(x: Column, kind: str) -> Column:
    """The triangle, or the cubic convolution kernel with a = -0.5."""
    x = F.abs(x)
    if kind == "bilinear":
        return F.greatest(1 - x, F.lit(0.0))
    near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
    return F.when(x < 1, near).when(x < 2, far).otherwise(0.0)


def resize_weights(sizes: DataFrame, size: str, out: int, kind: str = "bicubic") -> DataFrame:
    """(size, to, at, weight) for each length of a side in sizes: how much pixel `at` adds to pixel `to` of `out` pixels.

    Where a side is made shorter the filter is as much wider, so that all pixels count; weights of a pixel add up to 1.
    """
    if kind not in SUPPORT or out < 1:
        raise ValueError("a filter that is known, and at least one pixel")
    n = F.col(size)
    scale = n / F.lit(float(out))
    wide = F.greatest(scale, F.lit(1.0))
    each = sizes.select(size).where(n > 0).distinct().withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(out - 1))))
    centre = (F.col("to") + 0.5) * scale
    reach = SUPPORT[kind] * wide
    first, last = F.greatest(F.floor(centre - reach + 0.5), F.lit(0)), F.least(F.floor(centre + reach + 0.5), n.cast("long")) - 1
    each = each.withColumn("_centre", centre).withColumn("_wide", wide).withColumn("at", F.explode(F.sequence(first, last)))
    each = each.withColumn("_w", _filter((F.col("at") - F.col("_centre") + 0.5) / F.col("_wide"), kind))
    sums = each.groupBy(size, "to").agg(F.sum("_w").alias("_sum"))
    return each.join(sums, [size, "to"]).select(size, "to", F.col("at").cast("int").alias("at"), (F.col("_w") / F.col("_sum")).alias("weight"))


def resized(pixels: DataFrame, width: int, height: int, kind: str = "bicubic", keys: tuple[str, ...] = ("image",), value: str = "value", x: str = "x", y: str = "y", top: float | None = None) -> DataFrame:
    """(keys, y, x, value) of images of width x height from pixels (keys, y, x, value) of images of any size; keys may hold a channel.

    Columns are resized first, then rows. Weights depend on the length of a side only, and meet pixels by equi-joins; an image may be larger than a task's memory.
    With top, values are rounded to whole numbers from 0 to top after either step, as in an image of bytes. An image's size follows from its last row and column; pixels that aren't there add nothing.
    """
    sizes = pixels.groupBy(*keys).agg((F.max(x) + 1).cast("int").alias("_width"), (F.max(y) + 1).cast("int").alias("_height"))
    held = pixels.select(*keys, F.col(x).cast("int").alias("_x"), F.col(y).cast("int").alias("_y"), F.col(value).cast("double").alias("_v")).join(sizes, list(keys))
    across = resize_weights(sizes, "_width", width, kind).withColumnsRenamed({"to": "_to_x", "at": "_x"})
    sums = F.sum(F.col("_v") * F.col("weight"))
    sums = sums if top is None else F.least(F.greatest(F.floor(sums + 0.5).cast("double"), F.lit(0.0)), F.lit(float(top)))
    wide = held.join(across, ["_width", "_x"]).groupBy(*keys, "_height", "_y", "_to_x").agg(sums.alias("_v"))
    down = resize_weights(sizes, "_height", height, kind).withColumnsRenamed({"to": "_to_y", "at": "_y"})
    done = wide.join(down, ["_height", "_y"]).groupBy(*keys, "_to_y", "_to_x").agg(sums.alias("_v"))
    return done.select(*keys, F.col("_to_y").alias(y), F.col("_to_x").alias(x), F.col("_v").alias(value))


def mosaic_tiles(rows: DataFrame, grid: int = 10, keys: tuple[str, ...] = ("mosaic",), y: str = "y", pixels: str = "pixels") -> DataFrame:
    """(keys, tile, tile_row, tile_col, pixels) of grid x grid tiles of mosaics that are kept as rows of pixels (keys, y, pixels array): an array of rows.

    Tiles are of whole pixels; what is left over at the right and at the bottom is dropped. A mosaic's width is that of its shortest row, its height follows from its last row. A row
    is cut where it is, and only the rows of one tile meet. A mosaic with fewer pixels than tiles on a side has none.
    """
    sizes = rows.groupBy(*keys).agg(F.floor(F.min(F.size(pixels)) / grid).cast("int").alias("_w"), F.floor((F.max(y) + 1) / grid).cast("int").alias("_h"))
    held = rows.join(sizes.where("_w > 0 AND _h > 0"), list(keys)).where(F.col(y) < F.col("_h") * grid)
    held = held.withColumn("tile_row", F.floor(F.col(y) / F.col("_h")).cast("int")).withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    cut = held.select(*keys, "tile_row", "tile_col", F.struct((F.col(y) % F.col("_h")).alias("y"), F.slice(F.col(pixels), F.col("tile_col") * F.col("_w") + 1, F.col("_w")).alias("p")).alias("r"))
    tiles = cut.groupBy(*keys, "tile_row", "tile_col").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["p"]).alias("pixels"))
    return tiles.select(*keys, (F.col("tile_row") * grid + F.col("tile_col")).alias("tile"), "tile_row", "tile_col", "pixels")
