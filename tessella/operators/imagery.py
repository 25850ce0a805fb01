"""Image metadata: acquisition choice, time windows, masks, validity, pair states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each group, the greater tie of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def source_filter(images: DataFrame, cloud_below: float, start: str, end: str) -> DataFrame:
    """Images with less cloud than that, from start to before end."""
    return images.where((F.col("cloud") < cloud_below) & (F.col("time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("time") < F.lit(end).cast("timestamp_ntz")))


def time_window(time: Column, start: str, end: str, pad_days: int) -> Column:
    """struct(start date, end date, tag): the time plus and minus the pad, cut to the defaults; the defaults themselves where nothing is left.

    The greater and the smaller of two times are compared as times; the result is their dates.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    pad = F.expr(f"interval {pad_days} days")
    s, e = F.greatest(lo, time - pad), F.least(hi, time + pad)
    return F.when(s >= e, F.struct(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"), F.lit("default").alias("tag"))).otherwise(F.struct(s.cast("date").alias("start"), e.cast("date").alias("end"), F.lit("aligned").alias("tag")))


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz")


def first_success(tries: DataFrame, key: str, order: str, success: str) -> DataFrame:
    """The first of the ordered tries of each key that succeeded."""
    return tries.where(success).groupBy(key).agg(F.min_by(F.struct(*[c for c in tries.columns if c != key]), order).alias("t")).select(key, "t.*")


def masked_median(pixels: DataFrame, keys: list[str], code: str, masked: tuple, value: str, divisor: float = 10_000.0) -> DataFrame:
    """(keys, median): of value / divisor, without masked codes; interpolated."""
    return pixels.where(~F.col(code).isin(*masked)).groupBy(*keys).agg(F.median(F.col(value) / divisor).alias("median"))


def image_valid(pixels: Column, threshold: float = 0.25, dark: int = 5, mode: str = "all_channels") -> Column:
    """pixels: array<array<int>> of channels. A pixel is dark if all (or any) channels are at most `dark`; valid if the share of dark ones is below the threshold. Null or empty images aren't valid."""
    test = F.forall if mode == "all_channels" else F.exists
    share = F.size(F.filter(pixels, lambda p: test(p, lambda x: x <= dark))) / F.size(pixels)
    return F.coalesce((F.size(pixels) > 0) & (share < threshold), F.lit(False))


def pair_status(lr_exists: Column, hr_folder: Column, tiles: Column, tiles_valid: Column, lr_valid: Column, expected: int = 100) -> Column:
    """complete: all there and valid; invalid: all there, some not valid; missing: neither image nor folder; incomplete: the rest."""
    whole = lr_exists & hr_folder & (tiles == expected)
    return F.when(whole & lr_valid & (tiles_valid == expected), "complete").when(whole, "invalid").when(~lr_exists & ~hr_folder, "missing").otherwise("incomplete")


def next_action(status: Column, overwrite: bool = False, repair: bool = False) -> Column:
    """existing, error, repair or download."""
    done = F.when(status == "complete", "repair" if overwrite else "existing")
    return done.when(status == "missing", "download").otherwise("repair" if overwrite or repair else "error")


def crop_tiles(width: int, height: int, grid: int = 10) -> list[tuple[int, int, int, int, int]]:
    """(tile, left, top, right, bottom) in pixels: integer tile sizes, what is left over at the right and bottom is dropped."""
    w, h = width // grid, height // grid
    return [(r * grid + c, c * w, r * h, (c + 1) * w, (r + 1) * h) for r in range(grid) for c in range(grid)]


def normalised_pixels(pixels: Column, mean: list[float], std: list[float], scale: float = 255.0) -> Column:
    """array<array<double>> of channels: (x / scale - mean) / std for each channel of each pixel of array<array<int>>."""
    m, s = F.array(*map(F.lit, map(float, mean))), F.array(*map(F.lit, map(float, std)))
    return F.transform(pixels, lambda p: F.transform(p, lambda x, i: (x / scale - F.get(m, i)) / F.get(s, i)))


def padded_rows(rows: Column, size: int, fill: float = 0.0) -> Column:
    """array<array<double>> of a size x size grid from a smaller one (rows of equal length): centred, with the greater half of an odd rest at the bottom and right."""
    none = lambda n: F.array_repeat(F.lit(fill), n)
    around = lambda a, n, make: F.concat(make(F.floor((size - n) / 2).cast("int")), a, make((size - n - F.floor((size - n) / 2)).cast("int")))
    wide = F.transform(rows, lambda r: around(r, F.size(r), none))
    return around(wide, F.size(wide), lambda n: F.array_repeat(none(F.lit(size)), n))


def replace_pairs(done: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """done with the rows of fresh instead of those that have their keys: what a repair leaves. Nothing else of done is touched, and no file is deleted."""
    return done.join(fresh.select(*keys).distinct(), keys, "left_anti").select(*done.columns).unionByName(fresh.select(*done.columns))
