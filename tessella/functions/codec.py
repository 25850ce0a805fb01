"""Text encodings of classes, fractions, scene names, labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let


def parse_classes(c: Column) -> Column:
    """`1|2|3` to array<int>; blank parts are skipped, null or empty gives an empty array, anything else that is no number is an error."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "[|]"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.trim(p).cast("int"))


def parse_fractions(c: Column) -> Column:
    """`k:v|k:v` to map<int,double>."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "[|]"), lambda p: F.trim(p) != "")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double"))))


def half_even(x: Column, digits: int) -> Column:
    """x as text with that many decimals (15 at most), rounded half to even on the exact binary value; Spark's own formatting rounds the shortest decimal text.

    The fraction times 10**digits is worked out as a double and the exact rest of the product, by splitting both factors; the rest decides where the double ends in a half.
    Null and NaN give null; whole parts of 38 digits and more, too.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must be from 0 to 15")
    power = 10.0**digits
    high = power * 134217729.0 - (power * 134217729.0 - power)
    low = power - high

    def parts(a: Column) -> Column:
        """Whole part, and the fraction times the power with its rest."""
        f = a - F.floor(a).cast("double")
        c = F.lit(134217729.0) * f
        top = c - (c - f)
        product = f * F.lit(power)
        rest = ((top * F.lit(high) - product) + top * F.lit(low) + (f - top) * F.lit(high)) + (f - top) * F.lit(low)
        return F.struct(product.alias("p"), rest.alias("e"))

    def rounded(s: Column) -> Column:
        down = F.floor(s["p"])
        half = s["p"] - down.cast("double") == 0.5
        return F.when(half & (s["e"] > 0), down + 1).when(half & (s["e"] < 0), down).otherwise(F.rint(s["p"]).cast("long"))

    def text(a: Column) -> Column:
        whole = F.floor(a).cast("decimal(38,0)")

        def joined(n: Column) -> Column:
            carried = (whole + F.when(n >= int(power), 1).otherwise(0).cast("decimal(1,0)")).cast("decimal(38,0)").cast("string")
            return F.concat(carried, F.lit("."), F.lpad((n % int(power)).cast("string"), digits, "0")) if digits else carried

        # Without decimals, half to even is about the whole number.
        if not digits:
            return F.when(a < 2.0**52, F.rint(a).cast("decimal(38,0)").cast("string")).otherwise(_exact_whole(a).cast("string"))
        return F.when(a < 2.0**52, let(let(parts(a), rounded), joined)).otherwise(F.concat(_exact_whole(a).cast("string"), F.lit("." + "0" * digits)))

    def signed(v: Column) -> Column:
        sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
        return F.when(F.isnan(v), None).when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf"))).when(F.abs(v) < 1e37, F.concat(sign, text(F.abs(v))))

    return let(x.cast("double"), signed)


def _exact_whole(a: Column) -> Column:
    """A double of 2**52 or more, which is whole, as a decimal: its parts above and below 2**62 are exact longs."""
    above = F.floor(a / F.lit(2.0**62))
    below = (a - above.cast("double") * F.lit(2.0**62)).cast("long")
    return (above.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + below.cast("decimal(19,0)")).cast("decimal(38,0)")


def encode_fractions(m: Column, digits: int) -> Column:
    """map<int,double> to `k:v|k:v`, sorted by key."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), half_even(e["value"], digits))), "|")


def encode_classes(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def format_scene_name(scene_id: Column, lat: Column, lon: Column, classes: Column) -> Column:
    """Id padded to five digits, centre with six decimals, then class ids, or no_class where there is none."""
    number = F.when(F.length(scene_id.cast("string")) < 5, F.lpad(scene_id.cast("string"), 5, "0")).otherwise(scene_id.cast("string"))
    tail = F.when(F.size(classes) > 0, F.array_join(F.transform(classes, lambda x: x.cast("string")), "_")).otherwise(F.lit("no_class"))
    return F.concat_ws("_", number, half_even(lat, 6), half_even(lon, 6), tail)


def parse_scene_name(name: Column) -> Column:
    """struct(scene_id, lat, lon, labels) from the stem of a file name; null where it isn't one."""
    # The stem of a name without suffix would lose its last decimals, so only a known suffix is cut.
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.(jpg|jpeg|png|tif)$", "")
    parts = F.split(stem, "_")
    labels = F.transform(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), lambda p: F.try_to_number(p, F.lit("999999999")).cast("int"))
    made = F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("scene_id"), F.get(parts, F.lit(1)).try_cast("double").alias("lat"), F.get(parts, F.lit(2)).try_cast("double").alias("lon"), labels.alias("labels"))
    fine = (F.size(parts) >= 4) & made["scene_id"].isNotNull() & made["lat"].isNotNull() & made["lon"].isNotNull() & ~F.exists(made["labels"], lambda x: x.isNull())
    return F.when(fine, made)


def present(c: Column) -> Column:
    """A label cell: null and blank text are no label."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def multi_hot(labels: Column, classes: int) -> Column:
    """array<tinyint> of 0 and 1; nulls are skipped, repeats count once. Ids outside the vocabulary are an error, negative ones too."""
    clean = F.array_compact(labels)
    checked = F.when(F.exists(clean, lambda x: (x < 0) | (x >= classes)), F.raise_error(F.lit(f"label outside 0..{classes - 1}"))).otherwise(clean)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(checked, i).cast("tinyint"))


def padded(labels: Column, width: int, prefix: str = "label_") -> list[Column]:
    """Columns label_0..label_{width-1}, null beyond the array."""
    return [F.get(labels, F.lit(i)).alias(f"{prefix}{i}") for i in range(width)]


def render(template: str, **values: Column) -> Column:
    """template with each {name} replaced by a column."""
    out: Column = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), c.cast("string"))
    return out


def scene_path(path: Column) -> Column:
    """struct(region, file) of REGION/LR/file; null for anything else."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when((n >= 3) & (F.get(parts, n - 2) == "LR"), F.struct(F.get(parts, n - 3).alias("region"), F.get(parts, n - 1).alias("file")))


def tile_path(path: Column, tile: Column) -> Column:
    """Path of a tile image beside the scene image: REGION/HR/stem/tile.jpg."""
    p = scene_path(path)
    return F.concat_ws("/", p["region"], F.lit("HR"), F.regexp_replace(p["file"], r"\.[^.]*$", ""), F.concat(tile.cast("string"), F.lit(".jpg")))


def under_root(root: str, path: Column) -> Column:
    """The last three parts of a path, under another root."""
    return F.concat_ws("/", F.lit(root), F.array_join(F.slice(F.split(path, "/"), -3, 3), "/"))
