"""Class-balanced samples, semi-joins by selected ids, candidate pairs."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, staged
from .spatial import dense_ids


def greedy_pick(ids: list[str], classes: list[Iterable[int]], most: int, seed: int = 42) -> list[str]:
    """Ids in the order in which they are taken: shuffled; first rows that have a class below most / classes, then whatever comes next. Where no row has a class, the first rows, whatever their ids.

    The order of these steps is fixed: samples that were drawn elsewhere by the same rule and seed have to come out equal. balanced_sample has the same picks for a table.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    order = list(range(len(ids)))
    random.Random(seed).shuffle(order)
    every = {c for row in classes for c in row}
    if not every:
        return list(dict.fromkeys(ids[i] for i in order[:most]))
    taken: dict[str, None] = {}
    share, counts = most / len(every), defaultdict(int)
    for i in order:
        if len(taken) >= most:
            break
        if any(counts[c] < share for c in classes[i]):
            taken[ids[i]] = None
            for c in classes[i]:
                counts[c] += 1
    for i in order:
        if len(taken) >= most:
            break
        taken[ids[i]] = None
    return list(taken)


def shuffled_places(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """(_group, at, pos) for groups (_group, n): where Python's random.Random(seed).shuffle puts each of n elements, 0-based.

    The generator's numbers depend on each other, so those of a group come from one task, which holds none of them. A shuffle goes down from the last place i and swaps it with a drawn place;
    what a place holds in the end is what the drawn place held then, and that came there by the swap at the next larger place that had drawn it, or was there from the start. These references are
    followed by doubling, all places at once, in as many rounds as the logarithm of the longest chain.
    """
    kind = dict(sizes.dtypes)["_group"]
    spark = sizes.sparkSession

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for group, n in zip(b["_group"], b["n"], strict=True):
                rng, top = random.Random(seed), int(n) - 1
                while top > 0:
                    low = max(0, top - 100_000)
                    places = list(range(top, low, -1))
                    yield pd.DataFrame({"_group": [group] * len(places), "i": places, "j": [rng.randrange(i + 1) for i in places]})
                    top = low

    drawn = sizes.repartition("_group").mapInPandas(draws, f"_group {kind}, i long, j long")
    drawn = staged(spark, drawn, "draws")
    later = F.min("i").over(Window.partitionBy("_group", "j").orderBy("i").rowsBetween(1, 1))
    # of: where the content of a place comes from just before its own swap, itself if no larger place drew it.
    moved = drawn.where("i > j").groupBy("_group", F.col("j").alias("v")).agg(F.min("i").alias("of"))
    while True:
        ahead = moved.select("_group", F.col("v").alias("of"), F.col("of").alias("next"))
        hopped = staged(spark, moved.join(ahead, ["_group", "of"], "left").select("_group", "v", F.coalesce("next", "of").alias("of"), F.col("next").isNotNull().alias("went")), "places")
        moved = hopped.drop("went")
        if hopped.where("went").isEmpty():
            break
    source = drawn.select("_group", F.col("i").alias("pos"), later.alias("from"), "j").unionByName(sizes.where("n > 0").select("_group", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("j")))
    held = source.join(moved.withColumnRenamed("v", "from"), ["_group", "from"], "left")
    return held.select("_group", F.coalesce("of", "from", "j").alias("at"), "pos")


def first_places(sizes: DataFrame, places: int, seed: int = 42) -> DataFrame:
    """The rows of shuffled_places whose pos is below places, without a table of all draws.

    A group's draws are made twice by its task: once to keep the generator's state every so often, and then from the last, small places to the first, each stretch from its state. In that order swaps
    are undone, so of what ends in one of the first places it is known where it was before; a task holds these only.
    """
    kind = dict(sizes.dtypes)["_group"]

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for group, n in zip(b["_group"], b["n"], strict=True):
                rng, top, states = random.Random(seed), int(n) - 1, []
                while top > 0:
                    low = max(0, top - 100_000)
                    states.append((rng.getstate(), top, low))
                    for i in range(top, low, -1):
                        rng.randrange(i + 1)
                    top = low
                held = {i: i for i in range(min(places, int(n)))}
                for state, top, low in reversed(states):
                    rng.setstate(state)
                    drawn = [rng.randrange(i + 1) for i in range(top, low, -1)]
                    for i, j in zip(range(low + 1, top + 1), reversed(drawn), strict=True):
                        if i != j and (j in held or i in held):
                            one, two = held.pop(i, None), held.pop(j, None)
                            held |= {k: v for k, v in ((j, one), (i, two)) if v is not None}
                if held:
                    yield pd.DataFrame({"_group": [group] * len(held), "at": list(held), "pos": list(held.values())})

    return sizes.repartition("_group").mapInPandas(traced, f"_group {kind}, at long, pos long")


#: Shuffled rows of a region that are looked at first; a sample that ends within them needs no others.
FIRST = 1 << 16
#: Rows of a region whose places are counted together.
PLACES = 1 << 16


def _kth(rows: DataFrame, keys: list[str], k: str) -> DataFrame:
    """(keys, place) of the k-th smallest place of each group of rows (keys, place, k), where there are as many. Places are counted by range; only the range that holds the k-th is sorted."""
    rows = rows.withColumn("_range", F.floor(F.col("place") / PLACES))
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.first(k).alias("_k"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where("_before < _k AND _before + _n >= _k").select(*keys, "_range", (F.col("_k") - F.col("_before")).alias("_rank"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("place"))
    return rows.join(counts, [*keys, "_range"]).withColumn("_nth", nth).where("_nth = _rank").select(*keys, "place")


def balanced_sample(rows: DataFrame, most: int, seed: int = 42, region: str = "region", patch: str = "patch_id", classes: str = "classes", order: str = "ord") -> DataFrame:
    """(region, patch_id) of a class-balanced sample of each region, whose rows are read in order (a number): greedy_pick's picks, with no region in one task.

    A row is taken while one of its classes is below its share, so all that matters is at which row of the shuffled order each class reaches it. To begin with, none does; given these places, the rows
    taken follow, and from them new places, until they don't change. A round settles one more class of each region at least. Of regions whose sample ends within their first shuffled rows no others
    are followed. Rows that tie in order are sorted by id and classes;
    a null id is the text None, null classes are none, a null region is one too.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[region]
    flat = rows.select(F.col(region).alias("_home"), F.coalesce(F.col(patch).cast("string"), F.lit("None")).alias("_patch"), F.coalesce(F.col(classes), F.array().cast("array<int>")).alias("_classes"), F.col(order).alias("_ord"))
    # Regions are known by a text, so that a null one joins.
    flat = flat.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col("_home").cast("string")), F.lit("-")))
    flat = staged(spark, flat, "rows")
    sizes = flat.groupBy("_group").agg(F.count("*").alias("n"))
    numbered = dense_ids(flat.withColumn("_o", F.col("_ord").cast("double")), "_group", "_o", "at", ties=["_patch", "_classes"]).select("_group", "_home", "_patch", "_classes", (F.col("at") - 1).alias("at"))
    sizes, numbered = staged(spark, sizes, "sizes"), staged(spark, numbered, "numbered")
    owned = flat.select("_group", F.explode("_classes").alias("class_id")).groupBy("_group").agg(F.count_distinct("class_id").alias("m"))
    shares = staged(spark, owned.select("_group", "m", F.ceil(F.lit(float(most)) / F.col("m")).alias("k")), "shares")
    never = F.lit((1 << 62)).cast("long")

    def picked(places: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(_group, _home, _patch, place, k) of the ids at these places, and (_group, class_id, end) of their classes."""
        rows = staged(spark, numbered.join(places, ["_group", "at"]).select("_group", "_home", "_patch", "_classes", F.col("pos").alias("place")), "shuffled")
        each = rows.select("_group", "place", F.explode("_classes").alias("class_id"))
        closed = staged(spark, each.select("_group", "class_id").distinct().withColumn("end", never), "closed")
        while True:
            # A row's last class to close says whether it is taken; repeats of a class in a row count as often.
            open_until = each.join(closed, ["_group", "class_id"]).groupBy("_group", "place").agg(F.max("end").alias("end"))
            taken = staged(spark, open_until.where("end >= place").select("_group", "place"), "taken")
            reached = _kth(each.join(taken, ["_group", "place"]).join(shares, "_group"), ["_group", "class_id"], "k").withColumnRenamed("place", "now")
            now = closed.join(reached, ["_group", "class_id"], "left").select("_group", "class_id", F.coalesce("now", never).alias("end"), (F.coalesce("now", never) != F.col("end")).alias("moved"))
            now = staged(spark, now, "closed")
            if now.where("moved").isEmpty():
                break
            forget(spark, closed, taken)
            closed = now.drop("moved")
            closed._staged_path = now._staged_path
        # Ids by the pass that takes them, then by place; with no class in a region, its first rows.
        marked = rows.join(taken.withColumn("first", F.lit(0)), ["_group", "place"], "left").join(shares, "_group", "left")
        marked = marked.where(F.col("k").isNotNull() | (F.col("place") < most))
        ids = marked.groupBy("_group", "_patch").agg(F.first("_home").alias("_home"), F.min(F.struct(F.coalesce("first", F.lit(1)).alias("first"), "place")).alias("at"))
        ids = staged(spark, ids.select("_group", "_home", "_patch", (F.col("at.first") * (1 << 50) + F.col("at.place")).alias("place"), F.lit(most).cast("long").alias("k")), "ids")
        return ids, closed

    if most * 4 <= FIRST:
        ids, closed = picked(first_places(sizes, FIRST, seed))
        # The sample ends within these places if they are all, if it is full, or if all classes are and the ids suffice.
        full = closed.where(F.col("end") < never).groupBy("_group").agg(F.count("*").alias("full"))
        held = ids.groupBy("_group").agg(F.count("*").alias("ids"), F.count_if(F.col("place") < 1 << 50).alias("taken"))
        known = sizes.join(shares, "_group", "left").join(full, "_group", "left").join(held, "_group", "left")
        known = staged(spark, known.select("_group", "n", F.expr(f"n <= {FIRST} OR m IS NULL OR taken >= {most} OR (ids >= {most} AND full = m)").alias("done")), "settled")
        rest = known.where("NOT coalesce(done, false)").select("_group", "n")
        if not rest.isEmpty():
            more = picked(shuffled_places(rest, seed))[0]
            ids = ids.join(rest, "_group", "left_anti").unionByName(more)
    else:
        ids = picked(shuffled_places(sizes, seed))[0]
    last = _kth(ids, ["_group"], "k").withColumnRenamed("place", "last")
    out = ids.join(last, "_group", "left").where("last IS NULL OR place <= last")
    return out.select(F.col("_home").cast(kind).alias(region), F.col("_patch").alias(patch))


def hashed_sample(rows: DataFrame, most: int, seed: int = 42, region: str = "region", patch: str = "patch_id", classes: str = "classes") -> DataFrame:
    """(region, patch_id) of a class-balanced sample in expressions only: the first share of each class by hash, then what is missing by hash. Other picks than balanced_sample's, with its bounds; for regions of any size."""
    h = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.col(patch).cast("string")), "UTF-8"))
    flat = rows.groupBy(region, patch).agg(F.array_distinct(F.flatten(F.collect_list(classes))).alias("c")).withColumn("h", h)
    each = flat.select(region, patch, "h", F.explode("c").alias("class_id"))
    number = each.groupBy(region).agg(F.count_distinct("class_id").alias("n"))
    # No share is above most; that bound, a plain number, lets each task drop the rest of its rows before they are shuffled and sorted.
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(region, "class_id").orderBy("h", patch))).where(F.col("r") <= most).join(number, region)
    first = ranked.where(F.col("r") <= F.ceil(F.lit(most) / F.col("n"))).select(region, patch).distinct().withColumn("first", F.lit(0))
    order = F.row_number().over(Window.partitionBy(region).orderBy(F.coalesce("first", F.lit(1)), "h", patch))
    return flat.join(first, [region, patch], "left").withColumn("r", order).where(F.col("r") <= most).select(region, patch)


def keep_selected(rows: DataFrame, selected: DataFrame, key: str = "patch_id") -> DataFrame:
    """Rows whose id was selected; columns, order and repeats stay."""
    return rows.join(selected.select(F.col(key).cast(dict(rows.dtypes)[key])).distinct(), key, "left_semi")


def paired_candidates(scenes: DataFrame, tiles: DataFrame, key: str = "patch_id", order: str = "ord") -> DataFrame:
    """The last scene row of each id that has tiles too."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    kept = scenes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return kept.join(tiles.select(key).distinct(), key, "left_semi")
