"""Which tiles to observe, and putting what was observed together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def router_topk(scores: DataFrame, k: int, sample: str = "sample_idx", tile: str = "tile", score: str = "score") -> DataFrame:
    """The k best tiles of each sample, with rank from 1; the lower tile of equal ones."""
    rank = F.row_number().over(Window.partitionBy(sample).orderBy(F.desc(score), tile))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def nested_prefixes(ranked: DataFrame, counts: list[int], sample: str = "sample_idx") -> DataFrame:
    """(sample, count, tiles): for each distinct count, 0 included, the first tiles of one ranking. The ranking is made once, for the largest."""
    wanted = sorted({0, *counts})
    lists = ranked.where(F.col("rank") <= max(wanted)).groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tile"))), lambda x: x["tile"]).alias("all"))
    return lists.select(sample, "all", F.explode(F.array(*map(F.lit, wanted))).alias("count")).select(sample, "count", F.slice("all", 1, F.col("count")).alias("tiles"))


def policy_valid(policy: DataFrame, classes: int) -> None:
    """The policy has each class once and counts from 0 to 100."""
    r = policy.agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("d"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.min("pc").alias("pl"), F.max("pc").alias("ph")).first()
    if (r["n"], r["d"], r["lo"], r["hi"]) != (classes, classes, 0, classes - 1):
        raise ValueError("policy classes must be 0..C-1, once each")
    if r["pl"] < 0 or r["ph"] > 100:
        raise ValueError("counts must be in [0, 100]")


def policy_gather(scores: DataFrame, policy: DataFrame) -> DataFrame:
    """Of scores (sample_idx, class_id, pc, score), each class's row at its policy's count. A count that has no row is an error."""
    policy = policy.select("class_id", "pc")
    missing = policy.join(scores.select("class_id", "pc").distinct(), ["class_id", "pc"], "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no score rows for {[tuple(r) for r in missing]}")
    return scores.join(policy, ["class_id", "pc"])


def resolve_count(queries: DataFrame, policy: DataFrame, default: int, name: str = "name") -> DataFrame:
    """queries with pc: that of a known class name, else the default."""
    return queries.join(policy.select(name, "pc"), name, "left").withColumn("pc", F.coalesce("pc", F.lit(default)))


def observation_ratio(selected: DataFrame, count: str = "selected_count", tiles: int = 100) -> DataFrame:
    """One row (used_ratio): the mean of selected counts by the number of tiles."""
    return selected.agg((F.avg(count) / tiles).alias("used_ratio"))


def policy_ratio(policy: DataFrame, tiles: int = 100) -> DataFrame:
    """One row (ratio): all counts of a policy by all tiles of all classes."""
    return policy.agg((F.sum("pc") / (tiles * F.count("*"))).alias("ratio"))


def fill_cells(samples: DataFrame, observed: DataFrame, mask: float, cells: int = 100, sample: str = "sample_idx") -> DataFrame:
    """(sample, tile, value, seen): every cell, with the observed value or the mask's.

    Only samples and observed cells are shuffled and sorted: each of them, in order of tiles, is followed by the cells up to the next one. A cell that was observed several times is there as often.
    """
    kind, tile = dict(samples.dtypes)[sample], F.col("tile")
    # A sample comes before its cells as tile -1.
    start = samples.select(sample).distinct().select(sample, F.lit(-1).alias("tile"), F.lit(None).cast(dict(observed.dtypes)["value"]).alias("value"))
    found = observed.where(F.col(sample).isNotNull() & tile.between(0, cells - 1) & (tile % 1 == 0)).select(sample, tile.cast("int").alias("tile"), "value")
    order = Window.partitionBy(sample).orderBy("tile")
    rows = start.unionByName(found).select(sample, "tile", "value", F.first("tile").over(order).alias("_first"), F.coalesce(F.lead("tile").over(order), F.lit(cells)).alias("_next")).where("_first = -1")
    each = rows.select(sample, F.col("tile").alias("_own"), "value", F.explode(F.sequence(tile, F.greatest(tile, F.col("_next") - 1))).alias("tile")).where("tile >= 0")
    value = F.when(tile == F.col("_own"), F.col("value"))
    return each.select(F.col(sample).cast(kind).alias(sample), "tile", F.coalesce(value, F.lit(mask)).alias("value"), value.isNotNull().alias("seen"))


def pool_scores(scores: DataFrame, mode: str, keys: tuple[str, ...] = ("sample_idx", "class_id"), value: str = "score") -> DataFrame:
    """(keys, score) over cells: max, mean, or the mean of both."""
    s = F.col(value)
    ways = {"max": F.max(s), "mean": F.avg(s), "mean_max": (F.avg(s) + F.max(s)) / 2}
    if mode not in ways:
        raise ValueError(f"unknown pool mode {mode}")
    return scores.groupBy(*keys).agg(ways[mode].alias("score"))


#: The ways to pool the features of a sample's cells, by their fixed names.
POOLS = ("patch_score_max", "raw_feature_max", "raw_feature_mean", "raw_feature_mean_max")


def pool_features(features: DataFrame, text: DataFrame, mode: str, keys: tuple[str, ...] = ("sample_idx",), feature: str = "feature") -> DataFrame:
    """(keys, class_id, score): cosines of text vectors (class_id, proto) with features (keys, feature) of cells, pooled: the best cell's, or that of the componentwise max, mean, or mean of both.

    There is one text vector for each class. Components are pooled by key and place, so a sample may have any number of cells.
    """
    if mode not in POOLS:
        raise ValueError(f"unknown pool mode {mode}")
    if mode != "patch_score_max":
        return pool_raw_features(features, text, (mode,), keys, feature).withColumnRenamed(mode, "score")
    cells = _against(features.select(*keys, S.l2_normalise(F.col(feature)).alias("_f")), text)
    return cells.select(*keys, "class_id", S.dot(F.col("_f"), F.col("_t")).alias("_s")).groupBy(*keys, "class_id").agg(F.max("_s").alias("score"))


def _against(rows: DataFrame, text: DataFrame) -> DataFrame:
    """Every row with every class. Classes are few; their size isn't known from files, and a product with a table that isn't broadcast would make it again for each part of rows."""
    return rows.crossJoin(F.broadcast(text.select("class_id", S.l2_normalise(F.col("proto")).alias("_t"))))


def pool_raw_features(features: DataFrame, text: DataFrame, modes: tuple[str, ...] = POOLS[1:], keys: tuple[str, ...] = ("sample_idx",), feature: str = "feature") -> DataFrame:
    """(keys, class_id, a column for each mode): scores of pool_features for several ways to pool raw features, all from one pass over components."""
    v = F.col("_v")
    ways = {"raw_feature_max": F.max(v), "raw_feature_mean": F.avg(v), "raw_feature_mean_max": (F.avg(v) + F.max(v)) / 2}
    by_place = features.select(*keys, F.posexplode(feature).alias("_i", "_v")).groupBy(*keys, "_i").agg(*(ways[m].alias(m) for m in modes))
    places = by_place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", *modes))).alias("_p"))
    rows = places.select(*keys, *(S.l2_normalise(F.col("_p").getField(m)).alias(m) for m in modes))
    return _against(rows, text).select(*keys, "class_id", *(S.dot(F.col(m), F.col("_t")).alias(m) for m in modes))


def ensemble(rows: DataFrame, keys: tuple[str, ...] = ("class_id",), vector: str = "vector") -> DataFrame:
    """(keys, proto): of each key, the mean of its vectors, such as those of a class's prompts, each of length 1, brought to length 1. Components are averaged by place, so a key may have any number of vectors."""
    each = rows.select(*keys, F.posexplode(S.l2_normalise(F.col(vector))).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg("_v").alias("_m"))
    whole = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("_p"))
    return whole.select(*keys, S.l2_normalise(F.col("_p")).alias("proto"))


def adaptive_pool(cells: DataFrame, size: int, to: int, keys: tuple[str, ...] = ("sample_idx",)) -> DataFrame:
    """(keys, row, col, value): mean of a size x size grid (row, col, value) in to x to bins, whose bounds are floor(i * size / to) and ceil((i + 1) * size / to)."""
    bounds = [(i * size // to, -(-(i + 1) * size // to)) for i in range(to)]
    bins = lambda c: F.explode(F.array_compact(F.array(*(F.when((F.col(c) >= s) & (F.col(c) < e), F.lit(i)) for i, (s, e) in enumerate(bounds)))))
    out = cells.withColumn("_r", bins("row")).withColumn("_c", bins("col"))
    return out.groupBy(*keys, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.avg("value").alias("value"))
