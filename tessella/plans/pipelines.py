"""The stages end to end: index building, sampling, splits, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataProfile, Policy, RobustStatistics
from ..functions import geometry as G
from ..functions import scores as S
from ..functions import tags as T
from ..operators import metrics, models, polygons, sampling, selection, shards, spatial, splits
from ..storage import forget, staged


def classified_features(features: DataFrame) -> DataFrame:
    """Features with a key of the whitelist and a class, with class_ids and parts.

    A feature is one polygon, rings: its outer ring, then holes; or several, parts: an array of such rings.
    """
    parts = F.col("parts") if "parts" in features.columns else F.array("rings")
    kept = features.where(T.whitelisted(F.col("tags"))).withColumn("parts", parts).where(F.size("parts") > 0)
    return kept.withColumn("class_ids", T.classify(F.col("tags"))).where(F.size("class_ids") > 0)


def one_box(footprint: DataFrame | None) -> Column | None:
    """The box of a footprint table as a literal; none for no table, an error unless it has one row. See readers.dissolved for several."""
    if footprint is None:
        return None
    rows = footprint.select("box").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a footprint has to be one box")
    return F.struct(*(F.lit(rows[0]["box"][k]).alias(k) for k in ("x0", "y0", "x1", "y1")))


def within_footprint(boxes: DataFrame, key: str, box: str, footprint: DataFrame | None, predicate: str) -> DataFrame:
    """Rows of boxes that a footprint holds (covers, contains) or meets (intersects): the union of its polygons if it has a column parts, else its one box. No footprint keeps all."""
    if footprint is None:
        return boxes
    if "parts" not in footprint.columns:
        return boxes.where(G.footprint_keeps(one_box(footprint), F.col(box), predicate))
    found = polygons.footprint_test(boxes, key, box, footprint).where("meets" if predicate == "intersects" else "within")
    return boxes.join(found.select(key), key, "left_semi")


def feature_edges(features: DataFrame, invalid: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(features, edges), both staged: uid, feature_id, ord, class_ids, fbox, lat, lon of classified features, and the edges of each uid.

    Features of the same parts and tags share a uid, so they are classified, taken to edges and tested once. lat and lon are the centroid's. Shapes that aren't valid (polygons.invalid_shapes)
    are left out; with invalid="keep" only polygons whose outer ring has fewer than three corners.
    """
    if invalid not in ("drop", "keep"):
        raise ValueError("invalid is drop or keep")
    spark = features.sparkSession
    parts = F.col("parts") if "parts" in features.columns else F.array("rings")
    each = features.withColumn("parts", parts).where(F.size("parts") > 0).select("feature_id", "ord", "parts", F.array_sort(F.map_entries("tags")).alias("_tags"))
    # Staged, as the rules would else be tried on every feature before they are grouped.
    kinds = staged(spark, each.groupBy("parts", "_tags").agg(F.count("*").alias("n")), "kinds")
    shapes = staged(spark, classified_features(kinds.withColumn("tags", F.map_from_entries("_tags"))).select("parts", "_tags", "class_ids", F.monotonically_increasing_id().alias("uid")), "shapes")
    edges = staged(spark, polygons.edge_rows(shapes, "parts", "uid"), "edges")
    if invalid == "drop":
        sound, every = edges, edges.join(polygons.invalid_shapes(edges, "uid").select("uid").distinct(), "uid", "left_anti")
    else:
        short = edges.where("ring = 0 AND n < 3").select("uid", "part").distinct()
        sound, every = edges, edges.join(short, ["uid", "part"], "left_anti")
    edges = staged(spark, every, "edges")
    facts = staged(spark, shapes.join(polygons.shape_facts(edges, "uid").withColumnRenamed("box", "fbox"), "uid"), "facts")
    # Features may be made of keys, so their size isn't known from their files: neither side is broadcast.
    found = staged(spark, each.hint("merge").join(facts, (each["parts"] == facts["parts"]) & each["_tags"].eqNullSafe(facts["_tags"])).select("uid", "feature_id", "ord", "class_ids", "fbox", "area", "lat", "lon"), "features")
    forget(spark, kinds, shapes, facts, sound)
    return found, edges


def build_index(
    features: DataFrame, region: str, footprint: DataFrame | None = None, tile_footprint: DataFrame | None = None, predicate: str = "covers", halfwidth: float = 0.0012, scale: float = 10, grid: int = 10,
    least_classes: int = 2, coverage_min: float = 0.0, spacing: float = 0.01, limit: int | None = None, invalid: str = "drop", bare: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(scenes, tiles) of one region: centres of features thinned by grid, boxes around them, overlapped with features, classes by area, dense ids.

    limit counts centres before scenes are rejected. Areas are those of polygons within boxes. Scenes have to lie within footprint (predicate: covers or contains) and tiles
    to meet tile_footprint, tables of polygons (parts) or of one box; a scene without any tile is left out unless bare. coverage_min is the least share of a scene that the union of its
    features covers. Shapes that aren't valid are left out (invalid="keep" keeps them). Scenes are made at once; tiles are made when they are read.
    """
    spark = features.sparkSession
    features, edges = feature_edges(features, invalid)
    centres = spatial.thin_centers(features.select("ord", "lat", "lon"), spacing)
    if limit is not None:
        centres = centres.orderBy("ord").limit(limit)
    side = 2 * halfwidth * scale
    patches = centres.withColumn("box", G.box_around(F.col("lat"), F.col("lon"), halfwidth, scale=scale)).select(F.col("ord").alias("center"), "lat", "lon", "box")
    patches = staged(spark, within_footprint(patches, "center", "box", footprint, predicate), "patches")
    # Shapes with the number n of features that have them.
    shapes = staged(spark, features.groupBy("uid").agg(F.first("class_ids").alias("class_ids"), F.first("fbox").alias("fbox"), F.count("*").alias("n")), "kinds")
    met = spatial.box_pairs(patches, shapes, side, "box", "fbox").drop("overlap")
    pairs = polygons.areas_within(met, edges, "uid", "box", ["center", "uid"], ["box", "fbox", "class_ids", "n"])
    pairs = staged(spark, pairs.withColumn("overlap", F.col("area") * F.col("n")).drop("area"), "pairs")
    areas = spatial.enough_classes(spatial.class_areas(pairs, "center", "class_ids", G.area(F.col("box"))), "center", least_classes)
    if coverage_min > 0:
        covered = polygons.union_areas(pairs.select("center", "uid", "box").join(edges, "uid"), "center", "uid", "box")
        areas = areas.join(covered.where(F.col("covered") / (side * side) >= coverage_min).select("center"), "center", "left_semi")
    entry = F.struct("class_id", "relative")
    scenes = areas.groupBy("center").agg(F.array_sort(F.collect_list("class_id")).alias("classes"), F.map_from_entries(F.collect_list(entry)).alias("class_fracs"), F.map_from_entries(F.collect_list(F.struct("class_id", "absolute"))).alias("class_fracs_abs"))
    scenes = staged(spark, scenes.join(patches, "center").withColumn("region", F.lit(region)), "scenes")
    frame = spatial.tile_frame(scenes.select("center", "box"), grid).withColumn("tbox", G.tile_box(F.col("box"), F.col("tile"), grid)).drop("box")
    if tile_footprint is not None:
        frame = staged(spark, within_footprint(frame.withColumn("at", F.struct("center", "tile")), "at", "tbox", tile_footprint, "intersects").drop("at"), "frame")
        if not bare:
            scenes = scenes.join(frame.select("center").distinct(), "center", "left_semi")
    scenes = staged(spark, spatial.dense_ids(scenes, "region", "center"), "scenes")

    cut = spatial.tile_overlaps(pairs.drop("overlap").join(scenes.select("center", "patch_id"), "center"), "box", "fbox", grid).withColumn("box", G.tile_box(F.col("box"), F.col("tile"), grid))
    cut = polygons.areas_within(cut, edges, "uid", "box", ["patch_id", "tile", "uid"], ["box", "class_ids", "n"]).withColumn("overlap", F.col("area") * F.col("n")).withColumn("key", F.struct("patch_id", "tile"))
    found = spatial.dominant_class(spatial.class_areas(cut, "key", "class_ids", G.area(F.col("box"))), ["key"], fractions="tile_class_fracs")
    frame = frame.join(scenes.select("center", "patch_id"), "center").withColumn("key", F.struct("patch_id", "tile"))
    tiles = frame.join(found, "key", "left")
    b, empty = F.col("tbox"), F.expr("cast(map() as map<int,double>)")
    tiles = tiles.select("patch_id", F.floor(F.col("tile") / grid).cast("int").alias("tile_row"), (F.col("tile") % grid).alias("tile_col"), F.col("tile").alias("tile_index"), b["y0"].alias("tile_min_lat"), b["x0"].alias("tile_min_lon"), b["y1"].alias("tile_max_lat"), b["x1"].alias("tile_max_lon"), "tile_class", F.coalesce("tile_class_fracs", empty).alias("tile_class_fracs"))
    scenes = scenes.select("patch_id", F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), F.col("box.y0").alias("sent_min_lat"), F.col("box.x0").alias("sent_min_lon"), F.col("box.y1").alias("sent_max_lat"), F.col("box.x1").alias("sent_max_lon"), "classes", "class_fracs", "class_fracs_abs")
    return scenes, tiles


def sample_index(scenes: DataFrame, tiles: DataFrame, most: int, seed: int = 42, native: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables of an index for a class-balanced sample of its scenes (columns region and ord are needed)."""
    pick = sampling.hashed_sample if native else sampling.balanced_sample
    taken = pick(scenes, most, seed).select(F.col("patch_id").cast(dict(scenes.dtypes)["patch_id"]).alias("patch_id"))
    return sampling.keep_selected(scenes, taken), sampling.keep_selected(tiles, taken)


def construct_splits(files: DataFrame, profile: DataProfile, tiles: int = 100, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scenes with their split, label distribution over train and valid). A scene without all its tiles is an error, also one of images (region, scene) without any."""
    scenes = splits.complete_scenes(files, tiles, images=images)
    scenes = splits.check_labels(scenes, len(profile.classes), int(profile.split.get("max_labels", 30)))
    rows = splits.require_disjoint(splits.assign_split(scenes, profile.splits()), "scene")
    return rows, splits.label_histogram(rows.where("split IN ('train', 'valid')"), len(profile.classes))


def expand_manifest(manifests: dict[str, DataFrame], width: int = 30, tiles: int = 100) -> dict[str, DataFrame]:
    """Grouped manifests of all splits; a scene in two of them is an error."""
    marked = [m.select("filepath").withColumn("split", F.lit(name)) for name, m in manifests.items()]
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    splits.require_disjoint(every, "filepath")
    return {name: splits.grouped_manifest(m, tiles, width) for name, m in manifests.items()}


def score_scenes(rows: DataFrame, router: Callable[[], models.Scorer], scorer: Callable[[], models.Scorer], topk: int = 12) -> DataFrame:
    """(sample_idx, class_id, score, selected_count): routes, selects the best tiles, and scores with what was selected. The scorer gets column tiles."""
    routed = models.route(rows, router)
    chosen = selection.router_topk(routed, topk).groupBy("sample_idx").agg(F.array_sort(F.collect_list("tile")).alias("tiles"))
    scored = models.score(rows.join(chosen, "sample_idx"), scorer)
    return scored.select("sample_idx", F.size("tiles").alias("selected_count"), F.posexplode("scores").alias("class_id", "score"))


def single_query(
    rows: DataFrame, router: Callable[[], models.Scorer], observed: Callable[[], models.Scorer], zero: Callable[[], models.Scorer], policy: Policy, query: int | str, gain: float = 0.075,
    tiles: Callable[[], models.Scorer] | None = None, features: Callable[[], models.Scorer] | None = None,
) -> DataFrame:
    """(sample_idx, router_scores, selected_indices, used_hr_ratio, class_scores, tile_scores, predicted_features): one class asked for, with its own budget, and the residual gain applied.

    tile_scores and predicted_features are those of the scorers tiles and features, which get column tiles too, and null where they aren't given.
    """
    k = policy.resolve(query)
    routed = models.score(rows, router, "router_scores")
    ranked = F.array_sort(F.transform("router_scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    chosen = routed.withColumn("tiles", F.transform(F.slice(ranked, 1, k), lambda x: x["i"]))
    further = {"tile_scores": tiles, "predicted_features": features}
    both = models.score_each(chosen, {"seen": observed, "blind": zero} | {name: make for name, make in further.items() if make})
    both = both.withColumns({name: F.lit(None).cast("array<double>") for name, make in further.items() if not make})
    gained = F.zip_with("seen", "blind", lambda a, b: S.residual_gain(a, b, gain))
    return both.select("sample_idx", "router_scores", F.col("tiles").alias("selected_indices"), (F.size("tiles") / 100).alias("used_hr_ratio"), gained.alias("class_scores"), "tile_scores", "predicted_features")


def classwise_scores(rows: DataFrame, router: Callable[[], models.Scorer], scorer: Callable[[], models.Scorer], policy: Policy, gain: float = 0.075) -> DataFrame:
    """(sample_idx, class_id, pc, score, zero_score, largest): every class scored with its own number of tiles.

    One ranking of tiles for each sample; the scorer gets column tiles for each distinct count of the policy and for none; each class takes its score at its count, moved away
    from that without tiles by the residual gain. largest is the longest prefix that any class needs, which is what has to be read.
    """
    spark = rows.sparkSession
    most = max(policy.counts)
    ranked = models.route(rows, router).select("sample_idx", "tile", "score")
    prefixes = selection.nested_prefixes(selection.router_topk(ranked, max(most, 1)), sorted(set(policy.counts)))
    scored = models.score(prefixes.join(rows, "sample_idx"), scorer).select("sample_idx", F.col("count").alias("pc"), F.posexplode("scores").alias("class_id", "score"))
    scored = staged(spark, scored, "scores")
    blind = scored.where("pc = 0").select("sample_idx", "class_id", F.col("score").alias("zero_score"))
    own = selection.policy_gather(scored, policy.table(spark)).join(blind, ["sample_idx", "class_id"])
    return own.select("sample_idx", "class_id", "pc", S.residual_gain(F.col("score"), F.col("zero_score"), gain).alias("score"), "zero_score", F.lit(most).alias("largest"))


def fuse_low_resolution(scores: DataFrame, stats: RobustStatistics, classes: tuple[str, ...]) -> DataFrame:
    """scores (hr, lr) with column score: the robust tail fusion. Another class order is an error."""
    if stats.classes != tuple(classes):
        raise ValueError("statistics are for other classes, or another order")
    joined = scores.join(F.broadcast(stats.table(scores.sparkSession)), "class_id")
    return joined.withColumn("score", S.robust_tail(F.col("hr"), F.col("lr"), F.col("hr_mad"), F.col("lr_median"), F.col("lr_mad"), stats.positive, stats.negative, stats.threshold))


def evaluate(parts: list[DataFrame], task: str, samples: int, ks: tuple[int, ...] = (20, 100), base: int | None = None, classes: int = 0) -> DataFrame:
    """Merges score shards (sample_idx, class_id, score, target), checks that all samples are there once, and reports by task: retrieval, multi-label or single-label."""
    keyed = [p.select("sample_idx", "class_id", "score", "target") for p in parts]
    shards.require_coverage(shards.merge([p.select("sample_idx").distinct() for p in keyed]), samples)
    rows = keyed[0]
    for p in keyed[1:]:
        rows = rows.unionByName(p)
    if task == "retrieval":
        return metrics.retrieval_report(rows, list(ks), base if base is not None else classes, classes)
    if task == "multi-label":
        return metrics.mean_average_precision(rows)
    if task == "single-label":
        return metrics.top1_accuracy(rows)
    raise ValueError(f"unknown task {task}")


def empty_scores(spark: SparkSession) -> DataFrame:
    """The schema of scores, for a shard without rows."""
    return spark.createDataFrame([], "sample_idx long, class_id int, score double, target int")


#: What marks a table of transfer predictions, and its tasks; fixed values.
TASKS = ("single-label-classification", "multi-label-classification")
PAYLOAD = "format string, dataset string, task string, name string, sample_idx long, class_id int, class_name string, score float, target int"


def prediction_payload(scores: dict[str, DataFrame], targets: DataFrame, classes: tuple[str, ...], dataset: str, task: str, tag: str, indices: DataFrame | None = None) -> DataFrame:
    """PAYLOAD rows of transfer predictions: every named score of every sample and class, with its target.

    scores: by name, rows (ord, class_id, score), where ord numbers the samples in the order in which they were scored, and score is kept as a float. targets: (ord, class_id), the one class of a
    sample, for single-label tasks, where target says whether a class is that one; (ord, class_id, target) else. indices: (ord, sample_idx), which has to have as many rows as
    there are samples with targets; without it samples are numbered 0, 1, ... by ord. No score gives a table without rows.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    spark = targets.sparkSession
    samples = targets.select("ord").distinct()
    if indices is None:
        numbered = spatial.dense_ids(samples.withColumn("_all", F.lit(0)), "_all", "ord", "sample_idx").select("ord", (F.col("sample_idx") - 1).alias("sample_idx"))
    else:
        if (m := indices.count()) != (n := samples.count()):
            raise ValueError(f"{m} sample indices, but {n} samples with targets")
        numbered = indices.select("ord", F.col("sample_idx").cast("long").alias("sample_idx"))
    parts = [df.select(F.lit(name).alias("name"), "ord", F.col("class_id").cast("int").alias("class_id"), F.col("score").cast("float").alias("score")) for name, df in sorted(scores.items())]
    if not parts:
        return spark.createDataFrame([], PAYLOAD)
    rows = reduce(DataFrame.unionByName, parts).join(numbered, "ord")
    if task == TASKS[0]:
        held = rows.join(targets.select("ord", F.col("class_id").alias("_own")), "ord").withColumn("target", (F.col("class_id") == F.col("_own")).cast("int"))
    else:
        held = rows.join(targets.select("ord", F.col("class_id").cast("int").alias("class_id"), F.col("target").cast("int").alias("target")), ["ord", "class_id"])
    name = F.try_element_at(F.array(*map(F.lit, classes)), F.col("class_id") + 1)
    return held.select(F.lit(tag).alias("format"), F.lit(dataset).alias("dataset"), F.lit(task).alias("task"), "name", "sample_idx", "class_id", name.alias("class_name"), "score", "target")
