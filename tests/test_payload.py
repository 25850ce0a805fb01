"""Transfer predictions, the record of a single query, prompt ensembles and dry runs."""

import math
import random

import pytest

from tessella import cli
from tessella.config import Policy
from tessella.operators import models, selection
from tessella.plans import pipelines

CLASSES = ("a", "b", "c")


def test_payload_numbers_samples_and_checks_lengths(spark):
    scores = spark.createDataFrame([(o, c, o + c / 10) for o in (7, 3, 5) for c in range(3)], "ord int, class_id int, score double")
    targets = spark.createDataFrame([(3, 0), (5, 2), (7, 1)], "ord int, class_id int")
    single = {(r["sample_idx"], r["class_id"]): (round(r["score"], 5), r["target"], r["class_name"], r["format"]) for r in pipelines.prediction_payload({"s": scores}, targets, CLASSES, "d", pipelines.TASKS[0], "p-1").collect()}
    assert single == {(i, c): (round(o + c / 10, 5), int(c == t), CLASSES[c], "p-1") for i, (o, t) in enumerate(((3, 0), (5, 2), (7, 1))) for c in range(3)}
    many = spark.createDataFrame([(o, c, (o + c) % 2) for o in (3, 5, 7) for c in range(3)], "ord int, class_id int, target int")
    given = spark.createDataFrame([(3, 100), (5, 200), (7, 300)], "ord int, sample_idx long")
    multi = pipelines.prediction_payload({"s": scores, "t": scores}, many, CLASSES, "d", pipelines.TASKS[1], "p-1", given).collect()
    assert len(multi) == 18 and {(r["sample_idx"], r["class_id"], r["target"]) for r in multi} == {(100 * (i + 1), c, (o + c) % 2) for i, o in enumerate((3, 5, 7)) for c in range(3)}
    with pytest.raises(ValueError, match="2 sample indices, but 3"):
        pipelines.prediction_payload({"s": scores}, targets, CLASSES, "d", pipelines.TASKS[0], "p-1", given.limit(2))
    with pytest.raises(ValueError, match="unknown task"):
        pipelines.prediction_payload({}, targets, CLASSES, "d", "other", "p-1")
    none = pipelines.prediction_payload({}, targets, CLASSES, "d", pipelines.TASKS[0], "p-1")
    assert none.count() == 0 and none.dtypes == pipelines.prediction_payload({"s": scores.limit(0)}, targets, CLASSES, "d", pipelines.TASKS[0], "p-1").dtypes


def test_single_query_record(spark):
    rows = spark.createDataFrame([(i, [float(i + t) for t in range(100)], [1.0, 2.0], [0.5, 0.5]) for i in range(3)], "sample_idx int, router array<double>, hr array<double>, lr array<double>")
    policy = Policy(("a", "b"), (2, 3))
    column = lambda name: lambda: models.ColumnScorer(name)
    plain = pipelines.single_query(rows, column("router"), column("hr"), column("lr"), policy, "b").collect()
    assert all(r["tile_scores"] is None and r["predicted_features"] is None and r["selected_indices"] == [99, 98, 97] for r in plain)
    whole = pipelines.single_query(rows, column("router"), column("hr"), column("lr"), policy, "b", tiles=column("router"), features=column("hr")).collect()
    assert all(len(r["tile_scores"]) == 100 and r["predicted_features"] == [1.0, 2.0] for r in whole)


def test_ensemble(spark):
    rng = random.Random(2)
    rows = [(c, [rng.gauss(0, 1) for _ in range(4)]) for c in (0, 0, 0, 1)] + [(2, [0.0] * 4)]
    unit = lambda v: [x / max(math.sqrt(sum(y * y for y in v)), 1e-12) for x in v]
    for r in selection.ensemble(spark.createDataFrame(rows, "class_id int, vector array<double>")).collect():
        own = [unit(v) for c, v in rows if c == r["class_id"]]
        want = unit([sum(x) / len(own) for x in zip(*own, strict=True)])
        assert all(abs(a - b) < 1e-12 for a, b in zip(r["proto"], want, strict=True))


@pytest.mark.parametrize("stage", [["sample", "--index", "{}/no", "--region", "R", "--output", "{}/o"], ["expand", "--manifest", "train={}/no", "--output", "{}/o"], ["split", "--profile", "{}/no.yaml", "--root", "{}", "--output", "{}/o"], ["index", "--features", "{}/no", "--region", "R", "--output", "{}/o"]])
def test_dry_runs_fail_where_inputs_are_missing(spark, tmp_path, stage):
    with pytest.raises(Exception):  # noqa: B017
        cli.main([*(x.format(tmp_path) for x in stage), "--dry-run"], spark)
