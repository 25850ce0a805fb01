"""Samples that follow a sequential rule, in rounds over tables, against the rule itself."""

import random

import pytest

from tessella.operators import sampling


def test_places_of_a_shuffle(spark):
    sizes = {"a": 1, "b": 2, "c": 257, "d": 0}
    got = sampling.shuffled_places(spark.createDataFrame(list(sizes.items()), "_group string, n long"), 5).collect()
    for g, n in sizes.items():
        order = list(range(n))
        random.Random(5).shuffle(order)
        assert sorted((r["pos"], r["at"]) for r in got if r["_group"] == g) == list(enumerate(order))


@pytest.mark.parametrize("most, places", [(1, 4), (25, 7), (60, 1 << 16), (10_000, 50)])
def test_sample_of_every_region(spark, monkeypatch, most, places):
    """Regions of many and of no classes, repeated ids and classes, ties, null ids, classes and region."""
    monkeypatch.setattr(sampling, "PLACES", places)
    rng = random.Random(most)
    rows = []
    for region, n, classes in (("many", 400, 12), ("few", 90, 2), (None, 40, 5), ("bare", 50, 0), ("one", 1, 3)):
        for i in range(n):
            own = [int(classes * rng.random() ** 3) for _ in range(rng.randrange(4))] if classes else rng.choice([None, []])
            rows.append((region, rng.choice([f"p{i}", f"p{i // 3}", f"p{i}", None]), own, i // 2))
    frame = spark.createDataFrame(rows, "region string, patch_id string, classes array<int>, ord int").repartition(5)
    got: dict = {}
    for r in sampling.balanced_sample(frame, most, seed=3).collect():
        got.setdefault(r["region"], []).append(r["patch_id"])
    for region in {r[0] for r in rows}:
        own = sorted(((o, str(p), c or []) for g, p, c, o in rows if g == region))
        want = sampling.greedy_pick([p for _, p, _ in own], [c for _, _, c in own], most, 3)
        assert sorted(got[region]) == sorted(want), region
    assert sampling.balanced_sample(frame.limit(0), most).count() == 0
