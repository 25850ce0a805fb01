"""The fit of quality over a table of labels, against numpy over all of them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality
from tessella.llm.words import chunks


@pytest.mark.parametrize("bad_of", [20, 2])
def test_every_label_counts(spark, bad_of):
    """More labels than one block or one sample holds, also with few rejected ones; held-out labels don't count."""
    n = 6000 if bad_of == 20 else 5400
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), 1 + F.col("id") % 9), lambda i: F.concat(F.lit("w"), (F.col("id") * i) % 13, F.when((F.col("id") + i) % bad_of == 0, "!!").otherwise(""))))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % bad_of != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = quality.train(docs.repartition(3), labels)
    told = docs.join(labels, "doc_id").where(~quality.held_out("doc_id")).orderBy("doc_id").toPandas()
    x = np.concatenate([quality.features(c) for _, c in chunks(pa.array(told["text"]))])
    y = told["quality"].to_numpy()
    assert len(x) > 4000
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-12, atol=1e-12) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6), rtol=1e-9, atol=1e-12)
    s, k = np.sort(model.strength(x)), int((y == 0).sum())
    assert abs(model.cut - (s[k - 1] + s[k]) / 2) < 1e-12 and abs(model.spread - max(s.std() / 4, 1e-6)) < 1e-9
    # Every document meets others, and at the fitted weights the loss of all pairs is flat.
    rows = spark.createDataFrame([(int(i), int(l), r.tobytes()) for i, l, r in zip(told["doc_id"], y, x)], "_id long, y int, x binary")
    blocks = quality.pair_blocks(rows, k, len(y) - k).collect()
    sides = [([bytes(v) for b in blocks for v in b[kind]]) for kind in ("bad", "good")]
    assert {v for side in sides for v in side} == {r.tobytes() for r in x} and min(len(v) for v in sides) >= min(k, len(y) - k) and max(map(len, sides)) == max(k, len(y) - k)
    z = lambda side: np.clip((np.frombuffer(b"".join(map(bytes, side))).reshape(-1, quality.WIDTH) - model.mean) / model.scale, -8, 8)
    d = np.concatenate([quality.differences(z(b["bad"]), z(b["good"])) for b in blocks])
    assert len(d) >= quality.PARTNERS * max(k, len(y) - k)
    assert np.abs(model.slopes(d)[0] / len(d) + model.l2 * model.w).max() < 1e-7


def test_nth_smallest(spark):
    values = [0.0, -3.5, 2.0, 2.0, 2.0 + 1e-15, 1e300, -1e-320, 0.0] + [i / 7 for i in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "s double")
    for k in (0, 1, 5, 1234, len(values) - 2, len(values) - 1):
        assert quality.nth(rows, "s", k) == sorted(values)[k]
