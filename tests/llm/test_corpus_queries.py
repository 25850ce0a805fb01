"""Corpus queries at the smallest scale against the same in SQL, and the pipeline stage by stage."""

import pytest
from conftest import SF, comparable

from tessella.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(name, spark, duck):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.ORACLE_SQL[name]).df()
    assert comparable(got) == comparable(want)


def test_pipeline_stages(spark):
    """Each stage keeps what its operator's own result says, on its own input."""
    import corpus_pipeline
    from test_operators import brute_near, brute_repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas().sort_values("doc_id")
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        after = docs.toPandas().sort_values("doc_id")
        assert list(docs.columns)[: len(columns)] == columns
        kept[name] = len(after)
        if name == "ngram_jaccard":
            want = {c for _, _, c in brute_near(list(before.text), list(before.doc_id))}
            assert set(after.doc_id) == want
        if name == "substring_dedup":
            assert [len(t.split()) for t in after.text] == [n - m for n, m, _ in brute_repeats(list(before.text))]
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept) and 0 < kept["mix_sources"] <= kept["decontaminate"] <= kept["quality"]
    assert (after.copies >= 1).all()
