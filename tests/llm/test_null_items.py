"""Benchmark items without an id are found like any other."""

import pytest

from terrafold.llm import decontaminate

ITEMS = [(None, "one two three four five six seven eight nine ten eleven"), (None, "red green blue"), (7, "red green blue"), (None, None)]


@pytest.mark.parametrize("set_words", [4, 1_000_000])
def test_null_item_ids_hit(spark, set_words):
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y"), (2, "red green blue"), (3, "none here")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontamination_report(docs, bench, set_words=set_words).collect()}
    assert got == {1: (10, 0, True), 2: (3, 1, True), 3: (0, 0, False)}
    left = decontaminate.decontaminate(docs, bench, remove="documents", set_words=set_words).collect()
    assert [r.doc_id for r in left] == [3]


def test_the_stage_drops_them(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y"), (3, "none here")], "doc_id long, text string")
    assert [r.doc_id for r in cp.decontaminated(spark, docs, str(tmp_path)).collect()] == [3]
