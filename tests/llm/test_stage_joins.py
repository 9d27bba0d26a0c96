"""The near-dedup stage keeps the same rows whichever way the others are left out."""

import pytest


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_that_go(spark, monkeypatch, most):
    import corpus_pipeline as cp

    monkeypatch.setattr(cp, "MOST_SENT", most)
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (None, text), (9, "alone here"), (None, None), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in cp.near_dedup(spark, docs, "").collect()) == [3, 7, 9]
    assert cp.near_dedup(spark, docs.limit(0), "").count() == 0
