"""The fit's sample spreads over exact copies."""

from terrafold.llm import languages


def test_copies_are_drawn_one_by_one(spark):
    # one text per language, each a tenth of the rows: drawn by the text alone, most languages would be out whole
    rows = [(i, f"text number {'abcdefghij'[i % 10] * 5}", f"l{i % 10}") for i in range(3000)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=300)
    assert model.langs == [f"l{k}" for k in range(10)]
