from folio.llm import token_counts


def test_rows_of_an_id_with_many_are_dealt_and_counted_once_each(spark, monkeypatch):
    rows = [(1, f"text {i % 3} of one id") for i in range(40)] + [(2, "another text"), (3, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    edits = spark.createDataFrame([(1, 1, 0, 4, "word"), (2, 1, 0, 0, "x ")], "doc_id long, seq long, start long, length long, replacement string")
    whole = sorted(tuple(r) for r in token_counts.edited_token_counts(docs, edits).collect())
    monkeypatch.setattr(token_counts, "MANY", 4)
    assert sorted(tuple(r) for r in token_counts.edited_token_counts(docs, edits).collect()) == whole
    assert len(whole) == 42
