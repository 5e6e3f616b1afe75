from folio.operators import signals

TEXTS = [
    "Providers should report no later than 3 days, and shall\u00a0not wait; they may\nnot, but must and shall, act within two\u00a0months.",
    "Logs are kept for at least 6 years, at least until 10 days after one hour, exceeding three months.",
    None,
    "",
    "mayor; within four days; shallow",
]


def test_all_modals_qualifiers_and_numbers(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert {tuple(r) for r in signals.modal_counts(df).collect()} == {("should", 1), ("shall not", 1), ("may not", 1), ("shall", 1)}
    want = {"no later than 3 days", "within two months", "for at least 6 years", "at least until 10 days", "after one hour", "exceeding three months"}
    assert {tuple(r) for r in signals.duration_counts(df).collect()} == {(w, 1) for w in want}
