"""The licence classifier learns from every line of the table, not from a choice of them."""

from pyspark.sql import functions as F

from folio.llm import license_scan

HARD = "He spoke of the General Public Library at dinner."


def test_every_line_counts(spark):
    """Of over 64000 distinct lines all are counted, rare ones too; what is like a template is no case of the unknown class."""
    plain = spark.range(70_000).select(F.concat(F.lit("row "), "id").alias("paragraph"))
    lines = plain.union(spark.createDataFrame([(HARD,)] * 3 + [("Released under the MIT License.",)] * 5, "paragraph string"))
    found = [(tuple(r["grams"]), r["train"], r["n"]) for r in license_scan._unknown(lines).collect()]
    assert sum(n for grams, _, n in found if not grams) == 70_000
    assert [(grams, n) for grams, _, n in found if grams] == [(("general", "general public", "library", "public"), 3)]
    # Lines of equal features are one row, however many.
    assert len(found) == 3
