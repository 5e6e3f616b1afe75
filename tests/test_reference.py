import duckdb
import pytest

from folio.operators import integrity, signals
from folio.plans import reference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in "orders lineitem documents pages labels".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = reference.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({reference.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_gaps_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 5), (2, 3)], "p int, n int")
    assert sorted(map(tuple, integrity.numbering_gaps(df, "p", "n").collect())) == [(1, 2, 5, 2), (2, 0, 3, 2)]
    assert [tuple(r) for r in integrity.duplicate_ids(df, "p", "n").collect()] == [(1, 2, 2)]
    assert integrity.numbering_gaps(df.limit(0), "p", "n").count() == 0


def test_longer_modal_first(spark):
    df = spark.createDataFrame([("It shall not and may be.",), (None,), ("",)], "text string")
    assert {tuple(r) for r in signals.modal_counts(df).collect()} == {("shall not", 1), ("may", 1)}
