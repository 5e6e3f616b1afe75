import duckdb
import pytest

from folio.plans import acts, rendered

ASKED = {**{f"small_{n}": q for n, q in acts.SMALL.items()}, **{n: (q, m.ORACLE_SQL[n]) for m in (acts, rendered) for n, q in m.QUERIES.items()}}
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ASKED))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in "region nation customer orders lineitem part documents pages".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    query, sql = ASKED[name]
    df = query(spark, SF)
    found = con.execute(sql)
    columns, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))
