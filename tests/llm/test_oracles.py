import duckdb
import pytest

from fabula.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, want = queries.queries()[name](spark, DIR), db.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in places) for r in want.fetchall())
