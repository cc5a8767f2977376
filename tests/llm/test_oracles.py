"""Every query with SQL equals its SQL."""

import duckdb
import pytest

from loomline.llm import queries as q

AT = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    df = q.queries()[name](spark, AT)
    want = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({q.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
