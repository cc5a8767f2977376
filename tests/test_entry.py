"""The driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry

AT = "/root/testdata/sf0.001"
QUICK = ["seq_scan", "revcomp", "fasta_lines", "abundance_filter", "covered_runs", "uncovered_runs", "interval_coverage", "interval_containment", "interval_anti", "nearest_instance", "event_steps", "used_prefix", "block_neighbours"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "supplier lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    df = entry.queries()[name](spark, AT)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(r) for r in con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want
