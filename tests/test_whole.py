"""Queries over whole tables equal their SQL."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from loomline.plans import catalog

AT = "/root/testdata/sf0.001"
WHOLE = ["kmer_pack", "canonical_kmers", "kmer_abundance", "junctions", "junction_index", "occurrence_chars", "edge_multiplicity", "cursor_advance", "components", "path_links"]


def expected(name, columns):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "supplier lineitem documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    quoted = ", ".join(f'"{c}"' for c in columns)
    return sorted(repr(r) for r in con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query(spark, name):
    df = entry.queries()[name](spark, AT)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == expected(name, columns)


def test_whole_fasta_records(spark):
    df = entry.queries()["fasta_records"](spark, AT)
    got = sorted(repr(tuple(r)) for r in df.select("name", "record_md5").collect())
    assert got == expected("fasta_records", ["name", "record_md5"])
    # every line is in the record, not only the first
    whole = {r.name: r.seq for r in catalog.seqs_of(spark, AT).select("name", "seq").collect()}
    records = {f">{n}\n" + "\n".join(s[i : i + 80] for i in range(0, len(s), 80)) for n, s in whole.items()}
    assert sorted(hashlib.md5(x.encode()).hexdigest() for x in records) == sorted(r.record_md5 for r in df.collect())
