"""The query of raw blocks."""

import __spark_entry__ as entry

AT = "/root/testdata/sf0.001"


def test_raw_blocks_query(spark):
    """The query names each block by its round, path and place."""
    found = entry.queries()["raw_blocks"](spark, AT)
    assert found.columns == ["round", "path", "lo", "strand", "chr", "start", "end"]
    of = {}
    for r in found.collect():
        of.setdefault((r.round, r.path, r.lo), []).append((r.chr, r.start, r.end))
    assert of and all(len(x) > 1 for x in of.values())
