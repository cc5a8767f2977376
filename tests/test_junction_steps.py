"""Steps that the queries of the junction graph share: numbered junctions and packed super-k-mers."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.functions import windows as wd
from loomline.operators import graph, kmers


def genomes():
    rng = random.Random(8)
    base = "".join(rng.choices("ACGT", k=700))
    return [(5, base), (-2, base[100:600] + "N" + base[:90]), (7, base[300:] + base[:50]), (9, "AC" * 60), (11, base[::-1]), (12, base[40:62])]


@pytest.mark.parametrize("piece, held", [(1 << 16, 10**6), (37, 10**6), (37, 3)])
def test_index_of_pieces(spark, monkeypatch, piece, held):
    """Ordinals go on over the pieces of a sequence, also where the bitmap lets other k-mers through."""
    monkeypatch.setattr(kmers, "SORTED", held)
    monkeypatch.setattr(kmers, "FILTER", 1 << 10)
    monkeypatch.setattr(kmers.pieces, "__defaults__", (piece,))
    df = spark.createDataFrame(genomes(), "chr long, seq string")
    want = {}
    for r in graph.junctions(df, 11, 4).collect():
        want.setdefault(r.chr, []).append((r.pos, r.vid, r.ch, r.rev_ch))
    want = sorted((c, i, *x) for c, rows in want.items() for i, x in enumerate(sorted(rows)))
    got = graph.index(df, 11, 4).select("chr", "idx", "pos", "vid", "ch", "rev_ch").collect()
    assert len(want) > 10 and sorted(map(tuple, got)) == want


def test_index_is_made_once(spark):
    """Two uses of an index read what is written, and neither sorts nor places junctions again."""
    df = spark.createDataFrame(genomes(), "chr long, seq string")
    plan = graph.both_strands(graph.index(df, 11, 4))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan


def test_packed_runs():
    """Runs of two bits a base come back with ends that are no bases, in rows by share."""
    data = np.frombuffer(b"$ACGTN$GGGTTACAGT$", np.uint8)
    codes = wd.codes_of(data)
    first, sizes, share = np.array([0, 6, 10, 1]), np.array([6, 8, 8, 4]), np.array([3, 3, 8, 9])
    made = kmers._packed(codes, first, sizes, share)
    assert made.column("share").to_pylist() == [3, 8, 9] and made.column("n").to_pylist() == [14, 8, 4]
    assert sum(len(x) for x in made.column("bases").to_pylist()) == 4 + 2 + 1
    for kept in (made, made.slice(1), made.filter(pa.array([True, False, True]))):
        got, begins = kmers._unpacked(kept)
        rows = [i for i, s in enumerate(share) if s in kept.column("share").to_pylist()]
        assert got.tolist() == [c for i in rows for c in codes[first[i] : first[i] + sizes[i]]]
        assert np.diff(begins).tolist() == sizes[rows].tolist()


def test_tasks_grow_with_bases(spark, monkeypatch):
    df = spark.createDataFrame(genomes(), "chr long, seq string")
    cut = kmers.pieces(df, 11).cache()
    few = sorted(map(tuple, kmers.junction_vertices(cut, 11).collect()))
    monkeypatch.setattr(kmers, "TASK", 1 << 9)
    found = kmers.junction_vertices(cut, 11)
    assert found.rdd.getNumPartitions() > 8 and sorted(map(tuple, found.collect())) == few
