"""Many vertices, split buckets and neighbours of strides: the same rows, with less moved."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import components, graph, kmers, seeds
from loomline.operators.shared import checkpointed

from test_junction_steps import genomes
from test_kmers import number, plain, rows


@pytest.mark.parametrize("bits", [1 << 9, 1 << 11, 1 << 20])
def test_filter_leaves_the_index_numbered_on_pieces(spark, monkeypatch, bits):
    """Beyond SORTED vertices what the filter lets through wrongly is left out as junctions are placed, without a join of places."""
    df = spark.createDataFrame(genomes(), "chr long, seq string")
    want = sorted(map(tuple, graph.index(df, 11, 4).select("chr", "idx", "pos", "vid", "ch", "rev_ch").collect()))
    vertices = graph._kept(df, 11, 4)[1].count()
    monkeypatch.setattr(kmers, "SORTED", vertices - 1)
    monkeypatch.setattr(kmers, "FILTER", bits)
    monkeypatch.setattr(kmers.pieces, "__defaults__", (37,))
    cut, kept = graph._kept(df, 11, 4)
    assert kmers.placed(cut, kept, 11)[1] or bits == 1 << 9
    assert sorted(map(tuple, graph.index(df, 11, 4).select("chr", "idx", "pos", "vid", "ch", "rev_ch").collect())) == want


@pytest.mark.parametrize("task, share", [(1 << 21, 1 << 25), (100, 200)])
def test_counts_of_super_k_mers(spark, monkeypatch, task, share):
    monkeypatch.setattr(kmers, "COUNT_FEW", 0)
    monkeypatch.setattr(kmers, "COUNT_TASK", task)
    monkeypatch.setattr(kmers, "SHARE", share)
    cut = kmers.pieces(spark.createDataFrame(rows(), "chr long, seq string"), 11, 50).cache()
    counts = {}
    for _, seq in rows():
        for _, c, s, *_ in plain(seq, 11):
            n, strands = counts.get(number(c), (0, 0))
            counts[number(c)] = n + 1, strands + s
    made = kmers.counted(cut, 11)
    got = made.collect()
    assert {r.packed: (r.n, r.strands) for r in got} == counts and len(got) == len(counts)
    # k-mers are rows behind the exchange of super-k-mers only
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(share" in plan and ("hashpartitioning(packed" in plan) == (task == 100)


@pytest.mark.parametrize("stride", [1 << 12, 4])
def test_neighbours_in_strides(spark, monkeypatch, stride):
    monkeypatch.setattr(graph, "STRIDE", stride)
    index = checkpointed(graph.index(spark.createDataFrame(genomes(), "chr long, seq string"), 11, 4))
    at = {(r.chr, r.idx): r for r in index.collect()}
    steps = graph.edges(index)
    assert {(r.chr, r.idx, r.start, r.end, r.ch, r.rev_ch, r.length) for r in steps.collect()} == {(c, i, r.vid, x.vid, r.ch, x.rev_ch, x.pos - r.pos) for (c, i), r in at.items() if (x := at.get((c, i + 1)))}
    assert "Join" not in steps._jdf.queryExecution().executedPlan().toString()
    occ = graph.both_strands(index)
    for n in (3, -2, 0):
        got = {(r.chr, r.idx, r.strand): (r.to_vid, r.to_pos) for r in graph.advanced(occ, n).collect()}
        want = {(c, i, s): (x.vid * s, x.pos) if (x := at.get((c, i + n * s))) else (None, None) for c, i in at for s in (1, -1)}
        assert got == want


def test_written_steps_go(spark, tmp_path):
    """Of an index and of components only what is read later stays in the shared folder."""
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        index = graph.index(spark.createDataFrame(genomes(), "chr long, seq string"), 11, 4)
        folders = lambda: sum(1 for x in tmp_path.glob("*/*") if x.is_dir())
        assert folders() == 2
        found = components.sequence_components(index).collect()
        assert folders() == 3 and len(found) > 2
        pairs = {(r.chr_x, r.chr_y): r.shared for r in seeds.cooccurrence(index).collect()}
        own = index.select("chr", F.abs("vid").alias("v")).distinct()
        assert pairs == {(r.x, r.y): r.n for r in own.withColumnRenamed("chr", "x").join(own.withColumnRenamed("chr", "y"), "v").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n")).collect()}
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)
