"""k-mers as packed windows, super-k-mers and the places of vertices, against plain Python and the row form."""

import random

import numpy as np
import pytest

from loomline.functions import windows as wd
from loomline.operators import graph, kmers


def plain(seq, k):
    """(pos, canonical, strand, prev, next) of every k-mer of bases."""
    out = []
    for p in range(len(seq) - k + 1):
        x = seq[p : p + k]
        if set(x) <= set("ACGT"):
            rc = x[::-1].translate(str.maketrans("ACGT", "TGCA"))
            out.append((p, min(x, rc), 1 if x < rc else -1, seq[p - 1] if p else "", seq[p + k : p + k + 1]))
    return out


def number(kmer):
    return sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(kmer)))


def rows():
    rng = random.Random(4)
    base = "".join(rng.choices("ACGT", k=900))
    seqs = [base, base[200:700], "N".join([base[:60], base[40:90], "ACG"]), "A" * 300, "AC" * 90, "ACGTACGTA", "ACG", "", "RYK" * 9, base[::-1].translate(str.maketrans("ACGT", "TGCA")), base[:450] + "T" + base[451:]]
    return list(enumerate(seqs))


@pytest.mark.parametrize("k", [3, 5, 7, 11, 25, 31])
def test_packed_windows(k):
    seq = rows()[2][1]
    codes = wd.codes_of(f"${seq}$".encode())
    found = wd.KmerWindows(codes, k)
    want = plain(seq, k)
    assert (found.at - 1).tolist() == [p for p, *_ in want]
    assert (found.vertex - 1).tolist() == [number(c) for _, c, *_ in want]
    assert found.strand.tolist() == [s for _, _, s, _, _ in want]
    values = np.random.default_rng(1).integers(0, 100, 50)
    assert wd.least(values, k).tolist() == [values[i : i + k].min() for i in range(50 - k + 1)]


def expected(k):
    """vertex -> number of places, of those with several neighbours or at an end; and all their places."""
    seen = {}
    turned = {"A": "T", "C": "G", "G": "C", "T": "A"}
    for chr_, seq in rows():
        for p, c, s, prev, nxt in plain(seq, k):
            enters, leaves = (prev, nxt) if s > 0 else (turned.get(nxt, ""), turned.get(prev, ""))
            seen.setdefault(number(c) + 1, []).append((chr_, p, s, nxt, turned.get(prev, "N"), enters, leaves))
    def several(x):
        return len(x) > 1 or any(c not in "ACGT" or not c for c in x)
    kept = {v: at for v, at in seen.items() if several({a[5] for a in at}) or several({a[6] for a in at})}
    return {v: len(at) for v, at in kept.items()}, sorted((a[0], a[1], v * a[2], a[3], a[4]) for v, at in kept.items() for a in at)


@pytest.mark.parametrize("k, piece, share, held", [(11, 1 << 16, 1 << 25, 10**6), (11, 40, 100, 10), (5, 7, 300, 0)])
def test_vertices_and_places(spark, monkeypatch, k, piece, share, held):
    """Also with pieces shorter than repeats, split buckets, and the filter instead of the sorted array."""
    monkeypatch.setattr(kmers, "SHARE", share)
    monkeypatch.setattr(kmers, "SORTED", held)
    monkeypatch.setattr(kmers, "FILTER", 1 << 12)
    df = spark.createDataFrame(rows(), "chr long, seq string")
    cut = kmers.pieces(df, k, piece).cache()
    vertices, places = expected(k)
    found = kmers.junction_vertices(cut, k).cache()
    assert {r.vertex: r.abundance for r in found.collect()} == vertices and found.count() == len(vertices)
    assert sorted(map(tuple, kmers.places(cut, found, k).collect())) == places
    few = {v for v, n in vertices.items() if n < 4}
    got = graph.junctions(df, k, 4).collect()
    assert sorted(map(tuple, got)) == [p for p in places if abs(p[2]) in few]
    counts = {}
    for _, seq in rows():
        for _, c, s, *_ in plain(seq, k):
            n, strands = counts.get(number(c), (0, 0))
            counts[number(c)] = n + 1, strands + s
    assert {r.packed: (r.n, r.strands) for r in kmers.counted(cut, k).collect()} == counts


def test_no_kmers(spark):
    df = spark.createDataFrame([(1, "ACG"), (2, None)], "chr long, seq string")
    assert graph.junctions(df, 5).collect() == [] == kmers.counted(kmers.pieces(df, 5), 5).collect()
    with pytest.raises(ValueError):
        kmers.pieces(df, 4)


def test_memory_of_counts():
    """A task's numpy arrays stay as small for many pieces as for few."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    peaks = []
    for n in (64, 512):
        batch = pa.RecordBatch.from_arrays([pa.array([b"$" + rng.choice(list(b"ACGT"), 4096).astype(np.uint8).tobytes() + b"$" for _ in range(n)])], ["piece"])
        tracemalloc.start()
        assert sum(sum(made.column("n").to_pylist()) for made in kmers._counted(25)([batch])) == n * (4096 - 25 + 1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
