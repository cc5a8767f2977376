"""Top-k search and whitening against brute force, and their defined results of odd inputs."""

import math

import numpy as np
import pytest

from loomline.llm import metric_search as ms
from loomline.llm import queries as q
from loomline.llm.metric_search import top_k
from loomline.llm.whitening import Moments, moments_of, whiten

AT = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
ODD = [(0, [1.0, 2.0, -0.5]), (50, [1.0, 2.0, -0.5]), (50, [1.0, 2.0, -0.5]), (None, [1.0, 2.0, -0.5]), (3, None), (4, []), (5, [NAN, 1.0, 2.0]), (6, [1.0, None, 2.0]), (7, [INF, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (8, [-1.0, 0.25, 3.0]), (9, [0.5, 0.5, 0.5])]
SCHEMA = "vec_id long, embedding array<float>, row long, n long, tree string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, None, 3, "x") for r in rows], SCHEMA)


def sound(rows):
    return [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute_top_k(rows, k=5):
    points = [(i, np.floor(256 * v).astype(int)) for i, v in sound(rows)]
    d = max((len(x) for _, x in points), default=0)
    points = [(i, np.pad(x, (0, d - len(x)))) for i, x in points]
    found = []
    for at, (i, x) in enumerate(points):
        if i is not None and i % 50 == 0:
            others = sorted((-int(x @ y), j is None, j or 0) for b, (j, y) in enumerate(points) if b != at)[:k]
            found += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(others)]
    return sorted(found, key=repr)


def loaded(spark):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{AT}/embeddings.parquet").collect()]


def test_top_k(spark):
    assert sorted(map(tuple, q.op11_top_k(spark, AT).collect()), key=repr) == brute_top_k(loaded(spark))
    rows = [(i, v and [c if c is None else np.float32(c).item() for c in v]) for i, v in ODD]
    for mine in (rows, rows + [(11, [0.5])], rows[:1], []):
        got = top_k(odd(spark, mine))
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_top_k(mine)


def test_top_k_in_many_trees(spark, monkeypatch):
    """Small trees, pages and blocks; a third of the rows is one vector; two hundred are near it."""
    for name, value in (("TREE", 40), ("PAGE", 4), ("QUERIES", 7), ("ROOTS", 3), ("PIVOTS", 5)):
        monkeypatch.setattr(ms, name, value)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=6)
    rows = [(i, (hot if i % 3 == 0 else hot + rng.normal(size=6) * (0.01 if i % 3 == 1 else 2)).astype(np.float32).tolist()) for i in range(600)]
    table, space = ms.points(odd(spark, rows))
    placed = ms.place(table, space, size=40, most=5)
    assert placed.groupBy("tree").count().agg({"count": "max"}).first()[0] < 120
    assert sorted(map(tuple, top_k(odd(spark, rows)).collect()), key=repr) == brute_top_k(rows)


def test_tree_avoids_distances():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16)) * 400
    x = np.floor(centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 8).astype(np.int64)
    space = ms.Space(16, int((x * x).sum(axis=1).max()))
    floats = space.load([v.tobytes() for v in x])
    pages = ms.grow(space, floats, 7)
    last = space.last(floats)
    for p in pages:
        assert len(p["entry"]) == len(p["apart"]) == len(p["radius"]) and len(p["entry"]) <= max(ms.PAGE, 16)
        far = space.between(floats[p["entry"]], last[p["entry"]], floats[p["object"]], last[p["object"]])
        assert np.allclose(far, p["apart"])
    assert sorted(i for p in pages if p["leaf"] for i in p["entry"]) == list(range(4000))
    read = [p | {"object": x[p["object"]].tobytes(), "row": p["entry"], "vec_id": p["entry"], "entry": b"".join(x[i].tobytes() for i in p["entry"])} for p in pages]
    tree = ms.Tree(space, read)
    for i in range(0, 4000, 200):
        got = tree.search(floats[i], i, 5)
        assert [(-s, j) for s, _, j, _ in got] == [(-s, j) for s, j in sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)[:5]]
    assert tree.computed < 20 * 4000 / 2


def test_top_k_of_large_entries(spark):
    rows = [(0, [2.0**21, 1.0, 3.0]), (1, [2.0**21, 1.0, 4.0]), (2, [2.0**21, 2.0, 3.0]), (50, [-(2.0**21), 0.0, 1.0])]
    assert sorted(map(tuple, top_k(odd(spark, rows)).collect()), key=repr) == brute_top_k(rows)
    with pytest.raises(OverflowError):
        top_k(odd(spark, [(0, [2.0**30, 1.0])]))


def brute_whitening(rows, components=8):
    vectors = sound(rows)
    lengths = [len(v) for _, v in vectors]
    d = max(lengths, key=lambda m: (lengths.count(m), m))
    ids, v = zip(*((i, v) for i, v in vectors if len(v) == d))
    x = (np.floor(1024 * np.array(v)) + 100_000).astype(int)
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return ids, ((n * x - s) ** 2).sum(axis=1), c, c.T @ c / n, values[::-1][:components], axes[:, ::-1][:, :components]


def test_whitening(spark):
    rows = loaded(spark)
    got = {(r["vec_id"], r["component"]): r for r in q.op12_whitening(spark, AT).collect()}
    ids, deviation, c, v, values, axes = brute_whitening(rows)
    want = c @ axes / np.sqrt(values)
    assert len(got) == len(ids) * 8
    for k in range(8):
        mine = np.array([got[i, k + 1]["whitened"] for i in ids])
        assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-7
        assert abs(got[ids[0], k + 1]["explained"] / (values[k] / np.trace(v)) - 1) < 1e-9
    assert [got[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert {r["n"] for r in got.values()} == {len(ids)}
    [error] = {r["identity_error"] for r in got.values()}
    assert error < 1e-9


def test_whitening_of_odd_rows(spark):
    got = whiten(odd(spark, ODD + [(11, [0.5]), (12, [0.5, 1.0])])).collect()
    ids, deviation, c, v, values, axes = brute_whitening(ODD)
    assert sorted((r["vec_id"], r["deviation"], r["n"]) for r in got if r["vec_id"] is not None) == sorted((i, int(e), len(ids)) for i, e in zip(ids, deviation) if i is not None)
    assert len(got) == len(ids) and {len(r["whitened"]) for r in got} == {3} and got[0]["identity_error"] < 1e-9
    # one vector, equal vectors: no variance
    for rows in (ODD[:1], ODD[:3]):
        for r in whiten(odd(spark, rows)).collect():
            assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (len(rows), 0, [None] * 3, [0.0] * 3, 0.0)
    # a dimension that varies with another
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    r = whiten(odd(spark, flat)).first()
    assert r["whitened"][0] is not None and r["whitened"][1:] == [None, None] and abs(r["explained"][0] - 1) < 1e-12
    assert whiten(odd(spark, [])).collect() == [] == whiten(odd(spark, ODD[4:8])).collect()


def test_moments_merge():
    """Means far from zero and parts of unlike size keep the scatter of all."""
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (1000, 5)) + 10**9
    parts = [moments_of(x[a:b]) for a, b in ((0, 1), (1, 700), (700, 710), (710, 1000))]
    total = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    apart = (x - 10**9) - (x - 10**9).mean(axis=0)
    assert isinstance(total, Moments) and total.n == 1000 and total.sums.tolist() == x.sum(axis=0).tolist()
    assert np.abs(total.scatter - apart.T @ apart).max() < 1e-8 * np.trace(total.scatter)
