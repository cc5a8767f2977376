"""Trimming of block copies against a plain walk over the blocks in order."""

import random
from collections import defaultdict

from loomline.operators import intervals


def plain(rows, least):
    blocks = defaultdict(list)
    for b, s, c, x, y in rows:
        blocks[b].append((c, x, y, s))
    claims, kept = defaultdict(list), {}
    for b in sorted(blocks, key=lambda b: (-len(blocks[b]), b)):
        cut = []
        for c, x, y, s in blocks[b]:
            places = sorted((p, q) for p, q in claims[c] if p < y and x < q)
            runs = [(p, q) for p, q in zip([x] + [q for _, q in places], [p for p, _ in places] + [y])]
            p, q = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
            if q - p >= least:
                cut.append((c, p, q, s))
        whole, far = [], {}
        for c, p, q, s in sorted(cut):
            start = max(p, far.get(c, 0))
            far[c] = max(q, far.get(c, 0))
            if q - start >= least:
                whole.append((c, start, q, s))
        if len(whole) > 1:
            kept[b] = whole
            for c, p, q, _ in whole:
                claims[c].append((p, q))
    order = sorted(kept, key=lambda b: (-len(kept[b]), b))
    return sorted((i + 1, s, c, p, q) for i, b in enumerate(order) for c, p, q, s in kept[b])


def test_trimmed_equals_a_plain_walk(spark):
    random.seed(11)
    rows = []
    for b in range(25):
        for _ in range(random.randint(2, 4)):
            start = random.randrange(3000)
            rows.append((b, random.choice("+-"), random.randint(1, 3), start, start + random.randint(20, 400)))
    df = spark.createDataFrame(rows, "block long, strand string, chr long, start long, end long")
    got = sorted(tuple(r) for r in intervals.trimmed(df, 30).collect())
    assert got == plain(rows, 30) and len(got) > 10
    by = defaultdict(list)
    for _, _, c, p, q in got:
        by[c].append((p, q))
    assert all(a[1] <= b[0] for x in by.values() for a, b in zip(sorted(x), sorted(x)[1:]))


def test_a_dropped_block_gives_its_bases_back(spark):
    # block 1 has more copies and comes first, but only one of them is long enough, so it must not cut block 2
    rows = [(1, "+", 1, 0, 100), (1, "+", 2, 0, 10), (1, "+", 3, 0, 10), (2, "+", 1, 50, 150), (2, "-", 2, 200, 300)]
    df = spark.createDataFrame(rows, "block long, strand string, chr long, start long, end long")
    got = sorted(tuple(r) for r in intervals.trimmed(df, 30).collect())
    assert got == [(1, "+", 1, 50, 150), (1, "-", 2, 200, 300)]
    assert not intervals.trimmed(df.where("false"), 30).count()
