"""Line dedup against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import line_dedup as ld


def words(line):
    return set(line.encode().lower().split())


def brute(rows, percent=80):
    """{doc_id: (text, removed)} by comparing each line with all earlier ones; rows have distinct doc_ids."""
    earlier, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        removed = []
        for k, line in enumerate([] if text is None else text.split("\n")):
            w = words(line)
            if len(w) < ld.MIN_WORDS:
                continue
            if any(100 * len(w & e) >= percent * len(w | e) for e in earlier):
                removed.append(k)
            earlier.append(w)
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in set(removed))
        out[doc_id] = (kept, removed)
    return out


def found(df):
    return {r.doc_id: (r.text, list(r.removed)) for r in df.collect()}


def near_lines(seed, n):
    pick = random.Random(seed)
    base = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(n):
        line = list(base)
        for _ in range(pick.randrange(4)):
            line[pick.randrange(20)] = f"x{pick.randrange(500)}"
        other = " ".join(f"v{pick.randrange(300)}" for _ in range(pick.randrange(1, 12)))
        rows.append((i, " ".join(line) + "\n" + other + "\nshort line"))
    return rows


@pytest.mark.parametrize("few", [2, 128])
def test_groups_of_near_lines(spark, monkeypatch, few):
    monkeypatch.setattr(ld, "FEW", few)
    monkeypatch.setattr(ld, "COUNTED", 4)
    rows = near_lines(few, 300)
    assert found(ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(ld.line_dedup(docs)) == brute([tuple(r) for r in docs.collect()])


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two three four five\n\none two three four five", "c"), (4, "ONE two three four five", None), (5, long, "d"), (6, long + " more", "e"), (7, "x y\nx y", "f")]
    df = spark.createDataFrame([(*r, [9]) for r in rows], "doc_id long, text string, lost string, removed array<int>")
    out = ld.line_dedup(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert found(out) == brute([r[:2] for r in rows])
    assert {r.doc_id: r.lost for r in out.collect()} == {r[0]: r[2] for r in rows}
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.text) for r in ld.line_dedup(twice).collect()) == [(False, ""), (False, ""), (True, "a b c d e")]
    assert ld.line_dedup(df.limit(0)).count() == 0
    assert found(ld.line_dedup(spark.createDataFrame([(1, "t")], "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("t"), F.lit(2).alias("line")))) == {1: ("t", [])}


def test_signatures_of_unlike_width(spark, monkeypatch):
    """A line under LONG (or LONGER) words and one over it are held apart by their signatures, as lines of one width are."""
    seen = []
    monkeypatch.setattr(ld, "verified_later", lambda pairs, *rest, do=ld.verified_later: seen.append(pairs.count()) or do(pairs, *rest))
    monkeypatch.setattr(ld, "PASS_ROWS", 10, raising=False)  # so that tokens are met in passes
    pick, rows = random.Random(3), []
    for i in range(40):  # of 38 and 42 or 105 and 115 words; the rarest three are the same, the others in two pairs alone
        few, many = ((38, 42), (105, 115))[i % 2]
        rare, one, other = [f"r{i}_{j}" for j in range(3)], *(pick.sample(range(400), many) for _ in range(2))
        for k, (words_of, n) in enumerate(((one, few), (one if i < 2 else other, many))):
            rows.append((2 * i + k, " ".join(rare + [f"c{j}" for j in words_of[: n - 3]])))
    assert found(ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert 2 <= sum(seen) < 10


def test_pairs_of_alike_lines_are_few(spark, monkeypatch):
    """Of a group of lines that are all alike each has few pairs for each of its tokens, not one for every earlier line."""
    seen = []

    def counted(df, do=ld.written):
        out = do(df)
        if {"apart", "yd"} <= set(df.columns):
            seen.append(out.count())
        return out

    monkeypatch.setattr(ld, "written", counted)
    rows = [(i, " ".join([f"w{j}" for j in range(40) if j != i % 40] + [f"x{i // 40}", f"y{i % 7}"])) for i in range(400)]
    assert found(ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert 0 < sum(seen) < 20_000  # the 79,800 pairs of the group shared several tokens each


def test_lines_that_the_nearest_do_not_settle(spark, monkeypatch):
    """If the nearest earlier lines don't match, those after them are tried, in rounds, down to the last."""
    ranks = []
    monkeypatch.setattr(ld, "NEAREST", 1, raising=False)
    monkeypatch.setattr(ld, "GROWTH", 2)
    monkeypatch.setattr(ld, "_met", lambda rows, percent, low, high, do=ld._met: ranks.append((low, high)) or do(rows, percent, low, high))
    pick = random.Random(5)
    rows = [(i, " ".join(pick.sample([f"w{k}" for k in range(30)], 9))) for i in range(150)]
    assert found(ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50)) == brute(rows, 50)
    assert ranks[:2] == [(0, 1), (1, 4)]


def test_rows_are_met_in_pieces(monkeypatch):
    """Ranks of a token's pairs don't depend on how many rows and pairs are held at once."""
    import numpy as np
    import pyarrow as pa

    make = np.random.default_rng(2)
    n = make.integers(5, 12, 400)
    m = make.integers(0, 1 << 12, 400) << 25 | ld.LEADS | n << ld.LENGTH_BITS
    columns = [np.sort(make.integers(1, 6, 400)), make.integers(1, 4, 400), np.arange(400), np.arange(400), m, np.zeros(400, np.int64), np.zeros(400, np.int64)]
    batches = pa.Table.from_arrays([pa.array(x) for x in columns], list("abcdefg")).to_batches(50)

    def ranked(low, high):
        return sorted(tuple(r.values()) for x in ld._nearest(50, low, high)(iter(batches)) for r in x.to_pylist())

    whole = ranked(0, 3), ranked(3, 9), ranked(0, 400)
    assert whole[0] and any(r[-1] for r in whole[0]) and not any(r[-1] for r in whole[2])
    assert {r[:5] for r in whole[0] + whole[1]} == {r[:5] for r in ranked(0, 9)} < {r[:5] for r in whole[2]}
    for name, least in (("MET_ROWS", 8), ("MET_PAIRS", 16), ("HELD", 32)):
        monkeypatch.setattr(ld, name, least)
    assert (ranked(0, 3), ranked(3, 9), ranked(0, 400)) == whole
