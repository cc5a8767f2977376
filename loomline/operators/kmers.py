"""k-mers at scale: pieces dealt to all cores, super-k-mers dealt by minimizer, and vertices decided where they meet.

A super-k-mer is a run of k-mers with one minimizer bucket: its bases with a neighbour on either side, two bits each, instead of a
row for each k-mer; those that a batch has for one bucket travel as one row. All places of a k-mer meet in its bucket, so that its neighbours and its number of places
are known there without moving k-mers. Buckets with more bases than a task should have are split, and only their vertices
meet in one more aggregation. A second pass over the pieces then finds the places of the vertices that were kept: by
a broadcast sorted array behind a bitmap if they are few, else by a filter of hashed bits and the array of what it lets through wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import windows as wd

from .shared import checkpointed, tidied

PIECE, MINIMIZER, BUCKETS = 1 << 16, 11, 4096
#: Bases of a bucket's share, at most; vertices held sorted by tasks, at most; bits of the filter beyond that, at most, and its parts.
SHARE, SORTED, FILTER, RANGES = 1 << 25, 4_000_000, 1 << 30, 256
#: Bases of the super-k-mers of a task, about.
TASK = 1 << 25
#: Windows worked on at once.
BATCH = 1 << 20
#: The same where k-mers are only counted, and the bases of a piece there: a batch of 10,000 pieces holds 82 MB at most.
COUNT_BATCH, COUNT_PIECE = 1 << 17, 1 << 13
#: Bases of a task that counts super-k-mers, about; bases up to which k-mers are counted without them.
COUNT_TASK, COUNT_FEW = 1 << 21, 1 << 24


def pieces(seqs: DataFrame, k: int, size: int = PIECE) -> DataFrame:
    """(chr, offset, only, piece): bases of seqs (chr, seq) with k-mers that begin from offset (0-based) on, size of them at most.

    only: there is no other piece of the sequence. piece, bytes, holds one more base on either side; $ stands for the place before a sequence and behind it. Pieces are dealt
    to all cores, however few tasks the scan has.
    """
    if not (k % 2 and 1 < k < 32):
        raise ValueError(f"k is {k}: it must be odd, so that no k-mer is its own reverse complement, and from 3 to 31")
    edge = F.lit("$")
    whole = seqs.where(F.length("seq") >= k).select("chr", F.concat(edge, F.col("seq"), edge).cast("binary").alias("seq"), (F.length("seq") - k).cast("long").alias("last"))
    cut = whole.select("chr", "seq", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(size).cast("long"))).alias("offset"))
    spark = seqs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut.select("chr", "offset", (F.col("last") < size).alias("only"), F.substring("seq", (F.col("offset") + 1).cast("int"), F.lit(size + k + 1)).alias("piece")).repartition(parts)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and where each begins, with the end as last."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _parts(batches: Iterator[pa.RecordBatch], name: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that few have more than most (BATCH) bytes of name."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(_joined(batch.column(name))[1])
        group = np.cumsum(sizes) // (most or BATCH)
        begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        for a, b in zip(begins, [*begins[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def _inside(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Places of joined pieces where a k-mer with both neighbours lies in one piece."""
    inside = np.zeros(n + 1, np.int32)
    begin, end = starts[:-1] + 1, starts[1:] - k
    fits = end > begin
    np.add.at(inside, begin[fits], 1)
    np.add.at(inside, end[fits], -1)
    return np.cumsum(inside[:-1]) > 0


def _found(column: pa.Array, k: int) -> tuple[wd.KmerWindows, np.ndarray, np.ndarray]:
    """Windows of all pieces, their piece numbers, and where pieces begin."""
    data, starts = _joined(column)
    found = wd.KmerWindows(wd.codes_of(data), k, _inside(starts, k, len(data)))
    return found, np.searchsorted(starts, found.at, side="right") - 1, starts


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as its size, one after another."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _packed(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
    """A row for each share, in its order: (share, n, sizes, edges, bases) of the runs that begin at first.

    n is the number of bases, bases has four in a byte; edges has the codes of each run's first and last place, which may be none. sizes has the
    low bytes of all runs of the row first, then the next ones, as the high ones are nought and pack to nothing.
    """
    heads = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1])))
    total = np.add.reduceat(sizes, heads)
    room = -(-total // 4) * 4
    bits = np.zeros(room.sum(), np.uint8)
    bits[_spread(np.cumsum(room) - room, total)] = codes[_spread(first, sizes)] & 3
    four = bits.reshape(-1, 4)
    bases = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    edges = codes[first] | codes[first + sizes - 1] << 4
    runs = np.diff(np.concatenate((heads, [len(share)])))

    def binary(data: np.ndarray, widths: np.ndarray) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(widths))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])

    planes = np.empty(4 * len(sizes), np.uint8)
    planes[_planes(runs)] = sizes.astype(np.int32).view(np.uint8).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(share[heads]), pa.array(total), binary(planes, 4 * runs), binary(edges, runs), binary(bases, room // 4)], ["share", "n", "sizes", "edges", "bases"])


def _planes(runs: np.ndarray) -> np.ndarray:
    """Where the four bytes of each size are, for rows of so many runs."""
    head = np.cumsum(runs) - runs
    first = np.repeat(4 * head, runs) + np.arange(runs.sum()) - np.repeat(head, runs)
    return first[:, None] + np.repeat(runs, runs)[:, None] * np.arange(4)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all runs of the rows of _packed() one after another, and where each begins, with the end as last."""
    four, starts = _joined(batch.column("bases"))
    bits = np.empty((len(four), 4), np.uint8)
    for i in range(4):
        bits[:, i] = four >> 2 * i & 3
    codes = bits.reshape(-1)[_spread(4 * starts[:-1], np.array(batch.column("n")))]
    planes, of = _joined(batch.column("sizes"))
    sizes = planes[_planes(np.diff(of) // 4)].view(np.int32).reshape(-1)
    edges = _joined(batch.column("edges"))[0]
    begins = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    codes[begins[:-1]] = edges & 15
    codes[begins[1:] - 1] = edges >> 4
    return codes, begins


#: Columns of _packed() as Spark names them.
PACKED = "share long, n long, sizes binary, edges binary, bases binary"


def _runs(k: int, shares: dict[int, int]):
    """Super-k-mers of pieces, as _packed() has them by the share of their bucket."""
    m = min(MINIMIZER, k - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = np.ones(BUCKETS, np.int64)
        for bucket, n in shares.items():
            split[bucket] = n
        for batch in _parts(batches, "piece"):
            data, starts = _joined(batch.column("piece"))
            codes = wd.codes_of(data)
            inside = _inside(starts, k, len(data))
            if len(codes) < k + 2:
                continue
            fits = wd.whole(codes, k) & inside[: len(codes) - k + 1]
            mers = wd.scrambled(np.minimum(wd.packed(codes, m), wd.packed(codes, m, True)))
            bucket = (wd.least(mers, k - m + 1) % np.uint64(BUCKETS)).astype(np.int64)
            bucket[~fits] = -1
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.concatenate((first[1:], [len(bucket)]))
            kept = bucket[first] >= 0
            first, ends = first[kept], ends[kept]
            if not len(first):
                continue
            own = bucket[first]
            share = own + BUCKETS * (np.arange(len(first)) % split[own])
            order = np.argsort(share, kind="stable")
            yield _packed(codes, first[order] - 1, (ends - first + k + 1)[order], share[order])

    return run


def _decided(k: int, split: list[int]):
    """(vertex, entering, leaving, n, whole) of the super-k-mers of a task; of whole buckets only the junctions."""

    def table(parts: list[tuple], whole: bool) -> pa.RecordBatch:
        vertex, i, o, n = wd.summed(*(np.concatenate(x) for x in zip(*parts)))
        if whole:
            kept = several(i) | several(o)
            vertex, i, o, n = vertex[kept], i[kept], o[kept], n[kept]
        return pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(i.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(n), pa.array(np.full(len(vertex), whole))], ["vertex", "entering", "leaving", "n", "whole"])

    def several(mask: np.ndarray) -> np.ndarray:
        return (mask & (mask - 1) > 0) | (mask == wd.BIT[wd.NONE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {True: [], False: []}
        fresh = {True: 0, False: 0}
        for batch in _parts(batches, "bases", BATCH // 4):
            shared = np.isin(np.array(batch.column("share")) % BUCKETS, split)
            for whole in (True, False):
                mine = batch.filter(pa.array(shared != whole))
                if not mine.num_rows:
                    continue
                codes, starts = _unpacked(mine)
                found = wd.KmerWindows(codes, k, _inside(starts, k, len(codes)))
                held[whole].append(wd.summed(found.vertex, wd.BIT[found.entering], wd.BIT[found.leaving], np.ones(len(found.at), np.int64)))
                fresh[whole] += len(held[whole][-1][0])
                if fresh[whole] > max(4 * BATCH, len(held[whole][0][0])):
                    held[whole], fresh[whole] = [wd.summed(*(np.concatenate(x) for x in zip(*held[whole])))], 0
        for whole, parts in held.items():
            if parts:
                made = table(parts, whole)
                for at in range(0, made.num_rows, BATCH):
                    yield made.slice(at, BATCH)

    return run


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for made in _runs(k, {})(batches):
            total += np.bincount(np.array(made.column("share")), np.array(made.column("n")), BUCKETS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def _buckets(cut: DataFrame, k: int) -> dict[int, int]:
    """Bases of the super-k-mers of pieces by bucket."""
    with tidied(cut.sparkSession):
        sizes = cut.select("piece").mapInArrow(_sizes(k), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    return {r["bucket"]: r["n"] for r in sizes}


def junction_vertices(cut: DataFrame, k: int) -> DataFrame:
    """(vertex, abundance) of the k-mers of pieces with several bases before or after them, or at an end (or at a base that is none)."""
    sizes = _buckets(cut, k)
    shares = {bucket: -(-n // SHARE) for bucket, n in sizes.items() if n > SHARE}
    # so many tasks that the vertices of one stay few, however large the tables
    tasks = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // TASK))
    runs = cut.select("piece").mapInArrow(_runs(k, shares), PACKED).repartition(tasks, "share")
    decided = runs.mapInArrow(_decided(k, sorted(shares)), "vertex long, entering int, leaving int, n long, whole boolean")
    if not shares:
        return decided.select("vertex", F.col("n").alias("abundance"))
    decided = checkpointed(decided)
    several = lambda c: (F.bit_count(F.col(c)) > 1) | (F.col(c) == int(wd.BIT[wd.NONE]))
    met = decided.where("not whole").groupBy("vertex").agg(F.bit_or("entering").alias("i"), F.bit_or("leaving").alias("o"), F.sum("n").alias("n")).where(several("i") | several("o"))
    return decided.where("whole").select("vertex", F.col("n").alias("abundance")).unionByName(met.select("vertex", F.col("n").alias("abundance")))


def _tallied(vertex: np.ndarray, n: np.ndarray, strands: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each vertex once, with n and strands added up."""
    order = np.argsort(vertex)
    vertex = vertex[order]
    first = np.flatnonzero(np.concatenate(([True], vertex[1:] != vertex[:-1]))) if len(vertex) else order
    return vertex[first], np.add.reduceat(n[order], first) if len(first) else n, np.add.reduceat(strands[order], first) if len(first) else strands


def _tally(vertex: np.ndarray, n: np.ndarray, strands: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(vertex - 1), pa.array(n), pa.array(strands)], ["packed", "n", "strands"])


def _counted(k: int):
    """(packed, n, strands) of the k-mers of some pieces after others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "piece", COUNT_BATCH):
            found, _, _ = _found(batch.column("piece"), k)
            if len(found.vertex):
                yield _tally(*_tallied(found.vertex, np.ones(len(found.at), np.int64), found.strand))

    return run


def _counted_runs(k: int):
    """(packed, n, strands) of all super-k-mers of a task, each k-mer once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        fresh = 0
        for batch in _parts(batches, "bases", COUNT_BATCH // 4):
            codes, starts = _unpacked(batch)
            found = wd.KmerWindows(codes, k, _inside(starts, k, len(codes)))
            held.append(_tallied(found.vertex, np.ones(len(found.at), np.int64), found.strand))
            fresh += len(held[-1][0])
            if fresh > max(4 * COUNT_BATCH, len(held[0][0])):
                held, fresh = [_tallied(*(np.concatenate(x) for x in zip(*held)))], 0
        if held:
            made = _tally(*_tallied(*(np.concatenate(x) for x in zip(*held))))
            for at in range(0, made.num_rows, BATCH):
                yield made.slice(at, BATCH)

    return run


def counted(cut: DataFrame, k: int) -> DataFrame:
    """(packed, n, strands): every canonical k-mer of pieces, which should be cheap to read twice, with its number of places, and how many more are forward than not.

    All places of a k-mer meet in its bucket, so super-k-mers are moved and no k-mers; only those of buckets that are split are added up once more.
    """
    sizes, kinds = _buckets(cut, k), "packed long, n long, strands long"
    added = lambda rows: rows.groupBy("packed").agg(F.sum("n").alias("n"), F.sum("strands").alias("strands"))
    if sum(sizes.values()) <= COUNT_FEW:
        return added(cut.select("piece").mapInArrow(_counted(k), kinds))
    most = min(SHARE, 4 * COUNT_TASK)
    shares = {bucket: -(-n // most) for bucket, n in sizes.items() if n > most}
    tasks = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // COUNT_TASK))
    runs = cut.select("piece").mapInArrow(_runs(k, shares), PACKED)
    of = lambda rows: rows.repartition(tasks, "share").mapInArrow(_counted_runs(k), kinds)
    if not shares:
        return of(runs)
    split = (F.col("share") % BUCKETS).isin(*shares)
    return of(runs.where(~split)).unionByName(added(of(runs.where(split))))


_LETTERS = np.array([*"ACGTN", ""], dtype=object)


def _slots(vertex: np.ndarray, bits: int) -> np.ndarray:
    return (wd.scrambled(vertex) % np.uint64(bits)).astype(np.int64)


#: Bits that a vertex has in a filter, all in one of its RANGES parts or fewer.
_SALTS = (0x1B873593, 0x5BD1E9955, 0x2545F4914F)


def _width(bits: int) -> int:
    """Bits of each range of a filter."""
    return max(64, bits // RANGES)


def _ranges(vertex: np.ndarray, bits: int) -> np.ndarray:
    return _slots(vertex, max(1, bits // _width(bits)))


def _within(vertex: np.ndarray, salt: int, width: int) -> np.ndarray:
    return _slots(vertex ^ (np.int64(salt) << 7), width)


def _placed(k: int, known, bits: int):
    """Places of the vertices that known, a broadcast (filter, kept, wrong), holds: the bitmap of so many bits of kept, all in order, or, if that is None,
    of salted bits of all, which also lets wrong through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, kept, wrong = known.value

        def among(vertex: np.ndarray, some: np.ndarray) -> np.ndarray:
            return some[np.minimum(np.searchsorted(some, vertex), len(some) - 1)] == vertex if len(some) else np.zeros(len(vertex), bool)

        def marked(slot: np.ndarray) -> np.ndarray:
            return bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0

        for batch in _parts(batches, "piece"):
            found, piece, starts = _found(batch.column("piece"), k)
            if kept is not None:
                hit = np.flatnonzero(marked(_slots(found.vertex, bits)))
                hit = hit[among(found.vertex[hit], kept)]
            else:
                hit = np.arange(len(found.vertex))
                for salt in _SALTS:
                    vertex = found.vertex[hit]
                    hit = hit[marked(_ranges(vertex, bits) * _width(bits) + _within(vertex, salt, _width(bits)))]
                hit = hit[~among(found.vertex[hit], wrong)]
            piece, at = piece[hit], found.at[hit]
            nth = np.arange(len(piece)) - np.searchsorted(piece, piece)
            offset = np.array(batch.column("offset"))[piece]
            data = _joined(batch.column("piece"))[0]
            after = np.where(found.after[hit] == wd.OTHER, [chr(c) for c in data[at + k]], _LETTERS[found.after[hit]]) if len(hit) else _LETTERS[:0]
            before = found.before[hit]
            turned = np.array([*"TGCANN"], dtype=object)[before]
            of = pa.array(piece)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chr").take(of), pa.array(offset), batch.column("only").take(of), pa.array(nth), pa.array(offset + at - starts[piece] - 1), pa.array(found.vertex[hit] * found.strand[hit]), pa.array(after, pa.string()), pa.array(turned, pa.string())],
                ["chr", "offset", "only", "nth", "pos", "vid", "ch", "rev_ch"],
            )

    return run


PLACE = ["chr", "pos", "vid", "ch", "rev_ch"]


def placed(cut: DataFrame, vertices: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """places() with offset and only of their pieces, and nth, their ordinal from 0 on the piece; whether nth counts only what is kept.

    Up to SORTED vertices are held by all tasks. Beyond that tasks hold a filter, and the k-mers that it lets through but are none; if these are
    over SORTED too, a join leaves them out.
    """
    spark, column = cut.sparkSession, lambda rows: rows.limit(SORTED + 1).toArrow().column("vertex").to_numpy()
    kind = cut.schema["chr"].dataType.simpleString()

    def found(known: tuple, bits: int) -> DataFrame:
        cast = spark.sparkContext.broadcast(known)  # SORTED numbers and the filter's size at most
        return cut.mapInArrow(_placed(k, cast, bits), f"chr {kind}, offset long, only boolean, nth long, pos long, vid long, ch string, rev_ch string")

    few = column(vertices.select("vertex"))
    if len(few) <= SORTED:
        bits = min(1 << 27, FILTER, 1 << max(10, (16 * len(few)).bit_length()))
        return found((_bits(_slots(few, bits), bits), np.sort(few), None), bits), True
    bits = min(FILTER, 1 << max(10, (16 * vertices.count()).bit_length()))
    bitmap, none = _filter(vertices, bits), np.zeros(0, np.int64)
    passed = found((bitmap, None, none), bits)
    with tidied(spark):
        wrong = column(passed.select(F.abs("vid").alias("vertex")).distinct().join(vertices.select("vertex"), "vertex", "left_anti"))
    if len(wrong) <= SORTED:
        return found((bitmap, None, np.sort(wrong)), bits), True
    kept = vertices.select(F.col("vertex").alias("_vertex"))
    return passed.join(kept, F.abs("vid") == F.col("_vertex"), "left_semi"), False


def places(cut: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """(chr, pos, vid, ch, rev_ch): places in pieces of vertices (vertex), which should be cheap to read more than once.

    vid is signed by the strand; ch is the character after the k-mer ('' at the end), rev_ch the complement of the base
    before it (N at the start, or for what is no base).
    """
    return placed(cut, vertices, k)[0].select(*PLACE)


def _bits(slot: np.ndarray, bits: int) -> np.ndarray:
    made = np.zeros(bits // 8, np.uint8)
    np.bitwise_or.at(made, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return made


def _filter(vertices: DataFrame, bits: int) -> np.ndarray:
    """The filter of all vertices: each is dealt to the range that has its bits."""
    width = _width(bits)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ranges(np.array(batch.column("vertex")), bits)), batch.column("vertex")], ["range", "vertex"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            of, vertex = np.array(batch.column("range")), np.array(batch.column("vertex"))
            for at in np.unique(of).tolist():
                mine = vertex[of == at]
                fresh = _bits(np.concatenate([_within(mine, salt, width) for salt in _SALTS]), width)
                made[at] = made[at] | fresh if at in made else fresh
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made)), pa.array([x.tobytes() for x in made.values()], pa.binary())], ["range", "bits"])

    whole = np.zeros(bits // 8, np.uint8)
    with tidied(vertices.sparkSession):
        rows = vertices.select("vertex").mapInArrow(dealt, "range long, vertex long").repartition(RANGES // 4, "range").mapInArrow(joined, "range long, bits binary")
        for r in rows.toLocalIterator():  # RANGES rows, the filter's bytes
            whole[r["range"] * width // 8 : (r["range"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole
