"""Interval operators: containment, anti-join, as-of, uncovered runs, coverage, trimming.

Intervals are half-open and zero-based. Range predicates become equi-joins on bins, so a sequence that holds a
third of all rows is dealt over its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import checkpointed, numbered, scratch


def binned(intervals: DataFrame, width: int) -> DataFrame:
    """intervals (chr, start, end, ...) once for every bin that they touch; empty ones are dropped."""
    last = F.floor((F.col("end") - 1) / width)
    return intervals.where("end > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), last)))


def containing(points: DataFrame, intervals: DataFrame, width: int = 1024) -> DataFrame:
    """points (chr, pos, ...) with every interval (chr, start, end, ...) around them."""
    at = points.withColumn("bin", F.floor(F.col("pos") / width))
    return at.join(binned(intervals, width), ["chr", "bin"]).where("pos >= start and pos < end").drop("bin")


def outside(points: DataFrame, intervals: DataFrame, width: int = 1024) -> DataFrame:
    """points that no interval holds."""
    at = points.withColumn("bin", F.floor(F.col("pos") / width)).alias("p")
    of = binned(intervals.select("chr", "start", "end"), width).alias("i")
    hit = (F.col("p.chr") == F.col("i.chr")) & (F.col("p.bin") == F.col("i.bin")) & (F.col("p.pos") >= F.col("i.start")) & (F.col("p.pos") < F.col("i.end"))
    return at.join(of, hit, "left_anti").drop("bin")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, width: int = 1 << 16) -> DataFrame:
    """left with value of the last right row of its key at or before its own at (a number); null if there is none.

    Rows are carried forward within stretches of width, and the last value of each stretch over the stretches,
    so one key is sorted by many tasks. Of right rows at one place the greatest value counts.
    """
    given = right.groupBy(key, at).agg(F.max(value).alias("_v"))
    rows = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_left")).unionByName(given.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumn("_bin", F.floor(F.col(at) / width))
    here = Window.partitionBy(key, "_bin").orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_near", F.last("_v", ignorenulls=True).over(here)).where("_left = 1")
    last = given.groupBy(key, F.floor(F.col(at) / width).alias("_bin")).agg(F.max_by("_v", at).alias("_last"))
    bins = left.select(key, F.floor(F.col(at) / width).alias("_bin")).distinct().join(last, [key, "_bin"], "full")
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(key, "_bin", F.last("_last", ignorenulls=True).over(before).alias("_far"))
    return near.join(carried, [key, "_bin"], "left").select(*left.columns, F.coalesce("_near", "_far").alias(value))


def running(rows: DataFrame, key: str, at: str, value: str, name: str, width: int = 1 << 16, of=F.sum) -> DataFrame:
    """rows with name, the sum (or what of gives: F.max) of value over the rows of the same key before at, a number; null if there is none.

    Rows of one place don't count each other. Values are joined within stretches of width, and over the stretches
    before, so that one key is sorted by many tasks.
    """
    cut = rows.withColumn("_bin", F.floor(F.col(at) / width))
    here = Window.partitionBy(key, "_bin").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut.groupBy(key, "_bin").agg(of(value).alias("_all")).select(key, "_bin", of("_all").over(before).alias("_before"))
    own = cut.withColumn("_own", of(value).over(here))
    both = F.col("_before") + F.col("_own") if of is F.sum else F.greatest("_before", "_own")
    return own.join(bins, [key, "_bin"]).select(*rows.columns, F.coalesce(both, "_before", "_own").alias(name))


def merged(intervals: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(chr, start, end): the union of intervals; those that touch are one. A sequence is worked on in stretches of width bases."""
    once = intervals.where("end > start").groupBy("chr", "start").agg(F.max("end").alias("end"))
    prior = running(once, "chr", "start", "end", "prior", width, F.max)
    begun = prior.withColumn("new", F.when(F.col("start") <= F.col("prior"), 0).otherwise(1))
    island = running(begun, "chr", "start", "new", "islands", width)
    return island.groupBy("chr", (F.coalesce("islands", F.lit(0)) + F.col("new")).alias("island")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def uncovered(sizes: DataFrame, intervals: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(chr, start, end): the maximal runs of sequences (chr, size) that no interval covers."""
    covered = merged(intervals, width).join(sizes, "chr").select("chr", "start", F.least("end", "size").alias("end"), "size").where("start < size")
    gaps = running(covered, "chr", "start", "end", "last", width, F.max).select("chr", F.coalesce("last", F.lit(0)).alias("from"), F.col("start").alias("to"))
    tails = sizes.join(covered.groupBy("chr").agg(F.max("end").alias("last")), "chr", "left").select("chr", F.coalesce("last", F.lit(0)).alias("from"), F.col("size").alias("to"))
    return gaps.union(tails).where("to > from").toDF("chr", "start", "end")


def coverage(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: total length of blocks over total length of sequences."""
    total = sizes.agg(F.sum("size").alias("bases"))
    return blocks.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("covered")).crossJoin(total).select("covered", "bases", (F.col("covered") / F.col("bases")).alias("coverage"))


def unclaimed(copies: DataFrame, claims: DataFrame, width: int = 1024) -> DataFrame:
    """copies (_id, chr, start, end, ...) cut to their longest run that no claim (chr, start, end) holds, the first of equals.

    Claims don't overlap each other. A copy that is claimed whole comes out with an end not after its start.
    """
    of = binned(claims.select("chr", "start", "end"), width).select("chr", "bin", F.col("start").alias("from"), F.col("end").alias("to"))
    hits = binned(copies.select("_id", "chr", "start", "end"), width).join(of, ["chr", "bin"]).where("from < end and start < to").select("_id", "start", "end", "from", "to").distinct()
    before = F.lag("to").over(Window.partitionBy("_id").orderBy("from"))
    gaps = hits.select("_id", F.coalesce(before, F.col("start")).alias("s"), F.col("from").alias("e"))
    tails = hits.groupBy("_id").agg(F.max("to").alias("s"), F.max("end").alias("e"))
    run = F.struct("s", "e")
    best = gaps.union(tails).groupBy("_id").agg(F.max_by(run, F.struct(F.col("e") - F.col("s"), -F.col("s"))).alias("best"))
    return copies.join(best, "_id", "left").withColumn("start", F.coalesce("best.s", "start")).withColumn("end", F.coalesce("best.e", "end")).drop("best")


def trimmed(instances: DataFrame, least: int) -> DataFrame:
    """Block copies (block, strand, chr, start, end) cut so that none overlaps another on its sequence.

    Blocks claim bases in order of copies, most first, then of block. A copy keeps its longest run that no block before
    has claimed, and begins where copies of its own block before it end; copies under least go. A block left with
    fewer than two copies claims nothing. Blocks are settled in rounds: all those that overlap no open block before
    them at once. What is left is numbered anew by copies, then block.
    """
    rank = F.struct((-F.count("*").over(Window.partitionBy("block"))).alias("n"), F.col("block"))
    with scratch(instances.sparkSession) as steps:
        copies = checkpointed(instances.select("block", "strand", "chr", "start", "end", rank.alias("_rank"), F.monotonically_increasing_id().alias("_id")))
        at = binned(copies.select("chr", "start", "end", "block", "_rank"), 1024)
        other = at.select("chr", "bin", F.col("start").alias("from"), F.col("end").alias("to"), F.col("block").alias("before"), F.col("_rank").alias("_first"))
        waits = at.join(other, ["chr", "bin"]).where("from < end and start < to and _first < _rank").select("block", "before").distinct()
        waits, left = checkpointed(waits), checkpointed(copies)
        kept = checkpointed(copies.where("false"))
        steps.drop(waits, left, kept)
        order = Window.partitionBy("block", "chr").orderBy("start", "end", "strand", "_id").rowsBetween(Window.unboundedPreceding, -1)
        while left.limit(1).count():
            held = waits.select("block").distinct()
            cut = unclaimed(left.join(held, "block", "left_anti"), kept).where(F.col("end") - F.col("start") >= least)
            cut = cut.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0)))).where(F.col("end") - F.col("start") >= least)
            many = cut.withColumn("_n", F.count("*").over(Window.partitionBy("block"))).where("_n > 1")
            kept = checkpointed(kept.unionByName(many.select(*kept.columns)))
            left = checkpointed(left.join(held, "block", "left_semi"))
            still = left.select(F.col("block").alias("before")).distinct()
            waits = checkpointed(waits.join(still, "before", "left_semi").select("block", "before"))
            steps.drop(waits, left, kept)
        steps.keep(kept)
    numbers = kept.groupBy("block").agg(F.count("*").alias("n"))
    return kept.join(renumbered(numbers), "block").select("block_id", "strand", "chr", "start", "end")


def renumbered(blocks: DataFrame) -> DataFrame:
    """(block, block_id): blocks (block, n) numbered from 1 by n descending, then block."""
    return numbered(blocks.select(F.col("block"), "n"), [F.desc("n"), F.asc("block")], "block_id").select("block", "block_id")
