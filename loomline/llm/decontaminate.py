"""Benchmark decontamination: a prefix-filtered set join over word shingles.

Every benchmark item becomes windows of 13 words (a shorter item is one window). A window's tokens are
its 3-word shingles. Exact containment needs every token, so a prefix of one token is enough: the rarest
in the whole corpus. One pass finds the document shingles that any window has, with the words around them;
rarity is counted over these, and those that are anchors meet the index. Length
and position bounds place the window in the document, and its words are then compared one by one.

Only DataFrame functions run. The index is broadcast if its measured size allows, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, words, written

#: A word is a run of digits, letters a-z and anything beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, TOKEN = 13, 3
#: The same words in a text whose A-Z are not lowered yet, for counting.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A broadcast index has at most so many rows (about 300 bytes each).
BROADCAST_ROWS = 50_000


def _words(text: str) -> Column:
    return words(lower_ascii(F.col(text).cast("string")), WORD)


def _n_words() -> Column:
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")


def _is_small(df: DataFrame, weight: Column | None = None) -> bool:
    """Whether df, which must be checkpointed, has few enough rows (or a small enough sum of weight) to be broadcast."""
    n = df.limit(BROADCAST_ROWS + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return n <= BROADCAST_ROWS


def _context(flat: DataFrame) -> DataFrame:
    """flat with only the words that a window around its token can reach, instead of the whole text's."""
    base = F.greatest(F.lit(0), F.col("at") - (WINDOW - 1))
    rest = [c for c in flat.columns if c != "w"]
    return flat.select(*rest, base.alias("base"), F.size("w").alias("length"), F.slice("w", base + 1, 2 * WINDOW - 1).alias("near"))


def _token(w: Column, i: Column, k: int) -> Column:
    """A shingle as a hash: tokens that collide only make candidates, whose words are compared."""
    return F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k)))


def _shingles(w: Column, widths: list[int]) -> Column:
    """(at, width, token) of each shingle of the word array w, for each width that the index has."""

    def of_width(k):
        def one(i):
            return F.struct(i.alias("at"), F.lit(k).alias("width"), _token(w, i, k).alias("token"))

        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(F.array().cast("array<struct<at:int,width:int,token:bigint>>"))

    return F.concat(*map(of_width, widths)) if len(widths) > 1 else of_width(widths[0])


def windows(items: DataFrame) -> DataFrame:
    """(item_id, window): the distinct windows of each item; an item without words has none."""
    w = items.select("item_id", _words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - WINDOW))
    return w.select("item_id", F.explode(starts).alias("i"), "w").select("item_id", F.slice("w", F.col("i") + 1, WINDOW).alias("window")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every row of docs with struct `contamination`: n_words, n_hit, items (sorted ids as strings), contaminated.

    A document word inside any occurrence of a window is hit; a document is contaminated where
    n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words; null and empty items no
    windows. Rows that repeat are judged alike; rows that share a doc_id are judged by their own texts.
    A null item_id counts as no item in `items`, but its words are hit. Empty tables give no hits. A
    column called contamination is replaced.
    """
    spread = checkpointed(windows(items).select("item_id", "window", F.size("window").alias("n")))
    width = F.least(F.lit(TOKEN), F.size("window"))
    widths = sorted(r[0] for r in spread.select(width).distinct().collect())  # at most TOKEN values
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h")).alias("key")
    worded = docs.select(key, _words("text").alias("w"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "contamination"]
    if not widths:
        none = F.struct(_n_words().alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
        return docs.select(*columns, none.alias("contamination"))
    flat = worded.select("key", "w", F.explode(_shingles(F.col("w"), widths)).alias("s")).select("key", "w", F.col("s.at").alias("at"), F.col("s.token").alias("token"))
    # rarity over the whole corpus of the tokens that windows have
    own = F.explode(_shingles(F.col("window"), widths)).alias("s")
    tokens = spread.select("item_id", "window", "n", own).where(F.col("s.width") == width).select("item_id", "window", "n", F.col("s.at").alias("offset"), F.col("s.token").alias("token"))
    wanted = checkpointed(tokens.select("token").distinct())
    if _is_small(wanted):
        met = written(_context(flat.join(F.broadcast(wanted), "token")))
    else:
        # only places are shuffled to find the tokens; the words around them are taken where there are any
        places = written(flat.select("key", "at", "token").join(wanted, "token"))
        met = written(_context(worded.join(places, "key")))
    counts = met.groupBy("token").count()
    rarest = F.min_by(F.struct("offset", "token"), F.struct(F.coalesce("count", F.lit(0)), "offset")).alias("anchor")
    anchors = tokens.join(counts, "token", "left").groupBy("item_id", "window", "n").agg(rarest).select("item_id", "window", "n", "anchor.offset", "anchor.token")
    # items may share windows: one index row for each text of a window, with its items
    index = checkpointed(anchors.groupBy("window", "n", "offset", "token").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")))
    placed = met.join(F.broadcast(index) if _is_small(index) else index, "token")
    start = F.col("at") - F.col("offset")
    placed = placed.where((start >= 0) & (start + F.col("n") <= F.col("length")))
    found = placed.where(F.slice("near", start - F.col("base") + 1, F.col("n")) == F.col("window")).select("key", start.alias("start"), "n", "ids")
    # words hit: the union of the intervals, by the furthest end so far in each document
    spans = checkpointed(found.groupBy("key", "start").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids")))
    prior = F.max(F.col("start") + F.col("n")).over(_before())
    hit = spans.select("key", "ids", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(prior, F.lit(0)))).alias("new"))
    per_doc = hit.groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    per_doc = checkpointed(per_doc)
    small = _is_small(per_doc, 1 + F.size("items"))
    per_doc = per_doc.withColumnRenamed("key", "hit_key")
    all_docs = docs.select(F.struct(*columns).alias("d"), key, _n_words().alias("n_words"))
    joined = all_docs.join(F.broadcast(per_doc) if small else per_doc, F.col("key").eqNullSafe(F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    judged = F.struct("n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
    return joined.select(*(F.col(f"d.`{c}`") for c in docs.columns if c != "contamination"), judged.alias("contamination"))


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
