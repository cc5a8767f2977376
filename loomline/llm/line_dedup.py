"""Line dedup: an exact set-similarity join over the lines of all documents.

1. Words are counted over the whole corpus in a table of hashed slots whose size is fixed; words that meet in a slot
   count together. The slots' counts, on a logarithmic scale of one byte, are broadcast: a line's tokens
   (its distinct words as hashes) are ordered by that scale, then by hash, so every task has the same order by rarity.
2. Two lines of similarity t share a token within their prefixes of n - ceil(t n) + 1 rarest tokens, and the shorter
   one within its first n - ceil(2 t n / (1 + t)) + 1. Words that occur once in the corpus come first and can match nothing:
   they take up places of a prefix but are not joined, and a line whose prefix they fill is dropped at once.
3. Lines of equal token sets are one class, named by its first place in the corpus. Classes meet by token, in order of length; lengths, the
   token's places and the parity signatures of both sets bound their overlap.
4. Of each line's candidates the likeliest earlier one is verified on its words first; only lines that it doesn't settle
   have others verified, in rounds of ever more of them. Tokens of large groups are met by a growing share of the classes
   before, so that a group of k alike lines doesn't make all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import checkpointed, let, written
from .near_dup import CACHED_BYTES, mix, runs_of, word_hashes

PERCENT = 80
#: Lines of fewer distinct words are never removed.
MIN_WORDS = 5
#: Slots of the table of word counts (one byte each when broadcast, 16 MB), and the parts in which it is added up.
SLOT_BITS, RANGES = 24, 64
#: Words (or pairs of lines) held at once, and partitions of which the parts are added up in one step.
HELD, ONE_STEP = 1_000_000, 512
#: A token is its word's place on the scale of counts and so many bits of its hash.
TOKEN_BITS = 40
#: A joined row's signature, whether its token leads, length and token place share one long; lengths too large for their bits are not
#: used as bounds. Lines of so many words or more have 64 or 128 more bits of signature in longs of their own, which are 0 for others; signatures
#: are nested, so that a longer line's can be folded to the width of any shorter one's.
SIGN_BITS, LENGTH_BITS, LONG, LONGER = 39, 12, 40, 110
FULL, LEADS = (1 << LENGTH_BITS) - 1, 1 << 2 * LENGTH_BITS
#: Classes meet in so many passes over their tokens at most, of about so many rows or more, as shuffle files of a pass go when it ends.
PASSES, PASS_ROWS = 4, 4_000_000
#: Rows and pairs of them that a task compares at once, if no group of a token is larger, and what a row may be in a pair.
MET_ROWS, MET_PAIRS, EARLIER, LATER = 1 << 15, 1 << 16, 1, 2
#: Earlier lines of each token that are tried for a line at first.
NEAREST = 4
#: Places of candidate lines, lost lines and rows of a round's share that are broadcast at most (8 to 32 bytes each), else a shuffle joins them.
BROADCAST_PLACES, BROADCAST_LOST, BROADCAST_HEADS = 2_000_000, 500_000, 300_000
#: Numbers of lost lines that are broadcast to the documents at most (4 bytes each, and 16 a document), else documents are shuffled once.
BROADCAST_NUMBERS = 8_000_000
#: Large groups: alike lines are estimated from one class in COUNTED, of which a token's group tries TRIED or about so many; groups of up to
#: FEW alike lines are met at once.
COUNTED, TRIED, FEW, GROWTH = 16, 512, 2048, 16


# Words and their rarity


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a partition's words by slot, as one compressed row a range of slots."""
    import zstandard

    table, held, size = np.zeros(1 << SLOT_BITS, np.uint32), [], 0

    def add():
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        table[slot] += n.astype(np.uint32)

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in runs_of(texts, CACHED_BYTES):
            held.append((word_hashes(texts[lo:hi])[0] >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
            size += len(held[-1])
            if size >= HELD:
                add()
                held, size = [], 0
    if held:
        add()
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [(i, pack(part.astype(np.int64).tobytes())) for i, part in enumerate(table.reshape(RANGES, -1)) if part.any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["range", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all rows of each range; rows stream through, only the sums are held."""
    import zstandard

    unpack, sums = zstandard.ZstdDecompressor().decompress, {}
    for batch in batches:
        for i, x in zip(batch.column("range").to_pylist(), batch.column("n")):
            n = np.frombuffer(unpack(x.as_py()), np.int64)
            sums[i] = sums[i] + n if i in sums else n
    pack = zstandard.ZstdCompressor(level=1).compress
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(x.tobytes()) for x in sums.values()], pa.binary())], ["range", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """The scale of every slot: 0 if no word falls there, 1 if the count is one, then four steps a doubling."""
    import zstandard

    parts = docs.select(F.col("text").cast("string")).mapInArrow(_counted, "range int, n binary")
    if docs.rdd.getNumPartitions() > ONE_STEP:
        parts = parts.repartition(RANGES * 16, "range", F.spark_partition_id() % 64).mapInArrow(_added, "range int, n binary")
    found = parts.repartition(RANGES, "range").mapInArrow(_added, "range int, n binary").toArrow()  # RANGES rows, whatever the input
    scale = np.zeros(1 << SLOT_BITS, np.uint8)
    for i, x in zip(found.column("range").to_pylist(), found.column("n").to_pylist()):
        n = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64)
        scale.reshape(RANGES, -1)[i] = np.where(n <= 1, n, np.minimum(2 + (4 * np.log2(np.maximum(n, 1))).astype(np.int64), 127))
    return scale


# Lines as token sets


def prefix_length(n, percent: int):
    return n + (-percent * n) // 100 + 1


def index_length(n, percent: int):
    """The prefix of the shorter of two lines."""
    return n + (-2 * percent * n) // (100 + percent) + 1


def _spread(lines: np.ndarray, key: np.ndarray, percent: int):
    """For each line (lines in order, a key a word): line, h1, h2 (0 where a word occurs once in the corpus), m, more, most, lead and its prefix."""
    base, kept = 0, []
    step = 1 << (64 - TOKEN_BITS - 7)
    while base < len(lines):
        low = int(lines[base])
        end = int(np.searchsorted(lines, low + step))
        both = np.sort((lines[base:end] - low).astype(np.uint64) << np.uint64(TOKEN_BITS + 7) | key[base:end])
        base = end
        both = both[np.append(True, both[1:] != both[:-1])]
        line, token = both >> np.uint64(TOKEN_BITS + 7), both & np.uint64((1 << (TOKEN_BITS + 7)) - 1)
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        n = np.diff(np.append(first, len(line)))
        alone = np.add.reduceat((token >> np.uint64(TOKEN_BITS) == 1).astype(np.int64), first)
        length = prefix_length(n, percent)
        use = (n >= MIN_WORDS) & (alone < length)
        if not use.any():
            continue
        hashed = mix(token)
        h1 = np.add.reduceat(hashed, first)
        h2 = np.add.reduceat((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F), first)
        # sign has the parities of all tokens; more those of the cells from SIGN_BITS on, most those of one half of more's tokens
        cell = hashed % np.uint64(SIGN_BITS + 64)
        beyond = cell >= SIGN_BITS
        place = np.where(beyond, cell - np.uint64(SIGN_BITS), cell)
        bit = np.left_shift(np.uint64(1), place)
        wide, widest = (beyond & np.repeat(n >= least, n) for least in (LONG, LONGER))
        sign = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), place % np.uint64(SIGN_BITS)), first)
        more, most = (np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), first) for x in (wide, widest & (hashed >> np.uint64(40) & np.uint64(1)).astype(bool)))
        bits = np.minimum(n, FULL).astype(np.uint64) << np.uint64(LENGTH_BITS) | np.minimum(alone, FULL).astype(np.uint64)
        m = sign << np.uint64(2 * LENGTH_BITS + 1) | bits
        lead = np.where(n < FULL, np.maximum(index_length(n, percent) - alone, 0), length - alone)
        # of each line in use the places from its words that occur once to the end of its prefix
        begin, size = (first + alone)[use], (length - alone)[use]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        one = alone[use] > 0
        kept.append((line[first][use].astype(np.int64) + low, np.where(one, 0, h1[use]), np.where(one, 0, h2[use]), m[use], more[use], most[use], lead[use], size, token[at]))
    return [np.concatenate(x) for x in zip(*kept)] if kept else None


def _signed(scale, percent: int):
    """doc_id, u, h1, h2, m, more, most, lead and prefix of every line that may have a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = scale.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in runs_of(texts, CACHED_BYTES):
                word, owner, line = word_hashes(texts[lo:hi])
                if not len(word):
                    continue
                code = rare[word >> np.uint64(64 - SLOT_BITS)].astype(np.uint64)
                found = _spread(line, code << np.uint64(TOKEN_BITS) | word & np.uint64((1 << TOKEN_BITS) - 1), percent)
                if found is None:
                    continue
                line_of, h1, h2, m, more, most, lead, size, token = found
                # a text's first line is the count of the line feeds before it, and the texts before it
                begun = np.cumsum(np.array([0] + [(x or "").count("\n") + 1 for x in texts[lo:hi]]))
                of = np.searchsorted(begun, line_of, side="right") - 1
                u = t[lo:hi][of] << 32 | line_of - begun[of]
                none = (h1 == 0) & (h2 == 0)
                hashes = [pa.array(x.view(np.int64), mask=none) for x in (h1, h2)]
                prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(token.view(np.int64)))
                arrays = [pa.array(ids[lo:hi][of]), pa.array(u), *hashes, pa.array(m.view(np.int64)), pa.array(more.view(np.int64)), pa.array(most.view(np.int64)), pa.array(lead.astype(np.int32)), prefix]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "u", "h1", "h2", "m", "more", "most", "lead", "prefix"])

    return run


# The join


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _hinted(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if _few(df, most) else df


def _rows(classes: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """A row for each prefix token of classes (of the tokens of one part only), with the class's place and packed bounds.

    prior: low bits of the token before (0 for the first), then the class's role.
    """
    flat = classes.select("doc_id", "u", "m", "more", "most", "lead", "role", "prefix", F.posexplode("prefix").alias("k", "token"))
    if parts > 1:
        flat = flat.where(F.pmod("token", F.lit(parts)) == part)
    before = F.coalesce(F.get("prefix", F.col("k") - 1).bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0).cast("long"))
    at = F.least(F.col("k").cast("long"), FULL - F.col("m").bitwiseAND(F.lit(FULL)))
    m = F.col("m") + at + F.when(F.col("k") < F.col("lead"), F.lit(LEADS)).otherwise(0)
    return flat.select("token", (before * 4 + F.col("role")).alias("prior"), F.col("doc_id").alias("d"), "u", m.alias("m"), "more", "most")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in order of token, of whole groups of a token and about MET_ROWS rows at once."""
    held, size, least = [], 0, MET_ROWS
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= least:
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield [x[:cut] for x in rows]
            held, size = [[x[cut:] for x in rows]], size - cut
            least = max(MET_ROWS, 2 * size)
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _meet(rows: list[np.ndarray], percent: int):
    """Token, doc_id and u of rows that share a token with others, and blocks of pairs that bounds allow: (later, earlier, apart), as places in these.

    Of the shorter line (the first of equally long ones) only tokens that lead are met. A row's role is EARLIER, LATER or
    both. Of each group only rows whose lengths allow it are compared. apart: the least number of words in one line only.
    """
    token = rows[0]
    new = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(new, len(token)))
    group, shared = np.repeat(np.arange(len(new)), size), np.repeat(size > 1, size)
    rows, group = [x[shared] for x in rows], group[shared]
    key = group << LENGTH_BITS | rows[4] >> LENGTH_BITS & FULL
    order = np.argsort(key, kind="stable")
    key = key[order]
    token, prior, d, u, m, more, most = (x[order] for x in rows)
    m, more, most = (x.view(np.uint64) for x in (m, more, most))
    n, at = key & FULL, (m & np.uint64(FULL)).astype(np.int64)
    role, prior = prior & 3, prior >> 2
    leads = (m & np.uint64(LEADS)) != 0
    sign = m >> np.uint64(2 * LENGTH_BITS + 1)
    # overlap >= t (n_i + n_p) / (1 + t), so the words in one line only are at most (n_i + n_p) (1 - t) / (1 + t)
    allowed = np.minimum(np.arange(2 * FULL + 1) * (100 - percent) // (100 + percent), 255).astype(np.uint8)
    most_long = key - n + np.minimum(n * 100 // percent, FULL)

    def bounded(i: np.ndarray, p: np.ndarray):
        ok = np.bitwise_count(sign[i] ^ sign[p]) <= allowed[n[i] + n[p]]
        i, p = i[ok], p[ok]
        first = (d[i] < d[p]) | ((d[i] == d[p]) & (u[i] < u[p]))
        y, x = np.where(first, p, i), np.where(first, i, p)
        ok = (first | (n[i] < n[p])) & ((role[y] & LATER) != 0) & ((role[x] & EARLIER) != 0)
        # lines whose tokens before are equal too have met by these: of a run of common tokens the first is enough
        ok &= (prior[i] != prior[p]) | (prior[i] == 0)
        ok &= (n[p] == FULL) | (np.minimum(n[i] - at[i], n[p] - at[p]) * (100 + percent) >= (n[i] + n[p]) * percent)
        i, p, y, x = i[ok], p[ok], y[ok], x[ok]
        # at the width that both signatures have; parities are linear, so that it is the difference that is folded and unfolded
        wide, widest = (np.where(n[i] >= least, c[i] ^ c[p], np.uint64(0)) for c, least in ((more, LONG), (most, LONGER)))
        folded = wide & np.uint64((1 << SIGN_BITS) - 1) ^ wide >> np.uint64(SIGN_BITS)
        apart = np.bitwise_count(sign[i] ^ sign[p] ^ folded) + np.bitwise_count(wide ^ widest) + np.bitwise_count(widest)
        ok = apart <= allowed[n[i] + n[p]]
        return y[ok], x[ok], apart[ok]

    def blocks():
        # each pair has one of the rarer role, so that few lines that meet many are not compared with all
        fewer = role & (EARLIER if (role & EARLIER).astype(bool).sum() < (role & LATER).astype(bool).sum() else LATER) != 0
        for index, probe in ((leads & fewer, None), (leads & ~fewer, fewer)):
            i, p = np.flatnonzero(index), np.arange(len(key)) if probe is None else np.flatnonzero(probe)
            low, high = np.searchsorted(key[p], key[i]), np.searchsorted(key[p], most_long[i], side="right")
            ends = np.cumsum(high - low)
            begin = 0
            while begin < len(i):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + MET_PAIRS)))
                count = (high - low)[begin:end]
                place = np.arange(count.sum()) + np.repeat(high[begin:end] - (ends[begin:end] - done), count)
                yield bounded(np.repeat(i[begin:end], count), p[place])
                begin = end

    return (token, d, u), blocks()


def _nearest(percent: int, low: int, high: int):
    """Of each row's earlier ones the nearest, from the one of rank low to before rank high; more: whether there are others after these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            (_, d, u), blocks = _meet(rows, percent)
            held, size, least = [], 0, HELD

            def ranked():
                y, x, apart = (np.concatenate(z) for z in zip(*held))
                order = np.lexsort((u[x], d[x], apart, y))
                y, x, apart = y[order], x[order], apart[order]
                first = np.flatnonzero(np.append(True, y[1:] != y[:-1]))[: len(y)]
                count = np.diff(np.append(first, len(y)))
                return y, x, apart, np.arange(len(y)) - np.repeat(first, count), np.repeat(count > high, count)

            for block in blocks:
                held.append(block)
                size += len(block[0])
                if size >= least:
                    *block, rank, _ = ranked()
                    held = [[z[rank <= high] for z in block]]
                    size = len(held[0][0])
                    least = max(HELD, 2 * size)
            if not size:
                continue
            y, x, apart, rank, more = ranked()
            kept = (rank >= low) & (rank < high)
            y, x = y[kept], x[kept]
            yield pa.RecordBatch.from_arrays([pa.array(d[x]), pa.array(u[x]), pa.array(d[y]), pa.array(u[y]), pa.array(apart[kept].astype(np.int32)), pa.array(more[kept])], ["xd", "xu", "yd", "yu", "apart", "more"])

    return run


def _counts(percent: int):
    """For each token the pairs that bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            (token, _, _), blocks = _meet(rows, percent)
            n = np.zeros(len(token), np.int64)
            for y, _, _ in blocks:
                n += np.bincount(y, minlength=len(n))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(token[some]), pa.array(n[some])], ["token", "n"])

    return run


def _by_token(rows: DataFrame) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token")


def _met(rows: DataFrame, percent: int, low: int, high: int) -> DataFrame:
    """Pairs (xd, xu) before (yd, yu) that bounds allow: of each token and later line those of ranks low to high by apart."""
    return _by_token(rows).mapInArrow(_nearest(percent, low, high), "xd long, xu long, yd long, yu long, apart int, more boolean")


def _hot(classes: DataFrame, percent: int) -> tuple[DataFrame, int, int]:
    """Tokens whose groups seem to have more than FEW lines alike, the largest estimate and about how many rows there are. Wrong ones cost time only.

    A sample of a group meets itself: of k lines alike the share's square of k^2 / 2 pairs pass the bounds.
    """
    some = written(_rows(classes.where(F.pmod(F.xxhash64("doc_id", "u"), F.lit(COUNTED)) == 0).withColumn("role", F.lit(EARLIER | LATER))))
    large = checkpointed(some.groupBy("token").count().where(F.col("count") * COUNTED > FEW).select("token", F.ceil(F.col("count") / TRIED).alias("thin")))
    tried = some.join(_hinted(large, BROADCAST_HEADS), "token").where(F.pmod(F.xxhash64("d", "u", F.lit(3)), F.col("thin")) == 0).select(*some.columns)
    pairs = _by_token(tried).mapInArrow(_counts(percent), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    size = F.sqrt(2 * F.col("n")) * F.col("thin") * COUNTED
    hot = checkpointed(pairs.join(_hinted(large, BROADCAST_HEADS), "token").select("token", size.alias("size")).where(F.col("size") > FEW))
    return hot.select("token"), int(hot.agg(F.max("size")).first()[0] or 0), some.count() * COUNTED


def later_matches(classes: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Places (doc_id, u) of the classes that an earlier class matches. classes: doc_id, u, m, more, most, lead, prefix; lines: doc_id, t, text.

    Lines of a large group are settled by one earlier match each: before the join of all, tokens of large groups
    alone are met by one class in many, then by more, and what is settled needs no earlier line any more. So of a group of
    k lines that match with probability p, every round makes O(k / p) pairs. Of all other lines the NEAREST earlier
    ones of each token are verified, then GROWTH^2 times as many of those that are not settled and have more.
    """
    hot, most, size = _hot(classes, percent)
    shares = [GROWTH**k for k in range(1, 16) if most // GROWTH ** (k - 1) > FEW][::-1]
    settled = classes.select("doc_id", "u").limit(0)
    only = _hinted(hot, BROADCAST_HEADS) if shares else hot
    for share in shares:
        some = F.pmod(F.xxhash64("doc_id", "u", F.lit(7)), F.lit(share)) == 0
        rows = _rows(_with_roles(classes, some, settled)).join(only, "token", "left_semi")
        found = verified_later(written(_likeliest(_met(rows, percent, 0, 1))), lines, percent)
        settled = checkpointed(found.union(settled).distinct())
    of_all = _with_roles(classes, F.lit(True), settled)
    parts = min(PASSES, 1 + size // PASS_ROWS)
    low, high = 0, NEAREST
    pairs = reduce(DataFrame.union, [written(_met(_rows(of_all, k, parts), percent, low, high)) for k in range(parts)])
    found = checkpointed(verified_later(written(_likeliest(pairs)), lines, percent))
    while True:
        later = pairs.select("*", F.col("yd").alias("doc_id"), F.col("yu").alias("u"))
        rest = written(_without(later, found).select("xd", "xu", "yd", "yu").distinct())
        if rest.limit(1).count():
            found = checkpointed(found.union(verified_later(rest, lines, percent)))
        settled = checkpointed(found.union(settled).distinct())
        waiting = checkpointed(_without(later.where("more").select("doc_id", "u").distinct(), found))
        if not waiting.limit(1).count():
            return settled
        # only tokens of the lines that wait
        low, high = high, high * GROWTH**2
        few = classes.join(_hinted(waiting, BROADCAST_LOST), ["doc_id", "u"], "left_semi")
        tokens = checkpointed(few.select(F.explode("prefix").alias("token")).distinct())
        of_some = classes.join(_hinted(waiting.withColumn("waits", F.lit(True)), BROADCAST_LOST), ["doc_id", "u"], "left")
        of_some = of_some.withColumn("role", F.when(F.col("waits"), EARLIER | LATER).otherwise(EARLIER))
        pairs = written(_met(_rows(of_some).join(_hinted(tokens, BROADCAST_HEADS), "token", "left_semi"), percent, low, high))
        found = found.limit(0)


def _with_roles(classes: DataFrame, earlier: Column, settled: DataFrame) -> DataFrame:
    """Classes with a role: EARLIER by the condition, LATER unless they are settled."""
    marked = classes.join(_hinted(settled.withColumn("done", F.lit(True)), BROADCAST_LOST), ["doc_id", "u"], "left")
    role = F.when(earlier, EARLIER).otherwise(0) + F.when(F.col("done"), 0).otherwise(LATER)
    return marked.withColumn("role", role).where("role > 0").drop("done")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """For each later line the earlier one whose signature is nearest."""
    best = pairs.groupBy("yd", "yu").agg(F.min(F.struct("apart", "xd", "xu")).alias("x"))
    return best.select("x.xd", "x.xu", "yd", "yu")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(_hinted(gone, BROADCAST_LOST), ["doc_id", "u"], "left_anti")


def _alike(percent: int):
    def words(line: str) -> set:
        return set(line.encode("utf-8", "surrogatepass").lower().split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_x").to_pylist(), batch.column("text_y").to_pylist()):
                if x != last:
                    last, of_last = x, words(x)
                other = words(y)
                both = len(of_last & other)
                keep.append(100 * both >= percent * (len(of_last) + len(other) - both))
            yield batch.select(["doc_id", "u"]).filter(pa.array(keep, pa.bool_()))

    return run


def line_texts(places: DataFrame, lines: DataFrame) -> DataFrame:
    """places (doc_id, u and other columns) with value, the line there; lines: doc_id, t, text of each document."""
    rest = [c for c in places.columns if c != "doc_id"]
    of_doc = places.groupBy("doc_id", F.shiftright("u", 32).alias("t")).agg(F.collect_list(F.struct(*rest)).alias("at"))
    found = lines.join(F.broadcast(of_doc) if _few(places, BROADCAST_PLACES) else of_doc, ["doc_id", "t"])
    value = lambda s, x: F.get(s, x["u"].bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    each = let(F.split("text", "\n"), lambda s: F.transform("at", lambda x: F.struct(*(x[c].alias(c) for c in rest), value(s, x).alias("value"))))
    return found.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")


def verified_later(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The later place (doc_id, u) of each pair whose words reach the threshold. Each text goes to its pair's earlier place."""
    x = checkpointed(pairs.select(F.col("xd").alias("doc_id"), F.col("xu").alias("u")).distinct())
    y = pairs.select(F.col("yd").alias("doc_id"), F.col("yu").alias("u"), "xd", "xu")
    # rows that repeat wholly bring their lines twice
    of_x = line_texts(x, lines).groupBy(F.col("doc_id").alias("xd"), F.col("u").alias("xu")).agg(F.first("value").alias("text_x"))
    both = line_texts(y, lines).withColumnRenamed("value", "text_y").join(of_x, ["xd", "xu"])
    return both.select("doc_id", "u", "text_x", "text_y").mapInArrow(_alike(percent), "doc_id long, u long").distinct()


def _order(docs: DataFrame) -> Column:
    """What orders documents: doc_id as a number; names that are no numbers go by a hash of theirs, null is first."""
    number = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.coalesce(F.expr("try_cast(doc_id AS long)"), F.xxhash64("doc_id"))
    return F.when(F.col("doc_id").isNull(), F.lit(-(1 << 63))).otherwise(number)


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every row of docs with text cut to its kept lines and array column `removed` of the other lines' numbers from 0.

    A line goes if any earlier line (by doc_id, then number) has a Jaccard similarity of its distinct words
    (A-Z lower-cased, split at ASCII white space) of percent or more. Lines of fewer than MIN_WORDS
    distinct words stay. Null texts stay null and empty ones empty, with nothing removed. A null doc_id
    comes first, one that is no number is ordered by a hash; rows that share a doc_id but not a text come in the order of a
    hash of the text; rows that repeat wholly are judged as one and so stay alike. A column called removed is replaced.
    """
    t = F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).alias("t")
    keyed = docs.select(_order(docs).alias("doc_id"), t, F.col("text").cast("string").alias("text"))
    scale = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    signed = written(keyed.mapInArrow(_signed(scale, percent), "doc_id long, u long, h1 long, h2 long, m long, more long, most long, lead int, prefix array<long>"))
    # a line with a word of its own is a class of its own
    may_repeat, own = signed.where("h1 is not null"), signed.where("h1 is null")
    found = may_repeat.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "u", "m", "more", "most", "lead", "prefix")).alias("first"), F.count("*").alias("size"))
    shared = written(found.select("h1", "h2", "size", "first.*"))
    columns = ["doc_id", "u", "m", "more", "most", "lead", "prefix"]
    later = later_matches(own.select(*columns).union(shared.select(*columns)), keyed, percent)
    # a class goes whole if an earlier one matches it, else all of it but its first line
    whole = _hinted(later, BROADCAST_LOST).withColumn("whole", F.lit(True))
    gone = shared.select("h1", "h2", "doc_id", "u", "size").join(whole, ["doc_id", "u"], "left").where("whole or size > 1")
    gone = gone.select("h1", "h2", F.col("doc_id").alias("first_doc"), F.col("u").alias("first_u"), "whole")
    copies = may_repeat.select("doc_id", "u", "h1", "h2").join(gone, ["h1", "h2"])
    copies = copies.where(F.coalesce("whole", F.lit(False)) | (F.col("doc_id") != F.col("first_doc")) | (F.col("u") != F.col("first_u")))
    lost = later.union(copies.select("doc_id", "u"))
    line = F.col("u").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    per_doc = checkpointed(lost.groupBy("doc_id", F.shiftright("u", 32).alias("t")).agg(F.sort_array(F.collect_set(line)).alias("lost")))
    few = (per_doc.agg(F.sum(F.size("lost") + 16)).first()[0] or 0) <= BROADCAST_NUMBERS
    kept_columns = [c for c in docs.columns if c != "removed"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept_columns)).alias("d"), _order(docs).alias("_order"), t)
    per_doc = per_doc.withColumnRenamed("doc_id", "_order")
    joined = packed.join(F.broadcast(per_doc) if few else per_doc, ["_order", "t"], "left")
    body = F.col("d.text").cast("string")
    kept = F.array_join(F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains("lost", i)), "\n")
    text = F.when(F.col("lost").isNull(), body).otherwise(kept).alias("text")
    rest = [text if c == "text" else F.col(f"d.`{c}`") for c in kept_columns]
    return joined.select(*rest, F.coalesce("lost", F.array().cast("array<int>")).alias("removed"))
