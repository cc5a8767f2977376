"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

1. One pass over the texts makes, for each document, the number of distinct shingles, a digest of
   the set and a SetSketch: m registers, each the truncated exponent of the least of exponentially
   spaced values. Registers are mergeable (element-wise maximum) and locality-sensitive.
2. Documents with equal sets are one class, which has a number of its own; one of its texts stands for it.
3. Bands of registers are bucketed. In each bucket every class meets the smallest one, so a bucket of
   k classes makes k-1 pairs. The joint likelihood of two register arrays and the known set sizes
   estimates the similarity; pairs that may reach the threshold are verified on their full sets.
4. Verified links make components. Where a bucket still spans several components, a link between two
   of its other members may be missing: a prefix- and position-filtered join over the rarest
   shingles of just these classes finds every such pair, and it is verified likewise.

A pair at the threshold shares no bucket with probability (1 - t^4)^32, 6e-11 at 0.85. No group is
gathered in one task: hot buckets are reduced by partial aggregates and joined by keys that adaptive
execution splits; a shingle that many classes have is met in shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SHINGLE = 5
REGISTERS, BANDS, ROWS = 128, 32, 4
#: Base of the register scale, rate of the exponential values and largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Added to registers: the largest value of an element is under BASE^SHIFT, so none is under zero.
SHIFT = 2000
#: Pairs whose estimate is this much under the threshold are over six standard errors away.
MARGIN = 0.2
#: Candidates are broadcast up to so many (about 100 bytes each), else joined by a shuffle.
BROADCAST_IDS = 250_000
#: Rows of one shingle that meet in one task; more are dealt over shares.
SHARE_ROWS = 2048
#: Texts are sketched in runs of about so many bytes, and hashed in runs that the processor's cache holds.
RUN_BYTES, CACHED_BYTES = 1 << 20, 1 << 17

_MUL = 0x9E3779B97F4A7C15
_ODD = 0xD1342543DE82EF95
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each value."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; short tables are kept."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        size = max(n, 4 * CACHED_BYTES)
        kept = np.full(size, base, dtype=np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if size <= 16 * CACHED_BYTES:
            _powers[str(base)] = kept
    return kept


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and line number (counted on over all texts) of every word of all texts, in order.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Each word's hash comes from prefix sums over
    the bytes, so no word is ever a Python object. A text of k line feeds has k+1 lines.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    # the data begin and end blank, so words begin and end in turn
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power(_INVERSE, len(data))[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * _power(_ODD, len(data))[starts] + (ends - starts).astype(np.uint64))

    def dealt(bounds: np.ndarray) -> np.ndarray:
        """The interval between bounds that each word begins in."""
        return np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))

    owner = dealt(np.cumsum(np.array([1] + [len(x) + 1 for x in parts], dtype=np.int64)))
    return word, owner, dealt(np.flatnonzero(data == 10))


def shingle_hashes(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, and how many each text has.

    A text of fewer than width words has one shingle, its whole sequence; one without words has none.
    """
    parts = [word_hashes(texts[lo:hi])[:2] + (lo,) for lo, hi in runs_of(texts, CACHED_BYTES)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, owner = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] + x[2] for x in parts])
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(word):
        return word, n_words
    salts = [np.uint64((_MUL * (2 * k + 1)) & (2**64 - 1)) for k in range(width)]
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    first = np.cumsum(n_words) - n_words
    place = np.arange(len(word)) - first[owner]
    count = n_words[owner]
    full = np.zeros(len(word), np.uint64)
    for k in range(width):
        full += np.where(place + k < count, padded[k : k + len(word)] * salts[k] ^ salts[k], np.uint64(0))
    full = mix(full)
    use = (place + width <= count) | ((count < width) & (place == 0))
    return full[use], np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))


def sketch(hashes: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (n x m, uint16) of n sets, given the distinct hashes of their elements.

    Element values are exponential, truncated to m intervals spaced so that each holds one of m
    values; the j-th goes to a register dealt by a permutation of the element's own. An element is done
    once its next interval begins beyond the least register of its set.
    """
    k = np.zeros(n * m, np.int64)
    gamma = np.log1p(np.arange(m) / (m - np.arange(m))) / RATE
    gamma = np.append(gamma, np.inf)
    step = ((hashes >> np.uint64(40)) | np.uint64(1)) & np.uint64(m - 1)
    begin = hashes & np.uint64(m - 1)
    inv_log = 1.0 / np.log(BASE)
    for j in range(m):
        if not len(hashes):
            break
        u = (mix(hashes + np.uint64((_MUL * (j + 1)) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        low, width = gamma[j], (1 - np.exp(-RATE * (gamma[j + 1] - gamma[j])))
        x = low - np.log1p(-u * width) / RATE
        value = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) * inv_log) + SHIFT, 0, TOP).astype(np.int64)
        slot = owner * m + ((begin + np.uint64(j) * step) & np.uint64(m - 1)).astype(np.int64)
        np.maximum.at(k, slot, value)
        least = k.reshape(n, m).min(axis=1)
        if j + 1 < m:
            bound = np.floor(1 - np.log(max(gamma[j + 1], 1e-300)) * inv_log) + SHIFT
            stay = bound > least[owner]
            hashes, owner, step, begin = hashes[stay], owner[stay], step[stay], begin[stay]
    return k.reshape(n, m).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity that makes the registers most likely, given the set sizes.

    With u = na/(na+nb) and v = 1-u a register of a is over that of b with probability u - vJ, under it
    with v - uJ and equal with J (for a base near 1); the likelihood's maximum solves a quadratic.
    """
    over, under = (a > b).sum(axis=1), (a < b).sum(axis=1)
    m = a.shape[1]
    same = m - over - under
    u = na / (na + nb)
    v = 1 - u
    qa, qb, qc = u * v * m, same * (u * u + v * v) + over * v * v + under * u * u, same * u * v
    return (qb - np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))) / (2 * qa)


def runs_of(texts: list, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of about most bytes of text each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i + 1 - at >= 2000:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        ids, keys, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for lo, hi in runs_of(texts):
            hashes, counts = shingle_hashes(texts[lo:hi])
            n = hi - lo
            parts = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
            size = np.array([len(x) for x in parts])
            registers = sketch(np.concatenate(parts), np.repeat(np.arange(n), size), n)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in parts]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, n), keys.slice(lo, n), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())],
                ["doc_id", "key", "n_shingles", "digest", "sketch"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text: doc_id and key, a hash of the text, tell a text from others that share its doc_id."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, digest of the set (null if empty) and sketch of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(_signatures, f"doc_id {kind}, key long, n_shingles long, digest binary, sketch binary")


def _bands() -> Column:
    size = 2 * ROWS
    return F.array(*(F.xxhash64(F.lit(i), F.substring(F.col("sketch"), 1 + i * size, size)) for i in range(BANDS)))


def word_set(text: str | None, width: int = SHINGLE) -> set:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(w[i:] for i in range(width)))) or ({tuple(w)} if w else set())


def _likely(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(len(f), REGISTERS) for c in ("sa", "sb"))
                ok = estimate(a, b, f["na"].to_numpy(float), f["nb"].to_numpy(float)) >= threshold - MARGIN
                yield f.loc[ok, ["a", "b"]]

    return run


def _confirmed(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of_last = None, set()
        for f in frames:
            keep = []
            for a, ta, tb in zip(f["a"], f["ta"], f["tb"]):
                if a != last:
                    last, of_last = a, word_set(ta)
                other = word_set(tb)
                both = len(of_last & other)
                keep.append(100 * both >= percent * (len(of_last) + len(other) - both))
            yield f.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


def texts_of(docs: DataFrame, reps: DataFrame, ids: DataFrame, repeats: bool) -> DataFrame:
    """(rep, text) of the classes in ids (rep), once each; what is looked for is broadcast only if it is little enough.

    repeats tells that docs may hold rows alike in doc_id and text; without any, texts need no grouping.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = reps.select("rep", "doc_id", "key").join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    wanted = wanted.select("rep", F.col("doc_id").alias("of"), F.col("key").alias("at"))
    found = keyed(docs).join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("at"))).select("rep", "text")
    return found.groupBy("rep").agg(F.max("text").alias("text")) if repeats else found


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, repeats: bool) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold, checkpointed."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    share = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    likely = checkpointed(pairs.join(side("b"), "b").join(side("a"), "a").where(share).mapInPandas(_likely(percent / 100), "a long, b long"))
    texts = texts_of(docs, reps, likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), repeats)
    of = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"t{x}"))
    return checkpointed(likely.join(of("b"), "b").join(of("a"), "a").mapInPandas(_confirmed(percent), "a long, b long"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, label): the smallest rep reachable over edges (a, b); rows only for nodes with an edge.

    Each round every node takes the least label next to it and then that label's own label, so
    chains shorten by doubling; rounds end when no label changes. State is checkpointed each round.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("label")).select("rep", F.least("rep", "label").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("rep").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("rep")).agg(F.min("other").alias("other"))
        near = labels.join(seen, "rep").select("rep", F.least("label", "other").alias("next"), "label")
        jumped = near.join(labels.select(F.col("rep").alias("next"), F.col("label").alias("far")), "next", "left")
        new = checkpointed(jumped.select("rep", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved")))
        labels = new.select("rep", "label")
        if not new.where("moved").limit(1).count():
            return labels


def _shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts = f["text"].tolist()
        for lo, hi in runs_of(texts):
            hashes, counts = shingle_hashes(texts[lo:hi])
            parts = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
            yield pd.DataFrame({"rep": f["rep"].iloc[lo:hi].to_numpy(), "label": f["label"].iloc[lo:hi].to_numpy(), "h": parts})


def missing_pairs(mixed: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, repeats: bool) -> DataFrame:
    """Pairs of different labels that may reach the threshold, by prefixes of the rarest shingles.

    mixed: (rep, label) of the classes whose buckets span several labels. Any two sets that reach
    the threshold share a shingle within their prefixes of n - ceil(t n) + 1 rarest ones, and where they
    first do, the places leave room for the overlap. Rarity is counted over all of mixed. The rows of a
    shingle that has many are dealt over shares, each of which meets all rows of the other side.
    """
    texts = texts_of(docs, reps, mixed.select("rep").distinct(), repeats)
    sets = checkpointed(mixed.join(texts, "rep").select("rep", "label", "text").mapInPandas(_shingled, "rep long, label long, h array<long>"))
    flat = sets.select("rep", "label", F.size("h").alias("n"), F.explode("h").alias("h"))
    # shingles of one class only join nothing but push others back: they are counted, not joined
    often = flat.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = flat.join(often, "h").groupBy("rep", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    alone = F.col("n") - F.size("s")
    kept = shared.select("rep", "label", "n", F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), prefix - alone).cast("int"))).alias("k", "x"), alone.alias("alone"))
    kept = checkpointed(kept.select("rep", "label", "n", (F.col("k") + F.col("alone")).alias("at"), F.col("x.h").alias("h")))
    per = kept.groupBy("h", "label").count()
    main = per.groupBy("h").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"), F.sum("count").alias("rows")).where("labels > 1")
    rows = kept.join(main.select("h", "main", F.ceil(F.col("rows") / SHARE_ROWS).cast("int").alias("shares")), "h")
    share = F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int").alias("share")
    x = rows.where("label != main").select("h", share, *(F.col(c).alias(f"{c}_x") for c in ("rep", "label", "n", "at")))
    y = rows.select("h", "main", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), *(F.col(c).alias(f"{c}_y") for c in ("rep", "label", "n", "at")))
    need = F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(percent) / F.lit(100 + percent))
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    once = (F.col("label_y") == F.col("main")) | (F.col("rep_x") < F.col("rep_y"))
    found = x.join(y, ["h", "share"]).where((F.col("label_x") != F.col("label_y")) & once & (room >= need))
    return found.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (columns doc_id and text).

    Links: 100 * intersection >= percent * union of the distinct 5-word shingle sets. component_id is
    the smallest doc_id reachable; doc_ids are of any type that has an order. Null, empty and wordless texts have no
    shingles, link to nothing and are their own component; fewer than five words make one shingle. A null doc_id is in
    its set's component but never kept, and sets that only such rows have link like others and leave component_id null.
    Rows that share a doc_id are judged each by its own text, and repeated rows stay repeated. An empty table gives an
    empty one.
    """
    signed = checkpointed(signatures(docs))
    # of each class the least doc_id, and a text that stands for all; a null doc_id comes before others, so it is passed over
    least = F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("of")
    classes = signed.where("digest is not null").groupBy("digest").agg(least, F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    # numbered in order of doc_id: copies made of an early document resemble it more than each other, so it should be met first
    classes = classes.orderBy(F.col("of.doc_id").asc_nulls_last(), "digest")
    reps = checkpointed(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "of.doc_id", "of.key", "n", "sketch"))
    buckets = checkpointed(reps.select("rep", F.explode(_bands()).alias("bucket")))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.count("*").alias("size")).where("size > 1").select("bucket", "a")
    pairs = buckets.join(shared, "bucket").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    repeats = bool(signed.where("digest is not null").groupBy("doc_id", "key").count().where("count > 1").limit(1).count())
    edges = verified(pairs, reps, docs, percent, repeats)
    labels = components(reps, edges)
    # classes in buckets that span several labels may have links that the first round has not seen
    named = buckets.join(labels, "rep", "left").select("rep", "bucket", F.coalesce("label", "rep").alias("label"))
    spans = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    mixed = checkpointed(named.join(spans, "bucket", "left_semi").select("rep", "label").distinct())
    more = verified(missing_pairs(mixed, reps, docs, percent, repeats), reps, docs, percent, repeats)
    labels = components(reps, edges.union(more))
    linked = reps.select("rep", "digest", "doc_id").join(labels, "rep", "left").select("digest", "doc_id", F.coalesce("label", "rep").alias("label"))
    linked = checkpointed(linked)
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = linked.join(least, "label").select("digest", "component_id")
    found = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
