"""Byte-level BPE with a distinct-word table.

1. Each task splits its texts into words (the pre-tokens of the vocabulary) and counts the distinct
   ones; a shuffle adds the counts up. Each distinct word of the corpus is then encoded once and the
   table (word, n, ids) is written to the shared checkpoint folder.
2. The most frequent words, at most FREQUENT of them, are ranked by their counts. Their hashes are broadcast (the first
   NEAREST also by name), and a second pass writes each text as the ranks of its words, small numbers that
   compress well; any other word is written as the first number that is no rank, and listed.
3. These other words are joined with the table by word and their ids joined back by document and
   position. A word outside the broadcast is rare, so no key of this join is hot. Both this join and the last step read
   the second pass from one shuffle. The ids of the ranks, broadcast too, then take the ranks' places.
4. Ids decode by a join with the id-to-piece table, whose size the vocabulary bounds: it is broadcast, and each
   batch takes the pieces of all its ids at once.

Texts are never shuffled, only the packed ranks of their words. Nothing grows with the corpus on the driver. A rare word whose
64-bit hash is a frequent word's would take its ids: for 10^10 rare words the chance of one such is 5e-4.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import written

#: Fixed value: the pre-token pattern of the vocabulary, with white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters under this one are split by the standard library's pattern with their letters and numbers spelled out, which is faster.
NEAR = 0x250
#: Texts of only these characters split alike under any Unicode version; the library splits the others.
SETTLED = r"[\x00-ԯ‐-⁤　-ヿ一-龥가-힣]*"
#: Words in the broadcast table, at most (about 25 bytes each), and those of them that are held by name.
FREQUENT, NEAREST = 1_000_000, 200_000
#: Seed of Spark's xxhash64.
SEED = 42
#: A task emits its distinct words whenever it holds so many.
HELD = 300_000
#: Ids and bytes of text of which a task makes one batch of results, more only where one text has more.
IDS_AT_ONCE, BYTES_AT_ONCE = 1_000_000, 8_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _library(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


@lru_cache(maxsize=2)
def _specials(spec: str) -> tuple[tuple[str, int], ...]:
    return tuple((x["content"], x["id"]) for x in json.loads(spec)["added_tokens"])


@lru_cache(maxsize=1)
def _near():
    """(find, fullmatch) for texts of characters under NEAR."""

    def of(*kinds: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(NEAR) if unicodedata.category(chr(c))[0] in kinds)

    letters, numbers = of("L"), of("N")
    spaces = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0)))
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    return re.compile(pattern).findall, re.compile(rf"[\x00-{chr(NEAR - 1)}]*").fullmatch


@lru_cache(maxsize=2)
def _splitter(spec: str):
    import regex

    near, is_near = _near()
    find, settled = regex.compile(PATTERN).findall, regex.compile(SETTLED).fullmatch
    specials = [s for s, _ in _specials(spec)]
    cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else None

    def plain(text: str) -> list[str]:
        if is_near(text):
            return near(text)
        return find(text) if settled(text) else [text[a:b] for _, (a, b) in _library(spec).pre_tokenizer.pre_tokenize_str(text)]

    def words(text: str | None) -> list[str]:
        if not text:
            return []
        if cut is None or not any(s in text for s in specials):
            return plain(text)
        return [w for i, part in enumerate(cut(text)) for w in ([part] if i % 2 else plain(part))]

    return words


@lru_cache(maxsize=2)
def _pieces(spec: str) -> list[bytes]:
    """The bytes of each id; byte-level vocabularies spell bytes as printable characters."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    x = json.loads(spec)
    of = {i: bytes(letter[c] for c in piece) for piece, i in x["model"]["vocab"].items()} | {i: s.encode() for s, i in _specials(spec)}
    return [of.get(i, b"") for i in range(max(of) + 1)]


def _counted(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _splitter(spec.value), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                if len(seen) >= HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()
        del seen
        pa.default_memory_pool().release_unused()  # the worker may serve other stages next

    return run


def _id_type(spec: str) -> type:
    """The narrowest numbers that hold all ids."""
    x = json.loads(spec)
    return np.uint16 if max([*x["model"]["vocab"].values(), *(i["id"] for i in x["added_tokens"])], default=0) < 1 << 16 else np.uint32


def _encoded(spec, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, special = _library(spec.value), dict(_specials(spec.value))
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [np.array([special[w]] if w in special else e.ids, kind).tobytes() for w, e in zip(words, library.encode_batch(words, add_special_tokens=False))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    return run


def word_table(docs: DataFrame, spec, kind: type) -> DataFrame:
    """(word, n, ids) of every distinct word of all texts; ids as packed numbers of kind."""
    seen = docs.select(F.col("text").cast("string")).mapInArrow(_counted(spec), "word string, n long")
    return written(seen.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_encoded(spec, kind), "word string, n long, ids binary"))


def _least_frequent(table: DataFrame, most: int) -> int:
    """The count from which at most so many words are as frequent."""
    by_count = table.groupBy("n").count().orderBy(F.desc("n"))
    total = 0
    for n, words in by_count.limit(most).collect():  # distinct counts, far fewer than words
        total += words
        if total > most:
            return n + 1
    return 1


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to most, or of one row that is larger."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, done + most, side="right")), lo + 1)
        yield lo, hi
        lo = hi


def _as_bytes(**columns) -> bytes:
    """The columns as one Arrow stream, far smaller on the driver than Python objects."""
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _column(stream: bytes, name: str) -> pa.Array:
    return pa.ipc.open_stream(stream).read_all().column(name).combine_chunks()


def _ranked(table: DataFrame, least: int) -> tuple[bytes, bytes, bytes]:
    """Of the words that occur least times or more, in the order of their counts: the nearest by name, all hashes in order with ranks, all ids."""
    top = table.where(F.col("n") >= least).select("word", "n", "ids", F.xxhash64("word").alias("h")).toArrow()  # at most FREQUENT rows
    top = top.take(np.argsort(-top.column("n").to_numpy(), kind="stable")).combine_chunks()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return _as_bytes(word=top.column("word")[:NEAREST]), _as_bytes(h=h[order], rank=order.astype(np.int32)), _as_bytes(ids=top.column("ids"))


def _rank_of(nearest: bytes, hashes: bytes):
    """A function from words to their ranks; a word that has none gets the number of all ranks."""
    from xxhash import xxh64_intdigest

    near = {w: i for i, w in enumerate(_column(nearest, "word").to_pylist())}
    h, rank = _column(hashes, "h").to_numpy(), _column(hashes, "rank").to_numpy()

    def ranks(words: list[str]) -> np.ndarray:
        found = np.fromiter(map(near.get, words, repeat(-1)), np.int32, len(words))
        far = np.flatnonzero(found < 0)
        if len(far):
            found[far] = len(h)
            if len(h):
                own = np.array([xxh64_intdigest(words[i].encode(), SEED) for i in far.tolist()], np.uint64)
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                hit = h[at] == own
                found[far[hit]] = rank[at[hit]]
        return found

    return ranks, len(h)


def _packed(spec, nearest, hashes):
    """Each text as the ranks of its words, byte by byte, and the words that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words, pack = _splitter(spec.value), zstandard.ZstdCompressor(level=1).compress
        rank_of, none = _rank_of(nearest.value, hashes.value)
        for whole in batches:
            for lo, hi in _cuts(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False), BYTES_AT_ONCE):
                batch, ranks, rare = whole.slice(lo, hi - lo), [], []
                for text in batch.column("text"):
                    own = words(text.as_py())
                    found = rank_of(own)
                    ranks.append(pack(np.ascontiguousarray(found.view(np.uint8).reshape(-1, 4).T).tobytes()))
                    rare.append([own[i] for i in np.flatnonzero(found == none).tolist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ranks, pa.binary()), pa.array(rare, pa.list_(pa.string()))], ["k1", "k2", "doc_id", "packed", "rare"])
        pa.default_memory_pool().release_unused()

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word without a rank: the keys of its text, its place among these words, the word."""
    for batch in batches:
        rare = batch.column("rare")
        row = rare.value_parent_indices()
        k = np.arange(len(row)) - rare.offsets.to_numpy()[row.to_numpy()] + rare.offsets[0].as_py()
        yield pa.RecordBatch.from_arrays([batch.column("k1").take(row), batch.column("k2").take(row), pa.array(k.astype(np.int32)), rare.flatten()], ["k1", "k2", "k", "word"])


def _filled(ids_of_ranks, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        spelled = _column(ids_of_ranks.value, "ids")
        own = np.frombuffer(spelled.buffers()[2] or b"", kind)
        starts = np.frombuffer(spelled.buffers()[1], np.int32)[spelled.offset : spelled.offset + len(spelled) + 1].astype(np.int64) // np.dtype(kind).itemsize
        for batch in batches:
            packed, found = batch.column("packed"), batch.column("found")
            bounds, rows = found.offsets.to_numpy(), found.values
            place, rare_ids = rows.field("k").to_numpy(zero_copy_only=False), rows.field("ids").to_pylist()
            flat, sizes, total = [], [], 0

            def out(end: int) -> pa.RecordBatch:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                values = pa.array(np.concatenate(flat).astype(np.int32))
                return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(end - len(sizes), len(sizes)), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

            for i in range(batch.num_rows):
                rank = np.ascontiguousarray(np.frombuffer(unpack(packed[i].as_py()), np.uint8).reshape(4, -1).T).view(np.int32)[:, 0]
                lo, hi = (bounds[i], bounds[i + 1]) if found[i].is_valid else (0, 0)
                rare = np.array([], kind)
                at = np.flatnonzero(rank == len(spelled))
                begin, size = starts[np.minimum(rank, len(spelled))], np.zeros(len(rank), np.int64)
                if len(at):
                    # the ids of a text's rare words follow those of all ranks
                    each = [rare_ids[lo + j] for j in np.argsort(place[lo:hi])]
                    rare = np.frombuffer(b"".join(each), kind)
                    size[at] = [len(x) // np.dtype(kind).itemsize for x in each]
                    begin[at] = len(own) + np.cumsum(size[at]) - size[at]
                known = rank < len(spelled)
                size[known] = starts[rank[known] + 1] - begin[known]
                where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                ids = own[np.minimum(where, len(own) - 1)] if len(own) else np.zeros(len(where), kind)
                if len(at):
                    beyond = where >= len(own)
                    ids[beyond] = rare[where[beyond] - len(own)]
                flat.append(ids)
                sizes.append(len(ids))
                total += len(ids)
                if total >= IDS_AT_ONCE:
                    yield out(i + 1)
                    flat, sizes, total = [], [], 0
            if sizes:
                yield out(batch.num_rows)
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of docs (columns doc_id and text): the ids of the whole text.

    The result equals encoding each text by itself without added special tokens; a special token's
    string within a text becomes its id. Null and empty texts have no ids. Repeated rows, null or
    repeated doc_ids are encoded row by row, as the join keys digest doc_id and text.
    """
    context = docs.sparkSession.sparkContext
    with open(tokenizer_path or default_path(), encoding="utf-8") as f:
        spec = context.broadcast(f.read())
    kind = _id_type(spec.value)
    table = word_table(docs, spec, kind)
    least = _least_frequent(table, FREQUENT)
    nearest, hashes, ids_of_ranks = map(context.broadcast, _ranked(table, least))
    text = F.col("text").cast("string")
    type_of_id = docs.schema["doc_id"].dataType
    own = F.col("doc_id").cast("long") if isinstance(type_of_id, IntegralType) else F.xxhash64("doc_id")
    # small numbers in k1 shuffle in less room than another digest would
    keyed = docs.select(F.coalesce(own, F.hash(text).cast("long")).alias("k1"), F.xxhash64(text, "doc_id").alias("k2"), "doc_id", text.alias("text"))
    schema = f"k1 long, k2 long, doc_id {type_of_id.simpleString()}, packed binary, rare array<string>"
    packed = keyed.mapInArrow(_packed(spec, nearest, hashes), schema).repartition("k1", "k2")
    # both readers of packed take all its columns, so that one shuffle serves them
    rare = packed.mapInArrow(_listed, "k1 long, k2 long, k int, word string")
    found = rare.join(table.where(F.col("n") < least).select("word", "ids"), "word").groupBy("k1", "k2").agg(F.collect_set(F.struct("k", "ids")).alias("found"))
    return packed.join(found, ["k1", "k2"], "left").mapInArrow(_filled(ids_of_ranks, kind), f"doc_id {type_of_id.simpleString()}, ids array<int>")


def _decoded(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(_pieces(spec.value), pa.large_binary())
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _cuts(sizes, IDS_AT_ONCE):
                part = batch.slice(lo, hi - lo)
                column = part.column("ids")
                bounds, valid = column.offsets.to_numpy(), column.is_valid().to_pylist()
                spelled = pieces.take(column.values.slice(bounds[0], bounds[-1] - bounds[0]))
                ends = np.frombuffer(spelled.buffers()[1], np.int64)[: len(spelled) + 1]
                body, at = memoryview(spelled.buffers()[2] or b""), ends[bounds - bounds[0]].tolist()
                texts = [str(body[at[i] : at[i + 1]], "utf-8", "replace") if valid[i] else "" for i in range(len(column))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])
        pa.default_memory_pool().release_unused()

    return run


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """encoded (with a column ids) and column decoded: the text that the ids spell, special tokens included.

    Null and empty ids spell the empty text; bytes that are no UTF-8 become replacement characters.
    """
    with open(tokenizer_path or default_path(), encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(spec), f"{columns}, decoded string")
