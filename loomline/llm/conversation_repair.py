"""Conversation structure repair: the cheapest edits that make roles alternate, found by A* on the edit lattice.

Faults of rows are decided by Spark; rows are dealt by conversation, sorted, and each conversation is read as a
stream in segments of bounded size, so that one of any length needs no more memory than a segment and its audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A segment ends after so many rows, or so many characters of text.
ROWS, CHARS = 1024, 1 << 24
VISIBLE = r"[^\x20\x09-\x0D]"
FINE, BLANK, DUPLICATE, CUT = range(4)
FULL = {"u": "user", "a": "assistant"}
#: Where the repaired roles may stand: nothing yet, behind a system row, a user row or an assistant row; and what may come next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n and fault of each row: the n-th of its conversation by turn (nulls first), role and text.

    Null roles and texts count as one blank. fault is 1 for a blank text, else 2 where an earlier row has the same
    role and text, else 3 for a text whose last visible character ends no sentence, else 0. Repeated rows stand side
    by side, all but the first as duplicates. Rows with neither role nor text that are marked as absent have no n.
    """
    here = F.col("present")
    alike = Window.partitionBy("conv_id", "role", "text", "present").orderBy("turn")
    order = Window.partitionBy("conv_id", "present").orderBy(F.asc_nulls_first("turn"), "role", "text")
    last = F.regexp_extract("text", rf"(?s)({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    dealt = rows.repartition("conv_id").withColumn("again", F.row_number().over(alike)).withColumn("fault", F.when(here, fault))
    return dealt.withColumn("n", F.when(here, F.row_number().over(order))).drop("again")


def prepared(conversations: DataFrame) -> DataFrame:
    """The four columns that matter, all rows present; null roles and texts are one blank."""
    blank = F.lit(" ")
    columns = [F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *columns, F.lit(True).alias("present"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of conv_id:turn (a null is one blank) modulo 20: 0 dropped (kept as absent,
    so that its conversation is known), 1 emptied, 2 without sentence ends, 3 repeated, 4 a user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.col("kind")
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    struck = prepared(conversations).withColumn("kind", F.crc32(key.cast("binary")) % 20)
    return struck.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), copies.alias("copy")).drop("copy")


def search(rows: list[tuple[str, int]], sources: list[tuple[int, str, int]], ends: bool) -> dict[int, tuple[int, int, str]]:
    """A* over the edits of rows (role initial, fault): exit place -> (cost, source, audit of these rows).

    sources: (cost, audit before, place), the places where the roles may stand before the first row. The heuristic is the
    sum over the rows ahead of what none of them escapes: the deletion of blank and duplicate rows, and for truncated
    ones the lesser of deletion and charge. Keys are (cost + heuristic, audit); audits of different sources never are one
    another's beginning, so the rank of a source stands for its audit. ends: no row follows; insertions may come last.
    The first end of the whole lattice is the answer then, otherwise each place that can be reached has one.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        ahead[i] = ahead[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else min(DELETE, TRUNCATED) if fault == CUT else 0)
    ranked = sorted(range(len(sources)), key=lambda i: sources[i][1])
    heap = [(sources[i][0] + ahead[0], rank, "", sources[i][0], 0, sources[i][2]) for rank, i in enumerate(ranked)]
    heapq.heapify(heap)
    closed, found = set(), {}
    while heap:
        _, rank, audit, cost, at, place = heapq.heappop(heap)
        if (at, place) in closed:
            continue
        closed.add((at, place))
        if at == n:
            if not ends or place in (START, ASSISTANT):
                found[place] = cost, ranked[rank], audit
                if ends:
                    return found
        steps = []
        if at < n:
            initial, fault = rows[at]
            steps.append(("D", DELETE, at + 1, place))
            if fault not in (BLANK, DUPLICATE):
                charge = TRUNCATED if fault == CUT else 0
                if initial in NEXT[place]:
                    steps.append(("K", KEEP + charge, at + 1, NEXT[place][initial]))
                steps += [("R", REROLE + charge, at + 1, to) for role, to in NEXT[place].items() if role != "s"]
        if at < n or ends:
            steps += [("I", INSERT, at, to) for role, to in NEXT[place].items() if role != "s"]
        for letter, more, to_row, to in steps:
            if (to_row, to) not in closed:
                heapq.heappush(heap, (cost + more + ahead[to_row], rank, audit + letter, cost + more, to_row, to))
    return found


def edited(audit: str, rows: list[tuple[str, str]], place: int = START) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) rows that the audit makes of rows, and the place behind them."""
    made, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else next(x for x in NEXT[place] if x != "s")
        made.append((role if letter == "K" else FULL[initial], text))
        place = NEXT[place][initial]
    return made, place


class _Conversation:
    """What is known of a conversation behind its segments so far: for each place of the roles the cheapest way there."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.rows, self.size = conv_id, [], 0
        self.ways = {START: (0, "", hashlib.sha256())}
        self.counts, self.illegal, self.before = [0] * 4, 0, None
        self.turns, self.low, self.high, self.last = 0, None, None, None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if self.rows and (len(self.rows) == ROWS or self.size > CHARS):
            self.settle(False)
        self.rows.append((role, text, fault))
        self.size += len(text)
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.turns, self.last, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low

    def settle(self, ends: bool) -> None:
        places = list(self.ways)
        sources = [(*self.ways[p][:2], p) for p in places]
        ways = {}
        for place, (cost, source, audit) in search([(role[:1], fault) for role, _, fault in self.rows], sources, ends).items():
            _, before, digest = self.ways[places[source]]
            digest = digest.copy()
            started = places[source] != START
            for role, text in edited(audit, [x[:2] for x in self.rows], places[source])[0]:
                digest.update(f"{chr(10) if started else ''}{role}:{text}".encode())
                started = True
            ways[place] = cost, before + audit, digest
        self.ways, self.rows, self.size = ways, [], 0

    def result(self) -> tuple:
        self.settle(True)
        [(cost, audit, digest)] = self.ways.values()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, cost, audit, digest.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done, size, kind = None, [], 0, None

    def out() -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*done), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        texts = batch.column("text")
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "role", "fault")]
        for i, (conv_id, present, turn, role, fault) in enumerate(zip(*columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                    size += len(done[-1][7])
                    if len(done) == 4096 or size > CHARS:
                        yield out()
                        done, size = [], 0
                now = _Conversation(conv_id)
            if present:
                now.add(turn, role, texts[i].as_py(), fault)
    if now is not None:
        done.append(now.result())
    if done:
        yield out()


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text; with present, as damaged() gives it, or without).

    gaps counts the turns missing between the least and the greatest, nulls aside; blank, duplicate and truncated the rows
    whose first fault that is; illegal the neighbours whose role initials are not su, ua or au. cost and audit are of
    the cheapest edits (K keep 0, R rerole to user or assistant 1, D delete 2, I insert an empty row 5; 5 for each
    truncated row that stays; blank and duplicate rows must go) after which role initials read (s?(ua)+)?; of several
    the least audit. repaired_sha256 is of the repaired role:text lines. A conversation without rows, or of which
    none stays, has the digest of the empty string. A null conv_id is a conversation of its own; other columns are
    ignored; an empty table gives none. The digest of a conversation needs its rows in order, so one task reads all of
    one, as a stream.
    """
    if "present" not in rows.columns:
        rows = prepared(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return faults(rows).sortWithinPartitions("conv_id", "n").mapInArrow(_repaired, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, n, part, edit, role, text: the rows behind the edits, in order of n and part; inserted rows carry the n of the row that follows.

    The letters of each audit go to their rows by a join on (conv_id, n), so no conversation is gathered.
    """
    if "present" not in rows.columns:
        rows = prepared(rows)
    letters = repairs.select("conv_id", F.posexplode(F.split("audit", "")).alias("i", "edit")).where("edit <> ''")
    upto = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = letters.withColumn("n", F.sum((F.col("edit") != "I").cast("int")).over(upto) + (F.col("edit") == "I").cast("int"))
    stays = F.sum((F.col("edit") != "D").cast("int")).over(upto)
    own = faults(rows).where("present").select(F.col("conv_id").alias("c"), F.col("n").alias("m"), F.col("role").alias("old"), "text")
    joined = placed.withColumn("stays", stays).join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")) & (F.col("edit") != "I"), "left").where("edit <> 'D'")
    first = F.max(F.when((F.col("stays") == 1) & (F.col("edit") == "K") & F.col("old").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    turn = (F.col("stays") - F.col("first")) % 2
    role = F.when(F.col("edit") == "K", F.col("old")).otherwise(F.when(turn == 1, "user").otherwise("assistant"))
    return joined.withColumn("first", first).select("conv_id", F.col("n").cast("long").alias("n"), F.col("i").alias("part"), "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
