"""Conversation repair against a brute-force version that tries edits breadth-first, and its defined results of odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from loomline.llm import conversation_repair as cr
from loomline.llm import queries as q

AT = "/root/testdata/sf0.01"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, n int, fault string, audit long"


def struck(rows):
    """Damaged rows by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def legal(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(roles)) is not None


def brute(rows):
    """Faults, then the least (cost, audit) of all edits by memoised recursion over (row, roles' state)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(at, state, inserted):
        """Least (cost, edits) from row at on; state: the repaired initials that matter, '', s, u or a."""
        options = [(0, "", ())] if at == len(rows) and state in ("", "a") else []

        def may(role):
            return role == "s" and state == "" or role == "u" and state in ("", "s", "a") or role == "a" and state == "u"

        if inserted < 3:
            options += [(5 + c, "I" + e, ((x, None), *m)) for x in "ua" if may(x) for c, e, m in [best(at, x, inserted + 1)] if c < 10**9]
        if at < len(rows):
            role, stays = rows[at][1], 5 * (faults[at] == "truncated")
            c, e, m = best(at + 1, state, 0)
            options.append((2 + c, "D" + e, m))
            if faults[at] not in ("blank", "duplicate"):
                if may(role[:1]) and role:
                    c, e, m = best(at + 1, role[:1], 0)
                    options.append((stays + c, "K" + e, (("", at), *m)))
                for x in "ua":
                    if may(x):
                        c, e, m = best(at + 1, x, 0)
                        options.append((1 + stays + c, "R" + e, ((x, at), *m)))
        return min(options, default=(10**9, "", ()))

    cost, audit, made = best(0, "", 0)
    full = {"u": "user", "a": "assistant"}
    lines = [f"{full[x] if x else rows[i][1]}:{'' if i is None else rows[i][2]}" for x, i in made]
    turns = {r[0] for r in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    assert legal(x.split(":")[0][:1] for x in lines)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def compare(got, rows):
    want = sorted([(conv, *brute(mine)) for conv, mine in struck(rows).items()], key=repr)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{AT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(q.op13_conversation_repair(spark, AT), rows)


def odd():
    rng = random.Random(2)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "s", "a"]
    texts = [None, "", " \n", "One.", "One.", "Two", "Three!\n ", "four?　", "x" * 50_000, "…"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(150)] for _ in range(rng.randrange(1, 9))]
    return rows + rows[:40] + [(1000, t, "user", "again.") for t in range(30)] + [(1001, 5, "user", "same.")] * 20


@pytest.mark.parametrize("segment", [1024, 3, 1])
def test_odd_rows(spark, segment, monkeypatch):
    rows = odd()
    df = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], SCHEMA).repartition(5)
    if segment == 1024:
        compare(cr.repair(cr.damaged(df)), rows)
        assert cr.repair(cr.damaged(df.limit(0))).collect() == []
        return
    # workers read the module anew, so smaller segments are tried here
    monkeypatch.setattr(cr, "ROWS", segment)
    for conv, mine in struck(rows).items():
        now, seen = cr._Conversation(conv), set()
        for turn, role, text in sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            now.add(turn, role, text, 1 if not visible else 2 if (role, text) in seen else 3 if visible[-1] not in ".!?" else 0)
            seen.add((role, text))
        assert now.result() == (conv, *brute(mine))


def test_dropped_conversation(spark):
    conv = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert tuple(cr.repair(cr.damaged(df)).first()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rows_of_the_repair(spark):
    rows = odd()
    df = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], SCHEMA)
    found = cr.repair(cr.damaged(df))
    made = {}
    for r in cr.repaired_rows(cr.damaged(df), found).orderBy("n", "part").collect():
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(made.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_undamaged(spark):
    """repair() takes plain conversations too."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "assistant", "Hello."), (2, 1, "user", "cut")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (0, "KKK"), 2: (4, "DD")}
