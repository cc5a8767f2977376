"""Numbers over whole tables without one task for all."""

import random

from loomline.operators import intervals, shared
from loomline.plans import catalog


def test_numbered_by_ranges(spark):
    names = [f"s{i:05d}" for i in range(3000)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(x,) for x in names], "seg string")
    got = shared.numbered(df, ["seg"], "id")
    assert {r.seg: r.id for r in got.collect()} == {x: i + 1 for i, x in enumerate(sorted(names))}
    assert shared.numbered(df.limit(0), ["seg"], "id").count() == 0
    blocks = [(i, 2 + (i % 7 == 0)) for i in range(500)]
    found = {r.block: r.block_id for r in intervals.renumbered(spark.createDataFrame(blocks, "block long, n long")).collect()}
    assert found == {b: i + 1 for i, (b, _) in enumerate(sorted(blocks, key=lambda x: (-x[1], x[0])))}


def test_event_steps_of_one_user(spark, tmp_path):
    rows = [(i, 7 if i % 3 else 8, i * 1000 % 86_400) for i in range(600)] + [(1000, None, 5), (1001, None, 9000)]
    spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.event_steps(spark, str(tmp_path))
    want = set()
    for user in (7, 8, None):
        own = [e for _, e in sorted((s, e) for e, u, s in rows if u == user)]
        want |= {(user, e, i, n) for i, (e, n) in enumerate(zip(own, [*own[1:], None]))}
    assert {(r.chr, r.event_id, r.idx, r.next_id) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("hour" in x for x in plan.splitlines() if "row_number()" in x and x.lstrip(" :+-").startswith("Window"))
