"""Trained operators by held-out accuracy, chat formatting by its canonical form."""

import json
import re

from pyspark.sql import functions as F

from loomline.llm.chat_format import chat_format
from loomline.llm.quality_model import quality_model
from loomline.llm.secret_scan import CANDIDATE, describe, labelled_findings, secret_scan, train

AT = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{AT}/{name}.parquet")


def test_quality_held_out(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    held = F.col("doc_id") % 3 == 0
    got = quality_model(docs, labels.where(~held))
    assert got.count() == docs.count()
    right = got.join(labels.where(held), "doc_id").agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.9, right


def test_quality_odd(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "a", "b", 2), (2, "", "a", "b", 2), (None, "word " * 50_000, "a", None, 3)], "doc_id long, text string, source string, lang string, host int")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert quality_model(docs, labels).count() == 4
    assert quality_model(docs.limit(0), labels).count() == 0
    assert quality_model(docs, labels.limit(0)).where("score between 0.49 and 0.51").count() == 4


def test_secrets_held_out(spark):
    found = labelled_findings(spark)
    part = F.pmod(F.hash("candidate"), F.lit(4)) == 0
    model = train(found.where(~part))
    judged = model.transform(found.where(part).select(*describe(F.col("candidate"), F.col("before")), "label"))
    assert judged.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] >= 0.95


def test_secret_places(spark):
    model = train(labelled_findings(spark))
    docs = read(spark, "documents").select("doc_id", "text").limit(200)
    want = sorted((r.doc_id, m.start(), m[0]) for r in docs.collect() for m in re.finditer(CANDIDATE, r.text or "", re.A))
    got = secret_scan(docs, model).collect()
    assert sorted((r.doc_id, r.start, r.candidate) for r in got) == want
    rows = [(1, None, 1), (2, "", 2), (None, 'api_key = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c"', 3), (3, "plain words here", 4), (4, "x" * 300_000, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, start int")
    found = {r.doc_id: r.secret for r in secret_scan(odd, model).collect()}
    assert found == {None: True, 4: False}
    assert secret_scan(odd.limit(0), model).count() == 0


def canon(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_chat_canonical(spark):
    turns = read(spark, "conversations")
    got = chat_format(turns).collect()
    assert len(got) == turns.count()
    for r in got:
        assert canon(json.loads(r.line)) == r.line, r.line


def test_chat_links(spark):
    call = lambda *calls: json.dumps({"content": "go", "tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in calls]})
    result = lambda i: json.dumps({"tool_call_id": i, "content": "42"})
    rows = [
        (1, 0, "user", 'say "hi"\n', 1), (1, 1, "assistant", call(("a", "find", '{"q":"x","n":3}'), ("b", "sum", '{"of":"$a"}'), ("c", "sum", '{"of":"$b"}')), 1),
        (1, 2, "tool", result("a"), 1), (1, 2, "tool", result("b"), 1), (1, 2, "tool", result("c"), 1), (1, 3, "robot", None, 1),
        (2, 1, "assistant", call(("a", "find", '{"n":"many"}'), ("p", "sum", '{"of":"$r"}'), ("r", "sum", '{"of":"$p"}')), 1), (2, 2, "tool", result("none"), 1),
        (None, None, None, "", None), (3, 0, "user", "long " * 100_000, 1), (3, 0, "user", "twice", 1), (3, 0, "user", "twice", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    got = chat_format(df, {"find": {"q": ".+", "n": r"\A\d+\z"}}).collect()
    assert len(got) == len(rows)
    first = next(r for r in got if r.conv_id == 1 and r.role == "assistant")
    assert (first.n_calls, first.n_linked, first.n_valid) == (3, 3, 3)
    other = next(r for r in got if r.conv_id == 2 and r.role == "assistant")
    assert (other.n_calls, other.n_linked, other.n_valid) == (3, 0, 2)
    assert {json.loads(r.line)["tool_call_id"]: r.level for r in got if r.role == "tool"} == {"a": 0, "b": 1, "c": 2, "none": None}
    assert [json.loads(r.line)["role"] for r in got if r.turn == 3] == ["user"]
    for r in got:
        assert canon(json.loads(r.line)) == r.line
    assert chat_format(df.limit(0)).count() == 0
