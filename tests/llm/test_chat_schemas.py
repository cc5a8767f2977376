"""Arguments of tool calls: their canonical form at every depth and their check against schemas."""

import json

from loomline.llm import queries
from loomline.llm.chat_format import canonical_arguments, chat_format
from pyspark.sql import functions as F


def said(conv, calls):
    return (conv, 1, "assistant", json.dumps({"content": "", "tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in calls]}))


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_canonical_arguments(spark):
    texts = ['{"b":{"z":1,"a":[{"y":2.5,"x":"é"}]},"a":null}', '{"a":null,"b":{"a":[{"x":"é","y":2.5}],"z":1}}', '{"s":"{\\"b\\":1,\\"a\\":2}"}', '{"n":1,"t":"1"}', '{"a":{"v":123456789012345678901234567890123456789012}}', "{}"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", canonical_arguments(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts]
    odd = [r.c for r in spark.createDataFrame([("x",), ("[1]",), (None,), ("",)], "t string").select(canonical_arguments(F.col("t")).alias("c")).collect()]
    assert odd == [None] * 4


ODD = {1: '{"n":1}', 2: '{"q":"x","n":"1"}', 3: '{"q":"x","n":1,"z":1}', 4: "no object", 5: '{"q":"x","n":2.5}', 6: '{"n":3,"q":"x"}'}
VALID = {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1}


def test_derived_schemas(spark, tmp_path):
    usual = [said(100 + i, [("a", "find", '{"q":"x","n":1}'), ("b", "ping", "{}")]) for i in range(60)]
    df = turns(spark, usual + [said(c, [("a", "find", a)]) for c, a in ODD.items()] + [said(7, [("a", "ping", '{"n":1}')]), said(8, [("a", None, "{}")])])
    got = {r.conv_id: r.n_valid for r in chat_format(df, derived=True).collect()}
    assert {c: got[c] for c in range(1, 9)} == VALID | {7: 0, 8: 1}
    assert all(got[100 + i] == 2 for i in range(60))
    assert chat_format(df.limit(0), derived=True).count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id: r.n_valid for r in queries.op5_chat_format(spark, str(tmp_path)).collect()} == got


def test_given_schemas(spark):
    df = turns(spark, [said(c, [("a", "find", a)]) for c, a in ODD.items()])
    got = {r.conv_id: r.n_valid for r in chat_format(df, {"find": {"q": ".+", "n": r"\A\d+\z"}}).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
