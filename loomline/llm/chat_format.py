"""Chat formatting: tool calls linked to their results and messages written as canonical JSON.

An assistant message may be a JSON object with `tool_calls`, each an object with id, name and arguments; a tool
message may be a JSON object with `tool_call_id` and `content`. Calls and results meet in a hash join by
conversation and identifier; calls are ordered topologically, as an argument "$id" names another call
whose result it needs; arguments are checked against the schemas of the tools, which are given or derived from
what most calls of a tool do. Every message becomes one
line of canonical JSON (sorted keys, no spaces), so a long conversation is never gathered in one task.

Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: The roles that a message may have.
ROLES = ("system", "user", "assistant", "tool")
#: Derived schemas: an argument in so great a share of a tool's calls is required; one in less than the other share, or a type
#: in less than that share of an argument's values, is unknown.
REQUIRED, KNOWN = 0.9, 0.05
#: Numbers of more digits would be rounded by a variant.
LONG_NUMBER = r"\d[\d.]{38}"


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.get(F.regexp_extract_all(F.to_json(F.struct(text.alias("v"))), F.lit(r"(?s)\A\{\"v\":(.*)\}\z"), F.lit(1)), 0)


def canonical(pairs: list[tuple[str, Column]]) -> Column:
    """A JSON object with keys in order; pairs whose value is null are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(pairs, key=lambda x: x[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def members(text: Column) -> Column:
    """argument -> value of a JSON object, as variants; null if text is no object or repeats a key."""
    return F.when(F.ltrim(text).startswith("{"), F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))


def kind(value: Column) -> Column:
    """STRING, NUMBER, BOOLEAN, ARRAY, OBJECT or VOID."""
    name = F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), r"^[A-Z]+", 0)
    return F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(name)


def canonical_arguments(text: Column) -> Column:
    """The arguments object with its keys sorted at every depth; null if text is no JSON object."""

    def member(x, k):
        raw = x["values"][k]
        bare = raw.rlike(r"\A(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[{].*)\z")
        as_text = F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]").isNotNull() & F.contains(text, F.concat(F.lit('"'), raw, F.lit('"')))
        typed = x["members"][k]
        is_text = F.when(x["members"].isNotNull(), kind(typed) == "STRING").otherwise(as_text)
        sorted_ = F.when(raw.rlike(r"\A[\[{]") & ~raw.rlike(LONG_NUMBER), F.to_json(F.try_parse_json(raw)))
        return F.concat(quoted(k), F.lit(":"), F.when(raw.isNull(), F.lit("null")).when(bare & ~is_text, F.coalesce(sorted_, raw)).otherwise(quoted(raw)))

    def whole(x):
        keys = F.array_sort(F.map_keys(x["values"]))
        return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: member(x, k)), ","), F.lit("}"))

    values = F.from_json(text, "map<string,string>")
    both = F.struct(values.alias("values"), members(text).alias("members"))
    return F.when(values.isNotNull() & F.ltrim(text).startswith("{"), let(both, whole))


def tool_schemas(spark, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """(name, required, kinds) of tools; schemas: tool -> argument -> pattern its value must fit."""
    rows = [(name, list(args), args) for name, args in schemas.items()]
    return spark.createDataFrame(rows, "name string, required array<string>, kinds map<string,string>")


def derived_schemas(calls: DataFrame) -> DataFrame:
    """(name, required, kinds) of every tool in calls (name, arguments): its usual arguments and the types of each, by counts over all calls.

    kinds: argument -> pattern of its types; arguments and types that are rare in the tool's calls are left out.
    """
    typed = calls.select("name", F.transform_values(members(F.col("arguments")), lambda k, v: kind(v)).alias("m")).where("name is not null and m is not null")
    totals = typed.groupBy("name").agg(F.count("*").alias("n"))
    counted = typed.select("name", F.explode("m").alias("argument", "kind")).groupBy("name", "argument", "kind").agg(F.count("*").alias("of_kind"))
    each = counted.groupBy("name", "argument").agg(F.sum("of_kind").alias("used"), F.collect_list(F.struct("kind", "of_kind")).alias("types"))
    usual = F.array_join(F.transform(F.filter("types", lambda t: t["of_kind"] >= KNOWN * F.col("used")), lambda t: t["kind"]), "|")
    known = each.join(totals, "name").where(F.col("used") >= KNOWN * F.col("n"))
    known = known.select("name", "argument", F.concat(F.lit(r"\A(?:"), usual, F.lit(r")\z")).alias("pattern"), (F.col("used") >= REQUIRED * F.col("n")).alias("must"))
    tools = known.groupBy("name").agg(F.collect_list(F.when(F.col("must"), F.col("argument"))).alias("required"), F.map_from_entries(F.collect_list(F.struct("argument", "pattern"))).alias("kinds"))
    none = [F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.coalesce("kinds", F.create_map().cast("map<string,string>")).alias("kinds")]
    return totals.join(tools, "name", "left").select("name", *none)


def levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, id, needs) with level: 0 without needs, else one over the highest need; null on a cycle.

    One round of joins a level, over the calls not yet placed; needs that name no call of the conversation count
    as met.
    """
    calls = checkpointed(calls)
    edges = calls.select("conv_id", "id", F.explode("needs").alias("need"))
    edges = checkpointed(edges.join(calls.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"]))
    placed = None
    waiting, level = checkpointed(calls.select("conv_id", "id")), 0
    while True:
        open_edges = edges.join(waiting.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_semi")
        ready = waiting.join(open_edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(level))
        ready = checkpointed(ready)
        if not ready.limit(1).count():
            rest = waiting.withColumn("level", F.lit(None).cast("int"))
            return rest if placed is None else placed.union(rest)
        placed = ready if placed is None else placed.union(ready)
        waiting, level = checkpointed(waiting.join(ready, ["conv_id", "id"], "left_anti")), level + 1


def chat_format(turns: DataFrame, schemas: dict[str, dict[str, str]] | None = None, derived: bool = False) -> DataFrame:
    """(conv_id, turn, level, role, line, n_calls, n_linked, n_valid): each message as a canonical JSON line.

    line has content, conv_id, role, tool_calls (each with arguments, id, name) and turn. Messages order by
    turn, then by level, the topological place of a result's call. Calls with a result are linked; calls that give
    all arguments of the tool's schema, each fitting its pattern, and no others are valid (any JSON object where the
    tool has no schema). With derived, schemas come from the calls themselves, and the types must fit. Calls on a cycle have
    a null level. Null roles become user, unknown roles too; null texts are empty; a null conv_id or turn stays
    and is left out of the line; repeated rows give repeated lines; an identifier that repeats in a
    conversation counts once, by its least name and arguments. An empty table gives an empty one.
    """
    spark = turns.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    looks = F.ltrim(text).startswith("{")
    base = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.when((role == "assistant") & looks & text.contains('"tool_calls"'), F.from_json(text, CALLS)).alias("c"),
        F.when((role == "tool") & looks, F.from_json(text, RESULT)).alias("r"),
    )
    spoken = base.where("c.tool_calls is not null").select("conv_id", F.explode("c.tool_calls").alias("k")).select("conv_id", "k.*").where("id is not null")
    calls = checkpointed(spoken.groupBy("conv_id", "id").agg(F.min(F.struct("name", "arguments")).alias("k")).select("conv_id", "id", "k.*"))
    results = base.where("r.tool_call_id is not null").select("conv_id", F.col("r.tool_call_id").alias("id")).distinct()
    needs = F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'"\$([^"]+)"'), F.lit(1))
    order = levels(calls.select("conv_id", "id", F.array_distinct(needs).alias("needs")))
    if derived:
        tools = derived_schemas(calls)
        values = F.transform_values(members(F.col("arguments")), lambda k, v: kind(v))
    else:
        tools = F.broadcast(tool_schemas(spark, schemas or {}))  # as many rows as tools were given
        values = F.from_json("arguments", "map<string,string>")
    present = F.forall("required", lambda a: F.map_contains_key(values, a))
    fits = F.coalesce(present & F.forall(F.map_keys(values), lambda a: F.coalesce(F.regexp_like(values[a], F.col("kinds")[a]), F.lit(False))), F.lit(False))
    valid = canonical_arguments(F.col("arguments")).isNotNull() & (F.col("required").isNull() | fits)
    checked = calls.join(tools, "name", "left").select("conv_id", "id", F.coalesce(valid, F.lit(False)).alias("valid"))
    linked = checked.join(results.withColumn("linked", F.lit(True)), ["conv_id", "id"], "left").join(order, ["conv_id", "id"])
    linked = checkpointed(linked.select("conv_id", "id", "valid", F.coalesce("linked", F.lit(False)).alias("linked"), "level"))
    one = lambda k: canonical([("arguments", F.coalesce(canonical_arguments(k["arguments"]), quoted(k["arguments"]))), ("id", quoted(k["id"])), ("name", quoted(k["name"]))])
    content = F.when(F.col("c.tool_calls").isNotNull(), F.coalesce("c.content", F.lit(""))).when(F.col("r.tool_call_id").isNotNull(), F.coalesce("r.content", F.lit(""))).otherwise(F.col("text"))
    made = F.when(F.col("c.tool_calls").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("c.tool_calls", one), ","), F.lit("]")))
    line = canonical([
        ("content", quoted(content)), ("conv_id", F.col("conv_id").cast("string")), ("role", quoted(F.col("role"))), ("tool_call_id", quoted(F.col("r.tool_call_id"))),
        ("tool_calls", made), ("turn", F.col("turn").cast("string")),
    ])
    plain = base.where("c.tool_calls is null and r.tool_call_id is null")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_linked", "n_valid")]
    simple = plain.select("conv_id", "turn", F.lit(0).alias("level"), "role", line.alias("line"), *zero)
    # messages with calls count those of their own calls that are linked and valid
    key = F.xxhash64("conv_id", "turn", "text")
    calling = base.where("c.tool_calls is not null").withColumn("key", key)
    own = calling.select("conv_id", "key", F.explode(F.array_distinct(F.col("c.tool_calls.id"))).alias("id")).distinct().join(linked, ["conv_id", "id"])
    sums = own.groupBy("key").agg(F.count("*").alias("n_calls"), F.sum(F.col("linked").cast("long")).alias("n_linked"), F.sum(F.col("valid").cast("long")).alias("n_valid"))
    calling = calling.join(sums, "key", "left").select("conv_id", "turn", F.lit(0).alias("level"), "role", line.alias("line"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_calls", "n_linked", "n_valid")))
    answering = base.where("r.tool_call_id is not null").withColumn("id", F.col("r.tool_call_id")).join(linked.select("conv_id", "id", "level"), ["conv_id", "id"], "left")
    answering = answering.select("conv_id", "turn", "level", "role", line.alias("line"), *zero)
    return simple.union(calling).union(answering)
