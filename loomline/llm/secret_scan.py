"""Secret scans: candidate strings judged by a random forest trained on labelled findings.

Candidates are runs of 16 or more key-like characters, and quoted values after a name. Each has features of its
length, character transitions, dictionary coverage, path and neighbouring words; the forest, trained on a
bounded table of labelled findings, removes false positives. All of it is DataFrame and ML-pipeline work in
the JVM; candidates are rows from the start, and nothing is shuffled after the scan.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, sign of assignment and quoted value; or a bare run.
CANDIDATE = r"""(?:[A-Za-z_][\w.\-]{1,40}["']?\s{0,3}[=:]\s{0,3}["'][^"'\s]{8,512}["'])|(?:[A-Za-z0-9_\-+/=.]{16,})"""
ASSIGNED = r"""\A([A-Za-z_][\w.\-]{1,40})["']?\s{0,3}[=:]\s{0,3}["']([^"'\s]{8,512})["']\z"""
#: Names that secrets are given, words of placeholders, and frequent words and word parts.
KEY_NAMES = "token|secret|passwd|password|pwd|api|apikey|access|auth|bearer|credential|private|key"
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|xxxx|test|todo|none|null|redacted|1234"
DICTIONARY = (
    "that|this|with|from|have|what|when|your|which|their|about|would|there|other|some|time|data|file|name|user|page|site|home|index|image|photo|news|blog|post|"
    "article|version|license|public|general|work|under|the|and|for|not|are|was|ing|tion|ment|able|ness|ent|ion|est|ver|con|pro|com|org|net|html|http|www"
)
FEATURES = ["length", "switches", "coverage", "digits", "distinct", "in_path", "dotted", "named", "placeholder", "prefixed"]
#: The forest: trees, depth, and labelled findings it is trained on at most.
TREES, DEPTH, LABELLED, SEED = 24, 6, 20_000, 7


def describe(candidate: Column, before: Column) -> list[Column]:
    """The features of a candidate and the text before it."""
    name = F.regexp_extract(candidate, ASSIGNED, 1)
    value = F.when(name != "", F.regexp_extract(candidate, ASSIGNED, 2)).otherwise(candidate)
    n = F.char_length(value).cast("double")
    low = F.lower(value)
    around = F.concat_ws(" ", F.lower(before), F.lower(name))
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "Z")
    return [
        F.least(n, F.lit(256.0)).alias("length"),
        (F.char_length(kind) / n).alias("switches"),
        (1 - F.char_length(F.regexp_replace(low, DICTIONARY, "")) / n).alias("coverage"),
        (F.regexp_count(value, F.lit("[0-9]")) / n).alias("digits"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0))).alias("distinct"),
        (value.contains("/") | F.rtrim(before).rlike(r"(?:://\S*|/)\z")).cast("double").alias("in_path"),
        (F.regexp_count(value, F.lit(r"[.\-_]")) / n).alias("dotted"),
        around.rlike(KEY_NAMES).cast("double").alias("named"),
        (low.rlike(PLACEHOLDERS) | low.rlike(r"(.)\1{5}")).cast("double").alias("placeholder"),
        value.rlike(r"\A(?:AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk_|pk_|glpat-|AIza|eyJ|ya29\.)").cast("double").alias("prefixed"),
    ]


def labelled_findings(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """(candidate, before, label): a synthetic table of true and false findings, made by digests of a counter."""
    n = min(n, LABELLED)
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "[+/=]", "")
    pick = lambda options, k: F.element_at(F.array(*map(F.lit, options)), (F.abs(F.hash(F.col("id"), F.lit(k))) % len(options) + 1).cast("int"))
    name = pick(["token", "secret", "api_key", "TOKEN", "password", "access_token", "auth", "private_key"], 1)
    other = pick(["title", "id", "href", "name", "color", "commit", "etag", "image", "path"], 2)
    word = pick(["thousandth", "information", "something", "nevertheless", "characteristic", "international", "straightforward"], 3)
    true = [
        F.concat(name, F.lit(' = "'), F.substring(h("a"), 1, 40), F.lit('"')),
        F.concat(name, F.lit(': "'), F.substring(mixed("b"), 1, 32), F.lit('"')),
        F.concat(F.upper(name), F.lit(' = "'), F.upper(F.substring(h("c"), 1, 40)), F.lit('"')),
        F.concat(pick(["AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"], 4), F.substring(mixed("d"), 1, 24)),
    ]
    false = [
        F.concat(word, F.lit("/"), other, F.lit("/"), F.substring(h("e"), 1, 6), F.lit(".html")),
        F.concat(name, F.lit(' = "'), pick(["your-token-here", "xxxxxxxxxxxxxxxx", "changeme1234", "EXAMPLEKEYEXAMPLE", "<redacted-value>", "placeholder-value"], 5), F.lit('"')),
        F.concat(word, F.lit("-"), word, F.lit("-"), other),
        F.concat(other, F.lit(' = "'), word, F.lit("."), other, F.lit('"')),
        F.concat_ws("-", F.substring(h("f"), 1, 4), F.lit("1234"), F.lit("5678"), F.lit("0000")),
        F.concat(F.lit("v"), F.substring(F.conv(F.substring(h("g"), 1, 15), 16, 10), 1, 16), F.lit(".0.0")),
        F.concat(other, F.lit(' = "'), F.substring(h("i"), 1, 40), F.lit('"')),
        F.concat(word, word, other),
        F.substring(F.conv(F.substring(h("j"), 1, 15), 16, 10), 1, 17),
    ]
    i = F.col("id")
    kinds = [(x, 1.0) for x in true] * 2 + [(x, 0.0) for x in false]
    candidate = F.coalesce(*(F.when(i % len(kinds) == k, x) for k, (x, _) in enumerate(kinds)))
    label = F.coalesce(*(F.when(i % len(kinds) == k, F.lit(y)) for k, (_, y) in enumerate(kinds)))
    before = pick(["see the ", "and with ", "", "for the value of ", "http://example.com/", "of this "], 6)
    return spark.range(0, n, 1, 1).select(candidate.alias("candidate"), before.alias("before"), label.alias("label"))


def train(findings: DataFrame) -> PipelineModel:
    """A random forest over labelled findings (candidate, before, label); at most LABELLED rows are used."""
    rows = findings.limit(LABELLED).select(*describe(F.col("candidate"), F.coalesce("before", F.lit(""))), "label")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep"), forest]).fit(rows)


def secret_scan(docs: DataFrame, model: PipelineModel, keep_at: float = 0.5) -> DataFrame:
    """(doc_id, start, length, candidate, probability, secret) of every candidate in the whole texts.

    start counts characters from 0. Null and empty texts have no candidates; a text repeated in rows gives its
    findings for each; a null doc_id stays null. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # each piece of the text between candidates goes with the candidate that ends it
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(text, CANDIDATE)
    base = docs.select("doc_id", found.alias("found"), F.when(F.size(found) > 0, gaps).alias("gaps")).where(F.size("found") > 0)
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size("found") - 1),
        place,
        lambda s, i: F.struct((s["at"] + F.char_length(F.get(F.col("gaps"), i)) + F.char_length(F.get(F.col("found"), i))).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.char_length(F.get(F.col("gaps"), i)))).alias("starts")),
        lambda s: s["starts"],
    )
    rows = base.select("doc_id", "found", "gaps", starts.alias("starts")).select("doc_id", F.explode(F.arrays_zip(F.col("found").alias("c"), F.slice("gaps", 1, F.size("found")).alias("g"), F.col("starts").alias("s"))).alias("z"))
    named = rows.select("doc_id", F.col("z.c").alias("candidate"), F.right(F.col("z.g"), F.lit(40)).alias("before"), F.col("z.s").cast("long").alias("start"))
    judged = model.transform(named.select("*", *describe(F.col("candidate"), F.col("before"))))
    p = vector_to_array("probability")[1]
    return judged.select("doc_id", "start", F.char_length("candidate").cast("long").alias("length"), "candidate", p.alias("probability"), (p >= keep_at).alias("secret"))
