"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic model of the measures of quality_rules, fitted on a bounded sample of labelled documents, gives
each document its own evidence. Grouped sums of that evidence give every path (a part of a host) and every
host a posterior: a path is shrunk toward its host, a host toward the global mean, by prior strengths taken
from the spread between the groups, so sparse sites stay near the global prior. A document's score adds to
its own log-odds what its path is above or below the global mean.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .quality_rules import measures

#: The model is fitted on at most so many labelled documents of each class, the first by a hash of doc_id.
LABELLED = 5_000
FEATURES = ["symbols", "shout", "stop", "chars", "repeats", "dup_lines", "pipes"]
#: Evidence of one document is held within these odds, so that no text overrules all else.
LIMIT = 12.0
#: Weight of what the path adds, and the hosts and paths that are broadcast at most.
SITE_WEIGHT, BROADCAST_SITES = 0.5, 50_000


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, host, path and the features of each row; docs has doc_id, text and, if any, source and lang."""
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), site("source").alias("host"), site("lang").alias("path"))
    m = measures(plain)
    n, w = F.col("_q.w.n_words"), F.col("_q.w")
    pipes = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r" \| "))
    return m.select(
        "doc_id", "host", "path", n.alias("n_words"),
        F.least(_share(F.col("_q.symbols"), n), F.lit(1.0)).alias("symbols"),
        F.least(_share(F.col("_q.shout"), n), F.lit(1.0)).alias("shout"),
        _share(w["n_stop"], n).alias("stop"),
        F.least(_share(w["word_chars"], n), F.lit(30.0)).alias("chars"),
        _share(w["n_repeat_words"], n).alias("repeats"),
        _share(F.col("_q.l.n_dup_lines"), F.col("_q.l.n_lines")).alias("dup_lines"),
        F.least(_share(pipes, n), F.lit(1.0)).alias("pipes"),
    )


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior strength by moments: what of the spread between groups the chance within them does not explain."""
    row = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("v")).first()
    within = max(mean * (1 - mean), 1e-9)
    if not row.k or row.k < 2 or not row.n:
        return 100.0
    between = max((row.v - (row.k - 1) * within) / row.n, 1e-9)
    return min(max(within / between - 1, 1.0), 10_000.0)


def quality_model(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, own (the text's evidence as a probability), host_mean, path_mean, score and kept for each row of docs.

    labels: doc_id and quality (0 or 1; null is no label). Without labels of both classes every document's own
    evidence is even. Null and empty texts have all measures zero; null hosts and paths are the
    empty name. Rows that repeat get equal scores but count each in their site. Equal doc_ids with
    other labels use each label once. An empty table gives an empty one.
    """
    f = checkpointed(features(docs))
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("label")).distinct()
    order = F.xxhash64("doc_id")
    sample = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(LABELLED) for y in (0.0, 1.0)]
    train = checkpointed(f.join(F.broadcast(sample[0].union(sample[1])), "doc_id"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="x")
    classes = {r.label for r in train.select("label").distinct().collect()}
    if len(classes) == 2:
        # both classes weigh the same
        n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        weighted = train.withColumn("weight", F.when(F.col("label") == 1.0, 1.0 / n[1.0]).otherwise(1.0 / n[0.0]) * (n[0.0] + n[1.0]) / 2)
        model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-4, maxIter=50).fit(assembler.transform(weighted))
        scored = model.transform(assembler.transform(f)).select("doc_id", "host", "path", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), vector_to_array("rawPrediction")[1])).alias("evidence"))
    else:
        scored = f.select("doc_id", "host", "path", F.lit(0.0).alias("evidence"))
    own = 1 / (1 + F.exp(-F.col("evidence")))
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(own).alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total.s / total.n if total.n else 0.5
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    of_host, of_path = _strength(hosts, mean), _strength(paths, mean)
    host = hosts.select("host", ((of_host * F.lit(mean) + F.col("s")) / (of_host + F.col("n"))).alias("host_mean"))
    site = paths.join(host, "host").select("host", "path", "host_mean", ((of_path * F.col("host_mean") + F.col("s")) / (of_path + F.col("n"))).alias("path_mean"))
    site = checkpointed(site)
    few = site.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    joined = scored.join(F.broadcast(site) if few else site, ["host", "path"])
    odds = F.col("evidence") + SITE_WEIGHT * (_logit(F.col("path_mean")) - _logit(F.lit(mean)))
    score = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", own.alias("own"), "host_mean", "path_mean", score.alias("score"), (score >= keep_at).alias("kept"))
