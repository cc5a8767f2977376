"""The registered queries of the text operators and their SQL.

Each query applies its operator, with production parameters, to its whole table and derives the
digest columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .chat_format import chat_format
from .common import read
from .conversation_repair import damaged, repair
from .decontaminate import decontaminate
from .html_extract import html_extract
from .line_dedup import line_dedup
from .metric_search import top_k
from .near_dup import near_duplicates
from .oracles import ORACLES
from .quality_model import quality_model
from .quality_rules import quality_rules
from .secret_scan import labelled_findings, secret_scan, train
from .url_filter import url_filter
from .whitening import whiten


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return judged.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        c["contaminated"].alias("contaminated"),
    )


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_model(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    rounded = [F.round(c, 6).alias(c) for c in ("own", "host_mean", "path_mean", "score")]
    return judged.select("doc_id", *rounded, "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(read(spark, sf_dir, "conversations"), derived=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "secret")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *(F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row."""
    both = decode(encode(docs))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    made = whiten(read(spark, sf_dir, "embeddings")).select("vec_id", "n", "deviation", "identity_error", each)
    return made.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_decontaminate, op3_quality_model, op4_html_extract, op5_chat_format,
        op6_quality_rules, op7_line_dedup, op8_secret_scan, op9_bpe, op10_near_duplicates,
        op11_top_k, op12_whitening, op13_conversation_repair,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
