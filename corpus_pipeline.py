"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality rules drop documents; line dedup cuts lines that an earlier line matches, and documents of which no
line is left; near-dedup keeps the first document of each component; decontamination drops documents that
benchmark windows cover; the last stage encodes what is left and decodes it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bpe import decode, encode
from loomline.llm.common import read, shared_folder
from loomline.llm.decontaminate import decontaminate
from loomline.llm.line_dedup import line_dedup
from loomline.llm.near_dup import near_duplicates
from loomline.llm.quality_rules import quality_rules

#: No SQL expresses the sketches, the verified joins and the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that all quality rules keep."""
    return quality_rules(docs).where("quality.kept").drop("quality")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier lines match; n_chars follows; those with no word left go."""
    cut = line_dedup(docs).where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.char_length("text")))
    return cut.select(*docs.columns)


def keep_first_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component."""
    gone = near_duplicates(docs).where("not kept and component_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    judged = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return judged.where("not contamination.contaminated").drop("contamination")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the digests of ids and of the text that they decode to."""
    both = decode(encode(docs))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", cut_lines),
    ("near_dedup", keep_first_of_alike),
    ("decontamination", keep_clean),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
