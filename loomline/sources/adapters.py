"""Tables as ordered symbol sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.sequence import letters_to_bases


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_sequences(docs: DataFrame) -> DataFrame:
    """(chr, name, seq, size): each document's letters dealt to the four bases."""
    seqs = docs.select(F.col("doc_id").alias("chr"), F.concat("source", F.lit(".doc"), F.col("doc_id").cast("string")).alias("name"), letters_to_bases(F.col("text")).alias("seq"))
    return seqs.withColumn("size", F.length("seq").cast("long"))


def event_sequences(events: DataFrame) -> DataFrame:
    """(chr, event_id, ts, symbol): users as sequences of events; order is (ts, event_id)."""
    symbol = F.coalesce(*(F.when(F.col("event_type") == t, s) for t, s in zip(("view", "click", "signup", "purchase", "error"), "ACGTN")))
    return events.select(F.col("user_id").alias("chr"), "event_id", "ts", symbol.alias("symbol"))
