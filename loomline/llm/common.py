"""Column helpers that several text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Session setting that removes the shuffle files of a finished execution.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with value computed once even if body names it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, pattern: str = WORD) -> Column:
    """All matches of pattern in the whole text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() is far faster and right where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="spark-")  # one machine, as in tests
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of steps that run within go as soon as the step's result is in the shared folder."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage."""
    shared_folder(df.sparkSession)
    with tidied(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, for results that are large as plain rows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with tidied(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
