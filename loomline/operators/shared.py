"""Written steps in the folder that all executors share, and ordinals over ranges."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Session setting that removes the shuffle files of a finished execution.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go as soon as it has ended."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


class Scratch:
    """The steps written since it was begun, by folder; those that are not kept go at its end, or when they are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def keep(self, *steps: DataFrame | None) -> None:
        """Hands steps, as checkpointed() gave them, to the scratch around this one, or to the end of the application."""
        own = {s.written_at for s in steps if s is not None} & set(self.folders)
        self.folders = [f for f in self.folders if f not in own]
        outer = _open.stack[_open.stack.index(self) - 1] if _open.stack.index(self) else None
        if outer is not None:
            outer.folders += sorted(own)

    def drop(self, *but: DataFrame | None) -> None:
        """Removes all steps but these; nothing may read the others any more."""
        kept = {s.written_at for s in but if s is not None}
        gone, self.folders = [f for f in self.folders if f not in kept], [f for f in self.folders if f in kept]
        context = self.spark.sparkContext
        for folder in gone:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch for the steps that are written within."""
    if not hasattr(_open, "stack"):
        _open.stack = []
    mine = Scratch(spark)
    _open.stack.append(mine)
    try:
        yield mine
    finally:
        mine.drop()
        _open.stack.remove(mine)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage: written as Parquet in the folder that the session names in spark.checkpoint.dir, and read again.

    What is read has the sizes of its files, so that joins with small tables are planned as such; a checkpoint keeps the
    estimates of the plan that it cuts, which grow without bound in a loop of joins. Its shuffle files go at once, its folder with
    the scratch() around it, if there is one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="spark-")  # one machine, as in tests
        context.setCheckpointDir(folder)
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    if getattr(_open, "stack", None):
        _open.stack[-1].folders.append(path)
    with tidied(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def counted(df: DataFrame, **conditions) -> tuple[DataFrame, dict[str, int]]:
    """checkpointed(df), and how many of its rows meet each condition, seen as they are written."""
    seen = Observation()
    made = checkpointed(df.observe(seen, *(F.count_if(c).alias(name) for name, c in conditions.items())))
    return made, seen.get


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with name, their ordinal from 1 by order, columns whose values no two rows share.

    Rows are dealt by ranges of order and numbered within each; ranges are shifted by the counts of those before.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # cut from its lineage, as a second run might draw other ranges
    dealt = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias(name))
