"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests, a local
shell) a folder below the working directory's temp space is named once and used for the session.
Tables are Parquet, committed by Spark's own writer, so a lost executor costs a re-run task only.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET = "voxlake.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one of our own only where the session names none and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_UNSET, None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + os.path.join(tempfile.mkdtemp(prefix="voxlake-"))
        spark.conf.set(_UNSET, named)
    return named.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by 8 MB where the session has Spark's default of 64: rows here are whole texts."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH, str(8 << 20))
    return spark


def small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """For a join: broadcast where its rows, of a few numbers each, are at most so many; else as it is, to be shuffled."""
    return F.broadcast(df) if rows <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table does not have, in any case."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables of one operator call.  ``drop`` removes those no later step reads; the rest go when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded(spark)
        self.top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path(self.top)
        path.getFileSystem(self._conf()).deleteOnExit(path)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write a table and read it back: its lineage starts at the files."""
        to = f"{self.top}/{name}"
        df.write.mode("overwrite").options(**options).parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.top}/{name}")
            path.getFileSystem(self._conf()).delete(path, True)
