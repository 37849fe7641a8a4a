"""Tables in the folder that the cluster shares: they cut lineage, survive lost executors and go when they are used up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of this many numeric ids at most (some 50 MB in memory) are broadcast; larger ones are joined by sorting.
BROADCAST_IDS = 1_000_000


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where none is set and everything runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="folianta-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed now and written to the shared checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables of one computation. Those that are superseded are dropped on the way, the others when the session's file system closes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at, self.paths = spark, f"{folder(spark)}/tables-{uuid.uuid4().hex}", {}
        path, fs = self._there(self.at)
        fs.deleteOnExit(path)

    def _there(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows, written now and read again."""
        at = f"{self.at}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.paths[id(out)] = (out, at)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, fs = self._there(self.paths[id(t)][1])
            fs.delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again: smaller than a checkpoint where there are long texts."""
    return Tables(df.sparkSession).keep(df)


def small(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """A stored table of ids, marked for broadcast where its numeric ids are ``BROADCAST_IDS`` at most."""
    number = ids.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.broadcast(ids) if number and ids.count() <= BROADCAST_IDS else ids
