"""Tables that are replaced as a whole: versions in a folder, each put there by one rename after it was written, read again and found good.

A version is ``<path>/version=<n>``. Writers are optimistic: each says on which version it builds, and only one of those that build on the same one gets in. What is being written lies
beside the versions under a name that readers skip, and goes if anything fails, so readers see a whole version or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer came first, or what the new version builds on has changed."""


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> int | None:
    """The last version's number; None where there is none."""
    folder, fs = _path(spark, path)
    if not fs.exists(folder):
        return None
    names = (s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows, the last one's by default."""
    n = latest(spark, path) if version is None else version
    if n is None:
        raise FileNotFoundError(f"no version in {path}")
    return spark.read.parquet(f"{path}/version={n}")


def fingerprint(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows and two sums over hashes of rows that any change would shift; the order of rows doesn't count."""
    one, two = F.xxhash64(*rows.columns), F.xxhash64(F.lit(1), *rows.columns)
    got = rows.select(one.alias("a"), two.alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("a"), F.lit(0)), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")).first()
    return got[0], got[1], int(got[2])


def commit(rows: DataFrame, path: str, base: int | None, validate: Callable[[DataFrame], str | None] | None = None, unchanged: tuple[int, int, int] | None = None) -> int:
    """Writes the rows as the version after ``base`` (None: the first) and gives its number.

    ``validate`` looks at the rows as they were written and gives an error or None. With ``unchanged``, the base's fingerprint is taken again before the rename and must still be this one.
    A version that isn't valid raises ValueError, a lost race Conflict; in both cases, and if writing fails, nothing of it stays.
    """
    spark = rows.sparkSession
    staged, fs = _path(spark, f"{path}/_staged-{uuid.uuid4().hex}")
    into, _ = _path(spark, f"{path}/version={0 if base is None else base + 1}")
    try:
        rows.write.parquet(str(staged))
        error = validate(spark.read.schema(rows.schema).parquet(str(staged))) if validate else None
        if error:
            raise ValueError(error)
        if latest(spark, path) != base:
            raise Conflict(f"{path} is no longer at version {base}")
        if unchanged is not None and fingerprint(load(spark, path, base)) != unchanged:
            raise Conflict(f"version {base} of {path} has changed")
        files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        no_overwrite = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(staged), fs.makeQualified(into), no_overwrite)
        except Py4JJavaError as e:
            if fs.exists(into):
                raise Conflict(f"{into} is already there") from e
            raise
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)
    return 0 if base is None else base + 1
