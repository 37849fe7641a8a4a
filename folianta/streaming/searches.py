"""Searches that newer ones supersede, and results that are only worked out as far as they are read."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


class Latest:
    """Runs the last search of each key and no other.

    A search waits until no newer one of its key has come for ``quiet`` seconds, so only the last of a burst starts. One that runs already when a newer one comes has its Spark jobs
    cancelled by their tag. Results are written beside their place and put there by one rename, only while the search is still its key's last one, so a search that was superseded leaves
    nothing, however far it got.
    """

    def __init__(self, spark: SparkSession, quiet: float = 0.15, at_once: int = 8) -> None:
        self.spark, self.quiet = spark, quiet
        self.last: dict[str, tuple[str, threading.Event]] = {}
        self.lock, self.pool = threading.Lock(), ThreadPoolExecutor(at_once)

    def submit(self, key: str, rows: Callable[[], DataFrame], path: str) -> Future:
        """The search's future: ``path`` once its rows are there, or None where a newer search of the key came."""
        tag, gone = f"search-{uuid.uuid4().hex}", threading.Event()
        with self.lock:
            older, self.last[key] = self.last.get(key), (tag, gone)
        if older:
            older[1].set()
            self.spark.sparkContext.cancelJobsWithTag(older[0])
        return self.pool.submit(self._run, key, tag, gone, rows, path)

    def cancel(self, key: str) -> None:
        """Stops the key's search, if one waits or runs."""
        with self.lock:
            older = self.last.pop(key, None)
        if older:
            older[1].set()
            self.spark.sparkContext.cancelJobsWithTag(older[0])

    def _run(self, key: str, tag: str, gone: threading.Event, rows: Callable[[], DataFrame], path: str) -> str | None:
        if gone.wait(self.quiet):
            return None
        into = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        beside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}._{tag}")
        fs = into.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.spark.sparkContext.addJobTag(tag)
        self.spark.sparkContext.setInterruptOnCancel(True)
        try:
            rows().write.parquet(str(beside))
            with self.lock:
                if gone.is_set():
                    return None
                fs.delete(into, True)
                fs.rename(beside, into)
            return path
        except Exception:
            if gone.is_set():
                return None
            raise
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            fs.delete(beside, True)

    def close(self) -> None:
        for key in list(self.last):
            self.cancel(key)
        self.pool.shutdown()


def last_asked(queries: DataFrame) -> DataFrame:
    """(key, seq, query): of a batch of queries, the last of each key."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    return queries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def follow(queries: DataFrame, latest: Latest, search: Callable[[str], DataFrame], path: str, checkpoint: str, every: str = "1 second"):
    """Searches for the queries of a stream (key, seq, query): each trigger takes the last query of each key, which supersedes what still runs for that key. Results lie in ``<path>/<key>``."""

    def put(batch: DataFrame, _: int) -> None:
        for row in last_asked(batch).toLocalIterator():
            latest.submit(row["key"], lambda q=row["query"]: search(q), f"{path}/{row['key']}")

    return queries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def lazily(rows: DataFrame) -> Iterator[Row]:
    """The rows in their order, a partition at a time: what isn't asked for isn't worked out."""
    yield from rows.toLocalIterator(prefetchPartitions=False)
