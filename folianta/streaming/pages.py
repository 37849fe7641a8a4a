"""The page operators over streams: they look at one page at a time, so they run on streaming frames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, search


def read_pages(spark: SparkSession, path: str, schema: str = "doc_id long, page int, text string", files_at_once: int = 100) -> DataFrame:
    """Pages that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def stream_matches(pages: DataFrame, query: str, **options) -> DataFrame:
    return search.find_text(pages, query, **options)


def stream_sensitive(pages: DataFrame, kinds: tuple[str, ...] = detect.KINDS) -> DataFrame:
    return detect.sensitive(pages, kinds)


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of event types in windows of event time, with a bound on lateness: (start, event_type, n, total)."""
    w = F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: (user_id, start, end, n)."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_batches(stream: DataFrame, path: str, checkpoint: str, key: str = "batch_id"):
    """Idempotent batches: each batch overwrites its own folder, so a batch that runs again changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{key}={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
