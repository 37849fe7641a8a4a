"""Sharding by fixed virtual slots.

A record hashes into one of a fixed number of virtual slots (thousands, far more than there will ever be
shards). Only slots are ever assigned to shards, in a small versioned map: version 0 deals the slots out in
turn, a rebalance aggregates the bytes of each slot and writes the next version, in which slots move from
shards that hold more than their share to those that hold less. The map has one row a slot, so its size is
bounded by ``n_slots`` whatever the data, and it is the only thing that is broadcast.

Cases: a null text counts as empty (one byte); a null ``doc_id`` hashes by its text instead, so that such
rows do not meet in one slot; repeated rows get places of their own; an empty table gives no rows; other columns of the
input are carried by :func:`assign` unless they are named like one that it adds, which is then replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import versions
from .shared import Tables, stored

N_SLOTS = 4096
N_SHARDS = 16
#: A shard keeps its slots, largest first, up to this part of its fair share; what is above is dealt again.
KEEP = 0.9


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) and one for the row's end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def virtual_slot(doc_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(n_slots)).cast("int")


def first_map(spark: SparkSession, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt out in turn. Columns version, vslot, shard."""
    return spark.range(n_slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def slot_loads(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Bytes and rows of each virtual slot that has any."""
    slot = virtual_slot(F.col("doc_id"), F.col("text"), n_slots).alias("vslot")
    return docs.select(slot, row_bytes(F.col("text")).alias("n")).groupBy("vslot").agg(F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _put(loads: Column, shard: Column, n: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + n).otherwise(x))


def rebalance(slot_map: DataFrame, loads: DataFrame, n_shards: int = N_SHARDS, keep: float = KEEP) -> DataFrame:
    """The next version of a map for these loads.

    Folds over the slots (one row a slot: bounded), largest first. A slot stays where it is while its shard
    is within ``keep`` of the mean; the others then go, again largest first, to the shard with the fewest
    bytes. Also grows or shrinks a map: a slot of a shard that no longer exists is always dealt again.
    """
    rows = slot_map.join(F.broadcast(loads), "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    slots = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "shard")))
    one = rows.agg(slots.alias("slots"), (F.max("version") + 1).alias("version"), (F.sum("bytes") * F.lit(keep / n_shards)).alias("share"))
    empty = F.array_repeat(F.lit(0).cast("long"), n_shards)
    none = F.filter(F.transform("slots", lambda s: F.struct(s["vslot"].alias("vslot"), s["shard"].alias("shard"))), lambda s: F.lit(False))

    def stay(state: Column, s: Column) -> Column:
        fits = (s["shard"] < n_shards) & (F.get(state["loads"], s["shard"]) - s["neg"] <= F.col("share"))
        return F.struct(
            F.when(fits, _put(state["loads"], s["shard"], -s["neg"])).otherwise(state["loads"]).alias("loads"),
            F.when(fits, F.concat(state["put"], F.array(F.struct(s["vslot"].alias("vslot"), s["shard"].alias("shard"))))).otherwise(state["put"]).alias("put"),
            F.when(fits, state["rest"]).otherwise(F.concat(state["rest"], F.array(s))).alias("rest"),
        )

    def deal(state: Column, s: Column) -> Column:
        to = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(_put(state["loads"], to, -s["neg"]).alias("loads"), F.concat(state["put"], F.array(F.struct(s["vslot"].alias("vslot"), to.alias("shard")))).alias("put"))

    kept = one.select("version", F.aggregate("slots", F.struct(empty.alias("loads"), none.alias("put"), F.filter("slots", lambda s: F.lit(False)).alias("rest")), stay).alias("k"))
    dealt = kept.select("version", F.aggregate("k.rest", F.struct(F.col("k.loads").alias("loads"), F.col("k.put").alias("put")), deal).alias("d"))
    return dealt.select("version", F.explode("d.put").alias("p")).select("version", "p.vslot", "p.shard")


def next_map(spark: SparkSession, loads: DataFrame, path: str | None = None, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """The stored map's next version: the last one, edited by one rebalance for these loads, appended and read again.

    ``path`` is where the versions lie; a new one begins with version 0. Without a path they lie in the cluster's shared folder and go with the session.
    """
    at = path or f"{Tables(spark).at}/slot-map"
    if versions.latest(spark, at) is None:
        save_map(first_map(spark, n_shards, n_slots), at)
    save_map(rebalance(load_map(spark, at), loads, n_shards), at)
    return load_map(spark, at)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add one version to the stored map, by one rename after it was written whole; where another writer has added this version, or it isn't the next one, that is an error and nothing stays."""
    kept = stored(slot_map)
    n, slots, shards = kept.agg(F.max("version"), F.count_distinct("vslot"), F.count("shard")).first()

    def whole(rows: DataFrame) -> str | None:
        return None if rows.agg(F.count_distinct("vslot"), F.count("shard")).first() == (slots, slots) and slots == shards else "a map has one shard for each slot"

    versions.commit(kept.select("vslot", "shard").coalesce(1), path, n - 1 if n else None, whole)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default."""
    n = versions.latest(spark, path) if version is None else version
    return versions.load(spark, path, n).select(F.lit(n).alias("version"), "vslot", "shard")


def assign(docs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds vslot, shard and map_version to each row, without a shuffle (the map has ``n_slots`` rows)."""
    own = docs.drop("vslot", "shard", "map_version").withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text"), n_slots))
    return own.join(F.broadcast(slot_map.withColumnRenamed("version", "map_version")), "vslot", "left")


def place(docs: DataFrame, slot_map: DataFrame, loads: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard, slot, vslot, map_version.

    ``slot`` numbers the rows of a shard from 0 without gaps. It is the number of rows in the shard's earlier
    virtual slots plus the row's number in its own, so rows only meet others of their virtual slot.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(F.broadcast(loads), "vslot").select("vslot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.col("text"), n_slots).alias("vslot"))
    number = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("nth", number).join(F.broadcast(starts), "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "vslot", "map_version")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Places all rows by the stored map's next version; the law is `bytes`."""
    loads = stored(slot_loads(docs, n_slots))
    return place(docs, next_map(docs.sparkSession, loads, map_path, n_shards, n_slots), loads, n_slots)
