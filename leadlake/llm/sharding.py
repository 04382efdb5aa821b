"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, thousands more than there are shards.
Bytes are added up per slot, and a small table maps slots to shards. Rebalancing edits
that map: overloaded shards give up slots, which go to the lightest ones; every edit is
a new version, kept beside the earlier ones. Records never move between slots.

Sizes of shards are near equal (law ``bytes``): no shard is heavier than the mean by
more than the largest slot. Within a shard, records are numbered without gaps: by slot,
then inside the slot, so that no task numbers a whole shard.

Everything is built-in functions; the work that needs an order (dealing the slots) is
on the slot table, whose rows are bounded by ``slots``. The map is bounded likewise, so
it is broadcast.

Nulls and empty texts have no bytes beyond the fixed ones; their checksum is 0. Records
are hashed by id, size and checksum, so a repeated id does not fill one slot; equal
records share a slot and are numbered one after the other. An empty table stays empty.
Columns named like a result are replaced by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlake.functions.reliability import ensure_checkpoint_dir
from leadlake.llm.apart import Apart
from leadlake.llm.text import let

SLOTS = 4096
OVERHEAD = 16
#: A shard may be heavier than the mean by this share before a rebalancing takes slots from it.
TOLERANCE = 0.001


def with_slots(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Add size (UTF-8 bytes and ``OVERHEAD``), text_crc32 and virtual_slot. No shuffle."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    slot = F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(slots)).cast("int")
    return docs.withColumn("size", size).withColumn("text_crc32", crc).withColumn("virtual_slot", slot)


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, rows) of every slot, empty ones too; added up map-side."""
    spark = records.sparkSession
    told = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(told, "virtual_slot", "left").select(
        F.col("virtual_slot").alias("slot"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: (version, slot, shard), slots dealt in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def _dealt(released: Column, loads: Column) -> Column:
    """Give each released slot, heaviest first, to the lightest shard: array of (slot, shard)."""

    def give(acc: Column, item: Column) -> Column:
        shard = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return let(
            shard,
            lambda to: F.struct(
                F.transform(acc["loads"], lambda b, k: F.when(k == to, b + item["bytes"]).otherwise(b)).alias("loads"),
                F.concat(acc["out"], F.array(F.struct(item["slot"].alias("slot"), to.alias("shard")))).alias("out"),
            ),
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<slot: int, shard: int>>").alias("out"))
    return F.aggregate(released, start, give)["out"]


def rebalanced(current: DataFrame, loads: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version of a map: every shard keeps slots up to the mean load, the rest goes to the lightest ones.

    Also the way to grow or shrink: shards beyond ``shards`` give up all their slots. One
    small task, on one row per slot.
    """
    mean = F.sum("bytes").over(Window.partitionBy("version")) / shards * (1 + tolerance)
    heaviest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    filled = current.join(loads, "slot").withColumns({"_upto": F.sum("bytes").over(heaviest), "mean": mean})
    marked = filled.withColumn("_kept", (F.col("_upto") <= F.col("mean")) & (F.col("shard") < shards))
    kept = F.when(F.col("_kept"), F.struct("shard", "slot", "bytes"))
    told = marked.agg(
        F.max("version").alias("version"),
        F.collect_list(kept).alias("kept"),
        F.sort_array(F.collect_list(F.when(~F.col("_kept"), F.struct("bytes", "slot"))), asc=False).alias("released"),
    )
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"), lambda a, k: a + k["bytes"]))
    given = F.concat(F.transform("kept", lambda k: F.struct(k["slot"].alias("slot"), k["shard"].alias("shard"))), _dealt(F.col("released"), load))
    return told.select((F.col("version") + 1).alias("version"), F.explode(given).alias("x")).select("version", "x.slot", "x.shard")


class SlotMap:
    """Versions of a slot map, one folder each below ``path``; a version is never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, version: int, rows: DataFrame) -> DataFrame:
        rows.coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/slot-map-{uuid.uuid4().hex}"


def sharded(records: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot`` (0, 1, … in the shard) to records that have virtual slots."""
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    named = slot_map.select(F.col("slot").alias("virtual_slot"), "shard").join(counts, "virtual_slot", "left")
    offsets = named.select("virtual_slot", "shard", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("virtual_slot").orderBy(key, "size", "text_crc32")
    numbered = records.withColumn("_inside", F.row_number().over(inside) - 1)
    told = numbered.join(F.broadcast(offsets), "virtual_slot")  # one row per slot
    return told.withColumn("slot", (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Slots, a first map, one rebalancing by bytes, and the records' shards and places.

    Both versions of the map are stored below ``path``.
    """
    spark, held = docs.sparkSession, Apart(docs)
    store = SlotMap(spark, path or shared_folder(spark))
    records = with_slots(held.df, held[key], held[text], slots)
    current = store.save(0, first_map(spark, shards, slots))
    dealt = sharded(records, store.save(1, rebalanced(current, slot_loads(records, slots), shards)), held[key])
    return held.back(dealt, {c: c for c in ("virtual_slot", "size", "text_crc32", "shard", "slot")})
