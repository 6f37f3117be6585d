"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are summed per slot, and a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map, not the hash, so
only the slots that it names move. The map has ``SLOTS`` rows whatever the data's size.

Nulls: a null ``doc_id`` is hashed by its text's checksum; a null text has no bytes and
checksum 0. Empty tables give an empty result and a map of empty slots. Repeated rows share
a slot and get places of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row of ``docs``."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    )
    salt = F.when(F.col("doc_id").isNull(), F.col("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", salt), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n) for each of the ``slots`` slots, empty ones too."""
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    axis = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return axis.join(got, "virtual_slot", "left").fillna(0, ["bytes", "n"])


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """(version 1, virtual_slot, shard): the largest slot goes to the least loaded shard, and so on.

    No shard then exceeds the mean by more than the largest slot. The fold runs over the
    fixed number of slots in one row.
    """
    heap = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.lit(0).cast("long").alias("load"), s.alias("shard"))))
    start = F.struct(heap.alias("heap"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("out"))

    def put(acc, x):
        least = acc["heap"][0]
        grown = F.struct((least["load"] + x["bytes"]).alias("load"), least["shard"].alias("shard"))
        return F.struct(
            F.array_sort(F.concat(F.slice(acc["heap"], 2, shards), F.array(grown))).alias("heap"),
            F.concat(acc["out"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), least["shard"].alias("shard")))).alias("out"),
        )

    by_bytes = F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False)
    folded = loads.agg(by_bytes.alias("slots")).select(F.aggregate("slots", start, put, lambda acc: acc["out"]).alias("out"))
    return folded.select(F.inline("out")).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def add_shard(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map of ``shards`` shards: shard number ``shards`` takes slots, no other shard does.

    Each old shard gives slots, small ones first, while what it gives stays within its excess
    over the new mean.
    """
    held = slot_map.join(loads.select("virtual_slot", "bytes"), "virtual_slot")
    shard = Window.partitionBy("shard")
    given = F.sum("bytes").over(shard.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    mean = F.sum("bytes").over(Window.partitionBy("version")) / (shards + 1)
    moved = held.withColumn("given", given).withColumn("excess", F.sum("bytes").over(shard) - mean)
    return moved.select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when((F.col("bytes") > 0) & (F.col("given") <= F.col("excess")), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append a version of the map to the table at ``path``; old versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version of the map, the latest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def place(rows: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the gapless place in the shard from 0.

    Places are counted in each virtual slot and shifted by the slots before it in its shard,
    so no task holds a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(loads, "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    # The map has a fixed number of rows.
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("nth")).drop("start", "nth")


def op4_virtual_slots(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by a map that grows by editing."""
    rows = records(read_table(spark, sf_dir, "documents"))
    loads = slot_loads(rows)
    slot_map = first_map(loads, shards)
    grown = add_shard(slot_map, loads, shards).select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    return (
        place(rows, slot_map, loads)
        .join(F.broadcast(grown), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"), "rebalanced_shard")
    )
