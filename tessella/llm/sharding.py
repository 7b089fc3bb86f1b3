"""Sharding over fixed virtual slots, with DataFrame functions only.

Records are hashed into SLOTS virtual slots, a number that never changes. A small map, stored as a table with
versions, says which shard holds each slot. Version 0 deals the slots in turn. Bytes are summed per slot, and the next
version is an edit of the last one: slots that don't fit into their shard within the mean go to the lightest shards. Another shard is added by an edit that moves slots only into it. The loop over slots is a fold over
an array of at most SLOTS entries; no record takes part in it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, table

SLOTS, SHARDS = 4096, 8
ROWS_PER_BLOCK = 50_000
COPIES_IN_PARTS = 65_536


def slot_of(*cols: str | Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, from a 64-bit hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def records_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, part, copies and virtual_slot.

    Rows that agree in id, size and checksum are counted first and then cut into parts of one row, or of one in
    COPIES_IN_PARTS of the copies if there are more: a part has its own slot, so an id that holds a third of all rows is
    spread over all slots.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    seen = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    counted = seen.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    each = counted.withColumn("each", F.greatest(F.lit(1).cast("long"), F.expr(f"n div {COPIES_IN_PARTS}")))
    parts = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div each"))))
    return parts.select(
        "doc_id", "size", "text_crc32", "part", F.least("each", F.col("n") - F.col("part") * F.col("each")).alias("copies"),
        slot_of("doc_id", "size", "text_crc32", "part", slots=slots).alias("virtual_slot"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """virtual_slot, bytes and rows: one row per slot that holds records."""
    return records.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map: virtual_slot and shard, dealt in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def _loaded(slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """The map with the bytes of each slot; slots without records have none."""
    return slot_map.select("virtual_slot", "shard").join(loads.select("virtual_slot", "bytes"), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, with near equal bytes per shard.

    From the largest slot to the smallest, a slot stays in its shard if that remains within the mean of bytes, and goes
    to the shard that is lightest by then if not. So no shard exceeds the mean by more than one slot, and what moves is
    the excess of the heavy shards. Slots without records stay.
    """
    mean = F.col("total") / shards
    nothing = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def step(state: Column, slot: Column) -> Column:
        fits = F.element_at(state["at"], slot["shard"] + 1) + slot["bytes"] <= mean
        to = F.when(fits, slot["shard"]).otherwise((F.array_position(state["at"], F.array_min(state["at"])) - 1).cast("int"))
        at = F.transform(state["at"], lambda x, k: F.when(k == to, x + slot["bytes"]).otherwise(x))
        return F.struct(at.alias("at"), F.concat(state["placed"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard")))).alias("placed"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("at"), nothing.alias("placed"))
    held = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "shard", "bytes")))  # SLOTS entries at most
    every = _loaded(slot_map, loads).where("bytes > 0").agg(held.alias("held"), F.sum("bytes").alias("total"))
    placed = every.select(F.explode(F.aggregate("held", start, step)["placed"]).alias("m")).select("m.virtual_slot", F.col("m.shard").alias("_new"))
    return slot_map.join(placed, "virtual_slot", "left").select("virtual_slot", F.coalesce("_new", "shard").alias("shard"))


def grow(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map with one shard more, numbered `shards`: slots move into it and nowhere else.

    Every old shard gives its smallest slots up to a share of 1 in `shards` + 1 of its bytes; slots without records
    move in the same share.
    """
    loaded = _loaded(slot_map, loads)
    own = Window.partitionBy("shard")
    by_size = own.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("bytes") + F.lit(1) / F.lit(float(SLOTS))  # so that slots without records count
    gone = F.sum(weight).over(by_size) <= F.sum(weight).over(own) / (shards + 1)
    return loaded.select("virtual_slot", F.when(gone, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def write_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version of the map below `path`; earlier versions stay, and writing one again gives the same rows."""
    slot_map.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """virtual_slot and shard of a stored version."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path.rstrip('/')}/version={version}")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`records`, a row for each copy, with `shard` and `slot`, its gapless position in the shard, from 0.

    Positions follow the virtual slot, then blocks of about ROWS_PER_BLOCK records within it, then id, size and checksum.
    A sort holds one block; offsets of blocks come from their counts.
    """
    blocks = 1 + records.count() // (SLOTS * ROWS_PER_BLOCK)
    held = records.withColumn("block", F.pmod(F.xxhash64("text_crc32", "part", "doc_id", "size"), F.lit(blocks)).cast("int"))
    counts = held.groupBy("virtual_slot", "block").agg(F.sum("copies").alias("n")).join(slot_map, "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", "block", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("virtual_slot", "block").orderBy("doc_id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumn("upto", F.sum("copies").over(within)).join(offsets, ["virtual_slot", "block"])
    last = F.col("offset") + F.col("upto")
    each = placed.withColumn("slot", F.explode(F.sequence(last - F.col("copies"), last - 1)))
    return each.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version.

    The law is `bytes`: sizes per shard are as near equal as whole records allow. Shards follow version 1 of the map, the
    edit of version 0 by the bytes of the slots; both are stored below `path`, or in the scratch folder. `grown_shard` is
    null, as the map depends on the bytes of all records. A null text has size 1 and the checksum of no bytes; a null id is
    hashed like any other value; equal rows are dealt over shards one by one. Columns other than the two are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    records = materialize(records_of(docs, doc_id, text), "shard-records")
    path = path or f"{scratch_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    write_map(first_map(spark, shards), path, 0)
    write_map(rebalance(read_map(spark, path, 0), slot_bytes(records), shards), path, 1)
    placed = assign(records, read_map(spark, path, 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version")
    )


def op12(spark, sf_dir: str) -> DataFrame:
    """The shard of every row of `documents` and its position there, with sizes near equal."""
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_virtual_slots": op12}
SQL: dict[str, str] = {}
