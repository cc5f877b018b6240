"""Sharding by fixed virtual slots (DataFrame functions only).

Every record hashes into one of a fixed number of slots. A small table, the
slot map, says which shard owns which slot; its versions are stored, each once. Rebalancing
sums the bytes per slot and writes the next version of the map: slots beyond a
shard's fair share are released, largest kept first, and go one after another to the
shard with the least bytes. Records never move between slots, so a new version
touches only the records of the slots that changed hands.

Edge cases: null keys hash like any other value; a null text counts no bytes; rows
that are equal in all keys are spread over slots by their number; an empty table
gives an empty result and leaves the map as it is.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragchew.llm.common import checkpoint_dir, expand_copies, free_name, let, materialize

SLOTS = 8192


def slot_of(*keys, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a slot map: slots dealt to the shards in turn."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"),
        (F.col("id") % shards).cast("int").alias("shard"))


def slot_bytes(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    """Rows and bytes in each slot (partial sums before the shuffle)."""
    return records.groupBy(F.col(slot).alias("vslot")).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` for ``shards`` shards and these ``loads``.

    The map has a fixed number of rows, so one task can order it. A shard keeps
    its slots, largest first, while their sum stays within the mean; empty slots stay; the
    others, and those of shards that no longer exist, go in order of
    bytes to the shard with the least so far.
    """
    known = slot_map.join(loads, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", "shard",
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    mean = F.sum("bytes").over(W.partitionBy()) / F.lit(shards)
    before = F.sum("bytes").over(
        W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0))
    marked = known.withColumn("mean", mean).withColumn("upto", before).withColumn(
        "stays", (F.col("shard") < shards) & ((F.col("upto") <= F.col("mean")) | (F.col("bytes") == 0)))
    one = marked.groupBy("version").agg(
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("kept"),
        F.reverse(F.array_sort(F.collect_list(
            F.when(~F.col("stays"), F.struct("bytes", "vslot"))))).alias("freed"))
    start = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"),
                              lambda a, k: a + k["bytes"]))

    def deal(state: Column, x: Column) -> Column:
        # array_position is 1-based: the first of the least loaded shards
        return let(F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1,
                   lambda to: F.struct(
                       F.transform(state["loads"],
                                   lambda v, i: F.when(i == to, v + x["bytes"]).otherwise(v)).alias("loads"),
                       F.concat(state["out"], F.array(F.struct(
                           x["vslot"].alias("vslot"), to.alias("to")))).alias("out")))

    none = F.array().cast("array<struct<vslot:int,to:int>>")
    dealt = one.select(F.explode(F.aggregate(
        "freed", F.struct(start.alias("loads"), none.alias("out")), deal)["out"]).alias("x"))
    moved = dealt.select(F.col("x.vslot").alias("vslot"), F.col("x.to").alias("to"))
    return known.join(moved, "vslot", "left").select(
        "version", "vslot", F.coalesce("to", "shard").alias("shard"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored at ``path``: folders whose write was finished."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def save_version(slot_map: DataFrame, path: str, version: int) -> None:
    """Write a version of the map, once: a stored version is never changed. What an earlier job left unfinished is overwritten."""
    if version in versions(slot_map.sparkSession, path):
        raise FileExistsError(f"{path} has version {version}")
    slot_map.select("vslot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map; the latest unless one is named."""
    version = max(versions(spark, path)) if version is None else version
    return spark.read.parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), "vslot", "shard")


def next_version(spark: SparkSession, loads: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Store and return the map that follows the latest one at ``path`` (slots dealt in turn where there is none yet)
    for these loads. Slots that need not move stay where they are."""
    known = versions(spark, path)
    if not known:
        save_version(first_map(spark, shards, slots), path, 1)
    now = max(known, default=1)
    save_version(rebalance(load_version(spark, path, now), loads, shards), path, now + 1)
    return load_version(spark, path, now + 1)


def own_map(spark: SparkSession) -> str:
    """A place for a map that goes with the session, under the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def assign(records: DataFrame, slot_map: DataFrame, slot: str = "vslot") -> DataFrame:
    """``records`` with their shard: a broadcast of the map, whose size is fixed."""
    return records.join(F.broadcast(slot_map.select(F.col("vslot").alias(slot), "shard")), slot)


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS,
                    id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Put every document into a shard, sizes near equal (law ``bytes``), and number the
    documents of each shard without gaps. The slot map at ``map_path`` is edited (version after version;
    by default a map of the session's own).

    Returns doc_id, size, text_crc32, law, shard, slot (place in the shard),
    grown_shard (null under this law), vslot and map_version.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = materialize(
        docs.select(F.col(id_col).alias("doc_id"),
                    (F.octet_length(text).cast("long") + 8).alias("size"),
                    F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")),
        "shard-kinds")
    units = expand_copies(kinds, "copies", "copy").withColumn(
        "vslot", slot_of("doc_id", "text_crc32", "copy", slots=slots))
    loads = materialize(slot_bytes(units), "shard-loads")
    slot_map = next_version(spark, loads, shards, map_path or own_map(spark), slots)
    # where the rows of a slot begin within its shard: sums over a table of `slots` rows
    starts = slot_map.join(loads, "vslot", "left").select(
        "vslot", "shard", F.col("version").alias("map_version"),
        (F.sum(F.coalesce("n_rows", F.lit(0))).over(
            W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, 0))
         - F.coalesce("n_rows", F.lit(0))).alias("start"))
    place = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy"))
    return units.withColumn("place", place).join(F.broadcast(starts), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def shard_rows(docs: DataFrame, shards: int = 24, slots: int = SLOTS,
               id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """``docs`` and behind its columns ``vslot`` and ``shard`` (named by ``free_name``): the slot is a hash of id and
    text, the map at ``map_path`` is rebalanced by the bytes per slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slot = slot_of(F.col(id_col), F.crc32(F.encode(text, "UTF-8")), slots=slots)
    loads = materialize(slot_bytes(docs.select(
        slot.alias("vslot"), (F.octet_length(text).cast("long") + 8).alias("size"))), "shard-loads")
    slot_map = next_version(spark, loads, shards, map_path or own_map(spark), slots)
    own, place = free_name(docs, "vslot"), free_name(docs, "shard")
    side = slot_map.select(F.col("vslot").alias(own), F.col("shard").alias(place))  # of a fixed number of rows
    return docs.withColumn(own, slot).join(F.broadcast(side), own).select(*[F.col(f"`{c}`") for c in docs.columns], own, place)
