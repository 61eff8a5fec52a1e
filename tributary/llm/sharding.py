"""Operator 6, sharding: fixed virtual slots and a versioned slot-to-shard map that rebalancing edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import table

#: Virtual slots; fixed for the life of a data set, so that its size never decides how many the driver holds.
SLOTS = 8192
SHARDS = 24
#: Rebalancing stops when the heaviest and lightest shard differ by less than this part of the mean.
TOLERANCE = 0.001


@dataclass(frozen=True)
class SlotMap:
    """Version `version` of the map: slot s belongs to shard shards[s]."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def initial(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, n_shards, tuple(s % n_shards for s in range(slots)))

    def rebalanced(self, weights: list[int], tolerance: float = TOLERANCE) -> SlotMap:
        """The next version: slots move one by one from the heaviest to the lightest shard while that narrows the gap."""
        shards = list(self.shards)
        load = [0] * self.n_shards
        own: list[list[int]] = [[] for _ in load]
        for slot, shard in enumerate(shards):
            load[shard] += weights[slot]
            own[shard].append(slot)
        small = max(1, tolerance * sum(load) / self.n_shards)
        for _ in range(4 * len(shards)):
            high = max(range(self.n_shards), key=lambda k: (load[k], -k))
            low = min(range(self.n_shards), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            fit = [s for s in own[high] if 0 < weights[s] < gap]
            if gap <= small or not fit:
                break
            slot = min(fit, key=lambda s: (abs(2 * weights[s] - gap), s))
            own[high].remove(slot)
            own[low].append(slot)
            shards[slot] = low
            load[high] -= weights[slot]
            load[low] += weights[slot]
        return SlotMap(self.version + 1, self.n_shards, tuple(shards))

    def grown(self, weights: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots from the heaviest shards until it has its share."""
        shards, n = list(self.shards), self.n_shards + 1
        load = [0] * n
        own: list[list[int]] = [[] for _ in load]
        for slot, shard in enumerate(shards):
            load[shard] += weights[slot]
            own[shard].append(slot)
        share = sum(load) / n
        while True:
            high = max(range(n - 1), key=lambda k: (load[k], -k))
            fit = [s for s in own[high] if 0 < weights[s] and load[-1] + weights[s] <= share]
            if not fit:
                break
            slot = max(fit, key=lambda s: (weights[s], -s))
            own[high].remove(slot)
            shards[slot] = n - 1
            load[high] -= weights[slot]
            load[-1] += weights[slot]
        return SlotMap(self.version + 1, n, tuple(shards))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.version, self.n_shards, s, k) for s, k in enumerate(self.shards)],
            "version int, n_shards int, virtual_slot int, shard int",
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Put this version into the map table at path, in place of what it holds of the same version; other versions stay readable."""
        rows = self.frame(spark).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the last."""
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("version")).first()[0]
        got = sorted(rows.filter(F.col("version") == version).select("virtual_slot", "shard", "n_shards").collect())
        return cls(version, got[0].n_shards, tuple(r.shard for r in got))


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none if null, plus 8."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long")


def slot_loads(docs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. What reaches the driver is one row a slot, whatever the input."""
    got = (
        docs.select(virtual_slot(F.col("doc_id"), slots).alias("v"), record_size(F.col("text")).alias("b"))
        .groupBy("v").agg(F.sum("b").alias("b"), F.count("*").alias("n")).collect()
    )
    size, rows = [0] * slots, [0] * slots
    for r in got:
        size[r.v], rows[r.v] = r.b, r.n
    return size, rows


def shard(docs: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot of every row of docs under slot_map.

    slot is the row's place in its shard, gapless from 0: the rows of the shard's earlier virtual slots, then
    the place in its own by doc_id, text_crc32 and size. rows: the row counts of slot_loads. No window spans more than a virtual slot.
    A null doc_id has the slot of null, a null text has size 8; repeated rows get places of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    first, seen = [], [0] * slot_map.n_shards
    for s, k in enumerate(slot_map.shards):
        first.append((s, k, seen[k]))
        seen[k] += rows[s]
    placed = F.broadcast(spark.createDataFrame(first, "virtual_slot int, shard int, first long"))
    narrow = docs.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), len(rows)).alias("virtual_slot"),
    )
    from pyspark.sql import Window

    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        narrow.withColumn("place", F.row_number().over(order))
        .join(placed, "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: the uniform map (version 1), edited once by the bytes of its slots (version 2)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size, rows = slot_loads(docs)
    slot_map = SlotMap.initial(SHARDS).rebalanced(size)
    return shard(docs, slot_map, rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )
