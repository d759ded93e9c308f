"""Sharding by fixed virtual slots (operator 7). DataFrame functions only.

Every record is hashed into one of thousands of virtual slots; bytes are summed per slot; a small versioned table maps
slots to shards. Balancing and rebalancing edit that table alone, never the hash, so records move only with their slot.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, staged

SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def virtual_slot(*cols, slots: int = SLOTS):
    """The slot of a record: the first 32 bits of an md5 of the columns as text, modulo the number of slots."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if c == "number" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """Bytes of every slot, empty ones too, of ``records(vslot, size)``, largest first: ``slots`` rows, so they fit the driver."""
    got = {r.vslot: int(r.bytes or 0) for r in records.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}
    return sorted(((s, got.get(s, 0)) for s in range(slots)), key=lambda x: (-x[1], x[0]))


def first_map(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Version 1: slots in order of size, each to the shard with the fewest bytes so far (of equals, the lowest)."""
    load = [(0, s) for s in range(shards)]
    rows = []
    for slot, n in sizes:
        total, shard = heapq.heappop(load)
        rows.append((1, slot, shard, n))
        heapq.heappush(load, (total + n, shard))
    return rows


def rebalanced(rows: list[tuple[int, int, int, int]], sizes: list[tuple[int, int]], shards: int, slack: float = 0.02) -> list[tuple[int, int, int, int]]:
    """The next version: while a shard holds over (1 + slack) times the mean, its best-fitting slot goes to the emptiest shard.

    ``shards`` may exceed the last version's number: new shards start empty and take only moved slots.
    """
    of, now = {slot: shard for _, slot, shard, _ in rows}, dict(sizes)
    version = max((v for v, *_ in rows), default=0) + 1
    load = {s: 0 for s in range(shards)}
    members: dict[int, set[int]] = {s: set() for s in range(shards)}
    for slot, n in now.items():
        shard = of.get(slot)
        shard = shard if shard is not None and shard < shards else min(load, key=lambda s: (load[s], s))
        load[shard] += n
        members[shard].add(slot)
    mean = sum(load.values()) / max(1, shards)
    for _ in range(len(now)):
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fit = [s for s in members[high] if 0 < now[s] < gap]
        if load[high] <= mean * (1 + slack) or not fit:
            break
        slot = min(fit, key=lambda s: (abs(gap / 2 - now[s]), s))
        members[high].remove(slot)
        members[low].add(slot)
        load[high] -= now[slot]
        load[low] += now[slot]
    return sorted((version, slot, shard, now[slot]) for shard, own in members.items() for slot in own)


def store_map(spark: SparkSession, rows: list[tuple[int, int, int, int]], path: str) -> None:
    """Adds a version of the map to the table at ``path``; older versions stay readable."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int]]:
    """One version of the stored map (the latest if none is named); at most one row per slot."""
    got = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = got.agg(F.max("version")).first()[0]
    return sorted(tuple(r) for r in got.where(F.col("version") == F.lit(version)).collect())


def numbered(records: DataFrame, run: int = 65_536) -> DataFrame:
    """``records`` with ``number``: equal rows are counted, then stand 0, 1, 2... again.

    They are alike, so none needs a place among the others: the count is summed before it moves, and written out in runs of
    bounded length that are dealt to all tasks.
    """
    cols = records.columns
    counts = records.groupBy(*cols).agg(F.count("*").alias("n"))
    runs = counts.select(*cols, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run))).alias("part"))
    many = runs.where("part > 0").repartition(partitions(records.sparkSession), *cols, "part")  # the first run of each record stays where it was counted
    every = runs.where("part = 0").union(many)
    return every.select(*cols, F.explode(F.sequence(F.col("part") * run, F.least(F.col("n"), (F.col("part") + 1) * run) - 1)).alias("number"))


def sharded(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, grow_to: int | None = None) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard, vslot``: every record's shard under the law ``bytes``.

    size: UTF-8 bytes of the text (null: none) plus 8. slot: the record's place in its shard, without gaps from 0,
    by (virtual slot, id, crc32). grown_shard is null under this law. Records hash by id (null ids: by crc32) and text size, so
    repeated ids with other texts spread; equal records (id, size, crc32) are numbered and hash by their number too, so they
    spread as well. Null ids and null or empty texts are records like any other. An empty table gives an empty result. Other columns are not read. Equal texts have equal crc32 and size, and go
    where their ids' slots go: to keep one huge group of them in a shard would break the law of near-equal bytes.
    ``map_path``: the table of map versions (a new one in the shared folder if none is named); placements are read from
    what is stored there. ``grow_to``: a second version for so many shards is stored too, and ``next_shard`` is the
    record's shard by it: only slots that rebalancing moves change it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    records = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    records = numbered(records)
    alone = F.when(F.col("number") > 0, F.col("number"))  # the first of equal records goes by id and size alone
    who = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.col("text_crc32").cast("string")))  # null ids stand by their texts
    records = staged(records.withColumns({"number": alone, "who": who}).withColumn("vslot", virtual_slot("who", "size", "number", slots=slots)).drop("number", "who"), "records")
    map_path, sizes = map_path or new_path(spark, "slot-map"), slot_bytes(records, slots)
    store_map(spark, first_map(sizes, shards), map_path)
    rows, later = load_map(spark, map_path, 1), {}
    if grow_to:
        store_map(spark, rebalanced(rows, sizes, grow_to), map_path)
        later = {slot: shard for _, slot, shard, _ in load_map(spark, map_path, 2)}
    counts = records.groupBy("vslot").agg(F.count("*").alias("n"))
    placed = spark.createDataFrame([(slot, shard, later.get(slot)) for _, slot, shard, _ in rows], "vslot int, shard int, next_shard int")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(counts, "vslot").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("vslot", "shard", "next_shard", "base")
    order = Window.partitionBy("vslot").orderBy("id", "text_crc32")
    out = records.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(placed), "vslot")  # at most ``slots`` rows
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", *(["next_shard"] if grow_to else []))
