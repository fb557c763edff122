"""Sharding over fixed virtual slots.

Records hash into ``SLOTS`` virtual slots by their text, so copies of a text share a slot. Bytes and rows
are aggregated per slot, and a versioned slot-to-shard map is stored as a table. Records are placed by the stored map.
Rebalancing edits that map and never rehashes a record: version n + 1 moves whole slots only.

A slot of many rows (``PART_ROWS``, or more than ``HOT_SHARE`` of a shard's fair share of rows or bytes) is cut into as
many parts as that takes, by its records' ids; the map has a row for each part. Parts bound the work of numbering a slot's
records. Parts of a slot lie in one shard unless the slot's bytes exceed ``LONE_SHARE`` of a shard's fair share: near
equal sizes go before copies lying together, so that one group of copies can hold a third of all bytes.

What reaches the driver are the rows of the map: ``SLOTS``, and one more for each ``PART_ROWS`` rows or each ``HOT_SHARE``
of a shard.

Law: ``bytes``: the shards' sizes are near equal.

Null text: size 1, crc of nothing. Equal texts: same slot, hence the same shard unless the slot is hot. Ties in a slot are
numbered by id, crc and size. Repeated rows: each is placed on its own. Rows with null ids count like others (in a cut
slot they share a part). Very long texts are hashed where they are. Extra columns play no part. Empty table: empty result
and a map without bytes.
"""

from __future__ import annotations

import heapq
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import only, shared_dir

SLOTS = 4096
#: Rows of a part that are numbered together, at most about; a slot above this share of a shard is cut as well.
PART_ROWS = 1_000_000
HOT_SHARE = 0.05
#: Parts are placed one by one in a slot above this share of a shard.
LONE_SHARE = 0.5
BROADCAST_MAP_ROWS = 500_000
MAP_SCHEMA = "version int, slot int, part int, shard int, bytes long, n_rows long"


def with_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, slot) by one narrow projection."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return only(df, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("slot"),
    )


def _part_of(records: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Adds ``part``: -1 in a whole slot, else the number of parts, a power of two, and the part's place added up. parts:
    the number of parts of the slots that are cut."""
    if not parts:
        return records.withColumn("part", F.lit(-1))
    table = records.sparkSession.createDataFrame(sorted(parts.items()), "slot int, parts int")
    hashed = F.col("parts") + F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.col("parts"))
    return records.join(F.broadcast(table), "slot", "left").withColumn("part", F.coalesce(hashed, F.lit(-1)).cast("int")).drop("parts")


def _weights(slotted: DataFrame, shards: int, part_rows: int = PART_ROWS) -> list[tuple[int, int, int, int]]:
    """(slot, part, bytes, rows); part -1 for a slot that is not cut."""
    whole = slotted.groupBy("slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    fair_bytes, fair_rows = (max(1.0, HOT_SHARE * sum(r[c] for r in whole) / shards) for c in ("b", "n"))
    parts = {r["slot"]: ceil(max(r["n"] / part_rows, r["n"] / fair_rows, r["b"] / fair_bytes)) for r in whole}
    parts = {slot: 1 << (n - 1).bit_length() for slot, n in parts.items() if n > 1}
    found = [(r["slot"], -1, r["b"], r["n"]) for r in whole if r["slot"] not in parts]
    if parts:
        cut = _part_of(slotted.where(F.col("slot").isin(list(parts))), parts)
        found += [tuple(r) for r in cut.groupBy("slot", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()]
    return found


def _units(weights: list[tuple[int, int, int, int]], shards: int) -> list[list[tuple[int, int, int, int]]]:
    """What lies together: a slot with all its parts, or a part alone where the slot is too heavy for one shard."""
    limit = LONE_SHARE * sum(w[2] for w in weights) / shards
    slots: dict[int, list] = {}
    for w in sorted(weights):
        slots.setdefault(w[0], []).append(w)
    units = []
    for parts in slots.values():
        units += [parts] if sum(w[2] for w in parts) <= limit else [[w] for w in parts]
    return units


def first_map(weights: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Version 1: heaviest unit first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    rows = []
    for unit in sorted(_units(weights, shards), key=lambda u: (-sum(w[2] for w in u), u[0])):
        load, shard = heapq.heappop(heap)
        rows += [(1, slot, part, shard, size, n) for slot, part, size, n in unit]
        heapq.heappush(heap, (load + sum(w[2] for w in unit), shard))
    return rows


def rebalanced(current: list[tuple], weights: list[tuple[int, int, int, int]], shards: int, slack: float = 0.01) -> list[tuple]:
    """The next version of a map under new weights or another shard count, moving few slots.

    Slots (parts, where they lie alone) stay where they are unless their shard is gone or above the mean by more than ``slack``; then its
    lightest fitting slots move to the lightest shard. Slots that the map does not know go to the lightest.
    """
    version = max((r[0] for r in current), default=0) + 1
    old = {(r[1], r[2]): r[3] for r in current}
    loads, held, loose = [0] * shards, [[] for _ in range(shards)], []
    for unit in _units(weights, shards):
        size = sum(w[2] for w in unit)
        shard = old.get(unit[0][:2], old.get((unit[0][0], -1)))
        if shard is None or shard >= shards:
            loose.append((size, unit))
        else:
            loads[shard] += size
            held[shard].append((size, unit))
    mean = sum(w[2] for w in weights) / shards
    for shard in range(shards):
        for item in sorted(held[shard], reverse=True):
            if loads[shard] - item[0] >= mean and loads[shard] > mean * (1 + slack):
                held[shard].remove(item)
                loads[shard] -= item[0]
                loose.append(item)
    for item in sorted(loose, reverse=True):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        loads[shard] += item[0]
        held[shard].append(item)
    return [(version, slot, part, shard, size, n) for shard in range(shards) for _, unit in sorted(held[shard]) for slot, part, size, n in unit]


def slot_map(df: DataFrame, shards: int = 8, part_rows: int = PART_ROWS, **columns: str) -> DataFrame:
    """The first version of the slot-to-shard map for a table, ready to be stored."""
    return df.sparkSession.createDataFrame(first_map(_weights(with_slots(df, **columns), shards, part_rows), shards), MAP_SCHEMA)


def store_map(slots: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay readable."""
    slots.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest by default."""
    found = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version)


def sharded(df: DataFrame, slots: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every record by a map: (doc_id, size, text_crc32, virtual_slot, shard, place).

    The map has few rows (see above) and is broadcast up to BROADCAST_MAP_ROWS of them. Places
    within a shard are gapless from 0: the map's row counts give each slot its first place, and records are
    numbered inside their slot (or part of a hot slot) only, never over a whole shard.
    """
    spark = df.sparkSession
    starts, rows, parts = {}, [], {}
    for r in sorted(slots.collect(), key=lambda r: (r["shard"], r["slot"], r["part"])):
        rows.append((r["slot"], r["part"], r["shard"], starts.get(r["shard"], 0)))
        starts[r["shard"]] = starts.get(r["shard"], 0) + r["n_rows"]
        if r["part"] > 0:
            parts[r["slot"]] = 1 << (r["part"].bit_length() - 1)
    placed = spark.createDataFrame(rows, "slot int, part int, shard int, first long")
    placed = F.broadcast(placed) if len(rows) <= BROADCAST_MAP_ROWS else placed
    records = _part_of(with_slots(df, id_col, text_col), parts).join(placed, ["slot", "part"])
    number = F.expr("row_number() over (partition by slot, part order by doc_id, text_crc32, size)") - 1
    return records.select("doc_id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard", (F.col("first") + number).cast("long").alias("place"))


def shard_table(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Build the map, store it (in the shared folder if no path is given), and place the records by the stored version."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/slot-map-{uuid.uuid4().hex}"
    store_map(slot_map(df, shards, part_rows, id_col=id_col, text_col=text_col), path)
    return sharded(df, read_map(spark, path), id_col, text_col)
