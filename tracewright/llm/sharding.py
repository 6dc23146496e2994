"""Sharding by fixed virtual slots.

A record's key is hashed into one of thousands of slots, whose number never changes.
Bytes are summed per slot, and a small versioned map says which shard holds a slot.
Rebalancing edits the map: a new version lists the slots that move, all others stay.
A slot that is too heavy to balance, as one key with a third of all rows makes it,
is dealt out over all slots row by row.

The tables about slots have ``SLOTS`` rows at most, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.session import materialize

SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8
# A slot above this part of a shard's even share is dealt out.
HEAVY_PART = 4


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes of the text, none for null, plus 8), ``text_crc32`` (0 for null) and a row number."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )


def slotted(rows: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """``rows`` with their ``virtual_slot``; ``row`` must be fixed, as in a written table."""
    first = rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))
    weights = first.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    total = weights.agg(F.sum("bytes")).scalar()
    # Fewer than shards * HEAVY_PART slots can be that heavy.
    heavy = F.broadcast(weights.filter(F.col("bytes") * shards * HEAVY_PART > total).select("virtual_slot", F.lit(True).alias("heavy")))
    dealt = F.pmod(F.xxhash64("doc_id", "row"), F.lit(slots)).cast("int")
    marked = first.join(heavy, "virtual_slot", "left")
    return marked.withColumn("virtual_slot", F.when(F.col("heavy"), dealt).otherwise(F.col("virtual_slot"))).drop("heavy")


def slot_table(placed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``bytes`` and ``rows`` of each of all slots, empty ones too."""
    held = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = placed.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(held, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def _heaviest_first(table: DataFrame, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", *columns)))


def _added(loads: Column, at: Column, size: Column) -> Column:
    return F.transform(loads, lambda load, i: load + F.when(i == at, size).otherwise(F.lit(0).cast("long")))


def first_map(table: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0 of the map: each slot, heaviest first, goes to the shard with the fewest bytes so far."""
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("map"),
    )

    def place(state: Column, slot: Column) -> Column:
        shard = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        entry = F.struct(slot["virtual_slot"].alias("virtual_slot"), shard.alias("shard"))
        return F.struct(
            _added(state["loads"], shard, -slot["minus"]).alias("loads"), F.array_append(state["map"], entry).alias("map")
        )

    folded = table.agg(F.aggregate(_heaviest_first(table), start, place, lambda s: s["map"]).alias("map"))
    return folded.select(F.lit(0).alias("version"), F.inline("map"))


def current(versions: DataFrame, version: int | None = None) -> DataFrame:
    """``virtual_slot`` and ``shard`` as of a version, the last one if none is named."""
    upto = versions if version is None else versions.filter(F.col("version") <= version)
    return upto.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def add_shard(versions: DataFrame, table: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version's entries after one more shard joined: only slots that move into it.

    A slot moves if the new shard stays within its even share and the old one keeps its own.
    """
    held = table.join(current(versions), "virtual_slot")
    held = held.withColumn("load", F.sum("bytes").over(Window.partitionBy("shard")))
    gathered = held.agg(
        _heaviest_first(held, "shard").alias("slots"), (F.sum("bytes") / (shards + 1)).alias("share"),
        F.map_from_entries(F.collect_set(F.struct("shard", "load"))).alias("of"),
    )
    gathered = gathered.withColumn(
        "loads",
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long"))),
    )
    start = F.struct(
        F.col("loads").alias("loads"), F.lit(0).cast("long").alias("fresh"),
        F.array().cast("array<int>").alias("moves"),
    )

    def move(state: Column, slot: Column) -> Column:
        size, old = -slot["minus"], slot["shard"]
        fits = (F.get(state["loads"], old) - size >= F.col("share")) & (state["fresh"] + size <= F.col("share")) & (size > 0)
        moved = F.struct(
            _added(state["loads"], old, -size).alias("loads"), (state["fresh"] + size).alias("fresh"),
            F.array_append(state["moves"], slot["virtual_slot"]).alias("moves"),
        )
        return F.when(fits, moved).otherwise(state)

    folded = gathered.select(F.aggregate("slots", start, move, lambda s: s["moves"]).alias("moves"))
    last = versions.agg(F.max("version") + 1).scalar()
    return folded.select(last.alias("version"), F.explode("moves").alias("virtual_slot"), F.lit(shards).alias("shard"))


def assigned(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Per input row ``doc_id``, ``size``, ``text_crc32``, law ``bytes``, its ``shard`` and its place ``slot`` there.

    Places count from 0 without gaps, by virtual slot, then ``doc_id``. ``virtual_slot`` and
    ``next_shard``, the shard after one more has joined, follow. ``grown_shard`` is null, as the
    law is not ``key``. Rows without text have 8 bytes, rows without ``doc_id`` share a slot until
    that is heavy, repeated rows are placed one by one, an empty table gives an empty one.
    """
    rows = materialize(slotted(materialize(sized(docs), "sized"), slots, shards), "slotted")
    table = materialize(slot_table(rows, slots), "slots")
    versions = materialize(first_map(table, shards), "map")
    grown = materialize(versions.unionByName(add_shard(versions, table, shards)), "map")
    before = F.sum("rows").over(
        Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    at = table.join(current(grown, 0), "virtual_slot").withColumn("before", F.coalesce(before, F.lit(0)))
    at = at.join(current(grown).withColumnRenamed("shard", "next_shard"), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "row")) - 1
    # One row per slot.
    placed = rows.withColumn("place", place).join(
        F.broadcast(at.select("virtual_slot", "shard", "next_shard", "before")), "virtual_slot"
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "next_shard",
    )
