"""Work that needs a total order, without ever sorting a whole table in one task.

Rows are range-partitioned, sorted inside each partition and written once with
their chunk number and position. A chunk then needs only a small summary of the
chunks before it, and there is one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.operators.joins import lookup
from tracewright.session import input_bytes, materialize

CHUNK, POSITION = "_chunk", "_position"


# Input bytes for one sorted chunk.
CHUNK_BYTES = 256 << 20


def chunk_count(df: DataFrame) -> int:
    """As many chunks as the input needs, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // CHUNK_BYTES))


def chunked(df: DataFrame, order: list, partitions: int | None = None) -> DataFrame:
    """``df`` plus its chunk number and row position; chunks follow ``order``."""
    n = partitions or chunk_count(df)
    marked = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_serial", F.monotonically_increasing_id())
        .withColumn(CHUNK, F.shiftright("_serial", 33))
        .withColumn(POSITION, F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_serial")
    )
    return materialize(marked, "chunked")


def _before(chunks: DataFrame, sums: list[str]) -> DataFrame:
    """Per chunk, totals over all earlier chunks. One input row per chunk."""
    w = W.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return chunks.select(
        CHUNK, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_before_{s}") for s in sums]
    )


def dense_index(df: DataFrame, order: list, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0..n-1 in the given total order."""
    rows = chunked(df, order, partitions)
    sizes = rows.groupBy(CHUNK).agg(F.count("*").alias("rows"))
    # One row per chunk, so the broadcast cannot grow with the table.
    return (
        rows.join(F.broadcast(_before(sizes, ["rows"])), CHUNK)
        .withColumn(name, F.col("_before_rows") + F.col(POSITION))
        .select(*df.columns, name)
    )


def group_index(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """Add ``name`` = 0..k-1 inside each group; a group may hold any share of the rows."""
    rows = dense_index(df, [*group, *order], "_index")
    starts = rows.groupBy(*group).agg(F.min("_index").alias("_start"))
    return (
        lookup(rows, starts, group, ["_index"], "inner")
        .withColumn(name, F.col("_index") - F.col("_start"))
        .select(*df.columns, name)
    )


def running_totals(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums over the whole table, ``{input: output}``."""
    rows = chunked(df, order)
    totals = rows.groupBy(CHUNK).agg(*[F.sum(c).alias(c) for c in sums])
    w = W.partitionBy(CHUNK).orderBy(POSITION).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(_before(totals, list(sums))), CHUNK)
    for source, target in sums.items():
        out = out.withColumn(target, F.col(f"_before_{source}") + F.sum(source).over(w))
    return out.select(*df.columns, *sums.values())


def exact_quantiles(df: DataFrame, columns: list[str], points: dict[str, float]) -> DataFrame:
    """One row per column (``field``) with linearly interpolated quantiles ``{name: q}``.

    Nulls are ignored; a column without values has no row. Equal values are counted
    before the shuffle and the counts are ranked by chunk, so a column of any size
    or skew is handled without one big task.
    """
    values = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("_v")) for c in columns
    ]))
    counts = (
        df.select(values.alias("e")).select("e.*").filter("_v is not null")
        .groupBy("field", "_v").agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(counts, ["field", "_v"], {"_n": "_upto"})
    spans = ranked.groupBy("field").agg(
        F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.max("_upto").alias("_end")
    )
    # One row per column name.
    placed = ranked.join(F.broadcast(spans), "field").withColumn("_upto", F.col("_upto") - F.col("_start"))
    last = F.col("_end") - F.col("_start") - 1

    def at(rank: Column) -> Column:
        inside = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        return F.max(F.when(inside, F.col("_v")))

    picks = []
    for name, q in points.items():
        place = F.lit(float(q)) * last
        low = F.floor(place)
        high = F.least(low + 1, last)
        share = F.max(place - low)
        picks.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return placed.groupBy("field").agg(*picks)


def ordered_halves(df: DataFrame, order: list, name: str = "half") -> DataFrame:
    """Mark the first ``n // 2`` rows ``reference`` and the rest ``current``."""
    indexed = dense_index(df, order, "_row")
    n = df.count()
    if n < 2:
        raise ValueError("two halves need at least two rows")
    mark = F.when(F.col("_row") < n // 2, F.lit("reference")).otherwise(F.lit("current"))
    return indexed.withColumn(name, mark).drop("_row")
