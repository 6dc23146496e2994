"""Lookups from a large, possibly skewed table into one with unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.session import broadcast_limit, planned_bytes

# Rows of one key that a task should hold; a key with more is dealt over as many parts as that takes.
ROWS_PER_TASK = 2_000_000
# No more hot keys than this are told apart, and their table is as small as that.
MAX_HOT_KEYS = 200_000


def hot_keys(rows: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and the number of ``_parts`` they are dealt over.

    Beyond ``MAX_HOT_KEYS`` times ``rows_per_task`` rows in all, the limit grows so that no
    more keys than that can pass it.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    limit = F.greatest(F.lit(rows_per_task).cast("double"), total / F.lit(MAX_HOT_KEYS))
    return counts.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))


def lookup(
    rows: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    force_salt: bool = False,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``dim`` (unique on ``on``) so that a hot key does not fill one task.

    A dimension below the session's broadcast limit goes the broadcast way that
    Catalyst picks by the same size check. Beyond it, rows of hot keys are dealt
    over sub-keys by a hash of ``spread_by``, and the matching dimension rows are repeated
    as often: one for every ``rows_per_task`` rows of the key. Hot keys are counted on
    ``count_on`` where ``rows`` is costly to compute twice but keeps its keys.
    """
    spark = rows.sparkSession
    if not force_salt and planned_bytes(dim) <= broadcast_limit(spark):
        return rows.join(dim, on, how)
    # At most MAX_HOT_KEYS rows, whatever the size of the data.
    marked = F.broadcast(hot_keys(rows if count_on is None else count_on, on, rows_per_task))
    spread = F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int")
    salted = rows.join(marked, on, "left").withColumn("_salt", F.coalesce(spread, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = dim.join(marked, on, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    if force_salt:  # Catalyst would still send a small dimension to all tasks
        repeated = repeated.hint("merge")
    return salted.drop("_parts").join(repeated, [*on, "_salt"], how).drop("_salt")


def lookup_as(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str,
    columns: dict[str, str],
    spread_by: list[str],
    how: str = "left",
    **options,
) -> DataFrame:
    """``lookup`` on differently named keys, taking ``{dim column: new name}``."""
    side = dim.select(
        F.col(dim_key).alias(key), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    joined = lookup(rows, side, [key], spread_by, how, **options)
    return joined.select(*rows.columns, *columns.values())


def undirected_pair(source: str | Column, destination: str | Column) -> tuple[Column, Column]:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (source, destination))
    return F.least(a, b), F.greatest(a, b)
