"""Event time: fixed windows, chronological splits and relationship recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.operators.leakage import ground_truth_mask
from tracewright.operators.ordered import CHUNK, POSITION, chunked
from tracewright.schemas import require_columns
from tracewright.session import materialize

WINDOW_SECONDS = 3600
TRAIN_SHARE, VALIDATION_SHARE = 0.70, 0.15
RELATION = ["split", "source_node_id", "edge_type", "destination_node_id"]
# Rows of one relation that a single task may sort.
ROWS_PER_KEY = 1_000_000
# So many keys at most can pass the size test below; their table stays small enough to broadcast.
HOT_KEY_LIMIT = 200_000
# The number of a long relation, which is sorted, shuffled and grouped by in place of its four columns.
NUMBER = "_relation"


def chronological_cuts(
    windows: int, train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE
) -> tuple[int, int]:
    """First window of validation and of test. Floats are truncated, as plain arithmetic does."""
    a, b = int(windows * train), int(windows * (train + validation))
    if not 0 < a < b < windows:
        raise ValueError(f"{windows} windows are too few for three splits")
    return a, b


def split_of_window(window: str, a: int, b: int) -> Column:
    w = F.col(window)
    return F.when(w < a, "train").when(w < b, "validation").otherwise("test")


def window_id(start: int, seconds: int = WINDOW_SECONDS) -> Column:
    return F.expr(f"(timestamp - {start}L) div {seconds}L")


def temporal_split(
    edges: DataFrame, seconds: int = WINDOW_SECONDS, ignore_missing: bool = False
) -> tuple[DataFrame, DataFrame, dict]:
    """(ordinary events, ground-truth events, manifest).

    The origin and the cuts come from all events, ground truth included. Events
    without a time count as -1 unless ``ignore_missing``.
    """
    require_columns(
        edges, ["timestamp", "source_node_id", "destination_node_id", "edge_type"], "edges"
    )
    rows = edges.filter("timestamp >= 0") if ignore_missing else edges
    mask = ground_truth_mask(rows)
    bounds = rows.agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        F.count_if(mask).alias("truth"), F.count("*").alias("n"),
    ).first()
    if not bounds["n"]:
        raise ValueError("no events to split")
    start = bounds["lo"]
    windows = (bounds["hi"] - start) // seconds + 1
    a, b = chronological_cuts(windows)
    marked = rows.withColumn("window_id", window_id(start, seconds)).withColumn(
        "split", split_of_window("window_id", a, b)
    )
    manifest = {
        "dataset_start_timestamp": start,
        "window_seconds": seconds,
        "number_of_windows": windows,
        "train_start_window": 0,
        "train_end_window_exclusive": a,
        "validation_start_window": a,
        "validation_end_window_exclusive": b,
        "test_start_window": b,
        "test_end_window_exclusive": windows,
        "maximum_window_id": windows - 1,
        "ordinary_event_count": bounds["n"] - bounds["truth"],
        "redteam_event_count": bounds["truth"],
    }
    return marked.filter(~mask), marked.filter(mask), manifest


def manifest_frame(spark, manifest: dict) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in manifest.items()])


def events_per_window(events: DataFrame) -> DataFrame:
    return events.groupBy("window_id").agg(F.count("*").alias("event_count"))


def window_metadata(ordinary: DataFrame, manifest: dict) -> DataFrame:
    """One row per window of the data set, empty windows included."""
    spark = ordinary.sparkSession
    start, seconds = manifest["dataset_start_timestamp"], manifest["window_seconds"]
    a, b = manifest["train_end_window_exclusive"], manifest["validation_end_window_exclusive"]
    spine = spark.range(manifest["number_of_windows"]).withColumnRenamed("id", "window_id")
    joined = spine.join(events_per_window(ordinary), "window_id", "left")
    n = F.coalesce("event_count", F.lit(0).cast("bigint"))
    return joined.select(
        "window_id",
        (F.lit(start) + F.col("window_id") * seconds).cast("bigint").alias("window_start_timestamp"),
        (F.lit(start) + (F.col("window_id") + 1) * seconds).cast("bigint").alias("window_end_timestamp"),
        split_of_window("window_id", a, b).alias("split"),
        n.alias("ordinary_event_count"), (n == 0).alias("is_empty"),
    )


def relation_window_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*RELATION, "window_id").agg(F.count("*").alias("events_in_window"))


def previous_window_counts(events: DataFrame) -> DataFrame:
    """Relation and window counts next to the same relation's count one window earlier."""
    now = relation_window_counts(events)
    w = W.partitionBy(*RELATION).orderBy("window_id").rangeBetween(-1, -1)
    return now.withColumn(
        "previous_window_count",
        F.coalesce(F.sum("events_in_window").over(w), F.lit(0).cast("bigint")),
    )


def _finish(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Features from place in the relation ``_n``, time before ``_last`` and first time ``_first``.

    Gaps telescope: those before the current one sum to ``_last - _first``.
    """
    return rows.select(
        *columns,
        F.col("_n").cast("bigint").alias("event_count_so_far"),
        F.col("_last").alias("last_seen_timestamp"),
        (F.col("timestamp") - F.col("_last")).alias("time_since_previous"),
        F.col("_first").alias("first_seen_timestamp"),
        F.when(F.col("_n") >= 3, (F.col("_last") - F.col("_first")) / (F.col("_n") - 2))
        .cast("double").alias("mean_previous_gap"),
        F.col("_recent").cast("bigint").alias("recent_event_count"),
    )


def _local(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    # ``order`` starts with the window, so both frames read the same sort.
    one_back = W.partitionBy(*keys).orderBy("window_id").rangeBetween(-1, -1)
    return (
        rows.withColumn("_n", F.row_number().over(w))
        .withColumn("_last", F.lag("timestamp").over(w))
        .withColumn("_first", F.first("timestamp").over(w))
        .withColumn("_recent", F.count("*").over(one_back))
    )


def _hot_relations(events: DataFrame, rows_per_key: int, total: int) -> DataFrame:
    """Relations too long for one task, numbered; the test size grows with ``total`` rows so that few can pass it."""
    counts = events.groupBy(*RELATION).agg(F.count("*").alias("_rows"))
    hot = counts.filter(F.col("_rows") > max(rows_per_key, total / HOT_KEY_LIMIT)).select(*RELATION)
    # Numbers depend on the partitions, so they are written before anything reads them.
    return materialize(hot.withColumn(NUMBER, F.monotonically_increasing_id()), "hot")


def _chunk_carry(rows: DataFrame) -> DataFrame:
    """What a chunk must know of its relation's earlier chunks. One row per chunk and relation."""
    by_window = rows.groupBy(NUMBER, CHUNK, "window_id").agg(
        F.count("*").alias("_c"), F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi")
    )
    earlier = W.partitionBy(NUMBER, "window_id").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(NUMBER).orderBy("window_id").rangeBetween(-1, -1)
    marked = by_window.withColumn(
        "_same_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))
    ).withColumn("_prev_total", F.coalesce(F.sum("_c").over(whole), F.lit(0)))
    per_chunk = marked.groupBy(NUMBER, CHUNK).agg(
        F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.min(F.struct("window_id", "_same_before", "_prev_total")).alias("_w"),
    )
    chain = W.partitionBy(NUMBER).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return per_chunk.select(
        NUMBER, CHUNK,
        F.coalesce(F.sum("_c").over(chain), F.lit(0)).alias("_c_before"),
        F.max("_hi").over(chain).alias("_hi_before"),
        F.min("_lo").over(chain).alias("_lo_before"),
        F.col("_w.window_id").alias("_w0"),
        F.col("_w._same_before").alias("_same_before"),
        F.col("_w._prev_total").alias("_prev_total"),
    )


def _recency_in_chunks(rows: DataFrame, columns: list[str], partitions: int | None) -> DataFrame:
    """Recency of long relations, given with their ``NUMBER``: each is cut into sorted chunks that run in parallel."""
    cut = chunked(rows, [NUMBER, "timestamp", "edge_id"], partitions)
    local = _local(cut, [CHUNK, NUMBER], ["window_id", POSITION])
    # One row per chunk plus one per hot relation, of which there are HOT_KEY_LIMIT at most.
    joined = local.join(F.broadcast(_chunk_carry(cut)), [CHUNK, NUMBER])
    zero = F.lit(0).cast("bigint")
    recent = (
        F.col("_recent")
        + F.when(F.col("window_id") == F.col("_w0"), F.col("_prev_total")).otherwise(zero)
        + F.when(F.col("window_id") == F.col("_w0") + 1, F.col("_same_before")).otherwise(zero)
    )
    shifted = joined.select(
        *columns,
        (F.col("_n") + F.col("_c_before")).alias("_n"),
        F.coalesce("_last", "_hi_before").alias("_last"),
        F.coalesce("_lo_before", "_first").alias("_first"),
        recent.alias("_recent"),
    )
    return _finish(shifted, columns)


def relationship_recency(
    events: DataFrame, rows_per_key: int = ROWS_PER_KEY, partitions: int | None = None
) -> DataFrame:
    """History of each relation before every event; ties in time follow ``edge_id``.

    Most relations fit a task and need one shuffle by relation. Longer ones are
    told apart by a count and go the chunked way, so none is sorted in one task.
    """
    require_columns(events, [*RELATION, "window_id", "timestamp", "edge_id"], "events")
    columns = events.columns
    plain = lambda rows: _finish(_local(rows, RELATION, ["window_id", "timestamp", "edge_id"]), columns)
    total = events.count()
    if total <= rows_per_key:
        return plain(events)
    hot = _hot_relations(events, rows_per_key, total)
    if hot.isEmpty():
        return plain(events)
    same = [events[c].eqNullSafe(hot[c]) for c in RELATION]
    # At most HOT_KEY_LIMIT rows.
    cold_rows = events.join(F.broadcast(hot), same, "left_anti")
    hot_rows = events.join(F.broadcast(hot), same).select(*[events[c] for c in columns], NUMBER)
    return plain(cold_rows).unionByName(_recency_in_chunks(hot_rows, columns, partitions))
