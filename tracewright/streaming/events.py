"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tracewright.functions.columns import edge_type
from tracewright.operators import models, normalize
from tracewright.schemas import raw_schema
from tracewright.session import delete_folder

RELATION = ["source_entity", "edge_type", "destination_entity"]


def raw_stream(spark: SparkSession, path: str, kind: str, max_files: int = 64) -> DataFrame:
    """Landed raw rows of one kind as they arrive in a parquet folder.

    ``max_files`` bounds a batch, and with it what one relation can bring into a task.
    """
    reader = spark.readStream.schema(raw_schema(kind, metadata=True))
    return reader.option("maxFilesPerTrigger", max_files).parquet(path)


def unified_stream(raw: dict[str, DataFrame]) -> DataFrame:
    """The batch expressions on streams: normalise and union."""
    return normalize.unify(raw)


def with_event_time(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    stamped = events.withColumn("event_time", F.timestamp_seconds("timestamp"))
    return stamped.withWatermark("event_time", delay)


def hourly_relation_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Tumbling counts per relation; rows later than the watermark are dropped."""
    kind = edge_type("event_family", "event_type").alias("edge_type")
    rows = with_event_time(events, delay)
    return rows.groupBy(
        F.window("event_time", width), "source_entity", kind, "destination_entity"
    ).agg(F.count("*").alias("events_in_window")).select(
        F.col("window.start").alias("window_start"), *RELATION, "events_in_window"
    )


# Written per batch: the features of its events, and for all relations so far count, first and last time.
RECENCY, HISTORY = "recency", "history"
HISTORY_SCHEMA = "source_entity string, edge_type string, destination_entity string, n bigint, first bigint, last bigint"


def _history(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """What is known of every relation after a batch; nothing before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(f"{root}/{HISTORY}/{batch_id}")


def relation_recency(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Recency of a batch's events, after what ``history`` knows of their relations.

    A relation's history stands before its events in one sort, so that no join is needed.
    """
    nothing = F.lit(None).cast("bigint")
    events = rows.select(*RELATION, "event_id", "timestamp", nothing.alias("n"), nothing.alias("first"), nothing.alias("last"))
    known = history.select(*RELATION, F.lit(None).cast("string").alias("event_id"), nothing.alias("timestamp"), "n", "first", "last")
    both = events.unionByName(known).withColumn("_event", F.col("n").isNull())
    w = W.partitionBy(*RELATION).orderBy("_event", "timestamp", "event_id")
    placed = both.select(
        *RELATION, "event_id", "timestamp", "_event",
        # The history is one row, and counts for ``n`` events.
        (F.row_number().over(w) + F.coalesce(F.first("n").over(w) - 1, F.lit(0))).cast("bigint").alias("n"),
        F.lag(F.coalesce("timestamp", "last")).over(w).alias("last"),
        F.first(F.coalesce("timestamp", "first")).over(w).alias("first"),
    ).filter("_event")
    mean = F.when(F.col("n") >= 3, (F.col("last") - F.col("first")) / (F.col("n") - 2))
    return placed.select(
        "event_id", *RELATION, "timestamp", F.col("n").alias("event_count_so_far"), F.col("last").alias("last_seen_timestamp"),
        (F.col("timestamp") - F.col("last")).alias("time_since_previous"), F.col("first").alias("first_seen_timestamp"),
        mean.cast("double").alias("mean_previous_gap"),
    )


def write_recency_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Features of a batch and the history after it, each in the folder of its batch id.

    A batch that is run again after a failure starts from the history before it and replaces what it wrote.
    """
    spark = batch.sparkSession
    before = _history(spark, root, batch_id - 1)
    found = relation_recency(batch, before)
    out = f"{root}/{RECENCY}/batch={batch_id}"
    found.write.mode("overwrite").option("compression", "zstd").parquet(out)
    # The last event of a relation says all; relations without an event keep what they had.
    now = spark.read.schema(found.schema).parquet(out).select(
        *RELATION, F.col("event_count_so_far").alias("n"), F.col("first_seen_timestamp").alias("first"), F.col("timestamp").alias("last")
    )
    latest = before.unionByName(now).groupBy(*RELATION).agg(
        F.max("n").alias("n"), F.max_by("first", "n").alias("first"), F.max_by("last", "n").alias("last")
    )
    latest.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{HISTORY}/{batch_id}")
    delete_folder(spark, f"{root}/{HISTORY}/{batch_id - 2}")  # no batch to come starts from it


def recency_to_end(events: DataFrame, root: str) -> None:
    """Running recency per relation of what is available, into ``root``; goes on from the last batch that was finished.

    A batch must not bring events older than those before it, as with a log that is read in file order.
    """
    rows = events.select(
        "event_id", "source_entity", edge_type("event_family", "event_type").alias("edge_type"),
        "destination_entity", "timestamp",
    )
    query = (
        rows.writeStream.foreachBatch(lambda batch, batch_id: write_recency_batch(batch, batch_id, root))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


SCORES, REJECTS = "scores", "rejects"


def write_scored_batch(model: PipelineModel, batch: DataFrame, batch_id: int, root: str, keep: list[str] | None = None) -> None:
    """Scores of a batch's valid rows and its rejected rows, each in the folder of its batch id.

    A batch that is run again after a failure replaces what it wrote before, so nothing shows twice.
    """
    rows = batch.persist()  # both sinks take the one read
    try:
        valid, rejected = models.accept_events(rows)
        models.score_events(model, valid, keep).write.mode("overwrite").parquet(f"{root}/{SCORES}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{root}/{REJECTS}/batch={batch_id}")
    finally:
        rows.unpersist()


def score_to_end(model: PipelineModel, events: DataFrame, root: str, keep: list[str] | None = None) -> None:
    """Score what is available into ``root``; goes on from the last batch that was finished."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_scored_batch(model, batch, batch_id, root, keep)

    query = (
        events.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_end(stream: DataFrame, sink_path: str, checkpoint: str, mode: str = "append"):
    """Drain what is available into parquet and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", sink_path)
        .option("checkpointLocation", checkpoint).outputMode(mode)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
