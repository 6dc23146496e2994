"""Queries on drift, integrity, manifests, lineage and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.operators import monitoring, ordered, quantile_profiles
from tracewright.functions.columns import first_json_number
from tracewright.plans.learning import event_rows, event_test_metrics
from tracewright.plans.metrics import rounded, scored
from tracewright.plans.reference_sql import cte, sql
from tracewright.plans.registry import query
from tracewright.session import app_dir, materialize
from tracewright.sources import tables, testbed
from tracewright.streaming import events as streams

cte("halves", """
SELECT event_type, value, CAST(user_id AS DOUBLE) AS user_id, CAST(r <= n // 2 AS INTEGER) AS is_ref
FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)
""")

cte("half_cells", """
SELECT 'value' AS field, value AS v, is_ref FROM halves
UNION ALL SELECT 'user_id', user_id, is_ref FROM halves
""")

cte("half_points", """
SELECT field, v, r, c, sum(r) OVER w / CAST(sum(r) OVER f AS DOUBLE) AS fr,
       sum(c) OVER w / CAST(sum(c) OVER f AS DOUBLE) AS fc, lead(v) OVER w - v AS width,
       sum(r) OVER f AS nr, sum(c) OVER f AS nc
FROM (SELECT field, v, sum(is_ref) AS r, sum(1 - is_ref) AS c FROM half_cells GROUP BY 1, 2)
WINDOW w AS (PARTITION BY field ORDER BY v), f AS (PARTITION BY field)
""")

cte("half_spread", """
SELECT field, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS std FROM half_cells WHERE is_ref = 1 GROUP BY field
""")


def _halves(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "user_id")
    marked = ordered.ordered_halves(rows, ["ts", "event_id"])
    columns = ["event_type", "value", "user_id"]
    return tuple(marked.filter(F.col("half") == h).select(columns) for h in ("reference", "current"))


cte("numeric_drift_table", """
SELECT d.field, round(max(abs(fr - fc)), 6) AS ks_distance,
       round(sum(abs(fr - fc) * width) / greatest(max(s.std), 0.001), 6) AS wasserstein, max(psi) AS psi
FROM half_points d JOIN half_spread s ON s.field = d.field
JOIN (SELECT field, round(sum((q - p) * ln(q / p)), 6) AS psi FROM (
        SELECT h.field, greatest(sum(r) / CAST(max(nr) AS DOUBLE), 1e-4) AS p,
               greatest(sum(c) / CAST(max(nc) AS DOUBLE), 1e-4) AS q
        FROM half_points h JOIN half_spread z ON z.field = h.field
        GROUP BY h.field, least(greatest(floor((v - lo) / (hi - lo) * 10), 0), 9)) GROUP BY field) x
  ON x.field = d.field
GROUP BY d.field""")

cte("category_drift_table", """
SELECT 'event_type' AS field,
       round(sqrt((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
                 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2), 6) AS jensen_shannon,
       round(sum(pow(r - (r + c) / (nr + nc) * nr, 2) / ((r + c) / (nr + nc) * nr)
               + pow(c - (r + c) / (nr + nc) * nc, 2) / ((r + c) / (nr + nc) * nc)), 6) AS chi_square
FROM (SELECT r, c, nr, nc, r / nr AS p, c / nc AS q FROM (
  SELECT CAST(sum(is_ref) AS DOUBLE) AS r, CAST(sum(1 - is_ref) AS DOUBLE) AS c,
         CAST(sum(sum(is_ref)) OVER () AS DOUBLE) AS nr, CAST(sum(sum(1 - is_ref)) OVER () AS DOUBLE) AS nc
  FROM halves GROUP BY event_type))""")

cte("drift_rows", """
SELECT field, 'wasserstein' AS test, wasserstein AS statistic, wasserstein >= 0.1 AS drifted FROM numeric_drift_table
UNION ALL SELECT field, 'jensen_shannon', jensen_shannon, jensen_shannon >= 0.1 FROM category_drift_table
""")


@query("numeric_drift", sql("SELECT * FROM numeric_drift_table"))
def numeric_drift(spark, sf_dir):
    return rounded(monitoring.numeric_drift(*_halves(spark, sf_dir), ["value", "user_id"]))


_POINTS = {"low": 0.05, "quarter": 0.25, "middle": 0.5, "three_quarters": 0.75, "high": 0.95}


def _profiles(spark, sf_dir):
    """Written profiles of the events by day."""
    days = F.to_date("ts").cast("string")
    return materialize(quantile_profiles.profiled(testbed.table(spark, sf_dir, "events"), ["value", "user_id"], days), "profiles")


@query("profile_quantiles", "SELECT field, point, true AS within_bound FROM (VALUES ('value'), ('user_id')) f(field), (VALUES "
       + ", ".join(f"('{p}')" for p in _POINTS) + ") p(point)")
def profile_quantiles(spark, sf_dir):
    """Quantiles from merged daily profiles, held against the exact ranks of the values."""
    found = quantile_profiles.quantiles(_profiles(spark, sf_dir), _POINTS)
    pairs = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(p).alias("share"), F.col(n).alias("quantile")) for n, p in _POINTS.items()])
    asked = found.select("field", F.inline(pairs))  # one row a field and point
    events = testbed.table(spark, sf_dir, "events")
    values = events.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in ("value", "user_id")
    ])).alias("c")).select("c.*").filter("v is not null")
    ranks = values.join(F.broadcast(asked), "field").groupBy("field", "point", "share").agg(
        F.count_if(F.col("v") < F.col("quantile")).alias("below"), F.count_if(F.col("v") <= F.col("quantile")).alias("upto"), F.count("*").alias("n")
    )
    error = F.greatest(F.col("below") / F.col("n") - F.col("share"), F.col("share") - F.col("upto") / F.col("n"))
    return ranks.select("field", "point", (error <= quantile_profiles.RANK_ERROR).alias("within_bound"))


@query("profile_drift", "SELECT field, true AS agrees FROM (VALUES ('value'), ('user_id')) f(field)")
def profile_drift(spark, sf_dir):
    """Drift from stored profiles next to the exact figures."""
    halves = _halves(spark, sf_dir)
    stored = [materialize(quantile_profiles.profiled(h, ["value", "user_id"], F.lit("all")), "profiles") for h in halves]
    exact = monitoring.numeric_drift(*halves, ["value", "user_id"]).select("field", F.col("ks_distance").alias("k"))
    both = quantile_profiles.drift(*stored).join(exact, "field")
    # Two ranks, each right to a step of the grid.
    bound = 2 * quantile_profiles.RANK_ERROR + 2 / quantile_profiles.GRID
    return both.select("field", (F.abs(F.col("ks_distance") - F.col("k")) <= bound).alias("agrees"))


@query("categorical_drift", sql("SELECT * FROM category_drift_table"))
def categorical_drift(spark, sf_dir):
    return rounded(monitoring.categorical_drift(*_halves(spark, sf_dir), ["event_type"]))


@query("drift_report", sql("SELECT * FROM drift_rows"))
def drift_report(spark, sf_dir):
    return rounded(monitoring.drift_report(*_halves(spark, sf_dir)))


@query("drift_summary", sql("""
SELECT count(*) AS columns, count(*) FILTER (WHERE drifted) AS drifted_columns,
       round(count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE), 6) AS drifted_share,
       count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE) >= 0.5 AS dataset_drift
FROM drift_rows"""))
def drift_summary(spark, sf_dir):
    return rounded(monitoring.drift_summary(monitoring.drift_report(*_halves(spark, sf_dir))))


@query("table_fingerprint")
def table_fingerprint(spark, sf_dir):
    return monitoring.table_fingerprint(testbed.table(spark, sf_dir, "lineitem"))


def _artifacts(spark, sf_dir):
    """A small text file per event family, as a job leaves its documents."""
    folder = f"{app_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    found = testbed.edges(spark, sf_dir).groupBy("event_family").agg(F.count("*").alias("n"))
    text = F.concat_ws(":", "event_family", F.col("n").cast("string")).alias("value")
    found.select(text, "event_family").repartition("event_family").write.partitionBy("event_family").text(folder)
    hashes = monitoring.file_hashes(spark, f"{folder}/*/*.txt")
    return hashes.withColumn("path", F.regexp_extract("path", "event_family=([^/]+)/", 1))


cte("artifact_texts", """
SELECT event_family AS path, event_family || ':' || count(*) || chr(10) AS content FROM edge_table GROUP BY event_family
""")


@query("file_hashes", sql("SELECT path, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS sha256 FROM artifact_texts"))
def file_hashes(spark, sf_dir):
    return _artifacts(spark, sf_dir)


@query("changed_hashes", sql("""
SELECT path, sha256('old' || content) AS sha256 FROM artifact_texts WHERE length(path) > 10"""))
def changed_hashes(spark, sf_dir):
    """Records of which those with a long name are out of date."""
    actual = _artifacts(spark, sf_dir)
    texts = testbed.edges(spark, sf_dir).groupBy("event_family").agg(F.count("*").alias("n"))
    content = F.concat(F.col("event_family"), F.lit(":"), F.col("n").cast("string"), F.lit("\n"))
    old = F.when(F.length("event_family") > 10, F.concat(F.lit("old"), content)).otherwise(content)
    recorded = texts.select(F.col("event_family").alias("path"), F.sha2(old, 256).alias("sha256"))
    return monitoring.changed_hashes(recorded, actual).select("path", "sha256")


@query("latest_version", """
SELECT event_type AS path, event_id AS size FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 1""")
def latest_version(spark, sf_dir):
    records = testbed.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("path"), F.format_string("%012d", "event_id").alias("hash"),
        F.col("event_id").alias("size"), F.col("ts").alias("recorded_at"),
    )
    return monitoring.latest_version(records, "click").select("path", "size")


@query("report_csv", sql("""
SELECT event_family, CAST(count(*) AS INTEGER) AS rows FROM edge_table GROUP BY event_family"""))
def report_csv(spark, sf_dir):
    """A result table written as CSV in a fixed order of columns and read back."""
    path = f"{app_dir(spark)}/report-{uuid.uuid4().hex}"
    counts = testbed.edges(spark, sf_dir).groupBy("event_family").agg(F.count("*").alias("rows"))
    tables.write_report_csv(counts, path, ["event_family", "rows"])
    return spark.read.csv(path, header=True, inferSchema=True)


@query("table_manifest")
def table_manifest(spark, sf_dir):
    tables = {
        "events": testbed.events(spark, sf_dir), "nodes": testbed.enriched_nodes(spark, sf_dir),
        "edges": testbed.edges(spark, sf_dir),
    }
    return monitoring.table_manifest(tables, ["event_family", "event_type", "entity_type", "label"])


@query("lineage_manifest")
def lineage_manifest(spark, sf_dir):
    f1 = event_test_metrics(spark, sf_dir).first()["f1"]
    return monitoring.lineage_manifest(
        event_rows(spark, sf_dir), {"model_name": "event_logistic", "model_type": "logistic"},
        {"max_iter": "1000"}, {"f1": f1}, {"provider": "parquet", "feature_view_name": "events"},
        "tracewright.plans.learning", "fit_event_logistic", f"{sf_dir}/events.parquet",
    )


@query("scalar_metrics", sql("""
SELECT run, metric, value FROM (UNPIVOT (
  SELECT event_family AS run, CAST(count(*) AS DOUBLE) AS rows, round(avg(score), 6) AS mean_score
  FROM scored GROUP BY 1) ON rows, mean_score INTO NAME metric VALUE value)"""))
def scalar_metrics(spark, sf_dir):
    runs = scored(spark, sf_dir).groupBy("event_family").agg(
        F.count("*").alias("rows"), F.round(F.avg("score"), 6).alias("mean_score"),
        (F.count("*") > 0).alias("any"),
    )
    return monitoring.scalar_metrics(runs, "event_family")


@query("json_safe_rows", """
SELECT '{"event_id":' || event_id || ',"top":' || safe || ',"list":[' || safe || ',1.0],"deep":{"inner":{"x":' || safe
       || '}},"named":{"k":' || safe || '}}' AS document
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '0.5' ELSE 'null' END AS safe FROM events)""")
def json_safe_rows(spark, sf_dir):
    """NaN and infinity in a field, an array, a struct in a struct and a map."""
    x = F.when(F.col("event_id") % 3 == 0, 0.5).when(F.col("event_id") % 3 == 1, float("nan")).otherwise(float("inf"))
    rows = testbed.table(spark, sf_dir, "events").select(
        "event_id", x.alias("top"), F.array(x, F.lit(1.0)).alias("list"),
        F.struct(F.struct(x.alias("x")).alias("inner")).alias("deep"), F.create_map(F.lit("k"), x).alias("named"),
    )
    return monitoring.json_safe(rows)


@query("json_first_path", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.5::DOUBLE WHEN event_id % 3 = 2 THEN 2.5::DOUBLE END AS number FROM events""")
def json_first_path(spark, sf_dir):
    """The first path that holds anything decides, also where that is no number."""
    doc = F.when(F.col("event_id") % 3 == 0, '{"a": 1.5, "b": 2.5}').when(F.col("event_id") % 3 == 1, '{"a": "x", "b": 2.5}')
    rows = testbed.table(spark, sf_dir, "events").select("event_id", doc.otherwise('{"b": 2.5}').alias("doc"))
    return rows.select("event_id", first_json_number("doc", ["a", "b"]).alias("number"))


@query("drift_far_from_zero", """
WITH given AS (SELECT CAST(l_orderkey AS DOUBLE) + 1700000000 AS v, l_linenumber % 2 = 1 AS is_ref FROM lineitem),
n AS (SELECT CAST(count(*) FILTER (WHERE is_ref) AS DOUBLE) AS nr, CAST(count(*) FILTER (WHERE NOT is_ref) AS DOUBLE) AS nc,
             stddev_pop(v - 1700000000) FILTER (WHERE is_ref) AS spread FROM given),
steps AS (SELECT v, sum(sum(CAST(is_ref AS INTEGER))) OVER w AS r, sum(sum(CAST(NOT is_ref AS INTEGER))) OVER w AS c,
                 lead(v) OVER (ORDER BY v) - v AS width FROM given GROUP BY v WINDOW w AS (ORDER BY v))
SELECT 'shifted' AS field, round(max(abs(r / nr - c / nc)), 6) AS ks_distance,
       round(sum(abs(r / nr - c / nc) * coalesce(width, 0)) / max(spread), 6) AS wasserstein
FROM steps, n""")
def drift_far_from_zero(spark, sf_dir):
    """Order keys moved to where epoch times lie: the distance must not depend on the shift."""
    rows = testbed.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 1_700_000_000).cast("double").alias("shifted"), (F.col("l_linenumber") % 2 == 1).alias("is_ref")
    )
    found = monitoring.numeric_drift(rows.filter("is_ref"), rows.filter("not is_ref"), ["shifted"])
    return rounded(found.select("field", "ks_distance", "wasserstein"))


# ---------------------------------------------------------------- streams over the landed tables


SLICES = 3


ALL_FILES = (1 << 31) - 1


def _arriving(landed, root: str):
    """The raw logs cut by time and written slice by slice as logs arrive, by as many tasks as read them."""
    time = F.col("timestamp").cast("bigint")
    ends = [df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first() for df in landed.values()]
    low, high = min(e["lo"] for e in ends), max(e["hi"] for e in ends)
    for k in range(SLICES):
        inside = F.floor((time - low) * SLICES / (high - low + 1)) == k
        for kind, df in landed.items():
            df.filter(inside).write.mode("append").parquet(f"{root}/{kind}")
        yield k


def _unified(spark, root: str):
    """A stream whose next batch is all that has arrived."""
    return streams.unified_stream({
        kind: streams.raw_stream(spark, f"{root}/{kind}", kind, max_files=ALL_FILES) for kind in ("auth", "dns", "flows", "proc", "redteam")
    })


def _drained(spark, sf_dir, shape=lambda events: events, mode="append"):
    """Every slice is drained when it has arrived; state and watermark pass on by the checkpoint."""
    root = f"{app_dir(spark)}/stream-{uuid.uuid4().hex}"
    for _ in _arriving(testbed.all_landed(spark, sf_dir), f"{root}/arriving"):
        stream = shape(_unified(spark, f"{root}/arriving"))
        streams.run_to_end(stream, f"{root}/out", f"{root}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("streamed_events", sql("""
SELECT event_id, "timestamp", event_type, source_entity, destination_entity, label FROM unified"""))
def streamed_events(spark, sf_dir):
    return _drained(spark, sf_dir).select(
        "event_id", "timestamp", "event_type", "source_entity", "destination_entity", "label"
    )


@query("streamed_hourly_counts", sql("""
SELECT "timestamp" // 3600 * 3600 AS window_start, source_entity, event_family || ':' || event_type AS edge_type,
       destination_entity, count(*) AS events_in_window
FROM unified
WHERE "timestamp" // 3600 * 3600 + 3600 <= (SELECT max("timestamp") - 3600 FROM unified)
GROUP BY 1, 2, 3, 4"""))
def streamed_hourly_counts(spark, sf_dir):
    """Windows the watermark has closed by the end of the input."""
    out = _drained(spark, sf_dir, streams.hourly_relation_counts)
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query("streamed_recency", sql("""
, gaps AS (
  SELECT event_id, source_entity, event_family || ':' || event_type AS edge_type, destination_entity, "timestamp",
         row_number() OVER k AS event_count_so_far, lag("timestamp") OVER k AS last_seen_timestamp,
         "timestamp" - lag("timestamp") OVER k AS time_since_previous,
         min("timestamp") OVER (k ROWS UNBOUNDED PRECEDING) AS first_seen_timestamp
  FROM unified
  WINDOW k AS (PARTITION BY source_entity, event_family, event_type, destination_entity ORDER BY "timestamp", event_id))
SELECT *, round(avg(time_since_previous) OVER (
         PARTITION BY source_entity, edge_type, destination_entity
         ORDER BY "timestamp", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_previous_gap
FROM gaps"""))
def streamed_recency(spark, sf_dir):
    """Every slice is drained when it has arrived; the history of the relations passes on from batch to batch."""
    root = f"{app_dir(spark)}/stream-{uuid.uuid4().hex}"
    for _ in _arriving(testbed.all_landed(spark, sf_dir), f"{root}/arriving"):
        streams.recency_to_end(_unified(spark, f"{root}/arriving"), root)
    return rounded(spark.read.parquet(f"{root}/{streams.RECENCY}").drop("batch"))
