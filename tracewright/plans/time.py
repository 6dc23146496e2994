"""Queries on windows, chronological splits and relationship recency."""

from __future__ import annotations

from tracewright.operators import leakage, temporal
from tracewright.plans.reference_sql import cte, sql
from tracewright.plans.registry import query
from tracewright.session import materialize
from tracewright.sources import testbed

cte("origin", 'SELECT min("timestamp") AS start FROM edge_table')

# At every scale of the test tables there are 720 windows; the cuts are int(720 * 0.70) and
# int(720 * (0.70 + 0.15)) in binary floating point.
cte("timed_edges", """
SELECT *, CASE WHEN window_id < 503 THEN 'train' WHEN window_id < 612 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT e.*, ("timestamp" - start) // 3600 AS window_id FROM edge_table e, origin)
""")

cte("ordinary", """
SELECT * FROM timed_edges
WHERE NOT (contains(lower(event_family), 'redteam_ground_truth') OR contains(lower(event_result), 'confirmed_redteam')
           OR contains(lower(source_file), 'redteam.txt.gz') OR contains(lower(edge_type), 'redteam_activity')
           OR contains(lower(edge_type), 'redteam_ground_truth'))
""")

cte("relation_windows", """
SELECT split, source_node_id, edge_type, destination_node_id, window_id, count(*) AS events_in_window
FROM ordinary GROUP BY 1, 2, 3, 4, 5
""")


def _split(spark, sf_dir):
    return temporal.temporal_split(testbed.edges(spark, sf_dir))


@query("ground_truth_mask", sql("""
SELECT edge_id FROM edge_table WHERE edge_id NOT IN (SELECT edge_id FROM ordinary)"""))
def ground_truth_mask(spark, sf_dir):
    return leakage.split_ordinary(testbed.edges(spark, sf_dir))[1].select("edge_id")


@query("temporal_split_ordinary", sql("SELECT edge_id, \"timestamp\", window_id, split FROM ordinary"))
def temporal_split_ordinary(spark, sf_dir):
    return _split(spark, sf_dir)[0].select("edge_id", "timestamp", "window_id", "split")


@query("temporal_split_ground_truth", sql("""
SELECT edge_id, window_id, split FROM timed_edges WHERE edge_id NOT IN (SELECT edge_id FROM ordinary)"""))
def temporal_split_ground_truth(spark, sf_dir):
    return _split(spark, sf_dir)[1].select("edge_id", "window_id", "split")


@query("split_manifest", sql("""
SELECT (SELECT start FROM origin) AS dataset_start_timestamp, CAST(3600 AS BIGINT) AS window_seconds,
       CAST(720 AS BIGINT) AS number_of_windows, CAST(0 AS BIGINT) AS train_start_window,
       CAST(503 AS BIGINT) AS train_end_window_exclusive,
       CAST(503 AS BIGINT) AS validation_start_window,
       CAST(612 AS BIGINT) AS validation_end_window_exclusive,
       CAST(612 AS BIGINT) AS test_start_window,
       max(window_id) + 1 AS test_end_window_exclusive, max(window_id) AS maximum_window_id,
       (SELECT count(*) FROM ordinary) AS ordinary_event_count,
       count(*) - (SELECT count(*) FROM ordinary) AS redteam_event_count
FROM timed_edges"""))
def split_manifest(spark, sf_dir):
    return temporal.manifest_frame(spark, _split(spark, sf_dir)[2])


@query("events_per_window", sql("SELECT window_id, count(*) AS event_count FROM ordinary GROUP BY 1"))
def events_per_window(spark, sf_dir):
    return temporal.events_per_window(_split(spark, sf_dir)[0])


@query("window_metadata", sql("""
SELECT w.window_id, start + w.window_id * 3600 AS window_start_timestamp,
       start + (w.window_id + 1) * 3600 AS window_end_timestamp,
       CASE WHEN w.window_id < 503 THEN 'train' WHEN w.window_id < 612 THEN 'validation' ELSE 'test' END AS split,
       count(o.edge_id) AS ordinary_event_count, count(o.edge_id) = 0 AS is_empty
FROM (SELECT range AS window_id FROM range(720)) w CROSS JOIN origin
LEFT JOIN ordinary o ON o.window_id = w.window_id GROUP BY w.window_id, start"""))
def window_metadata(spark, sf_dir):
    ordinary, _, manifest = _split(spark, sf_dir)
    return temporal.window_metadata(ordinary, manifest)


@query("relation_window_counts", sql("SELECT * FROM relation_windows"))
def relation_window_counts(spark, sf_dir):
    return temporal.relation_window_counts(_split(spark, sf_dir)[0])


@query("previous_window_counts", sql("""
SELECT n.*, coalesce(p.events_in_window, 0) AS previous_window_count
FROM relation_windows n LEFT JOIN relation_windows p
ON p.split = n.split AND p.source_node_id = n.source_node_id AND p.edge_type = n.edge_type
AND p.destination_node_id = n.destination_node_id AND p.window_id = n.window_id - 1"""))
def previous_window_counts(spark, sf_dir):
    return temporal.previous_window_counts(_split(spark, sf_dir)[0])


RECENCY_SQL = sql("""
, gaps AS (
  SELECT *, row_number() OVER k AS event_count_so_far, lag("timestamp") OVER k AS last_seen_timestamp,
         "timestamp" - lag("timestamp") OVER k AS time_since_previous,
         min("timestamp") OVER (k ROWS UNBOUNDED PRECEDING) AS first_seen_timestamp
  FROM ordinary
  WINDOW k AS (PARTITION BY split, source_node_id, edge_type, destination_node_id ORDER BY "timestamp", edge_id))
SELECT edge_id, event_count_so_far, g.last_seen_timestamp, time_since_previous, first_seen_timestamp,
       round(avg(time_since_previous) OVER (
         PARTITION BY g.split, g.source_node_id, g.edge_type, g.destination_node_id
         ORDER BY "timestamp", edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_previous_gap,
       coalesce(p.events_in_window, 0) AS recent_event_count
FROM gaps g LEFT JOIN relation_windows p
ON p.split = g.split AND p.source_node_id = g.source_node_id AND p.edge_type = g.edge_type
AND p.destination_node_id = g.destination_node_id AND p.window_id = g.window_id - 1""")
RECENCY_COLUMNS = [
    "edge_id", "event_count_so_far", "last_seen_timestamp", "time_since_previous",
    "first_seen_timestamp", "round(mean_previous_gap, 6) mean_previous_gap", "recent_event_count",
]


@query("relationship_recency", RECENCY_SQL)
def relationship_recency(spark, sf_dir):
    return temporal.relationship_recency(_split(spark, sf_dir)[0]).selectExpr(RECENCY_COLUMNS)


@query("relationship_recency_in_chunks", RECENCY_SQL)
def relationship_recency_in_chunks(spark, sf_dir):
    """The same features with every relation beyond ten rows on the way for hot relations."""
    keys = [c for c in temporal.RELATION if c != "split"]
    edges = testbed.narrow_edges(spark, sf_dir, ["edge_id", "timestamp", *keys, "event_family", "event_result", "source_file"])
    # What recency reads, written once: its passes would each look for ground truth in all rows again.
    rows = temporal.temporal_split(edges)[0].select(*temporal.RELATION, "window_id", "timestamp", "edge_id")
    return temporal.relationship_recency(materialize(rows, "ordinary"), rows_per_key=10).selectExpr(RECENCY_COLUMNS)
