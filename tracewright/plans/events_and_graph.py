"""Queries on landing, normalisation and the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import graph, leakage, normalize, profile
from tracewright.plans.reference_sql import EVENT_LIST, sql
from tracewright.plans.registry import query
from tracewright.schemas import raw_columns
from tracewright.sources import testbed

NORMALIZED = {
    "auth": "normalize_authentication", "dns": "normalize_dns", "flows": "normalize_network_flow",
    "proc": "normalize_process", "redteam": "normalize_ground_truth",
}


def _register_kind(kind: str, name: str) -> None:
    columns = ", ".join(f'"{c}"' for c in raw_columns(kind))

    @query(f"land_raw_{kind}", sql(
        f"SELECT row_number, {columns}, source_file, event_family FROM raw_{kind}"))
    def land(spark, sf_dir):
        return testbed.raw_log(spark, sf_dir, kind)

    @query(name, sql(f"SELECT * FROM norm_{kind}"))
    def normalise(spark, sf_dir):
        return normalize.NORMALIZERS[kind](testbed.landed(spark, sf_dir, kind))


for _kind, _query_name in NORMALIZED.items():
    _register_kind(_kind, _query_name)


@query("raw_preview", sql("""
SELECT row_number, "timestamp", source_user, destination_host, result
FROM raw_auth ORDER BY row_number LIMIT 10"""))
def raw_preview(spark, sf_dir):
    rows = testbed.landed(spark, sf_dir, "auth")
    return rows.orderBy("row_number").limit(10).select(
        "row_number", "timestamp", "source_user", "destination_host", "result"
    )


@query("unified_events", sql(f"SELECT {EVENT_LIST} FROM unified"))
def unified_events(spark, sf_dir):
    return normalize.in_total_order(normalize.unify(testbed.all_landed(spark, sf_dir)))


@query("event_counts", sql("""
SELECT 'event_family' AS field, event_family AS value, count(*) AS count FROM unified GROUP BY 2
UNION ALL SELECT 'event_type', event_type, count(*) FROM unified GROUP BY 2
UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM unified GROUP BY 2"""))
def event_counts(spark, sf_dir):
    return profile.count_tables(testbed.events(spark, sf_dir), ["event_family", "event_type", "label"])


@query("value_counts", sql("""
SELECT event_family AS value, count(*) AS count FROM unified GROUP BY 1 ORDER BY 1"""))
def value_counts(spark, sf_dir):
    return profile.value_counts(testbed.events(spark, sf_dir), "event_family")


@query("distinct_entities", sql("SELECT entity_type, entity_name, node_key FROM node_table"))
def distinct_entities(spark, sf_dir):
    return graph.entities(testbed.events(spark, sf_dir))


@query("graph_nodes", sql("""
SELECT node_id, entity_type, entity_name, node_key, CAST(-1 AS BIGINT) AS first_seen_timestamp,
       CAST(-1 AS BIGINT) AS last_seen_timestamp, CAST(0 AS BIGINT) AS event_count,
       CAST(0 AS BIGINT) AS label
FROM node_table"""))
def graph_nodes(spark, sf_dir):
    return graph.build_nodes(testbed.events(spark, sf_dir))


@query("graph_edges", sql("SELECT * FROM edge_table"))
def graph_edges(spark, sf_dir):
    edges = graph.build_edges(testbed.events(spark, sf_dir), testbed.nodes(spark, sf_dir))
    return graph.require_matched(edges)


@query("node_participation", sql("""
SELECT node_id, min("timestamp") AS first_seen_timestamp, max("timestamp") AS last_seen_timestamp,
       count(*) AS event_count, max(label) AS label
FROM roles GROUP BY node_id"""))
def node_participation(spark, sf_dir):
    return graph.participation(testbed.edges(spark, sf_dir))


@query("enriched_nodes", sql("SELECT * FROM enriched"))
def enriched_nodes(spark, sf_dir):
    return graph.enrich_nodes(testbed.nodes(spark, sf_dir), testbed.edges(spark, sf_dir))


@query("compact_node_index", sql("""
SELECT node_id, node_key, row_number() OVER (ORDER BY node_id) - 1 AS node_index FROM node_table"""))
def compact_node_index(spark, sf_dir):
    return graph.compact_index(testbed.nodes(spark, sf_dir)).select("node_id", "node_key", "node_index")


@query("per_type_index", sql("""
SELECT node_id, entity_type,
       row_number() OVER (PARTITION BY entity_type ORDER BY node_id) - 1 AS local_id
FROM node_table"""))
def per_type_index(spark, sf_dir):
    return graph.local_index(testbed.nodes(spark, sf_dir)).select("node_id", "entity_type", "local_id")


@query("per_type_endpoints", sql("""
SELECT edge_id, s.local_id AS source_local_id, d.local_id AS destination_local_id
FROM edge_table JOIN local_ids s ON s.node_id = source_node_id
JOIN local_ids d ON d.node_id = destination_node_id"""))
def per_type_endpoints(spark, sf_dir):
    indexed = graph.local_index(testbed.nodes(spark, sf_dir))
    return graph.local_endpoints(testbed.edges(spark, sf_dir), indexed).select(
        "edge_id", "source_local_id", "destination_local_id"
    )



@query("valid_edges", sql("""
SELECT edge_id, source_node_id, destination_node_id FROM checked_edges WHERE ok"""))
def valid_edges(spark, sf_dir):
    rows = graph.valid_edges(testbed.edges(spark, sf_dir), _account_nodes(spark, sf_dir))
    return rows.select("edge_id", "source_node_id", "destination_node_id")


@query("invalid_edges", sql("""
SELECT edge_id, source_node_id, destination_node_id FROM checked_edges WHERE NOT ok"""))
def invalid_edges(spark, sf_dir):
    rows = graph.invalid_edges(testbed.edges(spark, sf_dir), _account_nodes(spark, sf_dir))
    return rows.select("edge_id", "source_node_id", "destination_node_id")


def _account_nodes(spark, sf_dir):
    """Nodes of users and hosts only, so that edges to other types are invalid."""
    return testbed.nodes(spark, sf_dir).filter(F.col("entity_type").isin("user", "host"))


@query("type_conflicts", sql("""
SELECT edge_id FROM edge_table
JOIN (SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'process' ELSE entity_type END AS s FROM node_table) a ON a.node_id = source_node_id
JOIN (SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'process' ELSE entity_type END AS d FROM node_table) b ON b.node_id = destination_node_id
WHERE s <> source_entity_type OR d <> destination_entity_type"""))
def type_conflicts(spark, sf_dir):
    """Every fifth node is given another type, so edges at it disagree."""
    kind = F.when(F.col("node_id") % 5 == 0, "process").otherwise(F.col("entity_type"))
    nodes = testbed.nodes(spark, sf_dir).withColumn("entity_type", kind)
    return graph.type_conflicts(testbed.edges(spark, sf_dir), nodes).select("edge_id")


@query("degree_table", sql("SELECT * FROM degrees"))
def degree_table(spark, sf_dir):
    nodes = testbed.enriched_nodes(spark, sf_dir).select("node_id", "node_key", "entity_type", "label")
    return graph.degree_table(nodes, testbed.edges(spark, sf_dir))


@query("typed_relations", sql("SELECT * FROM relation_table"))
def typed_relations(spark, sf_dir):
    return graph.typed_relations(_safe(spark, sf_dir))


@query("relation_counts", sql("""
SELECT source_type, relation, destination_type, count(*) AS edge_count
FROM relation_table GROUP BY 1, 2, 3"""))
def relation_counts(spark, sf_dir):
    relations = graph.require_no_ground_truth_relation(graph.typed_relations(_safe(spark, sf_dir)))
    return graph.relation_counts(relations)


def _safe(spark, sf_dir):
    return leakage.safe_edges(testbed.edges(spark, sf_dir))


@query("unknown_entity_types", sql("""
SELECT DISTINCT entity_type || '_' || node_id % 3 AS entity_type FROM node_table WHERE node_id % 3 > 0"""))
def unknown_entity_types(spark, sf_dir):
    """Two nodes of three are given types that the typed graph does not know."""
    part = F.col("node_id") % 3
    kind = F.when(part > 0, F.concat_ws("_", "entity_type", part)).otherwise(F.col("entity_type"))
    return graph.unknown_types(testbed.nodes(spark, sf_dir).withColumn("entity_type", kind))


@query("graph_validation", sql("""
SELECT 'repeated_node_id' AS "check", count(node_id) - count(DISTINCT node_id) AS violations FROM enriched
UNION ALL SELECT 'gap_in_node_id', max(node_id) + 1 - count(node_id) FROM enriched
UNION ALL SELECT 'bad_node_label', count(*) FROM enriched WHERE label IS NULL OR label < 0
UNION ALL SELECT 'not_finite_event_count', count(*) FROM enriched WHERE event_count IS NULL
UNION ALL SELECT 'repeated_edge_id', count(edge_id) - count(DISTINCT edge_id) FROM edge_table
UNION ALL SELECT 'unknown_endpoint', count(*) FROM edge_table
          WHERE source_node_id IS NULL OR destination_node_id IS NULL
UNION ALL SELECT 'bad_edge_label', count(*) FROM edge_table WHERE label IS NULL OR label < 0"""))
def graph_validation(spark, sf_dir):
    return graph.validation_report(
        testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir), ["event_count"]
    )


@query("leakage_safe_edges", sql("SELECT * FROM safe_edge_table"))
def leakage_safe_edges(spark, sf_dir):
    return leakage.require_no_leak(_safe(spark, sf_dir))


@query("ground_truth_edges", sql("SELECT edge_id, label FROM edge_table WHERE label = 1"))
def ground_truth_edges(spark, sf_dir):
    return leakage.ground_truth_edges(testbed.edges(spark, sf_dir)).select("edge_id", "label")


@query("withheld_edge_types", sql("""
SELECT edge_id, CASE WHEN event_family = 'redteam_ground_truth'
       THEN 'ground_truth_edge_type_withheld' ELSE edge_type END AS visible_edge_type
FROM edge_table"""))
def withheld_edge_types(spark, sf_dir):
    return testbed.edges(spark, sf_dir).select(
        "edge_id", leakage.withheld_edge_type().alias("visible_edge_type")
    )


@query("edges_without_self_loops", sql("""
SELECT edge_id FROM edge_table WHERE source_node_id <> destination_node_id"""))
def edges_without_self_loops(spark, sf_dir):
    return leakage.without_self_loops(testbed.edges(spark, sf_dir)).select("edge_id")
