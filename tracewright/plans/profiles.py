"""Queries that describe the graph."""

from __future__ import annotations

from tracewright.operators import components, graph, leakage, profile
from tracewright.plans.reference_sql import cte, sql
from tracewright.plans.registry import query
from tracewright.sources import testbed

CONTEXT = ["node_id", "node_key", "entity_type", "label"]

cte("truth_edges", "SELECT * FROM edge_table WHERE label = 1")

cte("truth_nodes", """
SELECT * FROM enriched WHERE node_id IN (
  SELECT source_node_id FROM truth_edges UNION SELECT destination_node_id FROM truth_edges)
""")


def _graph(spark, sf_dir):
    return testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir)


def _degrees(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.degree_table(nodes.select(CONTEXT), edges)


def _register_top(kind: str) -> None:
    @query(f"top_{kind}", sql(f"SELECT * FROM degrees ORDER BY {kind} DESC, node_id LIMIT 25"))
    def top(spark, sf_dir):
        return profile.top_nodes(_degrees(spark, sf_dir), kind)


for _kind in profile.DEGREES:
    _register_top(_kind)


@query("ranked_degrees", sql("""
SELECT * FROM (
  SELECT degree_kind, node_id, degree,
         CAST(row_number() OVER (PARTITION BY degree_kind ORDER BY degree DESC, node_id) AS INTEGER) AS rank
  FROM (SELECT 'total_degree' AS degree_kind, node_id, total_degree AS degree FROM degrees
        UNION ALL SELECT 'in_degree', node_id, in_degree FROM degrees
        UNION ALL SELECT 'out_degree', node_id, out_degree FROM degrees))
WHERE rank <= 25"""))
def ranked_degrees(spark, sf_dir):
    return profile.ranked_degrees(_degrees(spark, sf_dir))


def _summary_sql(kind: str) -> str:
    return f"""SELECT '{kind}' AS field, CAST(min({kind}) AS DOUBLE) AS min,
  CAST(max({kind}) AS DOUBLE) AS max, round(avg({kind}), 6) AS mean,
  round(quantile_cont({kind}, 0.5), 6) AS median, round(quantile_cont({kind}, 0.95), 6) AS p95
FROM degrees"""


@query("degree_summary", sql("\nUNION ALL ".join(_summary_sql(k) for k in profile.DEGREES)))
def degree_summary(spark, sf_dir):
    out = profile.degree_profile(*_graph(spark, sf_dir))
    return out.selectExpr(
        "field", "min", "max", "round(mean, 6) mean", "round(median, 6) median", "round(p95, 6) p95"
    )


@query("graph_basic_profile", sql("""
SELECT (SELECT count(*) FROM enriched) AS node_rows,
       (SELECT count(DISTINCT node_id) FROM enriched) AS unique_node_ids,
       count(*) AS edge_rows, count(DISTINCT edge_id) AS unique_edge_ids,
       count(*) FILTER (WHERE source_node_id IS NOT NULL AND destination_node_id IS NOT NULL) AS valid_edge_rows,
       count(*) FILTER (WHERE source_node_id IS NULL OR destination_node_id IS NULL) AS invalid_edge_rows
FROM edge_table"""))
def graph_basic_profile(spark, sf_dir):
    return profile.basic_profile(*_graph(spark, sf_dir))


@query("graph_count_tables", sql("""
SELECT 'entity_type' AS field, entity_type AS value, count(*) AS count FROM enriched GROUP BY 2
UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM enriched GROUP BY 2
UNION ALL SELECT 'edge_type', edge_type, count(*) FROM edge_table GROUP BY 2
UNION ALL SELECT 'event_family', event_family, count(*) FROM edge_table GROUP BY 2
UNION ALL SELECT 'edge_label', CAST(label AS VARCHAR), count(*) FROM edge_table GROUP BY 2"""))
def graph_count_tables(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return profile.count_tables(nodes, ["entity_type", "label"]).unionByName(
        profile.count_tables(
            edges.withColumn("edge_label", edges.label), ["edge_type", "event_family", "edge_label"]
        )
    )


@query("isolated_nodes", sql("""
SELECT n.node_id, n.node_key FROM enriched n
WHERE n.node_id NOT IN (SELECT source_node_id FROM truth_edges
                        UNION SELECT destination_node_id FROM truth_edges)"""))
def isolated_nodes(spark, sf_dir):
    """Nodes no ground-truth edge touches."""
    nodes, edges = _graph(spark, sf_dir)
    return profile.isolated_nodes(nodes, leakage.ground_truth_edges(edges)).select("node_id", "node_key")


@query("self_loops", sql("""
SELECT edge_id, source_node_id AS node_id, edge_type FROM edge_table
WHERE source_node_id = destination_node_id"""))
def self_loops(spark, sf_dir):
    return profile.self_loops(testbed.edges(spark, sf_dir)).selectExpr(
        "edge_id", "source_node_id node_id", "edge_type"
    )


@query("edges_with_endpoint_context", sql("""
SELECT e.edge_id, s.node_key AS source_node_key, s.label AS source_label,
       d.node_key AS destination_node_key, d.label AS destination_label
FROM edge_table e LEFT JOIN enriched s ON s.node_id = source_node_id
LEFT JOIN enriched d ON d.node_id = destination_node_id"""))
def edges_with_endpoint_context(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return profile.with_endpoint_context(edges, nodes).select(
        "edge_id", "source_node_key", "source_label", "destination_node_key", "destination_label"
    )


@query("ground_truth_participants", sql("SELECT node_id, node_key FROM truth_nodes"))
def ground_truth_participants(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    truth = leakage.ground_truth_edges(edges)
    return profile.participating_nodes(nodes, truth).select("node_id", "node_key")


@query("ground_truth_profile", sql("""
SELECT (SELECT count(*) FROM truth_edges) AS ground_truth_edges,
       (SELECT count(*) FROM truth_nodes) AS participating_nodes,
       (SELECT count(*) FROM enriched WHERE label = 1) AS labelled_nodes"""))
def ground_truth_profile(spark, sf_dir):
    return profile.ground_truth_profile(*_graph(spark, sf_dir))


@query("ground_truth_counts", sql("""
SELECT 'edge_type' AS field, edge_type AS value, count(*) AS count FROM truth_edges GROUP BY 2
UNION ALL SELECT 'event_family', event_family, count(*) FROM truth_edges GROUP BY 2
UNION ALL SELECT 'entity_type', entity_type, count(*) FROM truth_nodes GROUP BY 2"""))
def ground_truth_counts(spark, sf_dir):
    return profile.ground_truth_counts(*_graph(spark, sf_dir))


@query("ground_truth_sample", sql("""
SELECT t.edge_id, t."timestamp", t.edge_type, t.event_family, source_node_id, destination_node_id,
       s.node_key AS source_node_key, d.node_key AS destination_node_key,
       source_entity_type, destination_entity_type, t.label
FROM (SELECT * FROM truth_edges ORDER BY "timestamp", edge_id LIMIT 25) t
JOIN enriched s ON s.node_id = source_node_id JOIN enriched d ON d.node_id = destination_node_id"""))
def ground_truth_sample(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return profile.ground_truth_sample(edges, nodes)


@query("graph_profile_document")
def graph_profile_document(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    weak = components.component_summary(components.weak_components(nodes, edges), "weak")
    strong = components.component_summary(components.strong_components(nodes, edges), "strong")
    return profile.graph_profile_document(nodes, edges, weak.unionByName(strong))


_WEAK = """
, pairs AS (SELECT source_node_id AS a, destination_node_id AS b FROM edge_table
            UNION SELECT destination_node_id, source_node_id FROM edge_table),
reach AS (SELECT node_id AS node, node_id AS root FROM node_table
          UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node),
assigned AS (SELECT node AS node_id, min(root) AS component FROM reach GROUP BY node)
"""

_STRONG = """
, pairs AS (SELECT DISTINCT source_node_id AS a, destination_node_id AS b FROM edge_table),
reach AS (SELECT node_id AS node, node_id AS root FROM node_table
          UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node),
assigned AS (SELECT x.node AS node_id, min(x.root) AS component
             FROM reach x JOIN reach y ON x.node = y.root AND x.root = y.node GROUP BY x.node)
"""


def _component_sql(closure: str, body: str) -> str:
    base = sql("SELECT 1 FROM edge_table, node_table", recursive=True)
    return base.rsplit("\n", 1)[0] + closure + body


def _summary_of(kind: str) -> str:
    return f"""SELECT '{kind}' AS kind, count(*) AS component_count, max(size) AS largest_component_size,
  min(size) AS smallest_component_size, round(max(size) / sum(size), 6) AS largest_component_ratio
FROM (SELECT component, count(*) AS size FROM assigned GROUP BY component)"""


@query("weak_components", _component_sql(_WEAK, "SELECT * FROM assigned"))
def weak_components(spark, sf_dir):
    return components.weak_components(*_graph(spark, sf_dir))


@query("strong_components", _component_sql(_STRONG, "SELECT * FROM assigned"))
def strong_components(spark, sf_dir):
    return components.strong_components(*_graph(spark, sf_dir))


@query("strong_component_summary", _component_sql(_STRONG, _summary_of("strong")))
def strong_component_summary(spark, sf_dir):
    # Enrichment and components read four columns of the edges.
    edges = testbed.narrow_edges(spark, sf_dir, ["source_node_id", "destination_node_id", "timestamp", "label"])
    nodes = graph.enrich_nodes(testbed.nodes(spark, sf_dir), edges)
    out = components.component_summary(components.strong_components(nodes, edges), "strong")
    return out.selectExpr(
        "kind", "component_count", "largest_component_size", "smallest_component_size",
        "round(largest_component_ratio, 6) largest_component_ratio",
    )


def _account_graph(spark, sf_dir):
    """Customers and their orders: as many components as there are customers."""
    customers = testbed.table(spark, sf_dir, "customer").selectExpr("c_custkey * 2 node_id")
    orders = testbed.table(spark, sf_dir, "orders")
    edges = orders.selectExpr("o_custkey * 2 source_node_id", "o_orderkey * 2 + 1 destination_node_id")
    nodes = customers.unionByName(orders.selectExpr("o_orderkey * 2 + 1 node_id"))
    return nodes, edges


@query("weak_components_of_accounts", """
WITH grouped AS (
  SELECT c_custkey, least(c_custkey * 2, min(o_orderkey * 2 + 1)) AS component
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey * 2 AS node_id, component FROM grouped
UNION ALL SELECT o_orderkey * 2 + 1, component FROM orders JOIN grouped ON c_custkey = o_custkey""")
def weak_components_of_accounts(spark, sf_dir):
    return components.weak_components(*_account_graph(spark, sf_dir))


@query("component_size_sample", """
SELECT size FROM (
  SELECT 1 + count(o_orderkey) AS size FROM customer LEFT JOIN orders ON o_custkey = c_custkey
  GROUP BY c_custkey) ORDER BY size DESC LIMIT 10""")
def component_size_sample(spark, sf_dir):
    found = components.weak_components(*_account_graph(spark, sf_dir))
    return components.largest_sizes(found, 10).select("size")
