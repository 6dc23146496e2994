"""Queries on features, splits and class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.columns import norm
from tracewright.operators import features, graph, leakage, ordered, splits
from tracewright.plans.reference_sql import cte, sql
from tracewright.plans.registry import query
from tracewright.sources import testbed

cte("spans", """
SELECT *, CAST(greatest(last_seen_timestamp - first_seen_timestamp, 0) AS DOUBLE) AS active_span FROM enriched
""")


def _scale(c: str, source: str) -> str:
    low, high = f"(SELECT min({c}) FROM {source})", f"(SELECT max({c}) FROM {source})"
    return f"round(coalesce(({c} - {low}) / CAST(nullif({high} - {low}, 0) AS DOUBLE), 0), 6)"


NODE_TYPES = ["host", "host_or_domain", "process", "user"]
EDGE_TYPES = [
    "authentication:auth_click", "authentication:auth_view", "dns:dns_resolution",
    "network_flow:network_flow", "process:process_purchase", "process:process_signup",
]


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("active_span", sql("SELECT node_id, active_span FROM spans"))
def active_span(spark, sf_dir):
    return features.with_active_span(testbed.enriched_nodes(spark, sf_dir)).select("node_id", "active_span")


@query("node_features", sql(f"""
SELECT node_id, {", ".join(f"{_scale(c, 'spans')} AS {c}" for c in features.NODE_NUMBERS)},
       {", ".join(f"CAST(entity_type = '{t}' AS DOUBLE) AS entity_type_{t}" for t in NODE_TYPES)}, label
FROM spans"""))
def node_features(spark, sf_dir):
    return _rounded(features.node_features(testbed.enriched_nodes(spark, sf_dir)), features.NODE_NUMBERS)


def _edge_feature_sql(fit: str) -> str:
    hot = ", ".join(
        f"""CAST(edge_type = '{t}' AS DOUBLE) AS "edge_type_{t}" """ for t in EDGE_TYPES
    )
    scaled = _scale('"timestamp"', fit)
    return sql(f"""
SELECT edge_id, source_node_id, destination_node_id, {scaled} AS timestamp_scaled, {hot}, label
FROM edge_table""")


@query("edge_features", _edge_feature_sql("edge_table"))
def edge_features(spark, sf_dir):
    return _rounded(features.edge_features(testbed.edges(spark, sf_dir)), ["timestamp_scaled"])


@query("edge_features_safe_fit", _edge_feature_sql("safe_edge_table"))
def edge_features_safe_fit(spark, sf_dir):
    out = features.edge_features(testbed.edges(spark, sf_dir), fit_on_safe_only=True)
    return _rounded(out, ["timestamp_scaled"])


# field, kind, model input, target, source column; positions follow the order.
_EDGE_FIELDS = [
    ("edge_id", "string", False, False, "edge_id"),
    ("source_node_id", "bigint", False, False, "source_node_id"),
    ("destination_node_id", "bigint", False, False, "destination_node_id"),
    ("timestamp_scaled", "double", True, False, "timestamp"),
    *[(f"edge_type_{t}", "double", True, False, "edge_type") for t in EDGE_TYPES],
    ("label", "bigint", False, True, "label"),
]
_FIELD_ROWS = ",\n  ".join(
    f"({i}, '{name}', '{kind}', {used}, {target}, '{source}', false, false)"
    for i, (name, kind, used, target, source) in enumerate(_EDGE_FIELDS)
)


@query("feature_manifest", sql(f"""
SELECT CAST(position AS INTEGER) AS position, field, kind, model_input, target, source_column, marks_ground_truth,
       dropped, (SELECT count(*) FROM edge_table) AS table_rows
FROM (VALUES
  {_FIELD_ROWS},
  (NULL, 'edge_type_redteam_ground_truth', NULL, false, false, 'edge_type', true, true)
) AS t(position, field, kind, model_input, target, source_column, marks_ground_truth, dropped)"""))
def feature_manifest(spark, sf_dir):
    table = features.edge_features(testbed.edges(spark, sf_dir))
    return features.feature_manifest(
        table, ["edge_id", "source_node_id", "destination_node_id"],
        origins={"timestamp_scaled": "timestamp", "edge_type_*": "edge_type"},
        dropped=["edge_type_redteam_ground_truth"],
    )


@query("category_ids", sql("""
SELECT edge_id, entity_id, edge_type_id, family_id FROM edge_table
JOIN (SELECT edge_type, row_number() OVER (ORDER BY edge_type) - 1 AS edge_type_id
      FROM (SELECT DISTINCT edge_type FROM edge_table)) USING (edge_type)
JOIN (SELECT event_family, row_number() OVER (ORDER BY event_family) - 1 AS family_id
      FROM (SELECT DISTINCT event_family FROM edge_table)) USING (event_family)
JOIN (SELECT source_entity_type, row_number() OVER (ORDER BY source_entity_type) - 1 AS entity_id
      FROM (SELECT DISTINCT source_entity_type FROM edge_table)) USING (source_entity_type)"""))
def category_ids(spark, sf_dir):
    rows = testbed.edges(spark, sf_dir)
    named = {"source_entity_type": "entity_id", "edge_type": "edge_type_id", "event_family": "family_id"}
    for column, name in named.items():
        rows = features.category_ids(rows, column, name, ["edge_id"])
    return rows.select("edge_id", *named.values())


cte("safe_roles", """
SELECT source_node_id AS node_id, destination_node_id AS other, 1 AS outward, "timestamp" FROM safe_edge_table
UNION ALL SELECT destination_node_id, source_node_id, 0, "timestamp" FROM safe_edge_table
""")

cte("safe_stats", """
SELECT n.node_id, entity_type, entity_name, label, outgoing_count, incoming_count, unique_neighbor_count,
       first_seen, last_seen, outgoing_count + incoming_count AS total_event_count,
       greatest(last_seen - first_seen, 0) AS activity_duration
FROM (SELECT e.node_id, entity_type, entity_name, e.label,
             count(r.node_id) FILTER (WHERE outward = 1) AS outgoing_count,
             count(r.node_id) FILTER (WHERE outward = 0) AS incoming_count,
             count(DISTINCT other) FILTER (WHERE outward = 1)
               + count(DISTINCT other) FILTER (WHERE outward = 0) AS unique_neighbor_count,
             coalesce(min("timestamp"), 0) AS first_seen, coalesce(max("timestamp"), 0) AS last_seen
      FROM enriched e LEFT JOIN safe_roles r ON r.node_id = e.node_id
      GROUP BY e.node_id, entity_type, entity_name, e.label) n
""")


@query("safe_node_statistics", sql("SELECT * FROM safe_stats"))
def safe_node_statistics(spark, sf_dir):
    return features.safe_statistics(testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir))


@query("safe_node_features", sql("""
SELECT node_id, entity_type, label, round(ln(1 + outgoing_count), 6) AS log_outgoing_event_count,
       round(ln(1 + incoming_count), 6) AS log_incoming_event_count, round(ln(1 + unique_neighbor_count), 6) AS log_unique_neighbor_count,
       round(ln(1 + total_event_count), 6) AS log_total_event_count, round(ln(1 + activity_duration), 6) AS log_activity_duration,
       round(first_seen / top, 6) AS normalized_first_seen, round(last_seen / top, 6) AS normalized_last_seen
FROM safe_stats, (SELECT CAST(greatest(max("timestamp"), 1) AS DOUBLE) AS top FROM safe_edge_table)"""))
def safe_node_features(spark, sf_dir):
    out = features.safe_node_features(testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir))
    return _rounded(features.require_finite(out, features.SAFE_FEATURES), features.SAFE_FEATURES)


# Line items shaped as a second, tabular flow data set.
cte("flow_table", """
SELECT l_quantity AS flow_duration, l_extendedprice AS flow_bytes_per_s, l_linenumber AS protocol,
       l_partkey AS destination_port, l_discount AS fwd_iat_mean, l_linestatus = 'F' AS fwd_psh_flags,
       CASE WHEN l_returnflag = 'N' THEN ' benign' WHEN l_returnflag = 'A' THEN 'DDoS' ELSE 'PortScan' END AS label
FROM lineitem
""")


def flow_table(spark, sf_dir):
    return testbed.table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity as ` Flow Duration`", "l_extendedprice as ` Flow Bytes/s`",
        "l_linenumber as ` Protocol`", "l_partkey as ` Destination Port`",
        "l_discount as `Fwd IAT Mean`", "l_linestatus = 'F' as ` Fwd PSH Flags`",
        "cast(null as double) as ` Unused`",
        "case when l_returnflag = 'N' then ' benign' when l_returnflag = 'A' then 'DDoS' "
        "else 'PortScan' end as ` Label`",
    )


FLOW_FEATURES = [
    "flow_duration", "flow_bytes_per_s", "protocol", "destination_port", "fwd_iat_mean", "fwd_psh_flags",
]


@query("tabular_features", sql(f"""
SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FLOW_FEATURES)},
       CAST(CASE WHEN upper(trim(label)) <> 'BENIGN' THEN 1 ELSE 0 END AS INTEGER) AS target
FROM flow_table"""))
def tabular_features(spark, sf_dir):
    return features.tabular_features(flow_table(spark, sf_dir))


@query("tabular_label_counts", sql("SELECT label AS value, count(*) AS count FROM flow_table GROUP BY 1"))
def tabular_label_counts(spark, sf_dir):
    named = features.normalized_columns(flow_table(spark, sf_dir))
    return named.groupBy(F.col("label").alias("value")).agg(F.count("*").alias("count"))


@query("feature_groups", sql("""
SELECT CAST(6 AS BIGINT) AS total_features, CAST(2 AS BIGINT) AS categorical_numeric_features,
       binaries AS binary_features, CAST(6 - binaries - 2 AS BIGINT) AS continuous_features
FROM (SELECT CAST(""" + " + ".join(
    f"CAST(count(*) FILTER (WHERE CAST({c} AS DOUBLE) NOT IN (0, 1)) = 0 AS INTEGER)" for c in FLOW_FEATURES
) + """ AS BIGINT) AS binaries FROM flow_table)"""))
def feature_groups(spark, sf_dir):
    return features.feature_groups(features.tabular_features(flow_table(spark, sf_dir)))


def _cut(ratio: str) -> str:
    return f"CAST(floor(n * {ratio}) AS BIGINT)"


def split_cte(name: str, source: str, key: str, strata: str, train: str, validation: str | None) -> None:
    """Ranks by md5 inside each stratum against counts cut in double arithmetic."""
    first = _cut(train)
    rule = f"CASE WHEN r <= {first} THEN 'train' "
    if validation:
        rule += f"WHEN r <= {first} + {_cut(validation)} THEN 'validation' "
    cte(name, f"""
SELECT * EXCLUDE (r, n), {rule}ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5('42|' || {key})) AS r,
         count(*) OVER (PARTITION BY {strata}) AS n FROM {source})
""")


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


split_cte("edge_two_way", "edge_table", "edge_id", "label", f"(1 - {_d('0.2')})", None)
split_cte(
    "edge_three_way", "edge_table", "edge_id", "label",
    f"(1 - {_d('0.2')}) * (1 - {_d('0.2')})", f"(1 - {_d('0.2')}) * {_d('0.2')}",
)
split_cte("node_three_way", "enriched", "node_id", "label", _d("0.70"), _d("0.15"))
cte("typed_strata", """
SELECT *, CASE WHEN (SELECT count(DISTINCT label) = 2 FROM enriched x WHERE x.entity_type = e.entity_type)
               AND (SELECT min(c) >= 3 FROM (SELECT entity_type AS t, count(*) AS c FROM enriched
                                             GROUP BY entity_type, label) y WHERE y.t = e.entity_type)
          THEN label ELSE -1 END AS stratum
FROM enriched e WHERE entity_type IN ('user', 'host')
""")
split_cte("typed_three_way", "typed_strata", "node_id", "entity_type, stratum", _d("0.50"), _d("0.25"))


@query("stratified_split", sql("SELECT edge_id, label, split FROM edge_two_way"))
def stratified_split(spark, sf_dir):
    rows = testbed.edges(spark, sf_dir).select("edge_id", "label")
    return splits.stratified_split(rows, ["edge_id"], "label")


@query("stratified_three_way", sql("SELECT edge_id, label, split FROM edge_three_way"))
def stratified_three_way(spark, sf_dir):
    rows = testbed.edges(spark, sf_dir).select("edge_id", "label")
    return splits.stratified_three_way(rows, ["edge_id"], "label")


@query("node_split", sql("SELECT node_id, label, split FROM node_three_way"))
def node_split(spark, sf_dir):
    rows = testbed.enriched_nodes(spark, sf_dir).select("node_id", "label")
    out = splits.node_split(rows)
    splits.check_split(out, ["node_id"])
    return out


@query("typed_node_split", sql("SELECT node_id, entity_type, label, split FROM typed_three_way"))
def typed_node_split(spark, sf_dir):
    return splits.typed_node_split(testbed.enriched_nodes(spark, sf_dir)).select(
        "node_id", "entity_type", "label", "split"
    )


@query("split_sizes", sql("""
SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM edge_three_way GROUP BY split"""))
def split_sizes(spark, sf_dir):
    return splits.split_sizes(stratified_three_way(spark, sf_dir))


@query("fixed_size_sample", sql("""
SELECT edge_id FROM edge_table ORDER BY md5('42|' || edge_id) LIMIT 1000"""))
def fixed_size_sample(spark, sf_dir):
    return splits.hashed_sample(testbed.edges(spark, sf_dir).select("edge_id"), 1000, ["edge_id"], 42)


@query("ordered_halves", """
SELECT event_id, value, CASE WHEN r <= n // 2 THEN 'reference' ELSE 'current' END AS half
FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)""")
def ordered_halves(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return ordered.ordered_halves(rows, ["ts", "event_id"]).select("event_id", "value", "half")


@query("class_weights", sql("""
SELECT CAST(label AS INTEGER) AS class, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (2 * count(*)), 6) AS weight
FROM node_three_way WHERE split = 'train' GROUP BY label"""))
def class_weights(spark, sf_dir):
    train = node_split(spark, sf_dir).filter("split = 'train'")
    found = features.class_weights(train, strict=True)
    return spark.createDataFrame(
        [(c, round(w, 6)) for c, w in found.items()], "class int, weight double"
    )


@query("positive_weights_by_type", sql("""
SELECT entity_type, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives,
       round(count(*) FILTER (WHERE label = 0) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 6) AS positive_weight
FROM typed_three_way WHERE split = 'train' GROUP BY entity_type"""))
def positive_weights_by_type(spark, sf_dir):
    train = typed_node_split(spark, sf_dir).filter("split = 'train'")
    return _rounded(features.positive_weights_by(train, "entity_type"), ["positive_weight"])


STANDARD = ["flow_duration", "flow_bytes_per_s", "fwd_iat_mean"]


@query("standardized_safe_features", sql("""
SELECT node_id, """ + ", ".join(
    f"round((log_{c}_event_count - m_{c}) / nullif(s_{c}, 0), 5) AS log_{c}_event_count" for c in ("outgoing", "incoming", "total")
) + """
FROM (SELECT n.node_id, split, ln(1 + outgoing_count) AS log_outgoing_event_count, ln(1 + incoming_count) AS log_incoming_event_count,
             ln(1 + total_event_count) AS log_total_event_count
      FROM safe_stats n JOIN node_three_way s ON s.node_id = n.node_id),
     (SELECT """ + ", ".join(
    f"avg(ln(1 + {c}_{k}count)) AS m_{c}, stddev_pop(ln(1 + {c}_{k}count)) AS s_{c}"
    for c, k in (("outgoing", ""), ("incoming", ""), ("total", "event_"))
) + """ FROM safe_stats n JOIN node_three_way s ON s.node_id = n.node_id WHERE split = 'train')"""))
def standardized_safe_features(spark, sf_dir):
    """Scaling fitted on training nodes only."""
    rows = features.safe_node_features(testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir))
    marked = rows.join(node_split(spark, sf_dir).select("node_id", "split"), "node_id")
    columns = ["log_outgoing_event_count", "log_incoming_event_count", "log_total_event_count"]
    out = features.standardized(marked, columns, F.col("split") == "train")
    return out.select("node_id", *[F.round(c, 5).alias(c) for c in columns])


@query("unseen_category_encoding", sql("""
SELECT edge_id, edge_type IN (SELECT edge_type FROM edge_table WHERE label = 0) AS known
FROM edge_table"""))
def unseen_category_encoding(spark, sf_dir):
    """Encode every edge with categories fitted on ordinary edges; unseen types become all zeros."""
    rows = testbed.edges(spark, sf_dir).select("edge_id", "edge_type", "label")
    out = features.encoded(rows.filter("label = 0"), rows, ["edge_type"])
    from pyspark.ml.functions import vector_to_array

    total = F.aggregate(vector_to_array("edge_type_hot"), F.lit(0.0), lambda a, x: a + x)
    return out.select("edge_id", (total > 0).alias("known"))


@query("normalized_text", """
SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), 'unknown') AS segment,
       coalesce(nullif(trim(c_name), ''), 'unknown') AS name FROM customer""")
def normalized_text(spark, sf_dir):
    return testbed.table(spark, sf_dir, "customer").select(
        "c_custkey", norm("c_mktsegment").alias("segment"), norm("c_name").alias("name")
    )


@query("edge_types_visible_to_models", sql("""
SELECT DISTINCT event_type FROM safe_edge_table"""))
def edge_types_visible_to_models(spark, sf_dir):
    safe = leakage.safe_edges(testbed.edges(spark, sf_dir))
    return graph.typed_relations(safe).filter(~F.startswith("relation", F.lit("rev_"))).select(
        F.col("relation").alias("event_type")
    ).distinct()
