"""Events to a typed directed multigraph of node and edge tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F

from tracewright.functions.columns import edge_type, long_or, node_key, norm
from tracewright.operators.joins import lookup, lookup_as
from tracewright.operators.ordered import dense_index, group_index
from tracewright.schemas import (
    EDGE_SCHEMA,
    ENTITY_TYPES,
    NODE_SCHEMA,
    TableCheckError,
    require_columns,
    require_no_rows,
    require_unique,
)

log = logging.getLogger(__name__)

ENDPOINTS = ("source", "destination")


def entities(events: DataFrame) -> DataFrame:
    """Distinct entities of both roles, one per node key.

    Both roles leave one scan as an array. Equal ones are merged before anything is
    normalised: a distinct of plain texts is hashed, a minimum of structs would be sorted.
    """
    role = F.explode(
        F.array(*[
            F.struct(
                F.col(f"{end}_entity_type").cast("string").alias("entity_type"),
                F.col(f"{end}_entity").cast("string").alias("entity_name"),
            )
            for end in ENDPOINTS
        ])
    )
    given = events.select(role.alias("e")).select("e.*").distinct()
    return (
        given.select(norm("entity_type").alias("entity_type"), norm("entity_name").alias("entity_name"))
        .select("*", node_key("entity_type", "entity_name").alias("node_key"))
        .groupBy("node_key")
        .agg(F.min(F.struct("entity_type", "entity_name")).alias("e"))
        .select("e.entity_type", "e.entity_name", "node_key")
    )


def build_nodes(events: DataFrame) -> DataFrame:
    """Node table with ids 0..n-1 by (type, name); statistics still at their defaults."""
    require_columns(events, ["source_entity", "destination_entity"], "events")
    indexed = dense_index(entities(events), ["entity_type", "entity_name"], "node_id")
    return indexed.select(
        "node_id", "entity_type", "entity_name", "node_key",
        F.lit(-1).cast("bigint").alias("first_seen_timestamp"),
        F.lit(-1).cast("bigint").alias("last_seen_timestamp"),
        F.lit(0).cast("bigint").alias("event_count"),
        F.lit(0).cast("bigint").alias("label"),
    )


def compact_index(nodes: DataFrame, name: str = "node_index") -> DataFrame:
    """Add 0..n-1 by node id; ids must be unique."""
    require_unique(nodes, ["node_id"], "nodes")
    return dense_index(nodes, ["node_id"], name)


def local_index(nodes: DataFrame, name: str = "local_id") -> DataFrame:
    """Add 0..k-1 by node id inside each entity type."""
    return group_index(nodes, ["entity_type"], ["node_id"], name)


def build_edges(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per event. Raises when an endpoint has no node."""
    require_unique(nodes, ["node_key"], "nodes")
    rows = events.select(
        F.col("event_id").alias("edge_id"),
        node_key("source_entity_type", "source_entity").alias("source_key"),
        node_key("destination_entity_type", "destination_entity").alias("destination_key"),
        *[norm(f"{end}_entity{part}").alias(f"{end}_entity{part}") for part in ("", "_type") for end in ENDPOINTS],
        edge_type("event_family", "event_type").alias("edge_type"),
        norm("event_family").alias("event_family"),
        norm("event_type").alias("event_type"),
        long_or(events, "timestamp", -1).alias("timestamp"),
        norm("event_result").alias("event_result"),
        long_or(events, "label", 0).alias("label"),
        norm("source_file").alias("source_file"),
        long_or(events, "row_number", -1).alias("row_number"),
    )
    base = rows
    for end in ENDPOINTS:
        rows = lookup_as(
            rows, nodes, f"{end}_key", "node_key", {"node_id": f"{end}_node_id"}, ["edge_id"], count_on=base
        )
    return rows.select(*EDGE_SCHEMA.fieldNames())


def require_matched(edges: DataFrame) -> DataFrame:
    missing = edges.filter("source_node_id is null or destination_node_id is null")
    require_no_rows(missing.select("edge_id"), "edges without a node")
    return edges


def participation(edges: DataFrame) -> DataFrame:
    """Per node over both roles: first and last time, events (a self-loop counts twice), label."""
    both = F.explode(F.array("source_node_id", "destination_node_id"))
    return (
        edges.select(both.alias("node_id"), "timestamp", "label")
        .groupBy("node_id")
        .agg(
            F.min("timestamp").alias("first_seen_timestamp"),
            F.max("timestamp").alias("last_seen_timestamp"),
            F.count("*").alias("event_count"),
            F.max("label").alias("label"),
        )
    )


def enrich_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    plain = nodes.select("node_id", "entity_type", "entity_name", "node_key")
    defaults = {"first_seen_timestamp": -1, "last_seen_timestamp": -1, "event_count": 0, "label": 0}
    joined = plain.join(participation(edges), "node_id", "left")
    return joined.select(
        *plain.columns,
        *[F.coalesce(c, F.lit(d).cast("bigint")).alias(c) for c, d in defaults.items()],
    ).select(*NODE_SCHEMA.fieldNames())


def flag_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges plus ``endpoints_known``."""
    known = nodes.select("node_id", F.lit(True).alias("known"))
    spread = ["edge_id"] if "edge_id" in edges.columns else ["source_node_id", "destination_node_id"]
    out = edges
    for end in ENDPOINTS:
        out = lookup_as(out, known, f"{end}_node_id", "node_id", {"known": f"_{end}"}, spread, count_on=edges)
    both = F.coalesce(F.col("_source") & F.col("_destination"), F.lit(False))
    return out.select(*edges.columns, both.alias("endpoints_known"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return flag_endpoints(edges, nodes).filter("endpoints_known").drop("endpoints_known")


def invalid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return flag_endpoints(edges, nodes).filter(~F.col("endpoints_known")).drop("endpoints_known")


def apply_edge_policy(edges: DataFrame, nodes: DataFrame, policy: str = "warn") -> DataFrame:
    """Valid edges; invalid ones are logged (``warn``) or refused (``fail``)."""
    if policy not in ("warn", "fail"):
        raise ValueError(f"unknown invalid edge policy {policy!r}")
    bad = invalid_edges(edges, nodes).count()
    if bad and policy == "fail":
        raise TableCheckError(f"{bad} edges have an unknown endpoint")
    if bad:
        log.warning("%d edges have an unknown endpoint and are left out", bad)
    return valid_edges(edges, nodes)


def type_conflicts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose declared endpoint type differs from the node table, or whose node is unknown."""
    out = edges
    for end in ENDPOINTS:
        out = lookup_as(
            out, nodes, f"{end}_node_id", "node_id", {"entity_type": f"_{end}_type"}, ["edge_id"],
            count_on=edges,
        )
    agree = F.lit(True)
    for end in ENDPOINTS:
        agree = agree & F.col(f"_{end}_type").eqNullSafe(F.col(f"{end}_entity_type"))
    return out.filter(~agree).select(*edges.columns)


def degree_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node; a self-loop adds two to the total."""
    ends = F.explode(F.array(
        F.struct(F.col("source_node_id").alias("node_id"), F.lit(0).alias("inward")),
        F.struct(F.col("destination_node_id").alias("node_id"), F.lit(1).alias("inward")),
    ))
    counts = (
        edges.select(ends.alias("e")).groupBy("e.node_id")
        .agg(F.sum("e.inward").alias("in_degree"), F.count("*").alias("total_degree"))
    )
    joined = nodes.join(counts, "node_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *nodes.columns,
        F.coalesce("in_degree", zero).alias("in_degree"),
        F.coalesce(F.col("total_degree") - F.col("in_degree"), zero).alias("out_degree"),
        F.coalesce("total_degree", zero).alias("total_degree"),
    )


def unknown_types(nodes: DataFrame, known: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    return nodes.select("entity_type").distinct().filter(~F.col("entity_type").isin(*known))


def local_endpoints(edges: DataFrame, indexed_nodes: DataFrame, name: str = "local_id") -> DataFrame:
    """Replace global endpoint ids by per-type ids; raises on an unknown endpoint."""
    out = edges
    for end in ENDPOINTS:
        out = lookup_as(
            out, indexed_nodes, f"{end}_node_id", "node_id",
            {name: f"{end}_{name}"}, ["source_node_id", "destination_node_id"], count_on=edges,
        )
    return out


def typed_relations(edges: DataFrame) -> DataFrame:
    """Distinct (source type, relation, destination type) pairs plus reversed relations."""
    forward = edges.select(
        F.col("source_entity_type").alias("source_type"),
        F.col("event_type").alias("relation"),
        F.col("destination_entity_type").alias("destination_type"),
        "source_node_id", "destination_node_id",
    ).distinct()
    backward = forward.select(
        F.col("destination_type").alias("source_type"),
        F.concat(F.lit("rev_"), "relation").alias("relation"),
        F.col("source_type").alias("destination_type"),
        F.col("destination_node_id").alias("source_node_id"),
        F.col("source_node_id").alias("destination_node_id"),
    )
    return forward.unionByName(backward)


def relation_counts(relations: DataFrame) -> DataFrame:
    triple = ["source_type", "relation", "destination_type"]
    return relations.groupBy(*triple).agg(F.count("*").alias("edge_count")).orderBy(*triple)


def require_no_ground_truth_relation(relations: DataFrame) -> DataFrame:
    bad = relations.filter(F.lower("relation").contains("redteam")).select("relation").distinct()
    require_no_rows(bad, "ground-truth relations remain")
    return relations


def validation_report(nodes: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """One row per check with its number of violations."""
    spark = nodes.sparkSession
    id_stats = nodes.agg(
        (F.count("node_id") - F.countDistinct("node_id")).alias("repeated_node_id"),
        (F.max("node_id") + 1 - F.count("node_id")).alias("gap_in_node_id"),
        F.count(F.when(F.col("label").isNull() | (F.col("label") < 0), 1)).alias("bad_node_label"),
        *[
            F.count(F.when(
                F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                | (F.abs(F.col(c).cast("double")) == float("inf")), 1)).alias(f"not_finite_{c}")
            for c in features
        ],
    )
    edge_stats = flag_endpoints(edges, nodes).agg(
        (F.count("edge_id") - F.countDistinct("edge_id")).alias("repeated_edge_id"),
        F.count(F.when(~F.col("endpoints_known"), 1)).alias("unknown_endpoint"),
        F.count(F.when(F.col("label").isNull() | (F.col("label") < 0), 1)).alias("bad_edge_label"),
    )
    parts = [
        one.unpivot([], one.columns, "check", "violations") for one in (id_stats, edge_stats)
    ]
    return parts[0].unionByName(parts[1])
