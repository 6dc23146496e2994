"""Counts, summaries and samples that describe a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tracewright.operators import graph, leakage
from tracewright.operators.joins import lookup_as
from tracewright.operators.ordered import exact_quantiles

DEGREES = ["total_degree", "in_degree", "out_degree"]
NODE_CONTEXT = ["node_key", "entity_type", "label"]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value in value order; null is a value."""
    return (
        df.groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("count")).orderBy("value")
    )


def count_tables(df: DataFrame, columns: list[str]) -> DataFrame:
    """``value_counts`` of several columns as one table, from one scan."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("count"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max, mean, median and p95 (interpolated) per column; zeros for an empty one."""
    ends = df.agg(*[
        F.struct(
            F.lit(c).alias("field"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"),
        ).alias(c)
        for c in columns
    ]).select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("s")).select("s.*")
    middle = exact_quantiles(df, columns, {"median": 0.5, "p95": 0.95})
    return ends.join(middle, "field", "left").select(
        "field", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", "max", "mean", "median", "p95")]
    )


def approximate_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-pass variant of ``numeric_summary`` for many columns (sketch-based quantiles)."""
    parts = [
        F.struct(
            F.lit(c).alias("field"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"),
            F.percentile_approx(c, 0.5, 10_000).cast("double").alias("median"),
            F.percentile_approx(c, 0.95, 10_000).cast("double").alias("p95"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*parts).select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def basic_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of table sizes: rows, distinct ids, valid and invalid edges."""
    flagged = graph.flag_endpoints(edges, nodes)
    n = nodes.agg(
        F.count("*").alias("node_rows"), F.countDistinct("node_id").alias("unique_node_ids")
    ).first()
    e = flagged.agg(
        F.count("*").alias("edge_rows"),
        F.count_if("endpoints_known").alias("valid_edge_rows"),
        F.count_if(~F.col("endpoints_known")).alias("invalid_edge_rows"),
        F.countDistinct("edge_id").alias("unique_edge_ids"),
    )
    return e.select(
        *[F.lit(n[c]).cast("bigint").alias(c) for c in ("node_rows", "unique_node_ids")],
        "edge_rows", "unique_edge_ids", "valid_edge_rows", "invalid_edge_rows",
    )


def key_value_table(row: DataFrame) -> DataFrame:
    """(metric, value) rows from a one-row table of counts."""
    return row.unpivot([], row.columns, "metric", "value")


def top_nodes(degrees: DataFrame, by: str = "total_degree", k: int = 25) -> DataFrame:
    context = [c for c in ("node_id", *NODE_CONTEXT, *DEGREES) if c in degrees.columns]
    return degrees.select(context).orderBy(F.desc(by), F.asc("node_id")).limit(k)


def ranked_degrees(degrees: DataFrame, k: int = 25) -> DataFrame:
    """Top ``k`` nodes of each degree kind with their rank.

    ``limit`` keeps k rows per partition before the merge, so the rank window
    only ever sees k rows per kind.
    """
    parts = [
        top_nodes(degrees, kind, k).select(
            F.lit(kind).alias("degree_kind"), "node_id", F.col(kind).alias("degree")
        )
        for kind in DEGREES
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = W.partitionBy("degree_kind").orderBy(F.desc("degree"), "node_id")
    return rows.withColumn("rank", F.row_number().over(w))


def degree_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return numeric_summary(graph.degree_table(nodes, edges), DEGREES)


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("source_node_id", "destination_node_id"))
    seen = edges.select(ends.alias("node_id")).distinct()
    return nodes.join(seen, "node_id", "left_anti")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("source_node_id") == F.col("destination_node_id"))


def with_endpoint_context(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges plus the node key and label at both ends."""
    out = edges
    for end in graph.ENDPOINTS:
        out = lookup_as(
            out, nodes, f"{end}_node_id", "node_id",
            {"node_key": f"{end}_node_key", "label": f"{end}_label"}, ["edge_id"], count_on=edges,
        )
    return out


def participating_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at either end of the given edges."""
    ends = F.explode(F.array("source_node_id", "destination_node_id"))
    return nodes.join(edges.select(ends.alias("node_id")).distinct(), "node_id", "left_semi")


def ground_truth_sample(edges: DataFrame, nodes: DataFrame, k: int = 25) -> DataFrame:
    first = leakage.ground_truth_edges(edges).orderBy("timestamp", "edge_id").limit(k)
    return with_endpoint_context(first, nodes).select(
        "edge_id", "timestamp", "edge_type", "event_family", "source_node_id",
        "destination_node_id", "source_node_key", "destination_node_key",
        "source_entity_type", "destination_entity_type", "label",
    )


def ground_truth_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ground-truth edges, nodes that take part, nodes labelled."""
    truth = leakage.ground_truth_edges(edges)
    taking_part = participating_nodes(nodes, truth).agg(F.count("*"))
    labelled = nodes.filter(F.col("label") == 1).agg(F.count("*"))
    return truth.agg(F.count("*").alias("ground_truth_edges")).select(
        "ground_truth_edges", taking_part.scalar().alias("participating_nodes"),
        labelled.scalar().alias("labelled_nodes"),
    )


def ground_truth_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    truth = leakage.ground_truth_edges(edges)
    ends = count_tables(truth, ["edge_type", "event_family"])
    kinds = count_tables(participating_nodes(nodes, truth), ["entity_type"])
    return ends.unionByName(kinds)


def graph_profile_document(
    nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None, k: int = 25
) -> DataFrame:
    """The whole profile as one nested row, ready for a JSON sink."""
    counts = count_tables(nodes, ["entity_type", "label"]).withColumn("table", F.lit("nodes"))
    counts = counts.unionByName(
        count_tables(edges, ["edge_type", "event_family", "label"]).withColumn("table", F.lit("edges"))
    )

    def rows(df: DataFrame, name: str) -> DataFrame:
        # Each input is a small report table.
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))

    degrees = graph.degree_table(nodes, edges)
    out = basic_profile(nodes, edges).select(F.struct("*").alias("basic"))
    parts = [
        rows(counts, "counts"),
        rows(degree_profile(nodes, edges), "degree_summary"),
        rows(ranked_degrees(degrees, k), "top_nodes"),
        rows(ground_truth_counts(nodes, edges), "ground_truth_counts"),
        rows(ground_truth_sample(edges, nodes, k), "ground_truth_sample"),
        isolated_nodes(nodes, edges).agg(F.count("*").alias("isolated_nodes")),
        rows(isolated_nodes(nodes, edges).orderBy("node_id").limit(k), "isolated_sample"),
        self_loops(edges).agg(F.count("*").alias("self_loops")),
        rows(self_loops(edges).orderBy("edge_id").limit(k), "self_loop_sample"),
    ]
    if components is not None:
        parts.append(rows(components, "components"))
    for part in parts:
        out = out.withColumn(part.columns[0], part.scalar())
    return out
