"""Keeping ground truth out of model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.columns import contains_any, to_long_or
from tracewright.schemas import require_columns, require_no_rows

# The marks ground-truth rows carry.
GROUND_TRUTH_FAMILY = "redteam_ground_truth"
GROUND_TRUTH_TYPE = "redteam_activity"
GROUND_TRUTH_RESULT = "confirmed_redteam"
GROUND_TRUTH_SOURCE = "redteam"
GROUND_TRUTH_MARKERS = [
    "redteam_ground_truth",
    "confirmed_redteam",
    "redteam.txt.gz",
    "redteam_activity",
]
MARKED_COLUMNS = ["event_family", "event_result", "source_file", "edge_type"]
WITHHELD = "ground_truth_edge_type_withheld"


def leaks_label() -> Column:
    """True for an edge that reveals ground truth through its label or a descriptive column."""
    # Each test alone decides. Null-safe equality counts null as no match and reaches the scan.
    return (
        F.col("label").eqNullSafe(1)
        | F.col("event_family").eqNullSafe(GROUND_TRUTH_FAMILY)
        | F.col("event_type").eqNullSafe(GROUND_TRUTH_TYPE)
        | F.col("event_result").eqNullSafe(GROUND_TRUTH_RESULT)
        | F.coalesce(F.startswith("edge_type", F.lit(GROUND_TRUTH_FAMILY)), F.lit(False))
        | F.coalesce(F.contains(F.lower("source_file"), F.lit(GROUND_TRUTH_SOURCE)), F.lit(False))
    )


def safe_edges(edges: DataFrame) -> DataFrame:
    """Edges that carry no ground truth: the input of every feature for models."""
    require_columns(
        edges,
        ["label", "event_family", "event_type", "edge_type", "event_result", "source_file"],
        "edges",
    )
    return edges.filter(~leaks_label())


def require_no_leak(edges: DataFrame) -> DataFrame:
    require_no_rows(edges.filter(leaks_label()), "ground truth remains in the edges")
    return edges


def ground_truth_mask(df: DataFrame) -> Column:
    """Marker search of the temporal path; it does not read ``label``, and skips absent columns."""
    out = F.lit(False)
    for name in MARKED_COLUMNS:
        if name in df.columns:
            out = out | contains_any(name, GROUND_TRUTH_MARKERS)
    return out


def split_ordinary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary rows, ground-truth rows)"""
    mask = ground_truth_mask(df)
    return df.filter(~mask), df.filter(mask)


def ground_truth_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(to_long_or("label", 0) == 1)


def withheld_edge_type() -> Column:
    """Edge type as a model may see it: ground-truth rows share one neutral value."""
    return F.when(F.col("event_family") == GROUND_TRUTH_FAMILY, F.lit(WITHHELD)).otherwise(
        F.col("edge_type")
    )


def without_self_loops(pairs: DataFrame, source: str = "source_node_id", destination: str = "destination_node_id") -> DataFrame:
    return pairs.filter(F.col(source) != F.col(destination))
