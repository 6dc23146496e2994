"""Raw logs of five kinds to one event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.columns import UNKNOWN, event_id, long_or, norm, to_double_or
from tracewright.schemas import EVENT_COLUMNS, FAMILIES, raw_columns, require_columns

# Fixed value: event ids of the public log set start with it.
PREFIX = "lanl"
MISSING_TIME = -1


def _common(
    df: DataFrame,
    kind: str,
    event_type: Column,
    source: tuple[str, str],
    destination: tuple[str, str],
    result: Column,
    label: int,
    prefix: str,
    id_part: str | None = None,
) -> list[Column]:
    family = FAMILIES[kind]
    return [
        event_id(prefix, id_part or family, "row_number").alias("event_id"),
        long_or(df, "timestamp", MISSING_TIME).alias("timestamp"),
        F.lit(family).alias("event_family"),
        event_type.alias("event_type"),
        norm(source[0]).alias("source_entity"),
        norm(destination[0]).alias("destination_entity"),
        F.lit(source[1]).alias("source_entity_type"),
        F.lit(destination[1]).alias("destination_entity_type"),
        result.alias("event_result"),
        F.lit(label).cast("bigint").alias("label"),
        norm("source_file").alias("source_file"),
        long_or(df, "row_number", -1).alias("row_number"),
    ]


def _texts(*names: str) -> list[Column]:
    return [norm(name).alias(name) for name in names]


def _checked(df: DataFrame, kind: str) -> DataFrame:
    return require_columns(df, ["row_number", *raw_columns(kind), "source_file"], f"raw {kind}")


def authentication(df: DataFrame, label: int = 0, prefix: str = PREFIX) -> DataFrame:
    return _checked(df, "auth").select(
        *_common(
            df, "auth", F.concat(F.lit("auth_"), F.lower(norm("auth_orientation"))),
            ("source_user", "user"), ("destination_host", "host"),
            F.lower(norm("result")), label, prefix,
        ),
        *_texts("source_user", "destination_user", "source_host", "destination_host"),
    )


def dns(df: DataFrame, label: int = 0, prefix: str = PREFIX) -> DataFrame:
    return _checked(df, "dns").select(
        *_common(
            df, "dns", F.lit("dns_resolution"), ("source_host", "host"),
            ("resolved_host", "host_or_domain"), F.lit(UNKNOWN), label, prefix,
        ),
        *_texts("source_host", "resolved_host"),
    )


def network_flow(df: DataFrame, label: int = 0, prefix: str = PREFIX) -> DataFrame:
    measures = ["duration", "packet_count", "byte_count"]
    return _checked(df, "flows").select(
        *_common(
            df, "flows", F.lit("network_flow"), ("source_host", "host"),
            ("destination_host", "host"), F.lit("observed"), label, prefix,
        ),
        *_texts("source_host", "destination_host", "source_port", "destination_port", "protocol"),
        *[to_double_or(m).alias(m) for m in measures],
    )


def process(df: DataFrame, label: int = 0, prefix: str = PREFIX) -> DataFrame:
    action = F.lower(norm("process_event"))
    return _checked(df, "proc").select(
        *_common(
            df, "proc", F.concat(F.lit("process_"), action), ("source_user", "user"),
            ("process_name", "process"), action, label, prefix,
        ),
        *_texts("source_user", "host", "process_name", "process_event"),
    )


def ground_truth(df: DataFrame, label: int = 1, prefix: str = PREFIX) -> DataFrame:
    return _checked(df, "redteam").select(
        *_common(
            df, "redteam", F.lit("redteam_activity"), ("source_user", "user"),
            ("destination_host", "host"), F.lit("confirmed_redteam"), label, prefix,
            id_part="redteam",
        ),
        *_texts("source_user", "source_host", "destination_host"),
    )


NORMALIZERS = {
    "auth": authentication,
    "dns": dns,
    "flows": network_flow,
    "proc": process,
    "redteam": ground_truth,
}

TOTAL_ORDER = ["timestamp", "event_family", "event_id"]


def unify(raw: dict[str, DataFrame]) -> DataFrame:
    """One plan over all given kinds: normalise, keep the 12 common columns, union."""
    parts = [NORMALIZERS[kind](df).select(*EVENT_COLUMNS) for kind, df in raw.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_total_order(events: DataFrame) -> DataFrame:
    """Globally sorted by range partitions; a parquet write keeps the order in file names."""
    return events.orderBy(*TOTAL_ORDER)
