"""Queries that go through files: derived tables are written as logs, CSV or JSON and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.operators import components, monitoring, profile, reports
from tracewright.plans.features_and_splits import flow_table
from tracewright.plans.learning import _documents
from tracewright.plans.metrics import rounded
from tracewright.plans.profiles import _WEAK, _component_sql, _degrees, _graph, _summary_of
from tracewright.plans.reference_sql import sql
from tracewright.plans.registry import query
from tracewright.operators.features import normalized_columns
from tracewright.schemas import raw_columns
from tracewright.session import app_dir, materialize
from tracewright.sources import raw_logs, tables, testbed


def _folder(spark, label: str) -> str:
    return f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _register_landing(kind: str) -> None:
    listed = ", ".join(f'"{c}"' for c in raw_columns(kind))

    @query(f"land_files_{kind}", sql(f"""
SELECT {listed}, '{raw_logs.FAMILIES[kind]}' AS event_family, CAST(0 AS BIGINT) AS misnumbered FROM raw_{kind}"""))
    def land(spark, sf_dir):
        """Compressed log files landed whole; ``misnumbered`` counts numbers that are not 0..n-1 in the row's file."""
        folder = _folder(spark, f"logs-{kind}")
        testbed.landed(spark, sf_dir, kind).select(raw_columns(kind)).write.option(
            "compression", "gzip").csv(folder)
        rows = materialize(raw_logs.land(spark, f"{folder}/*.csv.gz", kind), "landed")
        per_file = rows.groupBy("source_file").agg(
            (F.max("row_number") + 1 - F.count("*") + F.count("*") - F.countDistinct("row_number")).alias("misnumbered"),
        )
        return rows.join(per_file, "source_file").select(*raw_columns(kind), "event_family", "misnumbered")


for _kind in ("auth", "dns", "flows", "proc", "redteam"):
    _register_landing(_kind)


@query("land_first_rows", sql("""
SELECT row_number() OVER (ORDER BY row_number) - 1 AS row_number, "timestamp", source_host, resolved_host
FROM raw_dns QUALIFY row_number() OVER (ORDER BY row_number) <= 100"""))
def land_first_rows(spark, sf_dir):
    """One log file landed with a row limit, which keeps its first rows."""
    folder = _folder(spark, "limited")
    testbed.landed(spark, sf_dir, "dns").orderBy("row_number").coalesce(1).select(raw_columns("dns")).write.csv(folder)
    return raw_logs.land(spark, folder, "dns", max_rows=100).select("row_number", "timestamp", "source_host", "resolved_host")


@query("landing_manifest", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{f}' AS event_family, count(*) AS row_count, CAST({n} AS INTEGER) AS column_count FROM raw_{k}"
    for k, f, n in (("auth", "authentication", 12), ("dns", "dns", 6), ("flows", "network_flow", 12),
                    ("proc", "process", 8), ("redteam", "redteam_ground_truth", 7)))))
def landing_manifest(spark, sf_dir):
    folder = _folder(spark, "landing")
    kinds = list(raw_logs.FAMILIES)
    for kind in kinds:
        testbed.landed(spark, sf_dir, kind).select(raw_columns(kind)).write.csv(f"{folder}/{kind}")
    out = raw_logs.land_all(spark, folder, f"{folder}/bronze", {k: k for k in kinds})
    return out.select("kind", "event_family", "row_count", "column_count")


@query("flow_csv_files", """
SELECT CASE WHEN l_returnflag = 'N' THEN 'benign' WHEN l_returnflag = 'A' THEN 'DDoS' ELSE 'PortScan' END AS label,
       count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS protocol_sum, count(*) AS without_extra
FROM lineitem GROUP BY 1""")
def flow_csv_files(spark, sf_dir):
    """Two groups of files with different headers, united by column name."""
    folder = _folder(spark, "flows")
    flows = flow_table(spark, sf_dir).drop(" Unused")
    early = F.col("` Protocol`") <= 3
    flows.filter(early).write.option("header", True).csv(f"{folder}/early.csv")
    flows.filter(~early).withColumn("Extra", F.lit(None).cast("string")).write.option("header", True).csv(
        f"{folder}/late.csv")
    table = normalized_columns(tables.read_flow_csvs(spark, tables.csv_files(spark, folder)))
    return table.groupBy(F.trim("label").alias("label")).agg(
        F.count("*").alias("rows"), F.sum(F.col("protocol").cast("bigint")).alias("protocol_sum"),
        F.count_if(F.col("extra").isNull()).alias("without_extra"),
    )


@query("comparison_from_files", sql("""
SELECT model_key, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc FROM family_metrics"""))
def comparison_from_files(spark, sf_dir):
    """Metric documents written as one JSON file per model and read back with their path."""
    folder = _folder(spark, "documents")
    _documents(spark, sf_dir).select("document", "model_key").write.partitionBy("model_key").text(folder)
    good, _ = tables.read_documents(spark, [f"{folder}/*/*.txt"])
    keyed = good.withColumn("model_key", F.regexp_extract("path", "model_key=([^/]+)/", 1))
    return rounded(reports.comparison_rows(keyed).select("model_key", "accuracy", "f1", "pr_auc"))


@query("partitioned_event_table", sql("""
SELECT event_family, count(*) AS rows FROM unified WHERE event_family IN ('dns', 'process') GROUP BY 1"""))
def partitioned_event_table(spark, sf_dir):
    """Events written by family; the filter prunes partitions."""
    path = tables.zone_path(_folder(spark, "lake"), "silver", "events")
    tables.write_table(testbed.events(spark, sf_dir), path, ["event_family"])
    table = tables.read_table(spark, path, ["event_id", "event_family"])
    return table.filter(F.col("event_family").isin("dns", "process")).groupBy(
        F.col("event_family").cast("string").alias("event_family")).agg(F.count("*").alias("rows"))


@query("run_records", sql("""
SELECT run, metric, value FROM (UNPIVOT (
  SELECT event_family AS run, CAST(count(*) AS DOUBLE) AS rows FROM scored GROUP BY 1) ON rows INTO NAME metric VALUE value)"""))
def run_records(spark, sf_dir):
    root = _folder(spark, "runs")
    runs = testbed.edges(spark, sf_dir).groupBy("event_family").agg(F.count("*").alias("rows"))
    monitoring.append_run_rows(monitoring.scalar_metrics(runs, "event_family"), root)
    return spark.read.parquet(f"{root}/metadata/runs")


@query("weak_component_summary", _component_sql(_WEAK, _summary_of("weak")))
def weak_component_summary(spark, sf_dir):
    found = components.weak_components(*_graph(spark, sf_dir))
    return rounded(components.component_summary(found, "weak"))


@query("graph_key_values", sql("""
SELECT metric, value FROM (UNPIVOT (
  SELECT (SELECT count(*) FROM enriched) AS node_rows, (SELECT count(DISTINCT node_id) FROM enriched) AS unique_node_ids,
         count(*) AS edge_rows, count(DISTINCT edge_id) AS unique_edge_ids,
         count(*) FILTER (WHERE known) AS valid_edge_rows, count(*) FILTER (WHERE NOT known) AS invalid_edge_rows
  FROM (SELECT edge_id, source_node_id IN (SELECT node_id FROM enriched)
               AND destination_node_id IN (SELECT node_id FROM enriched) AS known FROM edge_table))
  ON node_rows, unique_node_ids, edge_rows, unique_edge_ids, valid_edge_rows, invalid_edge_rows
  INTO NAME metric VALUE value)"""))
def graph_key_values(spark, sf_dir):
    return profile.key_value_table(profile.basic_profile(*_graph(spark, sf_dir)))


@query("approximate_degree_summary")
def approximate_degree_summary(spark, sf_dir):
    return profile.approximate_summary(_degrees(spark, sf_dir), profile.DEGREES)
