"""Readers and writers for tables, flow files and metric documents."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewright.schemas import TableCheckError, require_columns
from tracewright.sources.raw_logs import path_exists

ZONES = ("bronze", "silver", "gold", "metadata", "artifacts")


def zone_path(root: str, zone: str, *parts: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}")
    return "/".join([root.rstrip("/"), zone, *parts])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, name: str = "table") -> DataFrame:
    return require_columns(spark.read.parquet(path), columns or [], name)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One file with a fixed column order, for result tables of a few rows."""
    require_columns(df, columns, "report").select(*columns).coalesce(1).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def write_document(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row nested table as a JSON document."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files of a folder in name order."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.csv")
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.globStatus(glob) or [])
    if not found:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return found


def _folders(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths``, or of what their patterns match, that are folders."""
    found = []
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [s.getPath().toString() for s in fs.globStatus(target) or [] if s.isDirectory()]
    return found


def _bare(path: str) -> str:
    """The path without its slashes after the scheme, which may be written as one or as three."""
    return re.sub(r"^(\w+:)/+", r"\1/", path)


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Paths by header line, in one pass; every path, a file or a folder of parts, must have a row behind its headers.

    A part of a folder may be a header alone: Spark writes one for an empty first partition.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("at"),
    )
    first = F.min_by("value", F.struct("block", "at"))
    found = lines.groupBy("path").agg(first.alias("header"), F.count("*").alias("lines")).orderBy("path").collect()
    folders, rows = _folders(spark, paths), {}
    groups: dict[str, list[str]] = {}
    for r in found:  # one row per file
        file = unquote(r["path"])
        groups.setdefault(r["header"], []).append(file)
        given = next((f for f in folders if _bare(file).startswith(f"{_bare(f)}/")), file)
        rows[given] = rows.get(given, 0) + r["lines"] - 1
    if not rows or min(rows.values()) < 1:
        raise TableCheckError(f"flow files without rows: {sorted(f for f, n in rows.items() if n < 1) or paths}")
    return groups


def read_flow_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Headered CSV files united by trimmed column name; a missing column is null.

    Files with the same header are read together, so a column has one type in all of them.
    """
    if not paths:
        raise TableCheckError("no flow files")
    parts = []
    for group in _headers(spark, paths).values():
        df = spark.read.csv(group, header=True, inferSchema=True)
        named = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns], F.col("_metadata.file_path").alias("source_file"))
        parts.append(named.withColumn("source_file", F.element_at(F.split("source_file", "/"), -1)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_documents(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of whole-file JSON texts with their path; unparsable texts are set aside."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"documents not found: {missing}")
    texts = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")
    )
    valid = F.try_parse_json("document").isNotNull()
    good = texts.filter(valid)
    return good, texts.filter(~valid)


REGISTRATION = StructType([
    StructField(c, StringType()) for c in ("name", "source", "uri", "zone", "format", "description")
])


def register_dataset(spark: SparkSession, root: str, **record: str) -> DataFrame:
    """Append one record to the registered data sets and return it."""
    unknown = set(record) ^ set(REGISTRATION.fieldNames())
    if unknown:
        raise TableCheckError(f"record fields differ: {sorted(unknown)}")
    if record["zone"] not in ZONES:
        raise ValueError(f"unknown zone {record['zone']!r}")
    row = spark.createDataFrame([tuple(record[c] for c in REGISTRATION.fieldNames())], REGISTRATION)
    write_document(row, zone_path(root, "metadata", "manifests"), mode="append")
    return row
