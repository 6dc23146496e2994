"""Landing of headerless raw log files."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tracewright.functions.columns import missing_to_null
from tracewright.operators.joins import lookup
from tracewright.schemas import FAMILIES, TableCheckError, raw_columns, raw_schema
from tracewright.session import materialize

def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def path_bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All-text columns by position; the usual words for a missing value become null.

    A line of any file with another number of columns stops a job that reads all columns.
    """
    rows = spark.read.schema(raw_schema(kind)).csv(path, header=False, mode="FAILFAST")
    return rows.withColumns({c: missing_to_null(c) for c in rows.columns})


def preview(spark: SparkSession, path: str, kind: str, rows: int = 10) -> DataFrame:
    return read_raw(spark, path, kind).limit(rows)


def _scanned(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The files' rows written once, each with its file, its block there and its order in the task.

    Everything after reads the written rows, so a scan that is cut differently the next time
    can't separate them from their blocks' numbers.
    """
    marked = read_raw(spark, path, kind).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_serial"),
    )
    try:
        rows = materialize(marked, "scanned")
    except Exception as e:
        if "MALFORMED_RECORD" not in str(e):
            raise
        raise TableCheckError(f"a line of {path} has not the {len(raw_columns(kind))} columns of {kind}") from e
    if rows.isEmpty():
        raise TableCheckError(f"{path} is empty")
    return rows


def with_row_numbers(scanned: DataFrame) -> DataFrame:
    """0-based row number in file order of written rows.

    Blocks are numbered through by one small count per block, so a large uncompressed file
    is read in parallel and no row is moved to be numbered. A compressed file is one block.
    """
    blocks = scanned.groupBy("_file", "_block").agg(
        F.min("_serial").alias("_first"), F.count("*").alias("_n")
    )
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    ), "blocks")
    # Left, so that a row without its block would show as a missing number instead of going.
    placed = lookup(scanned, offsets, ["_file", "_block"], ["_serial"], "left")
    number = F.col("_start") + F.col("_serial") - F.col("_first")
    lost = F.raise_error(F.lit("a row has lost its block")).cast("bigint")
    return placed.withColumn("row_number", F.coalesce(number, lost))


def land(
    spark: SparkSession, path: str, kind: str, max_rows: int | None = None,
    add_row_number: bool = True, add_source_file: bool = True, add_family: bool = True,
) -> DataFrame:
    """Raw rows plus metadata columns; all rows, or the first ``max_rows`` of each file."""
    if max_rows is not None and (isinstance(max_rows, bool) or not isinstance(max_rows, int) or max_rows <= 0):
        raise ValueError("max_rows must be a positive integer or None")
    rows = with_row_numbers(_scanned(spark, path, kind))
    if max_rows is not None:
        rows = rows.filter(F.col("row_number") < max_rows)
    out = list(raw_columns(kind))
    if add_row_number:
        out.insert(0, "row_number")
    columns = [F.col(c) for c in out]
    if add_source_file:
        columns.append(F.element_at(F.split("_file", "/"), -1).alias("source_file"))
    if add_family:
        columns.append(F.lit(FAMILIES[kind]).alias("event_family"))
    return rows.select(*columns)


@dataclass(frozen=True)
class LandingStep:
    kind: str
    source: str
    target: str


def landing_plan(spark: SparkSession, source_dir: str, target_dir: str, files: dict[str, str]) -> list[LandingStep]:
    """One step per configured kind; every source must exist before any work starts."""
    steps = [
        LandingStep(kind, f"{source_dir}/{name}", f"{target_dir}/raw_{kind}")
        for kind, name in files.items()
    ]
    for step in steps:
        raw_columns(step.kind)
    missing = [s.source for s in steps if not path_exists(spark, s.source)]
    if missing:
        raise FileNotFoundError(f"raw files not found: {missing}")
    return steps


def land_all(
    spark: SparkSession, source_dir: str, target_dir: str, files: dict[str, str],
    max_rows: int | None = None,
) -> DataFrame:
    """Write one parquet table per kind and return the manifest, one row per file."""
    entries = []
    for step in landing_plan(spark, source_dir, target_dir, files):
        land(spark, step.source, step.kind, max_rows).write.mode("overwrite").parquet(step.target)
        written = spark.read.parquet(step.target)
        entries.append((
            step.kind, FAMILIES[step.kind], step.source, step.target, written.count(),
            len(written.columns), path_bytes(spark, step.source), path_bytes(spark, step.target),
            datetime.now(timezone.utc).isoformat(),
        ))
    return spark.createDataFrame(
        entries,
        "kind string, event_family string, source string, target string, row_count bigint, "
        "column_count int, input_bytes bigint, output_bytes bigint, generated_at string",
    )
