"""Drift, integrity, manifests, lineage and run records."""

from __future__ import annotations

import platform
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, MapType, NumericType, StringType, StructType,
)

from tracewright.operators.ordered import CHUNK, POSITION, chunked
from tracewright.operators.profile import count_tables
from tracewright.schemas import TableCheckError, require_rows
from tracewright.session import materialize

# Our own choice of tests and limits: the compared definition names none.
DISTANCE_LIMIT = 0.1
SHARE_LIMIT = 0.5
PSI_BINS = 10
NOT_MONITORED = ("timestamp", "label")


def monitored(df: DataFrame, skip: tuple[str, ...] = NOT_MONITORED) -> DataFrame:
    return df.drop(*skip)


def _kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BooleanType))]
    return numeric, texts


def _long_counts(sides: list[DataFrame], columns: list[str], kind: str) -> DataFrame:
    """(field, value, ref, cur): equal values are counted before anything is ordered."""
    parts = None
    for place, side in enumerate(sides):
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("field"), F.col(c).cast(kind).alias("value")) for c in columns
        ]))
        part = side.select(cells.alias("e")).select("e.*", F.lit(place).alias("side"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.filter("value is not null").groupBy("field", "value").agg(
        F.count_if(F.col("side") == 0).alias("ref"), F.count_if(F.col("side") == 1).alias("cur")
    )


def numeric_drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: Kolmogorov-Smirnov distance, Wasserstein distance over the reference's
    standard deviation, and PSI on ten even bins of the reference range."""
    counts = _long_counts([reference, current], columns, "double")
    cut = chunked(counts, ["field", "value"])
    totals = cut.groupBy("field").agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    heads = cut.groupBy("field", CHUNK).agg(
        F.sum("ref").alias("r"), F.sum("cur").alias("c"), F.min("value").alias("head")
    )
    chain = W.partitionBy("field").orderBy(CHUNK)
    before = chain.rowsBetween(W.unboundedPreceding, -1)
    # One row per chunk and column name.
    carry = heads.select(
        "field", CHUNK, F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
        F.lead("head").over(chain).alias("next_head"),
    )
    inner = W.partitionBy(CHUNK, "field").orderBy(POSITION)
    run = inner.rowsBetween(W.unboundedPreceding, 0)
    points = (
        cut.join(F.broadcast(carry), ["field", CHUNK]).join(F.broadcast(totals), "field")
        .select(
            "field",
            ((F.col("r0") + F.sum("ref").over(run)) / F.col("n_ref")).alias("f_ref"),
            ((F.col("c0") + F.sum("cur").over(run)) / F.col("n_cur")).alias("f_cur"),
            (F.coalesce(F.lead("value").over(inner), "next_head") - F.col("value")).alias("width"),
        )
    )
    gap = F.abs(F.col("f_ref") - F.col("f_cur"))
    distances = points.groupBy("field").agg(
        F.max(gap).alias("ks_distance"), F.coalesce(F.sum(gap * F.col("width")), F.lit(0.0)).alias("area")
    )
    # The deviation takes a second pass around the mean: squares of values far from zero would lose it.
    ends = cut.filter("ref > 0").groupBy("field").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        (F.sum(F.col("ref") * F.col("value")) / F.sum("ref")).alias("mean"),
    )
    off = F.col("value") - F.col("mean")
    deviation = cut.filter("ref > 0").join(F.broadcast(ends), "field").groupBy("field").agg(
        F.sqrt(F.sum(F.col("ref") * off * off) / F.sum("ref")).alias("std")
    )
    spread = ends.join(deviation, "field").drop("mean")
    place = F.least(F.greatest(
        F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * PSI_BINS),
        F.lit(0)), F.lit(PSI_BINS - 1))
    bins = (
        cut.join(F.broadcast(spread), "field").join(F.broadcast(totals), "field")
        .groupBy("field", F.coalesce(place, F.lit(0)).alias("bin"), "n_ref", "n_cur")
        .agg(F.sum("ref").alias("r"), F.sum("cur").alias("c"))
    )
    small = F.lit(1e-4)
    p, q = F.greatest(F.col("r") / F.col("n_ref"), small), F.greatest(F.col("c") / F.col("n_cur"), small)
    psi = bins.groupBy("field").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return (
        distances.join(spread, "field").join(psi, "field")
        .select(
            "field", "ks_distance",
            (F.col("area") / F.greatest("std", F.lit(0.001))).alias("wasserstein"), "psi",
        )
    )


def categorical_drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: Jensen-Shannon distance (base 2) and the chi-square statistic."""
    counts = materialize(_long_counts([reference, current], columns, "string"), "categories")
    totals = counts.groupBy("field").agg(
        F.sum("ref").cast("double").alias("n_ref"), F.sum("cur").cast("double").alias("n_cur")
    )
    rows = counts.join(F.broadcast(totals), "field")
    p, q = F.col("ref") / F.col("n_ref"), F.col("cur") / F.col("n_cur")
    m = (p + q) / 2

    def part(x):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    share = (F.col("ref") + F.col("cur")) / (F.col("n_ref") + F.col("n_cur"))
    chi = (
        F.pow(F.col("ref") - share * F.col("n_ref"), 2) / (share * F.col("n_ref"))
        + F.pow(F.col("cur") - share * F.col("n_cur"), 2) / (share * F.col("n_cur"))
    )
    return rows.groupBy("field").agg(
        F.sqrt(F.greatest((F.sum(part(p)) + F.sum(part(q))) / 2, F.lit(0.0))).alias("jensen_shannon"),
        F.sum(chi).alias("chi_square"),
    )


def drift_report(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row per monitored column: test, statistic, drifted or not."""
    require_rows(reference, "reference")
    require_rows(current, "current")
    numeric, texts = _kinds(monitored(reference))
    parts = []
    if numeric:
        parts.append(numeric_drift(reference, current, numeric).select(
            "field", F.lit("wasserstein").alias("test"), F.col("wasserstein").alias("statistic")
        ))
    if texts:
        parts.append(categorical_drift(reference, current, texts).select(
            "field", F.lit("jensen_shannon").alias("test"), F.col("jensen_shannon").alias("statistic")
        ))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("drifted", F.col("statistic") >= DISTANCE_LIMIT)


def drift_summary(report: DataFrame) -> DataFrame:
    share = F.count_if("drifted") / F.count("*")
    return report.agg(
        F.count("*").alias("columns"), F.count_if("drifted").alias("drifted_columns"),
        share.alias("drifted_share"), (share >= SHARE_LIMIT).alias("dataset_drift"),
    )


# ---------------------------------------------------------------- integrity


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of small artifact files (models, configs, documents) under ``path``."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a sum of row hashes: equal for equal tables in any order or layout."""
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"),
    )


def changed_hashes(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded (path, sha256) that are not among the actual ones: changed and missing files."""
    return recorded.join(actual.select("path", "sha256"), ["path", "sha256"], "left_anti")


def require_recorded_hash(recorded: DataFrame, actual: DataFrame) -> None:
    """Every recorded (path, sha256) must be among the actual ones."""
    bad = changed_hashes(recorded, actual).limit(5).collect()
    if bad:
        raise TableCheckError(f"hash differs for {[r['path'] for r in bad]}")


# ---------------------------------------------------------------- manifests and lineage


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def table_manifest(tables: dict[str, DataFrame], count_by: list[str], paths: dict[str, str] | None = None) -> DataFrame:
    """One nested row: per table its rows, columns, counts and path."""
    spark = next(iter(tables.values())).sparkSession
    parts = None
    for name, df in tables.items():
        fields = [c for c in count_by if c in df.columns]
        found = count_tables(df, fields) if fields else None
        row = df.agg(F.count("*").alias("rows"))
        counts = (
            found.agg(F.sort_array(F.collect_list(F.struct("field", "value", "count"))).alias("c")).scalar()
            if fields else F.lit(None).cast("array<struct<field:string,value:string,count:bigint>>")
        )
        part = row.select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"),
            F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
            F.lit((paths or {}).get(name)).cast("string").alias("path"), counts.alias("counts"),
        )
        parts = part if parts is None else parts.unionByName(part)
    listed = parts.agg(F.sort_array(F.collect_list(F.struct(*parts.columns))).alias("tables"))
    return spark.range(1).select(
        F.lit(len(tables)).alias("table_count"), listed.scalar().alias("tables"),
        F.lit(_now()).alias("generated_at"),
    )


def lineage_manifest(
    training: DataFrame, model: dict, configs: dict[str, str], metrics: dict[str, float],
    feature_store: dict, entrypoint: str, command: str, data_path: str, version: str | None = None,
) -> DataFrame:
    """One nested row that ties a model to its data, settings and results."""
    spark = training.sparkSession
    mark = table_fingerprint(training)

    def text_map(values: dict) -> object:
        pairs = [F.lit(x) for k, v in values.items() for x in (k, None if v is None else str(v))]
        return F.create_map(*pairs) if pairs else F.create_map()

    numbers = [F.lit(x) for k, v in metrics.items() for x in (k, float(v))]
    return spark.range(1).select(
        F.lit("0.1").alias("lineage_manifest_version"), F.lit(_now()).alias("created_at"),
        text_map(model).alias("model"),
        F.struct(
            F.lit(data_path).alias("data_path"), F.lit(version).cast("string").alias("data_version"),
            mark.select("rows").scalar().alias("row_count"),
            mark.select("fingerprint").scalar().alias("fingerprint"),
            F.lit(len(training.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in training.columns]).alias("columns"),
        ).alias("training_data"),
        text_map(configs).alias("configs"), F.create_map(*numbers).alias("metrics"),
        text_map(feature_store).alias("feature_store"),
        F.struct(
            F.lit(platform.python_version()).alias("python_version"),
            F.lit(spark.version).alias("spark_version"),
            F.lit(entrypoint).alias("training_entrypoint"), F.lit(command).alias("training_command"),
        ).alias("reproducibility"),
    )


def latest_version(records: DataFrame, path: str) -> DataFrame:
    """Last recorded (path, hash, size) of a data path."""
    return records.filter(F.col("path") == path).orderBy(F.desc("recorded_at"), "hash").limit(1)


def scalar_metrics(metrics: DataFrame, run: str) -> DataFrame:
    """(run, metric, value) from the numeric, non-boolean columns of a metrics row."""
    names = [f.name for f in metrics.schema.fields if isinstance(f.dataType, NumericType) and f.name != run]
    cast = metrics.select(F.col(run).cast("string").alias("run"), *[F.col(c).cast("double").alias(c) for c in names])
    return cast.unpivot(["run"], names, "metric", "value").filter("value is not null")


def append_run_rows(rows: DataFrame, root: str) -> None:
    """Parameters or per-epoch values of a run, appended to ``metadata/runs``."""
    rows.write.mode("append").parquet(f"{root.rstrip('/')}/metadata/runs")


def _json_safe(ref, kind):
    """``ref`` with null for NaN and infinities at every depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(ref) & (F.abs(ref) < F.lit(float("inf"))), ref)
    if isinstance(kind, ArrayType):
        return F.transform(ref, lambda x: _json_safe(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(ref, lambda _, x: _json_safe(x, kind.valueType))
    if isinstance(kind, StructType):
        inner = F.struct(*[_json_safe(ref[g.name], g.dataType).alias(g.name) for g in kind.fields])
        return F.when(ref.isNotNull(), inner)
    return ref


def json_safe(df: DataFrame) -> DataFrame:
    """One JSON text per row, with NaN and infinities turned to null in fields, arrays, maps and structs."""
    columns = [_json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document"))
