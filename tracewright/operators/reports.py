"""Metric documents and the tables that compare models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright.functions.columns import first_json_number, interval_text, metric_text
from tracewright.operators import evaluation

# Where the two document layouts keep each metric.
RATE_PATHS = {
    name: [name, f"default_threshold_metrics.test_{name}"]
    for name in ("accuracy", "precision", "recall", "f1")
}
RANK_PATHS = {
    name: [name, f"threshold_independent_metrics.test_{name}"] for name in ("roc_auc", "pr_auc")
}
COUNT_PATHS = {
    name: [name, f"default_threshold_metrics.test_{name}"]
    for name in ("true_positive", "false_positive", "true_negative", "false_negative")
}
COMPARED = {**RATE_PATHS, **RANK_PATHS, **COUNT_PATHS}


def metric_document(
    predictions: DataFrame, model: str, threshold: float = 0.5, best_epoch: int | None = None
) -> DataFrame:
    """One nested row of sizes, metrics and the confusion matrix of scored rows."""
    rates = evaluation.classification(predictions, threshold)
    ranks = evaluation.ranking_metrics(predictions)
    sizes = predictions.agg(
        F.count("*").alias("test_rows"), F.count_if(F.col("label") == 1).alias("test_positive_rows")
    )
    matrix = F.array(
        F.array("true_negative", "false_positive"), F.array("false_negative", "true_positive")
    )
    return rates.select(
        F.lit(model).alias("model_key"), F.lit(float(threshold)).alias("threshold"),
        F.lit(best_epoch).cast("int").alias("best_epoch"),
        sizes.select("test_rows").scalar().alias("test_rows"),
        sizes.select("test_positive_rows").scalar().alias("test_positive_rows"),
        F.struct(*[F.col(c).alias(f"test_{c}") for c in [*RATE_PATHS, *COUNT_PATHS]])
        .alias("default_threshold_metrics"),
        F.struct(
            ranks.select("roc_auc").scalar().alias("test_roc_auc"),
            ranks.select("average_precision").scalar().alias("test_pr_auc"),
        ).alias("threshold_independent_metrics"),
        matrix.alias("confusion_matrix"),
    )


def calibration_document(scored: DataFrame, model: str, bins: int = 10) -> DataFrame:
    table = evaluation.calibration_bins(scored, bins)
    summary = evaluation.probability_summary(scored)
    sizes = scored.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"))
    listed = table.agg(F.sort_array(F.collect_list(F.struct(*table.columns))).alias("b"))
    return summary.select(
        F.lit(model).alias("model_key"), sizes.select("n").scalar().alias("test_rows"),
        sizes.select("p").scalar().alias("test_positive_rows"),
        (sizes.select("n").scalar() - sizes.select("p").scalar()).alias("test_negative_rows"),
        F.struct(
            evaluation.brier_score(scored).scalar().alias("brier_score"),
            evaluation.expected_calibration_error(table).scalar().alias("expected_calibration_error"),
            F.lit(bins).alias("n_bins"), F.lit("uniform").alias("strategy"),
        ).alias("calibration"),
        F.struct(*summary.columns).alias("probability_summary"),
        listed.scalar().alias("bins"),
    )


def comparison_rows(documents: DataFrame) -> DataFrame:
    """One row per model from (model_key, document) JSON texts of either layout."""
    kept = [c for c in ("model_key", "display_name", "model_family", "path") if c in documents.columns]
    return documents.select(
        *kept, *[first_json_number("document", paths).alias(name) for name, paths in COMPARED.items()]
    ).orderBy("model_key")


def best_model(rows: DataFrame, metric: str) -> DataFrame:
    """Row with the highest metric; models without it are ignored, the first key wins a tie."""
    return rows.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), "model_key").limit(1)


def comparison_table(rows: DataFrame) -> DataFrame:
    """Metrics as the text a report prints."""
    names = [*RATE_PATHS, *RANK_PATHS]
    return rows.select("model_key", *[metric_text(c).alias(c) for c in names])


def seed_stability_table(summary: DataFrame) -> DataFrame:
    return summary.select(
        "metric", metric_text("mean").alias("mean"), metric_text("std").alias("std"),
        metric_text("min").alias("min"), metric_text("max").alias("max"),
        interval_text("ci95_lower", "ci95_upper").alias("ci95"),
    )
