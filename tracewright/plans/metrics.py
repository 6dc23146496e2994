"""Queries on metrics, thresholds and calibration of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.columns import draw
from tracewright.operators import evaluation
from tracewright.plans.reference_sql import cte, sql
from tracewright.plans.registry import query
from tracewright.sources import testbed

# A repeatable score for every edge that leans towards its label.
cte("scored", """
SELECT edge_id, label, event_family,
       (CAST('0x' || substr(md5('score|' || edge_id), 1, 12) AS BIGINT) % 1000 + 250 * label)
         / CAST(1250 AS DOUBLE) AS score
FROM edge_table
""")

cte("score_groups", """
SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
FROM scored GROUP BY score
""")

cte("score_runs", """
SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
       CAST(sum(pos) OVER () AS DOUBLE) AS positives, CAST(sum(neg) OVER () AS DOUBLE) AS negatives
FROM score_groups WINDOW w AS (ORDER BY score DESC)
""")


def scored(spark, sf_dir):
    return testbed.edges(spark, sf_dir).select(
        "edge_id", "label", "event_family",
        ((draw("score", 1000, "edge_id") + 250 * F.col("label")) / F.lit(1250.0)).alias("score"),
    )


def rounded(df):
    return df.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


RATES = """
round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy,
round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1"""


def _counts(threshold: str) -> str:
    return f"""count(*) FILTER (WHERE label = 1 AND score >= {threshold}) AS tp,
count(*) FILTER (WHERE label = 0 AND score >= {threshold}) AS fp,
count(*) FILTER (WHERE label = 0 AND score < {threshold}) AS tn,
count(*) FILTER (WHERE label = 1 AND score < {threshold}) AS fn"""


NAMED = "tp AS true_positive, fp AS false_positive, tn AS true_negative, fn AS false_negative"


@query("confusion_counts", sql(f"SELECT {NAMED} FROM (SELECT {_counts('0.5')} FROM scored)"))
def confusion_counts(spark, sf_dir):
    return evaluation.confusion(scored(spark, sf_dir), 0.5)


@query("classification_metrics", sql(f"SELECT {NAMED}, {RATES} FROM (SELECT {_counts('0.5')} FROM scored)"))
def classification_metrics(spark, sf_dir):
    return rounded(evaluation.classification(scored(spark, sf_dir)))


@query("document_quality_metrics", f"""
SELECT {NAMED}, {RATES} FROM (
  SELECT {_counts('0.5')} FROM (
    SELECT quality AS label, least(n_chars / CAST(4000 AS DOUBLE), 1) AS score
    FROM labels JOIN documents USING (doc_id)))""")
def document_quality_metrics(spark, sf_dir):
    """Document length as a score for the quality label."""
    rows = testbed.table(spark, sf_dir, "labels").join(
        testbed.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return rounded(evaluation.classification(rows.select(
        F.col("quality").alias("label"), F.least(F.col("n_chars") / F.lit(4000.0), F.lit(1.0)).alias("score")
    )))


@query("ranking_metrics", sql("""
SELECT CAST(max(positives) AS BIGINT) AS positives, CAST(max(negatives) AS BIGINT) AS negatives,
       round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / (max(positives) * max(negatives)), 6) AS roc_auc,
       round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(positives), 6) AS average_precision
FROM score_runs"""))
def ranking_metrics(spark, sf_dir):
    return rounded(evaluation.ranking_metrics(scored(spark, sf_dir), on_single_class="error"))


@query("ranking_metrics_by_family", sql("""
SELECT event_family, CAST(max(positives) AS BIGINT) AS positives, CAST(max(negatives) AS BIGINT) AS negatives,
       CASE WHEN max(positives) > 0 AND max(negatives) > 0 THEN
         round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / (max(positives) * max(negatives)), 6) END AS roc_auc,
       CASE WHEN max(positives) > 0 AND max(negatives) > 0 THEN
         round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(positives), 6) END AS average_precision
FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             CAST(sum(pos) OVER g AS DOUBLE) AS positives, CAST(sum(neg) OVER g AS DOUBLE) AS negatives
      FROM (SELECT event_family, score, count(*) FILTER (WHERE flag) AS pos, count(*) FILTER (WHERE NOT flag) AS neg
            FROM (SELECT event_family, score, CAST('0x' || substr(md5('flag|' || edge_id), 1, 12) AS BIGINT) % 3 = 0 AS flag
                  FROM scored) GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY event_family ORDER BY score DESC), g AS (PARTITION BY event_family))
GROUP BY event_family"""))
def ranking_metrics_by_family(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("label", (draw("flag", 3, "edge_id") == 0).cast("bigint"))
    return rounded(evaluation.ranking_metrics(rows, by=["event_family"]))


@query("curve_points", sql("""
SELECT round(score, 6) AS score, tp, fp, round(fp / negatives, 6) AS false_positive_rate,
       round(tp / positives, 6) AS recall, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision
FROM score_runs"""))
def curve_points(spark, sf_dir):
    return rounded(evaluation.curve_points(scored(spark, sf_dir)))


def _grid(points: list[float]) -> str:
    return ", ".join(f"({t!r}::DOUBLE)" for t in points)


def _sweep_cte(name: str, grid: list[float], source: str) -> None:
    cte(name, f"""
SELECT threshold, {NAMED}, tp + fp AS alert_count, {RATES.replace('round(', '(').replace(', 6)', ')')}
FROM (SELECT t AS threshold, {_counts('t')} FROM {source}, (VALUES {_grid(grid)}) g(t) GROUP BY t)
""")


_sweep_cte("sweep", evaluation.REPORT_GRID, "scored")
_sweep_cte("fine_sweep", evaluation.FINE_GRID, "scored")

SWEPT = """round(threshold, 4) AS threshold, true_positive, false_positive, true_negative, false_negative,
alert_count, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
round(recall, 6) AS recall, round(f1, 6) AS f1"""


@query("threshold_sweep", sql(f"SELECT {SWEPT} FROM sweep"))
def threshold_sweep(spark, sf_dir):
    return rounded(evaluation.threshold_sweep(scored(spark, sf_dir)))


@query("recommended_threshold", sql(f"""
SELECT {SWEPT} FROM sweep ORDER BY sweep.f1 DESC, sweep.recall DESC, sweep.precision DESC, sweep.threshold LIMIT 1"""))
def recommended_threshold(spark, sf_dir):
    sweep = evaluation.threshold_sweep(scored(spark, sf_dir))
    return rounded(evaluation.recommended_threshold(sweep))


@query("validation_threshold", sql("""
SELECT round(threshold, 4) AS threshold FROM fine_sweep ORDER BY f1 DESC, fine_sweep.threshold LIMIT 1"""))
def validation_threshold(spark, sf_dir):
    best = evaluation.best_f1_threshold(scored(spark, sf_dir))
    return spark.range(1).select(F.lit(best).alias("threshold"))


@query("threshold_history", sql(f"""
SELECT run, round(threshold, 4) AS threshold, {NAMED}, tp + fp AS alert_count, {RATES} FROM (
  SELECT event_family AS run, t AS threshold, {_counts('t')}
  FROM scored, (VALUES {_grid([round(t, 4) for t in evaluation.REPORT_GRID])}) g(t) GROUP BY event_family, t)"""))
def threshold_history(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumnRenamed("event_family", "run")
    grid = [round(t, 4) for t in evaluation.REPORT_GRID]
    return rounded(evaluation.threshold_sweep(rows, grid, by=["run"]))


@query("best_round", sql("""
SELECT epoch, round(value, 6) AS value FROM (
  SELECT CAST(to_timestamp(CAST("timestamp" AS BIGINT)) AS DATE) - DATE '2024-01-01' AS epoch, avg(score) AS value
  FROM scored JOIN edge_table USING (edge_id) GROUP BY 1)
ORDER BY value DESC, epoch LIMIT 1"""))
def best_round(spark, sf_dir):
    """Mean score per day stands for a metric per epoch."""
    days = testbed.edges(spark, sf_dir).select(
        "edge_id", F.floor((F.col("timestamp") - 1704067200) / 86400).alias("epoch")
    )
    history = scored(spark, sf_dir).join(days, "edge_id").groupBy("epoch").agg(F.avg("score").alias("value"))
    return rounded(evaluation.best_round(history, "value"))


_EDGES = evaluation.bin_edges(10)
cte("calibration", f"""
SELECT CAST(bin_index AS INTEGER) AS bin_index, lower_bound, upper_bound, count(edge_id) AS sample_count,
       count(edge_id) / CAST((SELECT count(*) FROM scored) AS DOUBLE) AS sample_fraction,
       avg(score) AS mean_predicted_probability, avg(label) AS observed_positive_rate,
       abs(avg(score) - avg(label)) AS absolute_calibration_gap
FROM (VALUES {", ".join(f"({k}, {_EDGES[k]!r}::DOUBLE, {_EDGES[k + 1]!r}::DOUBLE)" for k in range(10))})
     b(bin_index, lower_bound, upper_bound)
LEFT JOIN scored ON score >= lower_bound AND (score < upper_bound OR (bin_index = 9 AND score <= 1))
GROUP BY 1, 2, 3
""")


@query("calibration_bins", sql("""
SELECT bin_index, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound, sample_count,
       round(sample_fraction, 6) AS sample_fraction,
       round(mean_predicted_probability, 6) AS mean_predicted_probability,
       round(observed_positive_rate, 6) AS observed_positive_rate,
       round(absolute_calibration_gap, 6) AS absolute_calibration_gap
FROM calibration"""))
def calibration_bins(spark, sf_dir):
    return rounded(evaluation.calibration_bins(scored(spark, sf_dir)))


@query("expected_calibration_error", sql("""
SELECT round(sum(sample_fraction * absolute_calibration_gap), 6) AS expected_calibration_error FROM calibration"""))
def expected_calibration_error(spark, sf_dir):
    bins = evaluation.calibration_bins(scored(spark, sf_dir))
    return rounded(evaluation.expected_calibration_error(bins))


@query("brier_score", sql("SELECT round(avg((score - label) * (score - label)), 6) AS brier_score FROM scored"))
def brier_score(spark, sf_dir):
    return rounded(evaluation.brier_score(scored(spark, sf_dir)))


@query("probability_summary", sql("""
SELECT round(min(score), 6) AS min_probability, round(max(score), 6) AS max_probability,
       round(avg(score), 6) AS mean_probability, round(quantile_cont(score, 0.5), 6) AS median_probability
FROM scored"""))
def probability_summary(spark, sf_dir):
    return rounded(evaluation.probability_summary(scored(spark, sf_dir)))


@query("run_summary", sql("""
SELECT metric, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(stddev_samp(value) / sqrt(count(value)), 6) AS standard_error,
       round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95_lower,
       round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95_upper
FROM (UNPIVOT (SELECT event_family, avg(score) AS mean_score, CAST(max(score) AS DOUBLE) AS max_score
               FROM scored GROUP BY event_family) ON mean_score, max_score INTO NAME metric VALUE value)
GROUP BY metric"""))
def run_summary(spark, sf_dir):
    """Event families stand for repeated runs."""
    runs = scored(spark, sf_dir).groupBy("event_family").agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("max_score")
    )
    return rounded(evaluation.run_summary(runs, ["mean_score", "max_score"]))
