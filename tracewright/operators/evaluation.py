"""Metrics of scored rows, exact and computed by Spark.

Input everywhere is a DataFrame with a 0/1 ``label`` and a ``score``. Scores are
grouped before anything is ordered, and running totals go by chunks, so neither
the rows nor the distinct scores meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.functions.columns import safe_ratio
from tracewright.operators.ordered import exact_quantiles, running_totals
from tracewright.schemas import TableCheckError

# Threshold grids. The first is 0.05 + k * 0.05, the second 91 even points.
REPORT_GRID = [0.05 + k * 0.05 for k in range(19)]
FINE_GRID = [0.05 + k * ((0.95 - 0.05) / 90) for k in range(90)] + [0.95]


# ---------------------------------------------------------------- confusion and rates


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Counts of the four cells. A row without score or label fits none and stops the job."""
    broken = F.col("score").isNull() | F.col("label").isNull()
    stop = F.raise_error(F.lit("a row lacks its score or label"))
    df = df.withColumn("score", F.when(broken, stop.cast("double")).otherwise(F.col("score")))
    hit = F.col("score") >= F.lit(float(threshold))
    positive = F.col("label") == 1
    counts = {
        "true_positive": positive & hit, "false_positive": ~positive & hit,
        "true_negative": ~positive & ~hit, "false_negative": positive & ~hit,
    }
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp = F.col("true_positive"), F.col("false_positive")
    tn, fn = F.col("true_negative"), F.col("false_negative")
    return counts.withColumns({
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
    })


def classification(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    return with_rates(confusion(df, threshold, by))


# ---------------------------------------------------------------- ranking metrics


def _cumulative(df: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score, best first: class counts and running counts within the group."""
    grouped = df.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    run = running_totals(grouped, [*by, F.col("score").desc()], {"pos": "tp", "neg": "fp"})
    spans = run.groupBy(*by).agg(
        F.min(F.col("tp") - F.col("pos")).alias("tp0"), F.min(F.col("fp") - F.col("neg")).alias("fp0"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )
    if by:
        run = run.join(spans, by)
    else:
        run = run.withColumns({c: spans.select(c).scalar() for c in ("positives", "negatives")})
        run = run.withColumns({"tp0": F.lit(0), "fp0": F.lit(0)})
    return run.withColumns({
        "tp": F.col("tp") - F.col("tp0"), "fp": F.col("fp") - F.col("fp0"),
    }).drop("tp0", "fp0")


def curve_points(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    by = by or []
    return _cumulative(df, by).select(
        *by, "score", "tp", "fp",
        safe_ratio(F.col("fp"), F.col("negatives")).alias("false_positive_rate"),
        safe_ratio(F.col("tp"), F.col("positives")).alias("recall"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def ranking_metrics(
    df: DataFrame, by: list[str] | None = None, on_single_class: str = "null"
) -> DataFrame:
    """Exact ROC-AUC (ties count half) and step-wise average precision.

    With one class only both are null, or NaN, or an error, by ``on_single_class``.
    """
    if on_single_class not in ("null", "nan", "error"):
        raise ValueError(f"unknown policy {on_single_class!r}")
    by = by or []
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    undefined = F.lit(float("nan")) if on_single_class == "nan" else F.lit(None).cast("double")
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    area = F.sum(neg * (tp - pos / 2))
    pairs = F.max("positives").cast("double") * F.max("negatives").cast("double")
    out = _cumulative(df, by).groupBy(*by).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        F.when(both, area / F.nullif(pairs, F.lit(0.0))).otherwise(undefined).alias("roc_auc"),
        F.when(both, F.sum(pos * tp / (tp + fp)) / F.nullif(F.max("positives").cast("double"), F.lit(0.0)))
        .otherwise(undefined).alias("average_precision"),
    )
    if on_single_class == "error" and not out.filter("positives = 0 or negatives = 0").isEmpty():
        raise TableCheckError("ranking metrics need both classes")
    return out


# ---------------------------------------------------------------- thresholds


def _points_reached(score: Column, grid: list[float]) -> Column:
    """How many grid points are at or below the score: a balanced tree of comparisons."""
    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(score >= F.lit(float(grid[mid])), node(mid + 1, hi)).otherwise(node(lo, mid))

    return node(0, len(grid))


def threshold_sweep(df: DataFrame, grid: list[float] = REPORT_GRID, by: list[str] | None = None) -> DataFrame:
    """Metrics at every grid point. Rows are counted once per interval of the grid.

    The window below sees one row per grid interval and group, whatever the data.
    """
    by = by or []
    spark = df.sparkSession
    binned = df.groupBy(*by, _points_reached(F.col("score"), grid).alias("_bin")).agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n")
    )
    points = [
        F.struct(F.lit(k).alias("_bin"), F.lit(t).cast("double").alias("threshold"))
        for k, t in [(0, None), *((k + 1, round(t, 4)) for k, t in enumerate(grid))]
    ]
    groups = binned.select(*by).distinct() if by else spark.range(1)
    spine = groups.select(*by, F.explode(F.array(*points)).alias("p")).select(*by, "p.*")
    joined = spine.join(binned, [*by, "_bin"], "left")
    above = W.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*(by or [F.lit(1)]))
    zero = F.lit(0).cast("bigint")
    tp, fp = F.coalesce(F.sum("p").over(above), zero), F.coalesce(F.sum("n").over(above), zero)
    counts = joined.select(
        *by, "threshold", tp.alias("true_positive"), fp.alias("false_positive"),
        (F.coalesce(F.sum("n").over(every), zero) - fp).alias("true_negative"),
        (F.coalesce(F.sum("p").over(every), zero) - tp).alias("false_negative"),
    ).filter("threshold is not null")
    return with_rates(counts).withColumn("alert_count", F.col("true_positive") + F.col("false_positive"))


def recommended_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best row by F1, then recall, then precision; the lowest threshold wins a tie."""
    rank = F.struct("f1", "recall", "precision", (-F.col("threshold")).alias("t"))
    best = sweep.groupBy(*(by or [])).agg(F.max_by(F.struct(*[c for c in sweep.columns if c not in (by or [])]), rank).alias("b"))
    return best.select(*(by or []), "b.*")


def best_f1_threshold(df: DataFrame, grid: list[float] = FINE_GRID) -> float:
    """Grid point with the highest F1 on validation rows; the first wins a tie."""
    sweep = threshold_sweep(df, grid)
    return sweep.agg(F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("t")))).first()[0]


def best_round(history: DataFrame, metric: str, round_column: str = "epoch", lower_is_better: bool = False) -> DataFrame:
    """History row with the best metric; the earliest wins a tie."""
    value = -F.col(metric) if lower_is_better else F.col(metric)
    rows = history.filter(F.col(metric).isNotNull())
    rank = F.struct(value.alias("v"), (-F.col(round_column)).alias("r"))
    return rows.agg(F.max_by(F.struct(*history.columns), rank).alias("b")).select("b.*")


# ---------------------------------------------------------------- calibration


def bin_edges(bins: int) -> list[float]:
    return [k * (1.0 / bins) if k < bins else 1.0 for k in range(bins + 1)]


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins on 0..1, the last one closed; empty bins are kept with nulls."""
    edges = bin_edges(bins)
    inside = (F.col("score") >= 0.0) & (F.col("score") <= 1.0)
    place = _points_reached(F.col("score"), edges[1:-1]).alias("bin_index")
    found = df.filter(inside).groupBy(place).agg(
        F.count("*").alias("sample_count"), F.avg("score").alias("mean_predicted_probability"),
        F.avg(F.col("label").cast("double")).alias("observed_positive_rate"),
    )
    total = df.agg(F.count("*"))
    spine = df.sparkSession.createDataFrame(
        [(k, edges[k], edges[k + 1]) for k in range(bins)],
        "bin_index int, lower_bound double, upper_bound double",
    )
    n = F.coalesce("sample_count", F.lit(0).cast("bigint"))
    return spine.join(found, "bin_index", "left").select(
        "bin_index", "lower_bound", "upper_bound", n.alias("sample_count"),
        safe_ratio(n, total.scalar()).alias("sample_fraction"),
        "mean_predicted_probability", "observed_positive_rate",
        F.abs(F.col("mean_predicted_probability") - F.col("observed_positive_rate"))
        .alias("absolute_calibration_gap"),
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    term = F.col("sample_fraction") * F.col("absolute_calibration_gap")
    return bins.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("expected_calibration_error"))


def brier_score(df: DataFrame) -> DataFrame:
    error = F.col("score") - F.col("label").cast("double")
    return df.agg(F.avg(error * error).alias("brier_score"))


def probability_summary(df: DataFrame) -> DataFrame:
    ends = df.agg(
        F.min("score").alias("min_probability"), F.max("score").alias("max_probability"),
        F.avg("score").alias("mean_probability"),
    )
    middle = exact_quantiles(df, ["score"], {"median_probability": 0.5})
    return ends.withColumn("median_probability", middle.select("median_probability").scalar())


def log_loss(df: DataFrame, weight: str | None = None) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg((F.sum(loss * w) / F.sum(w)).alias("loss"))


# ---------------------------------------------------------------- repeated runs


def run_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric over runs: count, mean, sample std, extremes, standard error, 95 % interval."""
    long = runs.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [], metrics, "metric", "value"
    ).filter("value is not null")
    stats = long.groupBy("metric").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    error = F.when(F.col("count") > 1, F.col("std") / F.sqrt(F.col("count").cast("double"))).otherwise(0.0)
    return stats.withColumn("standard_error", error).withColumns({
        "ci95_lower": F.col("mean") - 1.96 * F.col("standard_error"),
        "ci95_upper": F.col("mean") + 1.96 * F.col("standard_error"),
    })
