"""Queries that fit, score and report."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tracewright.functions.columns import business_hour
from tracewright.operators import (
    boosting,
    evaluation,
    features,
    leakage,
    models,
    propagation,
    reports,
    splits,
)
from tracewright.operators.ordered import dense_index, exact_quantiles
from tracewright.plans.features_and_splits import FLOW_FEATURES, flow_table
from tracewright.plans.metrics import rounded, scored
from tracewright.plans.reference_sql import cte, sql
from tracewright.plans.registry import query
from tracewright.sources import testbed
from tracewright.session import app_dir, materialize
from tracewright.streaming import events as streams

# ---------------------------------------------------------------- the event table as scoring rows


def event_rows(spark, sf_dir):
    """Events with the columns that a scorer takes; errors stand for what it should find."""
    hour = F.hour("ts")
    return testbed.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("i"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("user_"), "user_id").alias("user_id"), F.concat(F.lit("host_"), F.col("user_id") % 20).alias("host_id"),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("process_name"), "event_type",
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("source_ip"),
        F.concat(F.lit("10.0.1."), F.col("event_id") % 250).alias("destination_ip"),
        F.floor(F.abs("value")).cast("bigint").alias("bytes_in"), F.length("props").cast("bigint").alias("bytes_out"),
        hour.alias("event_hour"), business_hour(hour).alias("is_business_hour"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def _event_split(spark, sf_dir):
    return materialize(splits.stratified_split(event_rows(spark, sf_dir), ["i"], "label"), "events_split")


def _event_model(split):
    return models.fit_logistic(split.filter("split = 'train'"), models.EVENT_NUMBERS, models.EVENT_CATEGORIES)


def event_test_metrics(spark, sf_dir):
    split = _event_split(spark, sf_dir)
    held = models.scored(_event_model(split), split.filter("split = 'test'"), models.EVENT_NUMBERS)
    return models.evaluate(materialize(held, "scored"))


@query("event_hours", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS event_hour, hour(ts) >= 8 AND hour(ts) < 18 AS is_business_hour,
       hour(ts) >= 8 AND hour(ts) <= 18 AS is_business_hour_inclusive
FROM events""")
def event_hours(spark, sf_dir):
    hour = F.hour("ts")
    return testbed.table(spark, sf_dir, "events").select(
        "event_id", hour.alias("event_hour"), business_hour(hour).alias("is_business_hour"),
        business_hour(hour, inclusive_end=True).alias("is_business_hour_inclusive"),
    )


@query("scoring_input_checks", """
SELECT event_id, value >= 0 AND hour(ts) BETWEEN 0 AND 23 AND value <= 100 AS accepted FROM events""")
def scoring_input_checks(spark, sf_dir):
    """Events shaped as scoring rows; a value above 100 is made negative to be refused."""
    rows = testbed.table(spark, sf_dir, "events").select(
        "event_id", *[F.col("event_type").alias(c) for c in models.EVENT_CATEGORIES],
        F.when(F.col("value") <= 100, F.col("value")).otherwise(-F.col("value")).alias("bytes_in"),
        F.col("value").alias("bytes_out"), F.hour("ts").alias("event_hour"),
        F.lit(True).alias("is_business_hour"),
    )
    return rows.select("event_id", models.valid_event().alias("accepted"))


# ---------------------------------------------------------------- fits (rows-only checks)


@query("fit_event_logistic")
def fit_event_logistic(spark, sf_dir):
    return event_test_metrics(spark, sf_dir)


@query("score_events")
def score_events(spark, sf_dir):
    split = _event_split(spark, sf_dir)
    valid, _ = models.accept_events(split)
    return models.score_events(_event_model(split), valid, ["i"])


_LARGE = 100


@query("streamed_scores", f"""
SELECT event_id AS i, accepted, accepted AS scored_as_in_batch
FROM (SELECT event_id, coalesce(floor(abs(value)) < {_LARGE} AND ts IS NOT NULL AND user_id IS NOT NULL
                                AND event_type IS NOT NULL AND props IS NOT NULL, false) AS accepted FROM events)""")
def streamed_scores(spark, sf_dir):
    """Events scored as they arrive, large ones made invalid to be rejected, next to the same rows scored at once."""
    model = _event_model(_event_split(spark, sf_dir))
    large = F.col("bytes_in") >= _LARGE
    root = f"{app_dir(spark)}/scored-{uuid.uuid4().hex}"
    event_rows(spark, sf_dir).withColumn("bytes_in", F.when(large, -1).otherwise(F.col("bytes_in"))).repartition(6).write.parquet(f"{root}/in")
    rows = spark.read.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    streams.score_to_end(model, stream, root, ["i"])
    at_once = models.score_events(model, models.accept_events(rows)[0], ["i"]).select("i", F.col("suspicious_probability").alias("p"))
    scores = spark.read.parquet(f"{root}/{streams.SCORES}").join(at_once, "i", "left").select(
        "i", F.lit(True).alias("accepted"), F.col("suspicious_probability").eqNullSafe(F.col("p")).alias("scored_as_in_batch")
    )
    rejects = spark.read.parquet(f"{root}/{streams.REJECTS}").select("i", F.lit(False).alias("accepted"), F.lit(False).alias("scored_as_in_batch"))
    return scores.unionByName(rejects)


@query("saved_model_scores")
def saved_model_scores(spark, sf_dir):
    split = _flows(spark, sf_dir)
    model = models.fit_logistic(split.filter("split = 'train'"), FLOW_FEATURES, label="target")
    path = f"{app_dir(spark)}/flow-model"
    models.save_model(model, path, FLOW_FEATURES, 0.5, trained_on="flows")
    return models.score_table(path, split.filter("split = 'test'"), "target")


def _flows(spark, sf_dir):
    table = features.tabular_features(flow_table(spark, sf_dir))
    keyed = dense_index(table, [*FLOW_FEATURES, "target"], "row_id")
    chosen = features.feature_target(keyed, FLOW_FEATURES, keep=["row_id"])
    return materialize(splits.stratified_three_way(chosen, ["row_id"], "target"), "flows")


def _flow_metrics(model, split):
    held = models.scored(model, split.filter("split = 'test'"), FLOW_FEATURES, "target")
    return models.evaluate(materialize(held, "scored"))


@query("fit_flow_logistic")
def fit_flow_logistic(spark, sf_dir):
    split = _flows(spark, sf_dir)
    return _flow_metrics(
        models.fit_logistic(split.filter("split = 'train'"), FLOW_FEATURES, label="target"), split
    )


@query("fit_flow_boosted_trees")
def fit_flow_boosted_trees(spark, sf_dir):
    split = _flows(spark, sf_dir)
    model = boosting.fit(split.filter("split = 'train'"), FLOW_FEATURES, "target")
    held = boosting.scored(model, split.filter("split = 'test'"), "target")
    return models.evaluate(materialize(held, "scored")).withColumns(
        {"rounds": F.lit(model.rounds), "trees": F.lit(len(model.trees))}
    )


cte("tree_rows", "SELECT *, CASE WHEN upper(trim(label)) <> 'BENIGN' THEN 1 ELSE 0 END AS target FROM flow_table")
_TREE_FEATURES = ["flow_duration", "flow_bytes_per_s", "fwd_iat_mean"]
_TREE_BINS = 8


def _tree_histogram_sql() -> str:
    points = ", ".join(f"{k}::DOUBLE / {_TREE_BINS}" for k in range(1, _TREE_BINS))
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, target, CAST({c} AS DOUBLE) AS v, (SELECT list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{points}])) FROM tree_rows) AS edges FROM tree_rows"
        for c in _TREE_FEATURES
    )
    return f"""
SELECT feature, CAST(bin AS INTEGER) AS bin, count(*) AS rows, round(sum(w * (0.5::DOUBLE - target)), 4) AS gradient,
       round(sum(w * 0.25::DOUBLE), 4) AS hessian
FROM (SELECT feature, target, CASE WHEN v IS NULL THEN 0 ELSE 1 + len(list_filter(edges, lambda e: e < v)) END AS bin,
             CASE WHEN target = 1 THEN (SELECT (count(*) - sum(target)) / sum(target)::DOUBLE FROM tree_rows) ELSE 1::DOUBLE END AS w
      FROM ({parts}))
GROUP BY feature, bin"""


@query("tree_histogram", sql(_tree_histogram_sql()))
def tree_histogram(spark, sf_dir):
    """The sums that the first split of a boosted tree is picked from, with bins at exact quantiles."""
    rows = features.tabular_features(flow_table(spark, sf_dir))
    points = {f"q{k}": k / _TREE_BINS for k in range(1, _TREE_BINS)}
    found = {r.field: sorted({r[q] for q in points}) for r in exact_quantiles(rows, _TREE_FEATURES, points).collect()}
    out = boosting.first_histogram(rows, _TREE_FEATURES, [np.array(found[c]) for c in _TREE_FEATURES], "target")
    return out.withColumns({c: F.round(c, 4) for c in ("gradient", "hessian")})


def _network_metrics(run, split):
    held = models.network_scores(run, split.filter("split = 'test'"), "target")
    return models.evaluate(materialize(held, "scored")).withColumn("epochs", F.lit(len(run.history)))


@query("fit_flow_mlp")
def fit_flow_mlp(spark, sf_dir):
    split = _flows(spark, sf_dir)
    return _network_metrics(models.fit_mlp(split, FLOW_FEATURES, "target"), split)


@query("fit_flow_mlp_history")
def fit_flow_mlp_history(spark, sf_dir):
    split = _flows(spark, sf_dir)
    run = models.fit_mlp_with_history(split, FLOW_FEATURES, "target")
    curve = spark.createDataFrame(run.history, "epoch int, train_loss double, validation_loss double")
    return curve.withColumn("best_epoch", F.lit(run.best_epoch))


@query("seed_run_summary")
def seed_run_summary(spark, sf_dir):
    table = _flows(spark, sf_dir).drop("split")
    runs = models.seed_runs(table, ["row_id"], FLOW_FEATURES, "target")
    return reports.seed_stability_table(evaluation.run_summary(runs, models.SEED_METRICS))


def _node_table(spark, sf_dir, hops: int):
    nodes, edges = testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir)
    base = features.safe_node_features(nodes, edges)
    wide = propagation.k_hop_features(base, leakage.safe_edges(edges), features.SAFE_FEATURES, hops)
    marked = splits.node_split(base.select("node_id", "entity_type", "label"))
    return materialize(marked.join(wide, "node_id"), "node_table")


def _hop_columns(hops: int) -> list[str]:
    return features.SAFE_FEATURES + [f"{c}_hop{k}" for k in range(1, hops + 1) for c in features.SAFE_FEATURES]


@query("fit_node_classifier")
def fit_node_classifier(spark, sf_dir):
    table = _node_table(spark, sf_dir, 2)
    model, chosen = models.fit_node_classifier(
        table, {k: _hop_columns(k) for k in (1, 2)}
    )
    held = models.scored(model, table.filter("split = 'test'"), chosen["columns"])
    return models.evaluate(materialize(held, "scored")).withColumn("chosen", F.lit(chosen["candidate"]))


@query("typed_node_heads")
def typed_node_heads(spark, sf_dir):
    nodes, edges = testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir)
    base = features.safe_node_features(nodes, edges).select("node_id", *features.SAFE_FEATURES)
    table = materialize(splits.typed_node_split(nodes).select(
        "node_id", "entity_type", "label", "split").join(base, "node_id"), "typed")
    pooled = materialize(models.typed_heads(table, features.SAFE_FEATURES), "pooled")
    best = evaluation.best_f1_threshold(pooled.filter("split = 'validation'"))
    return models.evaluate(pooled.filter("split = 'test'"), best).withColumn("threshold", F.lit(best))


# ---------------------------------------------------------------- documents and reports


@query("metric_document")
def metric_document(spark, sf_dir):
    return reports.metric_document(scored(spark, sf_dir), "edge_scores")


@query("calibration_document")
def calibration_document(spark, sf_dir):
    return reports.calibration_document(scored(spark, sf_dir), "edge_scores")


# Per event family one metric document, in either of the two layouts.
cte("family_metrics", """
SELECT event_family AS model_key, count(*) FILTER (WHERE score >= 0.5) / CAST(count(*) AS DOUBLE) AS accuracy,
       max(score) AS f1, min(score) AS pr_auc, count(*) AS true_positive
FROM scored GROUP BY event_family
""")


def _documents(spark, sf_dir):
    found = scored(spark, sf_dir).groupBy(F.col("event_family").alias("model_key")).agg(
        (F.count_if(F.col("score") >= 0.5) / F.count("*")).alias("accuracy"), F.max("score").alias("f1"),
        F.min("score").alias("pr_auc"), F.count("*").alias("true_positive"),
    )
    flat = F.to_json(F.struct("accuracy", "f1", "pr_auc", "true_positive"))
    nested = F.to_json(F.struct(
        F.struct(
            F.col("accuracy").alias("test_accuracy"), F.col("f1").alias("test_f1"),
            F.col("true_positive").alias("test_true_positive"),
        ).alias("default_threshold_metrics"),
        F.struct(F.col("pr_auc").alias("test_pr_auc")).alias("threshold_independent_metrics"),
    ))
    return found.select("model_key", F.when(F.length("model_key") > 10, nested).otherwise(flat).alias("document"))


_MISSING = ", ".join(
    f"CAST(NULL AS DOUBLE) AS {c}" for c in
    ("precision", "recall", "roc_auc", "false_positive", "true_negative", "false_negative")
)


@query("model_comparison", sql(f"""
SELECT model_key, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc,
       CAST(true_positive AS DOUBLE) AS true_positive, {_MISSING}
FROM family_metrics"""))
def model_comparison(spark, sf_dir):
    return rounded(reports.comparison_rows(_documents(spark, sf_dir)))


@query("best_model", sql("""
SELECT model_key, round(f1, 6) AS f1 FROM family_metrics ORDER BY family_metrics.f1 DESC, model_key LIMIT 1"""))
def best_model(spark, sf_dir):
    rows = reports.comparison_rows(_documents(spark, sf_dir))
    return rounded(reports.best_model(rows, "f1").select("model_key", "f1"))


@query("comparison_table", sql("""
SELECT model_key, printf('%.4f', accuracy) AS accuracy, 'N/A' AS precision, 'N/A' AS recall,
       printf('%.4f', f1) AS f1, 'N/A' AS roc_auc, printf('%.4f', pr_auc) AS pr_auc
FROM family_metrics"""))
def comparison_table(spark, sf_dir):
    return reports.comparison_table(reports.comparison_rows(_documents(spark, sf_dir)))


@query("seed_stability_table", sql("""
SELECT metric, printf('%.4f', m) AS mean, printf('%.4f', s) AS std, printf('%.4f', lo) AS min,
       printf('%.4f', hi) AS max,
       printf('[%.4f, %.4f]', m - 1.96::DOUBLE * s / sqrt(n), m + 1.96::DOUBLE * s / sqrt(n)) AS ci95
FROM (SELECT metric, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi
  FROM (UNPIVOT (SELECT model_key, accuracy, f1 FROM family_metrics) ON accuracy, f1 INTO NAME metric VALUE value)
  GROUP BY metric)"""))
def seed_stability_table(spark, sf_dir):
    rows = reports.comparison_rows(_documents(spark, sf_dir))
    return reports.seed_stability_table(evaluation.run_summary(rows, ["accuracy", "f1"]))

