"""Fitting and scoring as Spark ML jobs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators import evaluation, network
from tracewright.operators.features import (
    class_weights,
    require_feature_order,
    weight_column,
)
from tracewright.operators.splits import stratified_three_way
from tracewright.schemas import TableCheckError
from tracewright.session import materialize

# Columns of the scoring event.
EVENT_NUMBERS = ["bytes_in", "bytes_out", "event_hour", "is_business_hour"]
EVENT_CATEGORIES = ["user_id", "host_id", "process_name", "event_type", "source_ip", "destination_ip"]


# Places for the categories of an event.
HASH_BITS = 16


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _scaling_stages(numeric: list[str], encoded: list[str] | None = None) -> list:
    stages = [
        VectorAssembler(inputCols=numeric, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled", *(encoded or [])], outputCol="features"),
    ]
    return stages


def _balanced(train: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Rows with balanced weights, and the weight total."""
    weights = class_weights(train, label)
    rows = train.withColumn("_weight", weight_column(label, weights))
    return rows, float(train.count())


def fit_logistic(
    train: DataFrame, numeric: list[str], categorical: list[str] | None = None,
    label: str = "label", max_iter: int = 1000,
) -> PipelineModel:
    """Balanced logistic regression on scaled numbers and hashed categories.

    Names and addresses have any number of values, so ``2 ** HASH_BITS`` hashed places stand for
    them and nothing is gathered on the driver; a value not seen in training has its place too.
    """
    categorical = categorical or []
    rows, total = _balanced(_numbers(train, numeric), label)
    hashed = FeatureHasher(inputCols=categorical, outputCol="_hashed", numFeatures=1 << HASH_BITS)
    stages = [hashed] if categorical else []
    stages += _scaling_stages(numeric, ["_hashed"] if categorical else [])
    stages.append(LogisticRegression(
        labelCol=label, weightCol="_weight", maxIter=max_iter, regParam=1.0 / total,
        standardization=False,
    ))
    return Pipeline(stages=stages).fit(rows.select(label, "_weight", *numeric, *categorical))


def fit_mlp(
    split: DataFrame, numeric: list[str], label: str = "label", hidden: tuple[int, ...] = (64, 32), max_iter: int = 300, seed: int = 42,
) -> network.Run:
    """ReLU network on the rows of ``split`` that train; ends early when ten epochs gain less than 0.0001."""
    return network.train(split, numeric, label, ["split"], [seed], hidden, max_iter, weighted=False, patience=10)[0]


def scored(model: PipelineModel, df: DataFrame, numeric: list[str], label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, label, score)"""
    out = model.transform(_numbers(df, numeric))
    return out.select(
        *(keep or []), F.col(label).cast("int").alias("label"),
        vector_to_array("probability")[1].alias("score"),
    )


def fit_mlp_with_history(
    split: DataFrame, numeric: list[str], label: str = "label", epochs: int = 30, seed: int = 42,
) -> network.Run:
    """Weighted network with dropout; the epoch with the least validation loss is kept, and the curve of all."""
    return network.train(split, numeric, label, ["split"], [seed], epochs=epochs, decay=1e-4, dropout=0.2, keep_best=True)[0]


def network_scores(run: network.Run, df: DataFrame, label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, label, score)"""
    found = network.scored([run.network], df, label, keep)
    return found.withColumn("score", F.col("scores")[0]).drop("scores")


def evaluate(predictions: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """All metrics of scored rows, one row per group."""
    by = by or []
    rates = evaluation.classification(predictions, threshold, by)
    ranks = evaluation.ranking_metrics(predictions, by)
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = predictions.groupBy(*by).agg(
        F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"),
        F.count("*").alias("rows"),
    )
    if by:
        return rates.join(ranks, by).join(loss, by)
    return rates.withColumns({
        c: part.select(c).scalar()
        for part, names in (
            (ranks, ["positives", "negatives", "roc_auc", "average_precision"]), (loss, ["loss", "rows"])
        )
        for c in names
    })


# Columns of a seed run.
SEED_COLUMNS = [
    "seed", "train_rows", "validation_rows", "test_rows", "train_positive_rows",
    "validation_positive_rows", "test_positive_rows", "final_train_loss", "test_loss", "roc_auc",
    "pr_auc", "accuracy", "precision", "recall", "f1", "true_positive", "false_positive",
    "true_negative", "false_negative",
]
SEED_METRICS = SEED_COLUMNS[7:]


def seed_runs(
    df: DataFrame, key: list[str], numeric: list[str], label: str = "label",
    seeds: tuple[int, ...] = (1, 2, 3, 4, 5), max_iter: int = 20, threshold: float = 0.5,
) -> DataFrame:
    """Split per seed, all networks trained by the same passes, all evaluated in one."""
    table, parts = df, [f"split_{seed}" for seed in seeds]
    for seed, part in zip(seeds, parts):
        table = stratified_three_way(table, key, label, seed=seed).withColumnRenamed("split", part)
    table = materialize(table, "seeds")
    runs = network.train(table, numeric, label, parts, list(seeds), epochs=max_iter, decay=1e-4, dropout=0.2)
    scores = network.scored([r.network for r in runs], table, label, parts)
    pairs = F.array(*[F.struct(F.lit(s).alias("seed"), F.col(p).alias("split"), F.col("scores")[i].alias("score"))
                      for i, (s, p) in enumerate(zip(seeds, parts))])
    each = scores.select("label", F.inline(pairs))
    counts = each.groupBy("seed").agg(*[
        F.count_if((F.col("split") == name) & test).alias(f"{name}_{kind}")
        for name in ("train", "validation", "test") for kind, test in (("rows", F.lit(True)), ("positive_rows", F.col("label") == 1))
    ])
    test = evaluate(materialize(each.filter("split = 'test'").select("seed", "label", "score"), "scored"), threshold, ["seed"])
    final = F.create_map(*[F.lit(v) for s, r in zip(seeds, runs) for v in (s, r.history[-1][1])])
    return (
        test.withColumnRenamed("loss", "test_loss").withColumnRenamed("average_precision", "pr_auc")
        .join(counts, "seed").withColumn("final_train_loss", final[F.col("seed")]).select(*SEED_COLUMNS)
    )


def fit_node_classifier(
    nodes: DataFrame, columns_by_hops: dict[int, list[str]], label: str = "label",
    strengths: tuple[float, ...] = (0.001, 0.01), max_iter: int = 100,
) -> tuple[PipelineModel, dict]:
    """Logistic model on propagated features; hops and strength are chosen on validation AP.

    ``nodes`` carries the features of every hop, ``label`` and ``split``.
    """
    rows, _ = _balanced(nodes, label)
    train = rows.filter("split = 'train'")
    train, _ = _balanced(train.drop("_weight"), label)
    held = nodes.filter("split = 'validation'")
    fitted, parts = {}, None
    for hops, columns in columns_by_hops.items():
        for strength in strengths:
            name = f"hops={hops},strength={strength}"
            stages = [*_scaling_stages(columns), LogisticRegression(
                labelCol=label, weightCol="_weight", maxIter=max_iter, regParam=strength, standardization=False
            )]
            model = Pipeline(stages=stages).fit(train)
            fitted[name] = (model, columns, hops, strength)
            part = scored(model, held, columns, label).withColumn("candidate", F.lit(name))
            parts = part if parts is None else parts.unionByName(part)
    ranks = evaluation.ranking_metrics(parts, ["candidate"])
    best = ranks.orderBy(F.desc_nulls_last("average_precision"), "candidate").first()
    model, columns, hops, strength = fitted[best["candidate"]]
    return model, {
        "candidate": best["candidate"], "columns": columns, "hops": hops, "strength": strength,
        "validation_average_precision": best["average_precision"],
    }


def typed_heads(
    nodes: DataFrame, columns: list[str], types: tuple[str, ...] = ("user", "host"),
    label: str = "label", max_iter: int = 100,
) -> DataFrame:
    """One model per node type; the pooled scores of all their nodes."""
    out = None
    for kind in types:
        rows = nodes.filter(F.col("entity_type") == kind)
        model = fit_logistic(rows.filter("split = 'train'"), columns, label=label, max_iter=max_iter)
        part = scored(model, rows, columns, label, ["node_id", "entity_type", "split"])
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- scoring


def valid_event() -> Column:
    """True for a scoring row that has every field inside its range."""
    present = F.lit(True)
    for name in [*EVENT_CATEGORIES, *EVENT_NUMBERS]:
        present = present & F.col(name).isNotNull()
    ranges = (
        (F.col("bytes_in") >= 0) & (F.col("bytes_out") >= 0) & F.col("event_hour").between(0, 23)
    )
    return F.coalesce(present & ranges, F.lit(False))


def accept_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)"""
    missing = [c for c in [*EVENT_CATEGORIES, *EVENT_NUMBERS] if c not in df.columns]
    if missing:
        raise TableCheckError(f"missing columns {missing}")
    return df.filter(valid_event()), df.filter(~valid_event())


def score_events(model: PipelineModel, events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Prediction, class text and probability; works on batch and streaming frames."""
    out = model.transform(_numbers(events, EVENT_NUMBERS))
    prediction = F.col("prediction").cast("int")
    return out.select(
        *(keep or []), prediction.alias("prediction"),
        F.when(prediction == 1, "suspicious").otherwise("normal").alias("classification"),
        vector_to_array("probability")[1].alias("suspicious_probability"),
    )


# ---------------------------------------------------------------- persistence


def save_model(model: PipelineModel, path: str, columns: list[str], threshold: float, **facts: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = _session()
    record = spark.createDataFrame(
        [(columns, float(threshold), {k: str(v) for k, v in facts.items()})],
        "feature_columns array<string>, threshold double, facts map<string,string>",
    )
    record.coalesce(1).write.mode("overwrite").json(f"{path}/record")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = _session()
    row = spark.read.schema(
        "feature_columns array<string>, threshold double, facts map<string,string>"
    ).json(f"{path}/record").first()
    return PipelineModel.load(f"{path}/model"), row.asDict()


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def score_table(path: str, df: DataFrame, label: str = "label") -> DataFrame:
    """Score with a saved model after checking that the features match the model's."""
    model, record = load_model(path)
    columns = record["feature_columns"]
    require_feature_order(df, columns)
    return scored(model, df, columns, label)
