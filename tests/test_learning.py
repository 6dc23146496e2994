import math

import pytest
from conftest import rows
from fixtures import TOY_EDGES, TOY_FEATURES
from pyspark.sql import functions as F

from tracewright.plans import learning
from tracewright.operators import evaluation, features, links, models, monitoring, propagation, reports, splits
from tracewright.schemas import SCORING_SCHEMA, TableCheckError
from tracewright.streaming import events as streams

XYZ = ["x", "y", "z"]


@pytest.fixture(scope="module")
def toy(spark):
    nodes = spark.createDataFrame(TOY_FEATURES, "node_id bigint, x double, y double, z double")
    edges = spark.createDataFrame(TOY_EDGES, "source_node_id bigint, destination_node_id bigint")
    return nodes, edges


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9)


def test_mean_neighbours(toy):
    out = rows(propagation.neighbour_aggregate(*toy, XYZ, undirected=True))
    near(out, [(0, 0, 1, 0), (1, 2 / 3, 1 / 3, 1 / 3), (2, 0, 1, 0), (3, 0, 1, 0)])
    none = rows(propagation.neighbour_aggregate(*toy, XYZ))
    assert none[0] == (0, 0.0, 0.0, 0.0)


def test_normalised_adjacency(toy):
    nodes, edges = toy
    w = {(r["src"], r["dst"]): r["weight"] for r in propagation.adjacency_weights(nodes, edges).collect()}
    assert w[(0, 0)] == pytest.approx(1 / 2) and w[(0, 1)] == pytest.approx(1 / math.sqrt(8))
    assert w[(1, 1)] == pytest.approx(1 / 4)
    got = rows(propagation.normalized_propagation(nodes, edges, XYZ))
    x = {r[0]: r[1:] for r in TOY_FEATURES}
    want = [(i, *[sum(w.get((j, i), 0) * x[j][d] for j in range(4)) for d in range(3)]) for i in range(4)]
    near(got, want)
    hops = propagation.k_hop_features(nodes, edges, XYZ, hops=2)
    assert hops.count() == 4 and len(hops.columns) == 10


def test_attention_by_hand(spark):
    nodes = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 1.0)], "node_id bigint, x double, y double")
    edges = spark.createDataFrame(
        [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (1, 2), (2, 2)], "source_node_id bigint, destination_node_id bigint")
    shares, fresh = propagation.attention(nodes, edges, ["x", "y"], [[1, 0], [0, 1]], [1, 0, 0, 1])
    w = {(r["src"], r["dst"]): r["weight"] for r in shares.collect()}
    near([w[(0, 0)], w[(1, 0)], w[(2, 0)]], [
        math.e / (math.e + 2 * math.e**2), math.e**2 / (math.e + 2 * math.e**2), math.e**2 / (math.e + 2 * math.e**2)])
    sums = rows(shares.groupBy("dst").agg(F.round(F.sum("weight"), 9)))
    assert sums == [(0, 1.0), (1, 1.0), (2, 1.0)]
    a = fresh.filter("node_id = 0").first()
    assert (round(a["z0"], 4), round(a["z1"], 4)) == (0.5777, 0.8446)


def test_relation_sum_adds_relations(toy, spark):
    nodes, _ = toy
    rel = spark.createDataFrame(
        [("u", "r1", "h", 0, 1), ("u", "r1", "h", 2, 1), ("u", "r2", "h", 3, 1)],
        "source_type string, relation string, destination_type string, source_node_id bigint, destination_node_id bigint")
    out = {r["node_id"]: r for r in propagation.relation_sum(nodes, rel, XYZ).collect()}
    assert (out[1]["x"], out[1]["y"], out[1]["z"]) == (1.5, 1.0, 0.5)
    assert out[0]["x"] == 0.0


def test_link_parts(spark):
    edges = spark.createDataFrame(
        [(i, j) for i in range(20) for j in (i, (i + 1) % 20, (i + 3) % 20)] + [(1, 0), (0, 1)],
        "source_node_id bigint, destination_node_id bigint")
    pairs = links.undirected_pairs(edges)
    assert pairs.count() == 40
    assert links.asymmetric_pairs(links.link_graph(edges)).isEmpty()
    split = links.split_pairs(pairs)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {
        "train": 28, "validation": 6, "test": 6}
    targets = links.link_targets(split, 20, "test")
    assert targets.filter("label = 0").count() == 6
    assert targets.filter("label = 0").join(pairs, ["a", "b"], "left_semi").isEmpty()
    links.require_no_leaked_pairs(targets, links.context_pairs(split, "test"))
    with pytest.raises(TableCheckError):
        links.require_no_leaked_pairs(targets, pairs)
    other = links.negative_pairs(pairs, 20, 6, epoch=1)
    assert other.exceptAll(links.negative_pairs(pairs, 20, 6, epoch=0)).count() > 0
    everything = links.negative_pairs(pairs, 20, 10_000)
    assert everything.count() == 190 - 40


def test_ranking_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.3, 1), (0.1, 0)], "score double, label int")
    out = evaluation.ranking_metrics(df).first()
    assert out["roc_auc"] == pytest.approx(0.611111, abs=1e-6)
    assert out["average_precision"] == pytest.approx(0.7)
    one = df.filter("label = 1")
    assert evaluation.ranking_metrics(one).first()["roc_auc"] is None
    assert math.isnan(evaluation.ranking_metrics(one, on_single_class="nan").first()["roc_auc"])
    with pytest.raises(TableCheckError):
        evaluation.ranking_metrics(one, on_single_class="error")


def test_auc_against_pair_count(spark):
    data = [((i * 7919 % 101) / 101, int(i * 31 % 7 == 0)) for i in range(300)]
    df = spark.createDataFrame(data, "score double, label int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.ranking_metrics(df).first()["roc_auc"] == pytest.approx(want)


def test_threshold_and_calibration(spark):
    df = spark.createDataFrame([(0.05, 0), (0.1, 0), (0.95, 1), (1.0, 1), (0.15000000000000002, 1)], "score double, label int")
    sweep = evaluation.threshold_sweep(df)
    assert sweep.count() == 19
    assert sweep.filter("threshold = 0.05").first()["alert_count"] == 5
    assert evaluation.recommended_threshold(sweep).first()["threshold"] == 0.15
    bins = evaluation.calibration_bins(df, 10)
    got = {r["bin_index"]: r for r in bins.collect()}
    assert len(got) == 10 and got[9]["sample_count"] == 2 and got[5]["mean_predicted_probability"] is None
    assert got[1]["sample_count"] == 2
    assert evaluation.brier_score(df).first()[0] == pytest.approx(
        sum((s - y) ** 2 for s, y in [(0.05, 0), (0.1, 0), (0.95, 1), (1.0, 1), (0.15, 1)]) / 5)


def test_run_summary_of_one_run(spark):
    out = evaluation.run_summary(spark.createDataFrame([(0.5,)], "f1 double"), ["f1"]).first()
    assert (out["std"], out["standard_error"], out["ci95_lower"]) == (0.0, 0.0, 0.5)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    assert features.class_weights(df) == {0: 4 / 6, 1: 2.0}
    assert features.positive_weight(df) == 3.0
    with pytest.raises(TableCheckError):
        features.positive_weight(df.filter("label = 0"))
    with pytest.raises(TableCheckError):
        features.class_weights(df.filter("label = 0"), strict=True)


@pytest.fixture(scope="module")
def generated(spark):
    """A thousand scoring rows, of which those with much traffic at night count as suspicious."""
    odd = F.col("id") % 8 == 0
    hour = F.when(odd, 2).otherwise(9 + F.col("id") % 8).cast("int")
    return spark.range(1000).select(
        F.lit("2026-01-01T00:00:00").alias("timestamp"), F.format_string("user_%03d", F.col("id") % 50).alias("user_id"),
        F.format_string("host_%03d", F.col("id") % 20).alias("host_id"),
        F.when(odd, "tool").otherwise("shell").alias("process_name"), F.lit("login").alias("event_type"),
        F.lit("10.0.0.1").alias("source_ip"), F.lit("10.0.0.2").alias("destination_ip"),
        F.when(odd, 9000 + F.col("id")).otherwise(F.col("id")).alias("bytes_in"), F.col("id").alias("bytes_out"),
        hour.alias("event_hour"), hour.between(8, 17).alias("is_business_hour"), odd.cast("int").alias("label"),
    ).cache()


def test_scoring_rows_follow_the_schema(generated):
    assert generated.columns == SCORING_SCHEMA.fieldNames()


def test_fit_score_save_and_reject(spark, generated, tmp_path):
    rows_ = generated.withColumn("i", F.monotonically_increasing_id())
    split = splits.stratified_split(rows_, ["i"], "label")
    model = models.fit_logistic(split.filter("split = 'train'"), models.EVENT_NUMBERS, ["process_name"], max_iter=20)
    held = models.scored(model, split.filter("split = 'test'"), models.EVENT_NUMBERS)
    assert models.evaluate(held).first()["roc_auc"] > 0.95
    broken = rows_.withColumn("event_hour", F.when(F.col("i") == 0, 24).otherwise(F.col("event_hour")))
    valid, rejected = models.accept_events(broken)
    assert rejected.count() == 1
    out = models.score_events(model, valid, ["i"])
    assert {r[0] for r in out.select("classification").distinct().collect()} <= {"normal", "suspicious"}
    with pytest.raises(TableCheckError):
        models.accept_events(generated.drop("bytes_in"))
    models.save_model(model, str(tmp_path / "m"), ["bytes_in"], 0.4, name="x")
    loaded, record = models.load_model(str(tmp_path / "m"))
    assert record["threshold"] == 0.4 and record["facts"] == {"name": "x"}
    assert loaded.transform(split.limit(1)).count() == 1


def test_stream_scoring_splits_rejects(spark, generated, tmp_path):
    source = str(tmp_path / "in")
    generated.withColumn("event_hour", F.when(F.col("user_id") == "user_001", 30).otherwise(F.col("event_hour"))
                         ).write.parquet(source)
    model = models.fit_logistic(generated, models.EVENT_NUMBERS, max_iter=10)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    root = str(tmp_path / "out")
    streams.score_to_end(model, stream, root)
    a, b = spark.read.parquet(f"{root}/scores").count(), spark.read.parquet(f"{root}/rejects").count()
    assert a + b == 1000 and b == generated.filter("user_id = 'user_001'").count()


def test_a_repeated_batch_changes_nothing(spark, generated, tmp_path, monkeypatch):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = generated.withColumn("event_hour", F.when(F.col("user_id") == "user_001", 30).otherwise(F.col("event_hour")))
    rows.withColumn("i", F.monotonically_increasing_id()).repartition(4).write.parquet(source)
    model = models.fit_logistic(generated, models.EVENT_NUMBERS, max_iter=10)
    given = spark.read.parquet(source)
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(source)
    whole, calls = streams.write_scored_batch, []

    def broken(model, batch, batch_id, root, keep):
        calls.append(batch_id)
        whole(model, batch, batch_id, root, keep)
        if calls == [0, 1]:
            raise RuntimeError("lost after both sinks were written")

    monkeypatch.setattr(streams, "write_scored_batch", broken)
    with pytest.raises(Exception, match="lost after"):
        streams.score_to_end(model, stream, root, ["i"])
    streams.score_to_end(model, stream, root, ["i"])
    assert calls == [0, 1, 1, 2, 3]
    scored = {r.i: r.suspicious_probability for r in spark.read.parquet(f"{root}/scores").collect()}
    valid, rejected = models.accept_events(given)
    want = {r.i: r.suspicious_probability for r in models.score_events(model, valid, ["i"]).collect()}
    assert scored == want and spark.read.parquet(f"{root}/scores").count() == len(want)
    assert spark.read.parquet(f"{root}/rejects").count() == rejected.count() > 0


def test_unseen_category_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",)], "k string")
    out = features.encoded(train, spark.createDataFrame([("a",), ("zz",)], "k string"), ["k"]).collect()
    assert sorted(r["k_hot"].toArray().sum() for r in out) == [0.0, 1.0]


def test_drift_and_fingerprint(spark):
    a = spark.createDataFrame([(float(i), "x") for i in range(100)], "v double, k string")
    b = a.withColumn("v", F.col("v") + 50)
    same = {r["field"]: r for r in monitoring.drift_report(a, a).collect()}
    assert not same["v"]["drifted"] and not same["k"]["drifted"]
    moved = monitoring.numeric_drift(a, b, ["v"]).first()
    assert moved["ks_distance"] == pytest.approx(0.5)
    assert moved["wasserstein"] == pytest.approx(50 / a.agg(F.stddev_pop("v")).first()[0])
    assert monitoring.table_fingerprint(a).first() == monitoring.table_fingerprint(a.repartition(3)).first()
    assert monitoring.table_fingerprint(a).first() != monitoring.table_fingerprint(b).first()
    with pytest.raises(TableCheckError):
        monitoring.drift_report(a.limit(0), a)


def test_hashes_lineage_and_comparison(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"abc")
    found = monitoring.file_hashes(spark, str(tmp_path / "m.bin"))
    assert found.first()["sha256"].startswith("ba7816bf")
    monitoring.require_recorded_hash(found.select("path", "sha256"), found)
    with pytest.raises(TableCheckError):
        monitoring.require_recorded_hash(found.select("path", F.lit("0").alias("sha256")), found)
    one = monitoring.lineage_manifest(
        spark.range(3), {"model_name": "m"}, {}, {"f1": 0.5}, {}, "e", "c", "/d").first()
    assert one["training_data"]["row_count"] == 3 and one["metrics"]["f1"] == 0.5
    docs = spark.createDataFrame([
        ("b", '{"f1": 0.9, "pr_auc": 0.5}'),
        ("a", '{"default_threshold_metrics": {"test_f1": 0.9}}'), ("c", '{"f1": null}')],
        "model_key string, document string")
    table = reports.comparison_rows(docs)
    assert [r["f1"] for r in table.collect()] == [0.9, 0.9, None]
    assert reports.best_model(table, "f1").first()["model_key"] == "a"
    assert reports.comparison_table(table).filter("model_key = 'c'").first()["f1"] == "N/A"
