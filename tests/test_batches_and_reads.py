"""Batches of a stream against all rows at once, and inputs that an operator reads once."""

import random

from conftest import rows
from pyspark.sql import functions as F

from tracewright.operators import links, propagation
from tracewright.operators.joins import lookup
from tracewright.streaming import events as streams

FEATURES = "event_id, event_count_so_far, last_seen_timestamp, time_since_previous, first_seen_timestamp, mean_previous_gap"
WANTED = """
SELECT event_id, row_number() OVER k AS event_count_so_far, lag(timestamp) OVER k AS last_seen_timestamp,
       timestamp - lag(timestamp) OVER k AS time_since_previous, first(timestamp) OVER k AS first_seen_timestamp,
       CASE WHEN row_number() OVER k >= 3 THEN (lag(timestamp) OVER k - first(timestamp) OVER k) / (row_number() OVER k - 2) END AS mean_previous_gap
FROM arrived WINDOW k AS (PARTITION BY source_entity, event_family, event_type, destination_entity ORDER BY timestamp, event_id)"""


def _arrived(spark):
    rnd = random.Random(3)
    data = [
        (f"e{i:03d}", rnd.choice(["a", "b", None]), "f", rnd.choice("xy"), rnd.choice(["p", None]), i // 4 * 10)
        for i in range(120)
    ]
    schema = "event_id string, source_entity string, event_family string, event_type string, destination_entity string, timestamp bigint"
    return spark.createDataFrame(data, schema)


def _plain(df):
    return sorted(tuple(-1.0 if v is None else v for v in r) for r in df.collect())


def test_recency_of_batches_equals_that_of_all_rows(spark, tmp_path):
    arrived = _arrived(spark)
    arrived.createOrReplaceTempView("arrived")
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    # The second batch starts within a second that the first one ends in; the last one meets relations of the first.
    for low, high in (("e000", "e050"), ("e050", "e051"), ("e051", "f")):
        arrived.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(source)
        streams.recency_to_end(spark.readStream.schema(arrived.schema).parquet(source), root)
    found = spark.read.parquet(f"{root}/{streams.RECENCY}")
    assert _plain(found.selectExpr(FEATURES.split(", "))) == _plain(spark.sql(WANTED))


def test_a_recency_batch_run_again_replaces_its_rows(spark, tmp_path):
    arrived, root = _arrived(spark).withColumn("edge_type", F.concat_ws(":", "event_family", "event_type")), str(tmp_path)
    parts = [arrived.filter("event_id < 'e060'"), arrived.filter("event_id >= 'e060'")]
    for k in (0, 1):
        streams.write_recency_batch(parts[k], k, root)
    once = _plain(spark.read.parquet(f"{root}/{streams.RECENCY}"))
    streams.write_recency_batch(parts[1], 1, root)
    assert _plain(spark.read.parquet(f"{root}/{streams.RECENCY}")) == once
    assert len(once) == 120


def _counted(spark, df, column):
    """``df`` and a count of how often its rows were made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf(df.schema[column].dataType)
    def through(x):
        made.add(1)
        return x

    return df.withColumn(column, through(column)), made


def test_reconstruction_report_decodes_once(spark):
    pairs = spark.range(40).select(
        (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") * 7 % 40 + 1) / 42).alias("probability"))
    decoded, made = _counted(spark, pairs, "probability")
    assert rows(links.reconstruction_report(decoded)) == rows(links.reconstruction_report(pairs))
    assert made.value == 40


def test_split_pairs_reads_its_pairs_once(spark):
    pairs = spark.range(60).select("id", (F.col("id") + 100).alias("b")).withColumnRenamed("id", "a")
    given, made = _counted(spark, pairs, "b")
    assert rows(links.split_pairs(given)) == rows(links.split_pairs(pairs))
    assert made.value == 60


def test_self_and_neighbours_reads_features_once(spark):
    nodes = spark.range(12).select(F.col("id").alias("node_id"), (F.col("id") / 3).alias("x"))
    edges = spark.range(30).selectExpr("id % 12 AS source_node_id", "id * 5 % 12 AS destination_node_id")
    given, made = _counted(spark, nodes, "x")
    call = lambda x: propagation.self_and_neighbours(x, edges, ["x"], [[1.0]], [[2.0]], undirected=True)
    assert rows(call(given).select("node_id", F.round("z0", 9))) == rows(call(nodes).select("node_id", F.round("z0", 9)))
    assert made.value == 12


def test_undirected_pairs_are_shuffled_in_one_direction(spark):
    """Self-loops, repeats, both directions and null ends give the pairs that both directions of all edges give."""
    data = [(1, 2), (2, 1), (1, 2), (3, 3), (4, 1), (None, 5), (5, None), (None, 6), (None, None)]
    edges = spark.createDataFrame(data, "source_node_id bigint, destination_node_id bigint")
    want = {(a, b, 1) for s, d in data for a, b in ((s, d), (d, s))}
    found = [tuple(r) for r in propagation.weighted_pairs(edges, undirected=True).collect()]
    assert len(found) == len(want) and set(found) == want
    plan = propagation.weighted_pairs(edges, undirected=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the shuffle comes before the second direction


def test_forced_lookup_shuffles_a_small_dimension(spark):
    given = spark.range(50).select((F.col("id") % 7).alias("k"), "id")
    dim = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = lookup(given, dim, ["k"], ["id"], force_salt=True)
    assert rows(found.na.fill(-1), "id", "v") == rows(given.join(dim, "k", "left").na.fill(-1), "id", "v")
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
