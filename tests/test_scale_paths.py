"""Every way built for skew or size must give what the plain way gives."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.functions import columns
from tracewright.operators import ordered, sampling, temporal
from tracewright.operators.joins import hot_keys, lookup
from tracewright.plans import operations
from tracewright.session import broadcast_limit
from tracewright.sources import testbed


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one relation, a third of those in one hour, many at one second."""
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        if i % 3 == 0:
            time = 3600 * 5 + 17 if i % 9 == 0 else rnd.randrange(0, 40_000)
            data.append((f"e{i:05d}", 1, 2, "hot", time))
        else:
            data.append((f"e{i:05d}", rnd.randrange(50), rnd.randrange(50), "cold", rnd.randrange(0, 40_000)))
    df = spark.createDataFrame(
        data, "edge_id string, source_node_id bigint, destination_node_id bigint, edge_type string, timestamp bigint")
    return df.withColumn("window_id", F.expr("timestamp div 3600")).withColumn(
        "split", F.when(F.col("window_id") < 7, "train").otherwise("test")).cache()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_recency_in_chunks_equals_plain(skewed, partitions):
    plain = temporal.relationship_recency(skewed)
    cut = temporal.relationship_recency(skewed, rows_per_key=20, partitions=partitions)
    assert rows(plain.na.fill(-1)) == rows(cut.select(plain.columns).na.fill(-1))


def test_recency_by_hand(spark):
    df = spark.createDataFrame(
        [("a", 0), ("b", 10), ("c", 40), ("d", 3700)], "edge_id string, timestamp bigint"
    ).select("*", F.lit("train").alias("split"), F.lit(1).alias("source_node_id"), F.lit("t").alias("edge_type"),
             F.lit(2).alias("destination_node_id"), F.expr("timestamp div 3600").alias("window_id"))
    out = temporal.relationship_recency(df).orderBy("timestamp").collect()
    assert [r["event_count_so_far"] for r in out] == [1, 2, 3, 4]
    assert [r["time_since_previous"] for r in out] == [None, 10, 30, 3660]
    assert [r["mean_previous_gap"] for r in out] == [None, None, 10.0, 20.0]
    assert [r["recent_event_count"] for r in out] == [0, 0, 0, 3]
    assert {r["first_seen_timestamp"] for r in out} == {0}


def test_salted_lookup_equals_join(spark, skewed):
    dim = spark.range(40).select(F.col("id").alias("source_node_id"), (F.col("id") * 7).alias("v"))
    plain = skewed.join(dim, "source_node_id", "left").select("edge_id", "v")
    for how in ("left", "inner"):
        salted = lookup(skewed, dim, ["source_node_id"], ["edge_id"], how, rows_per_task=7, force_salt=True)
        want = plain if how == "left" else plain.filter("v is not null")
        assert rows(salted.select("edge_id", "v").na.fill(-1)) == rows(want.na.fill(-1))


@pytest.mark.parametrize("share", [2, 100, 2000])
def test_no_part_of_a_hot_key_is_above_the_bound(spark, share):
    """A key with a half, a hundredth or a two-thousandth of the rows."""
    given = spark.range(200_000).select(
        F.col("id").alias("edge_id"), F.when(F.col("id") % share == 0, -1).otherwise(F.col("id")).alias("k")
    )
    hot = hot_keys(given, ["k"], 50).collect()
    assert [(r["k"], r["_parts"]) for r in hot] == [(-1, -(-(-(-200_000 // share)) // 50))]
    dim = given.select("k").distinct().withColumn("v", F.col("k") + 1)
    out = lookup(given, dim, ["k"], ["edge_id"], rows_per_task=50, force_salt=True)
    assert out.count() == 200_000 and out.filter("v <> k + 1 or v is null").isEmpty()
    parts = given.filter("k = -1").groupBy(F.pmod(F.xxhash64("edge_id"), F.lit(hot[0]["_parts"]))).count()
    assert parts.agg(F.max("count")).first()[0] <= 2 * 50


def test_dense_and_group_index(spark):
    df = spark.createDataFrame([(i % 3 // 2, (i * 37) % 101) for i in range(101)], "g int, v int")
    out = ordered.dense_index(df, ["g", "v"], "i", partitions=7)
    want = sorted((r["g"], r["v"]) for r in df.collect())
    assert [(r["g"], r["v"]) for r in out.orderBy("i").collect()] == want
    assert [r["i"] for r in out.orderBy("i").collect()] == list(range(101))
    grouped = ordered.group_index(df, ["g"], ["v"], "i")
    assert grouped.filter("i = 0").count() == 2
    assert grouped.agg(F.max("i")).first()[0] == max(df.filter("g = 0").count(), df.filter("g = 1").count()) - 1


def test_exact_quantiles_match_percentile(spark):
    df = spark.createDataFrame([(float(i * i % 97), None if i % 5 else float(i)) for i in range(211)], "a double, b double")
    got = {r["field"]: r for r in ordered.exact_quantiles(df, ["a", "b"], {"q1": 0.25, "q95": 0.95}).collect()}
    for name in ("a", "b"):
        want = df.agg(F.percentile(name, 0.25), F.percentile(name, 0.95)).first()
        assert got[name]["q1"] == pytest.approx(want[0]) and got[name]["q95"] == pytest.approx(want[1])


@pytest.mark.parametrize("limit", [50_000, 5])
def test_hash_cuts_are_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "_EXACT_ROWS", limit)
    df = spark.range(40_000 if limit == 5 else 3000).withColumn("s", F.col("id") % 2)
    cuts = lambda n: [int(n * 0.7), int(n * 0.7) + int(n * 0.15)]
    out = sampling.hashed_split(df, ["id"], ["s"], ["train", "validation", "test"], cuts, 42)
    n = df.count() // 2
    a, b = cuts(n)
    for s in (0, 1):
        got = {r["split"]: r["count"] for r in out.filter(f"s = {s}").groupBy("split").count().collect()}
        assert got == {"train": a, "validation": b - a, "test": n - b}
    again = sampling.hashed_split(df.repartition(3), ["id"], ["s"], ["train", "validation", "test"], cuts, 42)
    assert out.exceptAll(again).isEmpty()


def test_sample_size(spark):
    df = spark.range(500)
    assert sampling.hashed_sample(df, 120, ["id"], 1).count() == 120
    assert sampling.hashed_sample(df, 900, ["id"], 1).count() == 500


def test_halves(spark):
    out = ordered.ordered_halves(spark.range(7), ["id"])
    assert rows(out.filter("half = 'reference'"), "id") == [(0,), (1,), (2,)]
    with pytest.raises(ValueError):
        ordered.ordered_halves(spark.range(1), ["id"])


def test_broadcast_limit_reads_units(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    for text, value in (("10MB", 10 << 20), ("1k", 1024), ("-1", -1), ("123b", 123)):
        spark.conf.set(name, text)
        assert broadcast_limit(spark) == value
    spark.conf.set(name, before)


def test_window_cuts_use_truncated_floats():
    assert temporal.chronological_cuts(720) == (503, 612)
    with pytest.raises(ValueError):
        temporal.chronological_cuts(2)


def test_a_slice_of_arriving_logs_has_a_file_from_each_task(spark, tmp_path):
    times = spark.range(60).select(F.col("id").cast("string").alias("timestamp")).repartition(4)
    seen = 0
    for k in operations._arriving({"dns": times}, str(tmp_path)):
        files = len(list((tmp_path / "dns").glob("*.parquet")))
        assert files - seen > 1  # one before, whatever the size of the table
        seen = files
        found = spark.read.parquet(str(tmp_path / "dns")).agg(F.count("*"), F.max(F.col("timestamp").cast("int"))).first()
        assert tuple(found) == (20 * (k + 1), 20 * (k + 1) - 1)


def test_flows_are_numbered_by_the_columns_they_are_made_of(spark, sf_dir):
    """Only these are sorted and written, and their texts aren't written a second time."""
    rows = testbed.landed(spark, sf_dir, "flows")
    written = spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0]).columns
    assert written == [*testbed.FLOW_ORDER, ordered.CHUNK, ordered.POSITION]


def test_texts_are_stripped_as_python_does(spark):
    texts = ["a", "ab", " a", "a　", " \t", "", None, "é", "a\nb", "\x1fx y\x85", "日 本", "~", "\x7f", "Redteam_Activity x", "\u212aey"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", columns.strip("t"), columns.norm("t"), columns.contains_any("t", ["redteam_activity", "key"])
    ).orderBy("i").collect()
    for (i, plain, named, marked), t in zip(found, texts):
        assert plain == (t if t is None else t.strip(columns.BLANKS)) and named == ((t or "").strip(columns.BLANKS) or "unknown")
        assert marked == (t == "Redteam_Activity x")


def test_whole_columns_are_read_like_texts(spark):
    df = spark.createDataFrame([(1, "1"), (None, "x"), (-7, " -7 ")], "n int, t string")
    found = df.select(columns.long_or(df, "n", -1), columns.to_long_or("n", -1), columns.long_or(df, "t", -1)).collect()
    assert [tuple(r) for r in found] == [(1, 1, 1), (-1, -1, -1), (-7, -7, -7)]


def test_long_relations_are_sorted_by_one_number(skewed, monkeypatch):
    orders = []
    chunked = temporal.chunked
    monkeypatch.setattr(temporal, "chunked", lambda rows, order, *rest: orders.append((order, rows.schema[order[0]].dataType.simpleString())) or chunked(rows, order, *rest))
    got = temporal.relationship_recency(skewed, rows_per_key=10, partitions=5)
    assert orders == [([temporal.NUMBER, "timestamp", "edge_id"], "bigint")]
    assert got.columns == temporal.relationship_recency(skewed).columns


def test_narrow_edges_are_columns_of_the_edges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(testbed, "_landed", {})
    names = ["source_node_id", "destination_node_id", "label"]
    narrow = testbed.narrow_edges(spark, sf_dir, names)
    assert not any(name in ("events", "edges") for _, _, name in testbed._landed)
    whole = testbed.edges(spark, sf_dir).select(names)
    assert narrow.columns == names and narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty()


def test_texts_of_visible_ends_are_told_without_a_regular_expression(spark):
    texts = ["a", "!", "~", "\x7f", " a", "a ", "a\nb", "é", "aé", "éa", "", " ", "　x", "x\x1f", "a b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", columns.norm("t").alias("n"), columns.strip("t").alias("s"))
    assert {(r.t, r.n, r.s) for r in df.collect()} == {(t, t.strip() or "unknown", t.strip()) for t in texts} | {(None, "unknown", None)}
    assert "RLIKE" not in str(columns.strip("t")).upper()
