"""Merged profiles against the values themselves."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import monitoring, quantile_profiles as qp
from tracewright.session import materialize


def test_merged_slices_keep_the_rank_error(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=30_000), np.zeros(20_000), rng.exponential(5, 50_000)])
    rng.shuffle(x)
    df = spark.createDataFrame([(i % 25, float(v)) for i, v in enumerate(x)], "day int, v double").repartition(6)
    profiles = qp.profiled(df, ["v"], F.col("day"))
    assert profiles.count() == 25
    shares = {f"q{k}": k / 20 for k in range(1, 20)}
    row = qp.quantiles(profiles, shares).first()
    worst = 0
    for name, p in shares.items():
        below, upto = (x < row[name]).mean(), (x <= row[name]).mean()
        worst = max(worst, below - p, p - upto)
    assert worst <= qp.RANK_ERROR
    some = qp.quantiles(profiles.filter("slice < 3"), {"m": 0.5}).first()["m"]
    part = x[np.arange(len(x)) % 25 < 3]
    assert abs((part < some).mean() - 0.5) < 0.25 and (part < some).mean() - qp.RANK_ERROR <= 0.5 <= (part <= some).mean() + qp.RANK_ERROR


def test_drift_of_profiles(spark):
    rng = np.random.default_rng(7)
    a = spark.createDataFrame([(float(v),) for v in rng.normal(size=20_000)], "v double")
    b = spark.createDataFrame([(float(v),) for v in rng.normal(0.3, 1.2, size=20_000)], "v double")
    one = F.lit(1)
    found = qp.drift(qp.profiled(a, ["v"], one), qp.profiled(b, ["v"], one)).first()
    want = monitoring.numeric_drift(a, b, ["v"]).first()
    assert abs(found["ks_distance"] - want["ks_distance"]) < 0.015 and abs(found["wasserstein"] - want["wasserstein"]) < 0.03
    # Sketches draw at random; a stored one is the same to both sides.
    stored = materialize(qp.profiled(a, ["v"], one), "profile")
    same = qp.drift(stored, stored).first()
    assert same["ks_distance"] == 0 and same["wasserstein"] == 0


def test_missing_values_do_not_count(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "v double, w double")
    rows = qp.profiled(df, ["v", "w"], F.lit(0)).collect()
    assert [(r.field, r.n, r.low, r.high) for r in rows] == [("v", 2, 1.0, 3.0)]
