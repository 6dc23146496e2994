"""Stored quantile profiles: a mergeable sketch per column and slice, written once.

A profile answers quantiles and ranks of any range of slices without a second read of the rows, and
drift against a stored reference needs the profiles of both sides alone. Sketches are KLL sketches; the
tests and the query ``profile_quantiles`` hold their ranks to ``RANK_ERROR`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Items that a sketch keeps per level; a larger number costs bytes and gains accuracy.
SIZE = 1000
RANK_ERROR = 0.005
# Shares at which two profiles are compared.
GRID = 400


def profiled(df: DataFrame, columns: list[str], slice_of: Column) -> DataFrame:
    """(slice, field, n, low, high, total, squares, sketch); nulls and NaN don't count, a field without values has no row."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]))
    rows = df.select(slice_of.alias("slice"), cells.alias("c")).select("slice", "c.*").filter("value is not null and not isnan(value)")
    return rows.groupBy("slice", "field").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("squares"), F.kll_sketch_agg_double("value", SIZE).alias("sketch"),
    )


def merged(profiles: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """One profile per ``by`` of the slices given."""
    return profiles.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.sum("squares").alias("squares"), F.kll_merge_agg_double("sketch", SIZE).alias("sketch"),
    )


def quantiles(profiles: DataFrame, points: dict[str, float]) -> DataFrame:
    """``field`` and a column per point, from merged profiles."""
    return merged(profiles).select(
        "field", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in points.items()]
    )


def drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Per field Kolmogorov-Smirnov distance, and Wasserstein distance over the reference's standard deviation (0.001 at least)."""
    shares = F.array(*[F.lit((k + 0.5) / GRID) for k in range(GRID)])
    left = merged(reference).select("field", F.col("sketch").alias("r"), "n", "total", "squares")
    both = left.join(merged(current).select("field", F.col("sketch").alias("c")), "field")
    both = both.withColumns({
        "qr": F.kll_sketch_get_quantile_double("r", shares), "qc": F.kll_sketch_get_quantile_double("c", shares),
    })
    # The rank of a value is the share of a side's quantiles up to it, right to a step of the grid.
    gaps = F.transform(
        F.concat("qr", "qc"), lambda v: F.abs(F.size(F.filter("qr", lambda q: q <= v)) - F.size(F.filter("qc", lambda q: q <= v))) / GRID
    )
    mean = F.col("total") / F.col("n")
    std = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    apart = F.aggregate(F.zip_with("qr", "qc", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / GRID
    return both.select("field", F.array_max(gaps).alias("ks_distance"), (apart / F.greatest(std, F.lit(0.001))).alias("wasserstein"))
