"""Seeded splits. One rounding rule: whole rows per stratum, the rest goes to the last part."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tracewright.operators.sampling import hashed_sample, hashed_split
from tracewright.schemas import TableCheckError

__all__ = [
    "stratified_split", "stratified_three_way", "node_split", "typed_node_split",
    "check_split", "split_sizes", "hashed_sample",
]


def stratified_split(
    df: DataFrame, key: list[str], label: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """``split`` = train or test, balanced per label."""
    return hashed_split(
        df, key, [label], ["train", "test"], lambda n: [int(n * (1 - test_size))], seed
    )


def stratified_three_way(
    df: DataFrame, key: list[str], label: str,
    test_size: float = 0.2, validation_size: float = 0.2, seed: int = 42,
) -> DataFrame:
    """Test share first, then ``validation_size`` of the remainder."""
    def cuts(n: int) -> list[int]:
        train = int(n * (1 - test_size) * (1 - validation_size))
        return [train, train + int(n * (1 - test_size) * validation_size)]

    return hashed_split(df, key, [label], ["train", "validation", "test"], cuts, seed)


def _shares(train: float, validation: float):
    def cuts(n: int) -> list[int]:
        return [int(n * train), int(n * train) + int(n * validation)]

    return cuts


def node_split(
    nodes: DataFrame, train: float = 0.70, validation: float = 0.15, seed: int = 42
) -> DataFrame:
    return hashed_split(
        nodes, ["node_id"], ["label"], ["train", "validation", "test"],
        _shares(train, validation), seed,
    )


def typed_node_split(
    nodes: DataFrame, train: float = 0.50, validation: float = 0.25, test: float = 0.25,
    seed: int = 42, types: tuple[str, ...] = ("user", "host"),
) -> DataFrame:
    """Split inside each node type, by label only where both classes have three nodes or more."""
    if not math.isclose(train + validation + test, 1.0):
        raise ValueError("split ratios must sum to 1")
    rows = nodes.filter(F.col("entity_type").isin(*types))
    counts = rows.groupBy("entity_type", "label").agg(F.count("*").alias("n"))
    balanced = [
        r["entity_type"]
        for r in counts.groupBy("entity_type")
        .agg(F.count("*").alias("classes"), F.min("n").alias("least")).collect()
        if r["classes"] == 2 and r["least"] >= 3
    ]
    stratum = F.when(F.col("entity_type").isin(balanced), F.col("label")).otherwise(F.lit(-1))
    marked = rows.withColumn("_stratum", stratum.cast("bigint"))
    return hashed_split(
        marked, ["node_id"], ["entity_type", "_stratum"], ["train", "validation", "test"],
        _shares(train, validation), seed,
    ).drop("_stratum")


def split_sizes(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), "split").agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("bigint")).alias("positives")
    )


def check_split(df: DataFrame, key: list[str], label: str = "label") -> list[str]:
    """Raise unless every row has one of three non-empty splits; return warnings on missing labels."""
    names = ("train", "validation", "test")
    found = df.groupBy("split", label).agg(F.count("*").alias("n")).collect()
    sizes = {name: sum(r["n"] for r in found if r["split"] == name) for name in names}
    empty = [name for name, n in sizes.items() if n == 0]
    if empty:
        raise TableCheckError(f"empty splits {empty}")
    stray = [r["split"] for r in found if r["split"] not in names]
    if stray:
        raise TableCheckError(f"rows outside the splits: {stray}")
    rows, keys = df.agg(F.count("*"), F.countDistinct(*key)).first()
    if rows != keys:
        raise TableCheckError("a key is in two splits")
    labels = {r[label] for r in found}
    return [
        f"split {name} has no label {value}"
        for name in names for value in sorted(labels, key=str)
        if not any(r["split"] == name and r[label] == value for r in found)
    ]
