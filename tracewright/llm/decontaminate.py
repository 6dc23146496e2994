"""Benchmark decontamination by greedy string tiling.

Seeds: any tile of ``MIN_TILE`` words or more holds a ``SEED``-gram of the document
that starts at a multiple of ``STRIDE``, so documents give only those to the join
with all SEED-grams of the benchmark items, and no tile is missed. A pair is tiled
if its seeds can add up to the wanted coverage. Tiling marks the longest common
runs first, found by running Karp-Rabin over word ids, so moved parts still count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.words import words
from tracewright.operators.joins import lookup
from tracewright.session import materialize, scratch

MIN_TILE = 5
SEED = 3
STRIDE = MIN_TILE - SEED + 1
COVERAGE = 0.5
_BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1, *[base] * n], np.uint64))


class _Windows:
    """Karp-Rabin hashes of a sequence's windows of any size, modulo 2**64. Id 0 stands for no word of the item."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, ids > 0
        down, self.up = _powers(pow(_BASE, -1, _WORD), len(ids)), _powers(_BASE, len(ids))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * down[:-1], dtype=np.uint64)])

    def unmarked(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows without a marked or foreign word, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[size:] == taken[:-size]) if len(self.ids) >= size else np.zeros(0, np.int64)
        return at, (self.sums[at + size] - self.sums[at]) * self.up[at]

    def mark(self, at: int, size: int) -> None:
        self.free[at : at + size] = False


def _near_matches(ids: np.ndarray, least: int) -> np.ndarray:
    """Positions in runs of ``least`` or more known words, each run with the position after it as a break."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
    runs = [range(b, min(e + 1, len(ids))) for b, e in edges.reshape(-1, 2).tolist() if e - b >= least]
    return np.array([i for r in runs for i in r], np.int64)


def tiles(item: list, text: list, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item start, text start, length), longest first, none overlapping in either sequence.

    Of equally long ones the earlier in the item goes first, then the earlier in the text.
    Runs shorter than ``least`` are not tiles, so an item with fewer words has none.
    """
    known = {w: i for i, w in enumerate(dict.fromkeys(item), 1)}
    full = np.array([known.get(w, 0) for w in text], np.uint64)
    place = _near_matches(full, least)
    a, b = _Windows(np.array([known[w] for w in item], np.uint64)), _Windows(full[place])

    def common(size: int) -> bool:
        return len(np.intersect1d(a.unmarked(size)[1], b.unmarked(size)[1])) > 0

    found: list[tuple[int, int, int]] = []
    top = min(len(a.ids), len(b.ids))
    while True:
        low, high = least - 1, top  # the longest common unmarked run has a size in low..high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        if low < least:
            return found
        starts, hashes = b.unmarked(low)
        order = np.argsort(hashes, kind="stable")
        starts, hashes = starts[order], hashes[order]
        marked = 0
        for i, h in zip(*(x.tolist() for x in a.unmarked(low))):
            left, right = np.searchsorted(hashes, np.uint64(h)), np.searchsorted(hashes, np.uint64(h), "right")
            for j in starts[left:right].tolist():
                if not a.free[i : i + low].all():
                    break
                if b.free[j : j + low].all() and (a.ids[i : i + low] == b.ids[j : j + low]).all():
                    a.mark(i, low)
                    b.mark(j, low)
                    found.append((i, int(place[j]), low))
                    marked += 1
        top = low if marked else low - 1


def _grams(array: F.Column, step: int) -> F.Column:
    last = F.size(array) - (SEED - 1)
    at = F.sequence(F.lit(1), last, F.lit(step))
    grams = F.transform(at, lambda i: F.xxhash64(F.slice(array, i, F.lit(SEED))))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<bigint>"))


def _tokens(text: str) -> F.Column:
    return words(F.lower(text))


def candidate_pairs(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``item_id`` of pairs whose seeds can add up to ``coverage``.

    A tile of n words holds n / (MIN_TILE + STRIDE - 1) aligned seeds at least, hence the lowest count.
    """
    items = items.select("item_id", _tokens("text").alias("item"))
    enough = F.ceil(F.size("item") * coverage / (MIN_TILE + STRIDE - 1))
    seeds = materialize(
        items.select("item_id", enough.alias("enough"), F.explode(F.array_distinct(_grams(F.col("item"), 1))).alias("seed")),
        "seeds",
    )
    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _tokens("text").alias("doc"))
    aligned = given.select("doc_id", "text_hash", F.explode(_grams(F.col("doc"), STRIDE)).alias("seed"))
    met = lookup(aligned, seeds, ["seed"], ["doc_id", "text_hash"], "inner")
    counted = met.groupBy("doc_id", "text_hash", "item_id", "enough").agg(F.count("*").alias("n"))
    return counted.filter("n >= enough").select("doc_id", "text_hash", "item_id")


def tiled_pairs(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs with ``n_tiles``, ``covered`` (words of the item under tiles), ``n_words`` and ``coverage`` reached."""
    pairs = materialize(candidate_pairs(docs, items, coverage), "pairs")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _tokens("text").alias("doc"))
    keys = pairs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "item_id")
    met = texts.join(keys, (F.col("h") == F.col("text_hash")) & F.col("d").eqNullSafe(F.col("doc_id")))
    met = met.dropDuplicates(["doc_id", "text_hash", "item_id"])
    whole = met.join(items.select("item_id", _tokens("text").alias("item")), "item_id").select(
        "doc_id", "text_hash", "item_id", "item", "doc"
    )

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tiles(list(a), list(b)) for a, b in zip(batch["item"], batch["doc"])]
            out = batch[["doc_id", "text_hash", "item_id"]].copy()
            out["n_tiles"] = [len(f) for f in found]
            out["covered"] = [sum(size for _, _, size in f) for f in found]
            out["n_words"] = batch["item"].map(len)
            yield out

    schema = "doc_id bigint, text_hash bigint, item_id bigint, n_tiles bigint, covered bigint, n_words bigint"
    tiled = whole.mapInPandas(tile, schema)
    return tiled.withColumn("coverage", F.col("covered") / F.col("n_words")).filter(F.col("coverage") >= coverage)


def _leaks(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    with scratch() as kept:
        per_doc = tiled_pairs(docs, items, coverage).groupBy("doc_id", "text_hash").agg(
            F.count("*").alias("n_items"), F.max("coverage").alias("coverage"),
            F.max(F.struct("coverage", (-F.col("item_id")).alias("last"))).alias("best"),
        )
        kept.append(materialize(
            per_doc.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "n_items", "coverage",
                           (-F.col("best.last")).alias("item_id")),
            "leaks",
        ))
    return kept[0]


def contamination(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Per input row: ``doc_id``, ``contaminated``, ``n_items``, best ``coverage`` and its ``item_id`` (smallest of ties).

    Words are lower-cased. Items with fewer than ``MIN_TILE`` words never match. Null and
    empty texts are clean, repeated rows get equal results, and an item repeated under one
    id is one item. Without a match n_items is 0, coverage 0 and item_id null.
    """
    items = items.select("item_id", "text").filter("item_id is not null").dropDuplicates(["item_id"])
    leaks = _leaks(docs, items, coverage)
    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    same = (F.col("_h") == F.col("text_hash")) & F.col("_d").eqNullSafe(F.col("doc_id"))
    return given.join(leaks, same, "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id",
    )


def clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, with all their columns."""
    items = items.select("item_id", "text").filter("item_id is not null").dropDuplicates(["item_id"])
    leaks = _leaks(docs, items, coverage)
    same = (F.xxhash64(docs["text"]) == leaks["_h"]) & docs["doc_id"].eqNullSafe(leaks["_d"])
    return docs.join(leaks.select("_d", "_h"), same, "left_anti")
