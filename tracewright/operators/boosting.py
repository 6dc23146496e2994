"""Boosted trees by gradient histograms.

Features are cut once into quantile bins and equal binned rows merge with their counts. A level of a
tree costs one aggregate: each task adds up gradients and hessians of its rows by open node, feature
and bin, Spark adds the tasks, and the driver picks splits from as many numbers as there are nodes,
features and bins. Sums are whole numbers of a fixed unit, so that their order does not matter.
Merged rows are packed once into blocks of contiguous columns. Margins of all trees so far are written
every few rounds, the sooner the more rows there are; a task applies only the trees since.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators.features import positive_weight
from tracewright.session import discard, materialize

BINS = 64
# Gradients and hessians are whole multiples of this.
UNIT = 2.0**-24
# Rounds between two writings of the margins: as many for a small table, for which a job costs most, and for one of
# many rows, where the trees since would cost most.
REFRESH, REFRESH_LARGE, SMALL_ROWS = 40, 8, 1_000_000
# Inner nodes of a tree whose ends are looked up in a table.
TABLE_BITS = 15
# Rows of a task that scans the merged rows.
ROWS_PER_TASK = 500_000


@dataclass(frozen=True)
class Settings:
    """Depth, step and shares of the reference's trainer; the penalties are the usual defaults."""

    rounds: int = 1000
    depth: int = 4
    step: float = 0.05
    row_share: float = 0.9
    column_share: float = 0.9
    penalty: float = 1.0
    least_hessian: float = 1.0
    held_share: float = 0.1
    patience: int = 20
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2i + 1 (bin up to ``cut``) and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def walker(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from columns of bins to the node each row ends in.

        Every inner node is compared for all rows at once; the answers are the bits of a place in a table of ends.
        """
        inner = np.flatnonzero(self.feature >= 0)
        if len(inner) > TABLE_BITS:
            return lambda columns: self._walked(columns.T)
        bit = np.zeros(len(self.feature), np.int64)
        bit[inner] = np.arange(len(inner))
        codes = np.arange(1 << len(inner))
        ends = np.zeros(len(codes), np.int64)
        while (going := self.feature[ends] >= 0).any():
            ends = np.where(going, 2 * ends + 1 + ((codes >> bit[ends]) & 1), ends)

        def walk(columns: np.ndarray) -> np.ndarray:
            code = np.zeros(columns.shape[1], np.uint16)
            for i, node in enumerate(inner):
                code |= (columns[self.feature[node]] > self.cut[node]).astype(np.uint16) << np.uint16(i)
            return ends.take(code)

        return walk

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        return self.walker()(bins.T)

    def _walked(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    rounds: int = 0
    losses: list[float] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees:
            out += tree.value[tree.places(bins)]
        return out


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each column, ``bins - 2`` at most; missing values have a bin of their own."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    numbers = df.select([F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    found = numbers.approxQuantile(columns, shares, 0.25 / bins)
    return [np.unique(np.array(q, float)) for q in found]


def bin_of(column: str, edges: np.ndarray) -> Column:
    """0 for a missing value, else one more than the number of edges below it."""
    x = F.col(column).cast("double")
    below = F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(1), lambda n, e: n + (e < x).cast("int"))
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(below if len(edges) else F.lit(1)).cast("smallint")


def merged_rows(df: DataFrame, columns: list[str], edges: list[np.ndarray], label: str, settings: Settings) -> DataFrame:
    """Distinct (bins, label) with ``n`` rows, an ``id`` from the bins, and whether they are ``held`` for validation."""
    bins = F.array(*[bin_of(c, e) for c, e in zip(columns, edges)]).alias("bins")
    rows = df.select(bins, F.col(label).cast("int").alias("label")).groupBy("bins", "label").agg(F.count("*").alias("n"))
    rows = rows.withColumn("id", F.xxhash64("bins", F.lit(settings.seed)))
    return rows.withColumn("held", F.pmod("id", F.lit(1 << 20)) < int(settings.held_share * (1 << 20))).withColumn("margin", F.lit(0.0))


_KINDS = {"bins": np.int16, "label": np.int8, "n": np.int64, "id": np.int64, "held": np.bool_, "margin": np.float64}
BLOCKS = ", ".join(f"{name} binary" for name in _KINDS)


@dataclass
class Block:
    """Merged rows as arrays; ``bins`` has a row for each feature."""

    bins: np.ndarray
    label: np.ndarray
    n: np.ndarray
    id: np.ndarray
    held: np.ndarray
    margin: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, width: int) -> Block:
        """From a batch of merged rows."""
        bins = np.ascontiguousarray(batch.column("bins").flatten().to_numpy().reshape(-1, width).T)
        return Block(bins, *[batch.column(c).to_numpy(zero_copy_only=False) for c in list(_KINDS)[1:]])

    def pack(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: [getattr(self, name).astype(kind).tobytes()] for name, kind in _KINDS.items()})

    @staticmethod
    def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in _KINDS]):
                bins, *rest = (np.frombuffer(x.as_py(), kind) for x, kind in zip(row, _KINDS.values()))
                yield Block(bins.reshape(width, -1), *rest)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Merged rows as blocks, one an Arrow batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield Block.of(batch, width).pack()

    return rows.mapInArrow(pack, BLOCKS)


def _margins(block: Block, recent: list[tuple[np.ndarray, Callable]]) -> np.ndarray:
    out = block.margin.copy()
    for value, walk in recent:
        out += value[walk(block.bins)]
    return out


def _drawn(ids: np.ndarray, turn: int, share: float) -> np.ndarray:
    """The rows of a round: the same ones in each of its levels."""
    mixed = (ids.view(np.uint64) ^ np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return weight * (p - label), weight * p * (1 - p)


def histograms(
    rows: DataFrame, width: int, bins: int, recent: list[Tree], tree: Tree, nodes: list[int], ratio: float, settings: Settings, turn: int,
) -> tuple[dict[int, np.ndarray], float, int]:
    """Per open node an array (feature, bin, [gradient, hessian]) in units; log loss and number of the held rows.

    At most nodes x features x bins rows come back.
    """
    slots, first = len(nodes) * width * bins, turn >= 0

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, loss, count = np.zeros((2, slots)), 0.0, 0
        place_of = np.full(len(tree.value), -1)
        place_of[nodes] = np.arange(len(nodes))
        walks, walk = [(t.value, t.walker()) for t in recent], tree.walker()
        for block in Block.unpacked(batches, width):
            margin, n, y, held = _margins(block, walks), block.n, block.label, block.held
            loss += float((n * np.logaddexp(0, np.where(y == 1, -margin, margin)))[held].sum())
            count += int(n[held].sum())
            place = place_of[walk(block.bins)]
            use = ~held & (place >= 0)
            if first:
                use &= _drawn(block.id, turn + settings.seed * 100_003, settings.row_share)
            g, h = gradients(margin[use], y[use], n[use] * np.where(y[use] == 1, ratio, 1.0))
            at = place[use] * width * bins
            for f in range(width):
                slot = at + (f * bins + block.bins[f][use])
                totals[0] += np.bincount(slot, g, slots)
                totals[1] += np.bincount(slot, h, slots)
        some = np.flatnonzero(totals.any(axis=0))
        whole = np.rint(totals[:, some] / UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(whole[0], round(loss / UNIT)), pa.int64()),
             pa.array(np.append(whole[1], count), pa.int64())], ["slot", "g", "h"]
        )

    sums = rows.mapInArrow(summed, "slot bigint, g bigint, h bigint").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    flat, loss, count = np.zeros((slots, 2), np.int64), 0.0, 0
    for r in sums.collect():
        if r.slot < 0:
            loss, count = r.g * UNIT, r.h
        else:
            flat[r.slot] = r.g, r.h
    parts = flat.reshape(len(nodes), width, bins, 2)
    return {node: parts[i] for i, node in enumerate(nodes)}, loss, count


def best_split(hist: np.ndarray, columns: list[int], settings: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left); ties go to the first feature and bin."""
    total = hist[columns[0]].sum(axis=0) * UNIT

    def score(g, h):
        return g * g / (h + settings.penalty)

    best = None
    for f in columns:
        left = np.cumsum(hist[f], axis=0)[:-1] * UNIT
        right = total - left
        gain = score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - score(*total)
        gain[np.minimum(left[:, 1], right[:, 1]) < settings.least_hessian] = 0
        cut = int(gain.argmax())
        # A split that gains no more than the unit's rounding is none.
        if gain[cut] > 1e-6 and (best is None or gain[cut] > best[0]):
            best = float(gain[cut]), f, cut
    return best


def _grown(rows: DataFrame, width: int, bins: int, recent: list[Tree], ratio: float, settings: Settings, turn: int) -> tuple[Tree, float, int]:
    """The next tree, and the held rows' loss before it."""
    columns = sorted(random.Random(f"{settings.seed}:{turn}").sample(range(width), max(1, round(settings.column_share * width))))
    tree, nodes, loss, count = Tree.empty(settings.depth), [0], 0.0, 0
    for level in range(settings.depth):
        found, l, c = histograms(rows, width, bins, recent, tree, nodes, ratio, settings, turn)
        if not level:
            loss, count = l, c
            g, h = found[0][columns[0]].sum(axis=0) * UNIT
            tree.value[0] = -settings.step * g / (h + settings.penalty)
        fresh = []
        for node, hist in found.items():
            split = best_split(hist, columns, settings)
            if split is None:
                continue
            _, tree.feature[node], tree.cut[node] = split
            total, left = hist[split[1]].sum(axis=0) * UNIT, hist[split[1]][: split[2] + 1].sum(axis=0) * UNIT
            for child, (g, h) in ((2 * node + 1, left), (2 * node + 2, total - left)):
                tree.value[child] = -settings.step * g / (h + settings.penalty)
                fresh.append(child)
        nodes = fresh
        if not nodes:
            break
    return tree, loss, count


def fit(
    train: DataFrame, columns: list[str], label: str = "label", settings: Settings = Settings(), bins: int = BINS,
    edges: list[np.ndarray] | None = None,
) -> Boosted:
    """Trees for a 0/1 label, positives weighted by negatives per positive.

    Rounds end at ``settings.rounds`` or once ``patience`` rounds in a row brought the held rows' log
    loss no lower; the prefix with the lowest loss is kept. Without held rows all rounds are kept.
    ``edges`` stand in for quantiles, which are approximate and follow the layout of ``train``; with
    the same edges the trees are the same on any layout.
    """
    ratio = positive_weight(train, label)
    edges = bin_edges(train, columns, bins) if edges is None else edges
    bins = max(map(len, edges)) + 2
    merged = materialize(merged_rows(train, columns, edges, label, settings), "merged")
    count = merged.count()
    tasks = -(-count // ROWS_PER_TASK) or 1
    # As many tasks as the rows need, and every core of a small session.
    spread, width = merged.repartition(max(tasks, train.sparkSession.sparkContext.defaultParallelism)), len(columns)
    rows = materialize(packed(spread, width), "binned")
    discard(merged)
    refresh = min(REFRESH, max(REFRESH_LARGE, REFRESH * SMALL_ROWS // max(count, 1)))
    model, recent, best = Boosted(columns, edges, []), [], (math.inf, 0)
    for turn in range(settings.rounds + 1):
        if turn == settings.rounds:
            if settings.held_share:
                _, loss, count = histograms(rows, width, bins, recent, Tree.empty(settings.depth), [], ratio, settings, turn)
        else:
            tree, loss, count = _grown(rows, width, bins, recent, ratio, settings, turn)
        if settings.held_share and count:
            model.losses.append(loss / count)
            if loss < best[0]:
                best = loss, turn
            if turn - best[1] >= settings.patience:
                break
        if turn == settings.rounds:
            break
        model.trees.append(tree)
        model.rounds += 1
        recent.append(tree)
        if len(recent) >= refresh:
            rows = _refreshed(rows, width, recent)
            recent = []
    discard(rows)
    if model.losses:
        model.trees = model.trees[: best[1]]
    return model


def _refreshed(rows: DataFrame, width: int, recent: list[Tree]) -> DataFrame:
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [(t.value, t.walker()) for t in recent]
        for block in Block.unpacked(batches, width):
            block.margin = _margins(block, walks)
            yield block.pack()

    out = materialize(rows.mapInArrow(moved, BLOCKS), "binned")
    discard(rows)
    return out


def scored(model: Boosted, df: DataFrame, label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, label, score)"""

    @F.pandas_udf("double")
    def probability(bins: pd.Series) -> pd.Series:
        x = np.stack(bins.to_numpy()) if len(bins) else np.zeros((0, len(model.features)), np.int16)
        return pd.Series(1.0 / (1.0 + np.exp(-model.margins(x))))

    bins = F.array(*[bin_of(c, e) for c, e in zip(model.features, model.edges)])
    return df.select(*(keep or []), F.col(label).cast("int").alias("label"), probability(bins).alias("score"))


def first_histogram(df: DataFrame, columns: list[str], edges: list[np.ndarray], label: str = "label") -> DataFrame:
    """Rows, gradient and hessian sums per ``feature`` and ``bin`` before the first tree, where every margin is 0."""
    ratio = positive_weight(df, label)
    weight = F.when(F.col(label) == 1, F.lit(ratio)).otherwise(1.0)
    binned = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c, e).cast("int").alias("bin")) for c, e in zip(columns, edges)]))
    rows = df.select(F.col(label).cast("int").alias("y"), weight.alias("w"), binned.alias("b"))
    return rows.groupBy("b.feature", "b.bin").agg(
        F.count("*").alias("rows"), F.sum(F.col("w") * (0.5 - F.col("y"))).alias("gradient"), F.sum(F.col("w") * 0.25).alias("hessian")
    )
