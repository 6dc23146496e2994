"""Boosted trees against a plain Python version."""

import math
import random

import numpy as np

from tracewright.operators import boosting
from tracewright.plans import learning

COLUMNS = ["a", "b", "c"]


def plain_bins(value, edges):
    return 0 if value is None or math.isnan(value) else 1 + sum(e < value for e in edges)


def plain_trees(rows, labels, edges, ratio, settings, turns):
    """Trees as nested tuples (feature, cut, left, right) or a value; all rows and columns take part."""
    bins = [[plain_bins(v, e) for v, e in zip(r, edges)] for r in rows]
    margin = [0.0] * len(rows)

    def grow(members, level):
        g = sum(grad[i] for i in members)
        h = sum(hess[i] for i in members)
        leaf = -settings.step * g / (h + settings.penalty)
        if level == settings.depth:
            return leaf
        best = None
        for f in range(len(edges)):
            for cut in range(len(edges[f]) + 1):
                left = [i for i in members if bins[i][f] <= cut]
                gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                if min(hl, h - hl) < settings.least_hessian:
                    continue
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-7):
                    best = gain, f, cut
        if best is None:
            return leaf
        _, f, cut = best
        left = [i for i in members if bins[i][f] <= cut]
        return f, cut, grow(left, level + 1), grow([i for i in members if bins[i][f] > cut], level + 1)

    def value(tree, b):
        while isinstance(tree, tuple):
            tree = tree[2] if b[tree[0]] <= tree[1] else tree[3]
        return tree

    out = []
    for _ in range(turns):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        w = [ratio if y else 1.0 for y in labels]
        grad = [w[i] * (p[i] - labels[i]) for i in range(len(rows))]
        hess = [w[i] * p[i] * (1 - p[i]) for i in range(len(rows))]
        out.append(grow(list(range(len(rows))), 0))
        margin = [m + value(out[-1], b) for m, b in zip(margin, bins)]
    return out, [1 / (1 + math.exp(-m)) for m in margin]


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return float(tree.value[at])
    return int(tree.feature[at]), int(tree.cut[at]), nested(tree, 2 * at + 1), nested(tree, 2 * at + 2)


def shape(tree):
    return (tree[0], tree[1], shape(tree[2]), shape(tree[3])) if isinstance(tree, tuple) else None


def table(spark, n, seed):
    random.seed(seed)
    rows = [(random.choice([None, float("nan"), *[k / 4 for k in range(30)]]), random.gauss(0, 1), float(random.randrange(5))) for _ in range(n)]
    labels = [int((r[0] or 0) > 3 and r[1] > -0.5 or random.random() < 0.1) for r in rows]
    df = spark.createDataFrame([(i, *r, y) for i, (r, y) in enumerate(zip(rows, labels))], "i int, a double, b double, c double, label int")
    return df, rows, labels


def test_trees_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df, rows, labels = table(spark, 300, 1)
    settings = boosting.Settings(rounds=5, row_share=1.0, column_share=1.0, held_share=0.0, depth=3)
    model = boosting.fit(df, COLUMNS, settings=settings, bins=12)
    ratio = labels.count(0) / labels.count(1)
    want, scores = plain_trees(rows, labels, model.edges, ratio, settings, 5)
    assert model.rounds == 5 and [shape(nested(t)) for t in model.trees] == [shape(t) for t in want]
    got = {r.i: r.score for r in boosting.scored(model, df, keep=["i"]).collect()}
    assert max(abs(got[i] - s) for i, s in enumerate(scores)) < 1e-5


def test_stop_keeps_the_best_prefix(spark):
    df, _, _ = table(spark, 2000, 2)
    settings = boosting.Settings(rounds=60, step=0.5, patience=5, held_share=0.2)
    model = boosting.fit(df, COLUMNS, settings=settings, bins=16)
    assert model.rounds < 60 and len(model.losses) == model.rounds + 1
    least = int(np.argmin(model.losses))
    assert len(model.trees) == least and model.losses[least] < 0.9 * model.losses[0]
    again = boosting.fit(df.repartition(3), COLUMNS, settings=settings, edges=model.edges)
    assert [shape(nested(t)) for t in again.trees] == [shape(nested(t)) for t in model.trees]


def test_one_class_of_values(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, k % 2) for k in range(40)], "a double, b double, c double, label int")
    model = boosting.fit(df, COLUMNS, settings=boosting.Settings(rounds=3, held_share=0.0))
    assert all(t.feature[0] == -1 for t in model.trees)
    assert {round(r.score, 6) for r in boosting.scored(model, df).collect()} == {0.5}


def test_flow_query(spark, sf_dir):
    row = learning.fit_flow_boosted_trees(spark, sf_dir).first()
    assert 0 < row["trees"] <= row["rounds"] <= 1000


def test_tree_ends_are_looked_up_as_they_are_walked():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 9, (500, 3)).astype(np.int16)
    for depth in (1, 3, 5):
        tree = boosting.Tree.empty(depth)
        inner = (1 << depth) - 1
        tree.feature[:inner], tree.cut[:inner] = rng.integers(0, 3, inner), rng.integers(0, 8, inner)
        tree.feature[1:3] = tree.feature[1:3] if depth > 3 else -1
        assert (tree.walker()(np.ascontiguousarray(bins.T)) == tree._walked(bins)).all()


def test_margins_of_many_rows_are_written_sooner(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.random(), rng.random(), rng.random(), int(rng.random() < 0.4)) for _ in range(300)], [*COLUMNS, "label"])
    settings, written = boosting.Settings(rounds=20, held_share=0.0), []
    refreshed = boosting._refreshed
    monkeypatch.setattr(boosting, "_refreshed", lambda rows, width, recent: written.append(len(recent)) or refreshed(rows, width, recent))
    seldom = boosting.fit(df, COLUMNS, settings=settings)
    assert written == []
    monkeypatch.setattr(boosting, "SMALL_ROWS", 10)
    often = boosting.fit(df, COLUMNS, settings=settings, edges=seldom.edges)
    assert written == [8, 8]
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(seldom.trees, often.trees))
