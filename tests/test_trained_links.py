"""Factors of context pairs: one update against numpy, and what they are good for."""

import numpy as np
import pytest

from tracewright.operators import links


@pytest.fixture(scope="module")
def split(spark):
    """Two communities with many pairs inside and few between."""
    rng = np.random.default_rng(3)
    pairs = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.4 if a // 30 == b // 30 else 0.02)}
    return links.split_pairs(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).persist()


def test_last_update_solves_the_weighted_squares(split):
    context = links.context_pairs(split, "test")
    weight, strength = 10.0, 0.1
    rows = links.trained_embeddings(context, rank=6, rounds=4, strength=strength, weight=weight).collect()
    sender = {r.node_id: np.array(r.sender) for r in rows}
    receiver = np.array([r.receiver for r in rows])
    place = {r.node_id: i for i, r in enumerate(rows)}
    known = [(r.a, r.b) for r in context.collect()]
    known += [(b, a) for a, b in known]
    for node in list(sender)[:20]:
        near = receiver[[place[b] for a, b in known if a == node]]
        left = receiver.T @ receiver + weight * near.T @ near + strength * len(near) * np.eye(6)
        want = np.linalg.solve(left, (1 + weight) * near.sum(axis=0))
        assert np.abs(want - sender[node]).max() < 1e-3


def test_held_out_pairs_rank_high(split):
    targets = links.link_targets(split, 60, "test").persist()
    report = links.reconstruction_report(links.trained_scores(split, targets, 60, rank=6)).first()
    assert report["roc_auc"] > 0.65 and report["mean_positive_probability"] > report["mean_negative_probability"]


def test_nodes_without_pairs_have_no_affinity(spark, split):
    pairs = spark.createDataFrame([(1, 1000), (2, 3)], "a bigint, b bigint")
    found = {r.b: r.affinity for r in links.affinity(pairs, links.trained_embeddings(links.context_pairs(split, "test"), 4, 2)).collect()}
    assert found[1000] == 0 and found[3] != 0
