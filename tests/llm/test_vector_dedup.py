"""Near vectors against brute force."""

import numpy as np
import pytest

from gleaner.llm import vector_dedup


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 40])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "SHARD", 100)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([centers[rng.integers(0, 30, 300)] + rng.normal(size=(300, 16)) * 0.25, rng.normal(size=(200, 16)), np.tile(centers[:1], (40, 1))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [1.0, 2.0], 1), (906, [], 1), (None, rows[0][1], 1), (2, rows[2][1], 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    top = np.arange(len(x))
    while True:
        new = np.minimum(top, np.where(near, top[None, :], len(x)).min(axis=1))
        if (new == top).all():
            break
        top = new
    got = vector_dedup.near_vectors(vectors).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.vec_id: r for r in got}
    total = sum(found[i].n_links for i in range(len(x)))
    assert total <= near.sum() and total >= 0.99 * near.sum()
    assert np.mean([found[i].component_id == top[i] for i in range(len(x))]) > 0.99
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(900, 907))
    assert found[None].component_id is None
    assert vector_dedup.near_vectors(vectors.limit(0)).collect() == []


def test_pruned_neighbours_are_diverse():
    x = vector_dedup.unit(np.random.default_rng(1).normal(size=(300, 8)))
    near = vector_dedup.robust_prune(x)
    assert near.shape == (300, vector_dedup.DEGREE)
    nearest = np.argsort(-(x @ x.T), axis=1)[:, 1]
    assert (near[:, 0] == nearest).all()
    met = vector_dedup.range_search(x, x, near, 0.9)
    true = x @ x.T >= 0.9
    assert (met & true).sum() >= 0.99 * true.sum() and not (met & ~true).any()
