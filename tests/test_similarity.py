import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators.similarity import (
    exp_mass,
    exp_weighted,
    max_similarity,
    nearest_items,
    sum_positive,
    sum_similarity,
    with_similarity,
)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


MEASURES = [max_similarity(), sum_similarity(), sum_positive(), exp_mass(4.0), exp_weighted(4.0)]

PLANS = {
    "right side shipped": {},
    "left side shipped": {"broadcast_bytes": 40 * 30},
    "blocks": {"broadcast_bytes": 40, "block_bytes": 300},
}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("text_ids", [False, True])
def test_every_plan_gives_the_same_numbers(vectors, plan, text_ids):
    ids = [f"left-{i:03d}" for i in range(30)] if text_ids else None
    names, x, left = vectors(30, ids=ids)
    _, y, right = vectors(90, seed=1)
    s = unit(x) @ unit(y).T
    want = np.stack([
        s.max(1), s.sum(1), np.maximum(s, 0).sum(1), np.exp(4 * (s - 1)).sum(1), (np.exp(4 * (s - 1)) * s).sum(1)
    ], axis=1)
    got = {r[0]: tuple(r)[1:] for r in with_similarity(left, right, MEASURES, **PLANS[plan]).collect()}
    assert np.array([got[n] for n in names]) == pytest.approx(want)


@pytest.mark.parametrize("plan", PLANS)
def test_weights_and_carried_columns(vectors, plan):
    names, x, left = vectors(30)
    _, y, right = vectors(90, seed=1)
    right = right.withColumn("w", F.col("item_id") * 0.5)
    got = with_similarity(
        left.withColumn("site", F.col("item_id") % 3), right, [exp_mass(2.0, "m")], weight="w", keep=["site"], **PLANS[plan]
    ).collect()
    want = (np.exp(2 * (unit(x) @ unit(y).T - 1)) * np.arange(90) * 0.5).sum(1)
    assert len(got) == 30
    for r in got:
        assert r["m"] == pytest.approx(want[r["item_id"]]) and r["site"] == r["item_id"] % 3


@pytest.mark.parametrize("plan", ["right side shipped", "blocks"])
def test_nearest_items_with_many_copies(vectors, plan):
    names, x, pool = vectors(60, copies=25)
    _, y, queries = vectors(7, seed=2)
    queries = queries.withColumnRenamed("item_id", "query_id")
    s = np.round(unit(y) @ unit(x).T, 12)
    got = {}
    for r in nearest_items(queries, pool, 9, exclude=[3, 4, 59], **PLANS[plan]).collect():
        got.setdefault(r["query_id"], {})[r["position"]] = r["item_id"]
    for q in range(7):
        order = [i for i in np.lexsort((np.arange(60), -s[q])) if i not in (3, 4, 59)][:9]
        assert [got[q][p] for p in range(1, 10)] == order


def test_empty_query_is_an_error(spark, vectors):
    _, _, pool = vectors(5)
    with pytest.raises(ValueError, match="empty"):
        with_similarity(pool, pool.filter("item_id < 0"), [max_similarity()])


@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 100, "block_bytes": 30_000}])
def test_nearest_items_of_more_queries_than_a_slice(vectors, plan):
    q_ids, q, queries = vectors(1100, seed=1)
    p_ids, p, pool = vectors(60, seed=2, copies=9)
    found = nearest_items(queries.withColumnRenamed("item_id", "query_id"), pool, 5, **plan)
    got = {(r["query_id"], r["position"]): r["item_id"] for r in found.collect()}
    sims = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (p / np.linalg.norm(p, axis=1)[:, None]).T, 12)
    assert got == {(i, k + 1): int(at) for i in q_ids for k, at in enumerate(np.lexsort((p_ids, -sims[i]))[:5])}
