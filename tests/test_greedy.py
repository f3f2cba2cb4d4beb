import numpy as np
import pytest

from gleaner.operators import facility as FL
from gleaner.operators import greedy as G


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, score, budget, start=()):
    """Plain greedy: every step scores every item."""
    picks = list(start)
    while len(picks) < min(budget, len(x)):
        s = np.round(score(picks), 12)
        s[picks] = -np.inf
        picks.append(int(np.lexsort((np.arange(len(x)), -s))[0]))
    return picks


def dist(x, picks):
    return np.linalg.norm(x[:, None, :] - x[picks][None, :, :], axis=2)


def ids(picks):
    return [p.item for p in picks]


@pytest.mark.parametrize("candidates", [3, 1000])
@pytest.mark.parametrize("copies", [0, 30])
def test_farthest_first(vectors, candidates, copies):
    _, x, df = vectors(80, copies=copies)
    anchor = np.full(5, 0.3)
    want = brute(x, lambda p: dist(x, p).min(1) if p else -np.linalg.norm(x - anchor, axis=1), 30)
    assert ids(G.greedy(df, G.FarthestFirst(anchor), 30, candidates=candidates)) == want


@pytest.mark.parametrize("candidates", [1, 4, 1000])
def test_residual_rule_proves_picks_by_its_slack(vectors, candidates):
    _, x, df = vectors(120, 6, seed=4)
    u, aim = unit(x), np.ones(6)

    def refit(picked):
        a = np.stack(picked).T
        w = np.linalg.lstsq(a, aim, rcond=None)[0]
        return aim - a @ w, w

    def score(p):
        return u @ (refit(list(u[p]))[0] if p else aim)

    rule = G.ResidualMatching(aim, refit, G.unit(1e-12, "max"))
    assert ids(G.greedy(df, rule, 5, candidates=candidates)) == brute(u, score, 5)


def test_other_rules(vectors):
    _, x, df = vectors(60, seed=5)
    u, target = unit(x), np.full(5, 0.2)
    first = G.Pick(0, x[0], 0.0)
    assert ids(G.greedy(df, G.DistanceSum([x[0]]), 10, [first])) == brute(x, lambda p: dist(x, p).sum(1), 10, [0])
    first = G.Pick(0, u[0], 0.0)
    assert ids(G.greedy(df, G.LeastAligned([u[0]]), 10, [first])) == brute(u, lambda p: -np.abs(u @ u[p].T).min(1), 10, [0])
    means = lambda p: -np.linalg.norm((x[p].sum(0) + x) / (len(p) + 1) - target, axis=1)
    assert ids(G.greedy(df, G.MeanMatching(target), 10)) == brute(x, means, 10)


def test_pool_ends_before_the_budget(vectors):
    _, _, df = vectors(4, copies=4)
    assert sorted(ids(G.greedy(df, G.FarthestFirst(np.zeros(5)), 9))) == [0, 1, 2, 3]


def test_text_ids_tie_to_the_lowest(vectors):
    _, _, df = vectors(6, ids=list("fbdace"), copies=6)
    assert ids(G.greedy(df, G.FarthestFirst(np.zeros(5)), 3)) == ["a", "b", "c"]


def coverage(x, budget, clip=True, cap=None, first=None):
    u = unit(x)
    k = u @ u.T
    k = np.maximum(k, 0) if clip else k
    if cap is not None:
        k = np.minimum(k, cap[:, None])
    picks = [] if first is None else [first]
    while len(picks) < budget:
        m = k[:, picks].max(1) if picks else np.zeros(len(x))
        gain = np.round(np.maximum(k - m[:, None], 0).sum(0), 9)
        gain[picks] = -np.inf
        picks.append(int(np.lexsort((np.arange(len(x)), -gain))[0]))
    return picks


@pytest.mark.parametrize("blocks", [(2048, 512, 2048, 64 << 20), (8, 3, 5, 1)])
@pytest.mark.parametrize("copies", [0, 25])
def test_facility_location_equals_plain_greedy(vectors, monkeypatch, blocks, copies):
    for name, value in zip(("READ_BLOCK", "EVALUATE_FIRST", "EVALUATE_MOST"), blocks):
        monkeypatch.setattr(FL, name, value)
    _, x, df = vectors(40, copies=copies // 2, seed=6)
    df = df.persist()
    got = FL.facility_location(df, 4, remembered_bytes=blocks[3])
    assert ids(got) == coverage(x, 4)
    gains = [p.gain for p in got]
    assert gains == sorted(gains, reverse=True)
    assert ids(FL.facility_location(df, 4, first=2, remembered_bytes=blocks[3])) == coverage(x, 4, clip=False, first=2)


def test_facility_location_with_caps_and_whole_pool(spark, vectors):
    _, x, df = vectors(30, seed=7)
    cap = np.linspace(0.1, 0.9, 30)
    rows = [(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, cap))]
    capped = spark.createDataFrame(rows, "item_id bigint, vec array<double>, cap double")
    assert ids(FL.facility_location(capped, 5, cap="cap")) == coverage(x, 5, cap=cap)
    everything = FL.facility_location(df, 99)
    assert sorted(ids(everything)) == list(range(30))


def test_a_pass_without_a_bound_brings_one_candidate(vectors, monkeypatch):
    """Until all items that are left can be sent at once; the picks are those of full passes."""
    _, x, df = vectors(60, seed=8)
    limits, scan = [], G.scan_top
    monkeypatch.setattr(G, "scan_top", lambda pool, scorer, limit, *a, **b: limits.append(limit) or scan(pool, scorer, limit, *a, **b))
    picks = G.greedy(df, G.DistanceSum([x[0]]), 55, [G.Pick(0, x[0], 0.0)], candidates=10)
    assert limits[0] == 10 and set(limits[1:-1]) == {1} and limits[-1] == 10
    total, left, want = np.linalg.norm(x - x[0], axis=1), set(range(1, 60)), [0]
    while len(want) < 55:
        want.append(max(left, key=lambda i: (round(total[i], 12), -i)))
        left.remove(want[-1])
        total = total + np.linalg.norm(x - x[want[-1]], axis=1)
    assert [p.item for p in picks] == want
