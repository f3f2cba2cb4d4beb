from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import selection as M


def ranking(result):
    return [r["item_id"] for r in result.ranking.orderBy("rank").collect()]


def scores(result):
    return {r["item_id"]: r["score"] for r in result.scores.collect()}


@pytest.fixture(scope="module")
def data(vectors):
    _, x, pool = vectors(60, 6, seed=8)
    _, y, query = vectors(8, 6, seed=9)
    return x, pool.persist(), y, query.persist()


def test_registry_and_missing_inputs(data):
    _, pool, _, _ = data
    assert {"random", "kcenter", "herding", "kmeans", "diversity", "rds", "less", "gradmatch", "craig", "craig_proxy", "orient"} <= set(M.methods())
    with pytest.raises(ValueError, match="available"):
        M.get_method("nope")
    with pytest.raises(ValueError, match="query_grads"):
        M.select("less", 3, pool_grads=pool)
    with pytest.raises(ValueError, match="gradmatch needs"):
        M.score_all(["random", "gradmatch"], 3, pool=pool)


def test_every_method_scores_the_whole_pool_with_picks_first(data):
    _, pool, _, query = data
    inputs = {"pool": pool, "query": query, "pool_grads": pool, "query_grads": query}
    options = {"kmeans": {"n_init": 1, "max_iter": 5}}
    for name in M.methods():
        result = M.select(name, 5, **inputs, **options.get(name, {}))
        picked, all_scores = ranking(result), scores(result)
        assert len(picked) == len(set(picked)) == 5, name
        assert len(all_scores) == 60, name
        if name not in ("craig_proxy", "orient"):
            worst = min(all_scores[i] for i in picked)
            assert worst > max(v for i, v in all_scores.items() if i not in picked), name


def test_line_fixture(spark):
    pool = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 1, 2, 10])], "item_id bigint, vec array<double>")
    query = spark.createDataFrame([(0, [-1.0]), (1, [1.0])], "item_id bigint, vec array<double>")
    assert ranking(M.kcenter_query(pool, query, 3)) == [0, 3, 2]


def test_budget_above_the_pool_and_duplicates(spark):
    pool = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "item_id bigint, vec array<double>")
    for run in (M.kcenter_pool(pool, 9), M.diversity_distsum(pool, 9), M.diversity_cosine(pool, 9), M.rds_round_robin(pool, pool, 9),
                M.kcenter_query(pool, pool, 9), M.herding(pool, pool, 9), M.random_select(pool, 9)):
        assert sorted(ranking(run)) == [0, 1, 2, 3], run.method


def robin(x, y, budget):
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    s, picks = v @ u.T, []
    while len(picks) < min(budget, len(x)):
        row = s[len(picks) % len(y)].copy()
        row[picks] = -np.inf
        picks.append(int(row.argmax()))
    return picks


@pytest.mark.parametrize("budget", [3, 20, 60])
def test_round_robin(data, budget):
    x, pool, y, query = data
    assert ranking(M.rds_round_robin(pool, query, budget)) == robin(x, y, budget)


def test_round_robin_when_all_queries_want_the_same_items(spark, vectors):
    _, x, pool = vectors(60, 6, seed=8)
    y = np.tile(x[:1], (12, 1)) + np.random.default_rng(0).normal(scale=1e-3, size=(12, 6))
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "item_id bigint, vec array<double>")
    assert ranking(M.rds_round_robin(pool, query, 50)) == robin(x, y, 50)


@pytest.mark.parametrize("rows", [1, 7, 40])
def test_round_robin_reads_lists_block_by_block(spark, vectors, monkeypatch, rows):
    monkeypatch.setattr(M, "LIST_ROWS", rows)
    _, x, pool = vectors(60, 6, seed=9)
    _, y, query = vectors(11, 6, seed=10)
    assert ranking(M.rds_round_robin(pool, query, 35)) == robin(x, y, 35)


def test_nonnegative_fit_against_all_supports():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.normal(size=(7, 5)), rng.normal(size=7)
        best = float(b @ b)
        for k in range(1, 6):
            for cols in combinations(range(5), k):
                w = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
                if (w >= 0).all():
                    best = min(best, float(((b - a[:, cols] @ w) ** 2).sum()))
        w = M.nonnegative_fit(a, b)
        assert (w >= 0).all()
        assert ((b - a @ w) ** 2).sum() == pytest.approx(best)


def test_nonnegative_matching_pursuit(data):
    x, pool, y, query = data
    aim, picks = y.mean(0), []
    residual, gains = aim, []
    while len(picks) < 6:
        corr = np.round(x @ residual, 12)
        corr[picks] = -np.inf
        picks.append(int(corr.argmax()))
        a = x[picks].T
        new = aim - a @ M.nonnegative_fit(a, aim)
        gains.append(residual @ residual - new @ new)
        residual = new
    got = M.gradmatch_nnls(pool, query, 6).ranking.orderBy("rank").collect()
    assert [r["item_id"] for r in got] == picks
    assert [r["gain"] for r in got] == pytest.approx(gains)


def test_low_rank_matching_against_svd(data):
    x, pool, y, query = data
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    proj, residual, picks = (u * s)[:, :3], vt[:3] @ y.mean(0), []
    while len(picks) < 4:
        c = np.round(proj @ residual, 9)
        c[picks] = -np.inf
        picks.append(int(c.argmax()))
        p = proj[picks[-1]]
        residual = residual - (p @ residual) / (p @ p) * p
    assert ranking(M.less_lowrank(pool, query, 4, rank=3)) == picks


def test_omp_weights_are_the_clipped_fit(data):
    x, pool, y, query = data
    rows = M.gradmatch_omp(pool, query, 4).ranking.orderBy("rank").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    aim = y.mean(0) / (np.linalg.norm(y.mean(0)) + 1e-8)
    w = np.linalg.lstsq(u[[r["item_id"] for r in rows]].T, aim, rcond=None)[0]
    assert [r["weight"] for r in rows] == pytest.approx(np.maximum(w, 0))


def test_kmeans_finds_separated_groups(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, size=(n, 2)) for c, n in ((0, 5), (5, 20), (9, 9))])
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, vec array<double>")
    picked = ranking(M.kmeans_select(pool, 3, n_init=3))
    assert sorted(np.searchsorted([5, 25], picked, side="right")) == [0, 1, 2]
    by_size = M.kmeans_by_size(pool, 3, n_init=3)
    assert np.searchsorted([5, 25], ranking(by_size), side="right").tolist() == [1, 2, 0]
    assert [scores(by_size)[i] for i in ranking(by_size)] == [1.0, 0.5, 0.0]
    one = M.kmeans_by_size(pool, 1, n_init=1)
    assert scores(one)[ranking(one)[0]] == 1.0


def test_random_does_not_depend_on_partitions(data):
    _, pool, _, _ = data
    a, b = M.random_select(pool, 7, seed=3), M.random_select(pool.repartition(3), 7, seed=3)
    assert ranking(a) == ranking(b) and scores(a) == scores(b)
    assert ranking(M.random_select(pool, 7, seed=4)) != ranking(a)


def test_orient_last_pick_counts_as_unselected(data):
    _, pool, _, query = data
    result = M.orient_flmi(pool, query, 3)
    picked, found = ranking(result), scores(result)
    assert [found[i] for i in picked[:2]] == [1.0, 0.5]
    assert 0 <= found[picked[2]] <= 0.5 / 3
    assert {r[0] for r in result.scores.filter("selected").select("item_id").collect()} == set(picked)
    assert [r[0] for r in M.orient_set(pool, query, 3).collect()] == sorted(picked)


def test_slice_scores_are_averaged_per_subject(data):
    x, pool, y, query = data
    source = pool.withColumn("subject_id", F.concat(F.lit("s"), (F.col("item_id") % 4).cast("string")))
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    s = u @ v.T
    w = np.exp(20 * s)
    slice_score = (w * s).sum(1) / (w.sum(1) + 1e-8)
    got = scores(M.less_softmax(source, query))
    assert got == pytest.approx({f"s{k}": slice_score[k::4].mean() for k in range(4)})


def test_mean_similarities_that_agree_in_12_decimals_tie(spark):
    """The item with the higher id is nearer by 4e-14 only; the lowest id comes first."""
    pool = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0 + 1e-13, 1.0]), (3, [0.0, 1.0])], "item_id long, vec array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "item_id long, vec array<double>")
    assert [r["item_id"] for r in M.mean_sim_rank(pool, query).orderBy("rank").collect()] == [1, 2, 3]


def test_kmeans_fits_share_their_passes(spark, vectors, monkeypatch):
    """All fits move in one pass a step, and the result is a fixed point at the lowest of the fits' costs."""
    _, x, df = vectors(300, 3, seed=5)
    passes = []
    sums = M._cluster_sums
    monkeypatch.setattr(M, "_cluster_sums", lambda items, fits: passes.append(len(fits)) or sums(items, fits))
    got = M.kmeans_centers(df, 4, seed=1, n_init=3)
    assert passes[0] == passes[-1] == 3 and sorted(passes[:-1], reverse=True) == passes[:-1]
    near = ((x[:, None, :] - got[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.abs(np.stack([x[near == c].mean(axis=0) for c in range(4)]) - got).max() < 1e-3
