import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import shift, splits


def sited(spark, sizes, d=4, seed=0, gap=0.0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for k, (name, n) in enumerate(sizes.items()):
        center = gap * np.eye(d)[k % d]
        for v in rng.normal(size=(n, d)) + center:
            rows.append((i, name, v.tolist()))
            i += 1
    return rows, spark.createDataFrame(rows, "item_id bigint, site string, vec array<double>").repartition(3)


def unit(x):
    x = np.array(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def mmd(a, b, gamma):
    k = lambda p, q: np.exp(-gamma * (1 - unit(p) @ unit(q).T) ** 2).mean()
    return k(a, a) + k(b, b) - 2 * k(a, b)


def test_eligible_and_target_sites(spark):
    _, df = sited(spark, {"A": 6, "B": 3, "UNKNOWN": 9})
    assert {tuple(r) for r in shift.eligible_sites(df, 3).collect()} == {("A", 6), ("B", 3)}
    assert shift.target_items(df, ["B"], 3).count() == 3
    for bad in (["C"], ["UNKNOWN"], ["A", "B"]):
        with pytest.raises(ValueError):
            shift.target_items(df, bad, 4 if bad == ["A", "B"] else 0)


def test_mmd_and_centroid_distance(spark):
    rows, df = sited(spark, {"A": 20, "B": 30}, gap=1.0)
    a, b = ([r[2] for r in rows if r[1] == s] for s in "AB")
    left, right = (df.filter(F.col("site") == s) for s in "AB")
    assert shift.mmd_rbf(left, right, gamma=0.7) == pytest.approx(mmd(a, b, 0.7))
    d = 1 - unit(a + b) @ unit(a + b).T
    gaps = d[np.triu_indices(50, 1)]
    assert shift.mmd_rbf(left, right) == pytest.approx(mmd(a, b, 1 / (np.median(gaps) ** 2 + 1e-8)))
    ma, mb = np.mean(a, 0), np.mean(b, 0)
    want = 1 - ma @ mb / (np.linalg.norm(ma) + 1e-8) / (np.linalg.norm(mb) + 1e-8)
    assert shift.centroid_cosine_distance(left, right) == pytest.approx(want)


def test_mmd_takes_all_rows_whatever_the_blocks(spark, monkeypatch):
    rows, df = sited(spark, {"A": 40, "B": 61}, gap=1.0)
    a, b = ([r[2] for r in rows if r[1] == s] for s in "AB")
    d = 1 - unit(a + b) @ unit(a + b).T
    want = mmd(a, b, 1 / (np.median(d[np.triu_indices(101, 1)]) ** 2 + 1e-8))
    for block in (2000, 9):
        monkeypatch.setattr(shift, "BLOCK_ROWS", block)
        assert shift.mmd_rbf(df.filter("site = 'A'"), df.filter("site = 'B'")) == pytest.approx(want)


def test_site_against_rest_with_a_dominant_site(spark, monkeypatch):
    """One site owns most rows; given and own bandwidth."""
    rows, df = sited(spark, {"big": 80, "s1": 12, "s2": 12}, gap=0.8)
    everything = {r["site"]: r for r in shift.site_vs_rest(df, min_n=10, gamma=1.0, topk=2).collect()}
    for s in ("big", "s1", "s2"):
        a, b = [r[2] for r in rows if r[1] == s], [r[2] for r in rows if r[1] != s]
        assert everything[s]["mmd2"] == pytest.approx(mmd(a, b, 1.0))
        assert everything[s]["n"] == len(a)
    every = [r[2] for r in rows]
    d = 1 - unit(every) @ unit(every).T
    gamma = 1 / (np.median(d[np.triu_indices(len(every), 1)]) ** 2 + 1e-8)
    monkeypatch.setattr(shift, "BLOCK_ROWS", 25)
    own = {r["site"]: r["mmd2"] for r in shift.site_vs_rest(df, min_n=10).collect()}
    for s in ("big", "s1", "s2"):
        assert own[s] == pytest.approx(mmd([r[2] for r in rows if r[1] == s], [r[2] for r in rows if r[1] != s], gamma))


def test_site_to_target_orders_by_distance(spark):
    _, df = sited(spark, {"A": 30, "B": 30, "C": 30}, gap=4.0)
    target = df.filter("site = 'B'")
    got = shift.site_to_target(df, target).collect()
    assert got[0]["site"] == "B" and got[0]["centroid_dist"] == pytest.approx(0, abs=1e-7)
    assert got[0]["mmd2"] == pytest.approx(0, abs=1e-7)


def test_separability_of_distant_and_equal_sites(spark):
    _, far = sited(spark, {"A": 25, "B": 25}, gap=9.0)
    assert shift.domain_separability(far, max_iter=20).first()["accuracy_mean"] == 1.0
    _, near = sited(spark, {"A": 50, "B": 50}, gap=0.0)
    assert 0.25 < shift.domain_separability(near, max_iter=20).first()["accuracy_mean"] < 0.75
    folds = shift.separability_folds(far).groupBy("site", "fold").count().select("count").distinct().collect()
    assert folds == [(5,)]


def test_subset_profile_counts_missing(spark, vectors):
    _, x, source = vectors(40)
    _, y, target = vectors(5, seed=1)
    chosen = spark.createDataFrame([("t", i) for i in (0, 1, 2, 999)], "tag string, item_id bigint")
    row = shift.subset_profile(chosen, source, target).first()
    sim = (unit(x) @ unit(y).T).mean(1)
    rank = np.argsort(np.argsort(-sim)) + 1
    assert (row["n_selected"], row["n_found"], row["n_missing"]) == (4, 3, 1)
    assert row["rank_median"] == np.median(rank[:3])
    assert row["top50"] == pytest.approx((rank[:3] <= 20).mean())
    assert [r["item_id"] for r in shift.subset_top(chosen, source, target, 2).orderBy("place").collect()] == list(np.argsort(rank[:3])[:2])


# ------------------------------------------------------------------ splits


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(100).select(
        F.col("id").alias("subject_id"), F.when(F.col("id") < 37, "LGG").otherwise("GBM").alias("stratum")
    )


def test_three_way_split_is_disjoint_complete_and_reproducible(people):
    a = {r["subject_id"]: r["split"] for r in splits.three_way_split(people, 20, 10).collect()}
    b = {r["subject_id"]: r["split"] for r in splits.three_way_split(people.repartition(7), 20, 10).collect()}
    assert a == b and len(a) == 100
    assert [sum(v == s for v in a.values()) for s in ("train", "val", "test")] == [20, 10, 70]
    with pytest.raises(ValueError):
        splits.three_way_split(people, 80, 30)


def test_stratified_quotas(people):
    rows = splits.stratified_split(people, ["LGG", "GBM"], 60, 45).collect()
    count = lambda split, stratum: sum(r["split"] == split and r["stratum"] == stratum for r in rows)
    lgg = round(60 * 0.37)
    train = round(45 * lgg / 60)
    assert count("train", "LGG") == train and count("val", "LGG") == lgg - train
    assert count("train", "GBM") == 45 - train and count("val", "GBM") == (60 - lgg) - (45 - train)
    assert len(rows) == 100
    assert splits.stratum_quotas({"a": 1, "b": 3}, ["a", "b"], 10, 5) == {"a": (2, 1), "b": (8, 4)}


def test_random_budgets_are_nested(people):
    rows = splits.random_budgets(people.select("subject_id"), [0, 1], [1, 3], 5).collect()
    sets = {(r["seed"], r["k"]): set() for r in rows}
    for r in rows:
        sets[r["seed"], r["k"]].add(r["subject_id"])
    assert all(len(sets[s, 1]) == 5 and len(sets[s, 3]) == 15 and sets[s, 1] < sets[s, 3] for s in (0, 1))
    assert sets[0, 3] != sets[1, 3]


def test_source_pool_modes_and_sites(spark):
    m = spark.createDataFrame([("A", 1), ("B", 1), ("B", 2), ("C", 3)], "site string, subject_id int")
    assert {r[0] for r in splits.source_pool(m, ["A"], "file").collect()} == {1, 2, 3}
    assert {r[0] for r in splits.source_pool(m, ["A"], "subject").collect()} == {2, 3}
    with pytest.raises(ValueError):
        splits.source_pool(m, ["A"], "x")
    subjects = spark.createDataFrame([(1,), (4,)], "subject_id int")
    assert {tuple(r) for r in splits.attach_site(subjects, m).collect()} == {(1, "A"), (4, "UNKNOWN")}


def test_caps_and_subject_samples(spark):
    s = spark.range(100).select((F.col("id") % 3).alias("subject_id"), F.col("id").alias("slice_idx"))
    capped = splits.cap_slices(s, 5)
    assert capped.groupBy("subject_id").count().select("count").distinct().collect() == [(5,)]
    assert sorted(capped.collect()) == sorted(splits.cap_slices(s.repartition(9), 5).collect())
    assert splits.sample_subjects(s, 2).select("subject_id").distinct().count() == 2


def test_weighted_sample(spark):
    s = spark.range(400).select(F.col("id").alias("item_id"), (F.col("id") < 20).alias("is_foreground"))
    w = splits.sample_weights(s, 0.4).groupBy("is_foreground").agg(F.sum("weight").alias("w")).collect()
    assert {r[0]: r[1] for r in w} == pytest.approx({True: 0.4, False: 0.6})
    draws = splits.weighted_sample(s, 3000, seed=1, foreground_fraction=0.4)
    assert draws.count() == 3000
    assert abs(draws.filter("is_foreground").count() / 3000 - 0.4) < 0.04
    assert draws.filter("is_foreground").select("item_id").distinct().count() == 20
    only = s.filter("not is_foreground")
    assert splits.weighted_sample(only, 50).filter("is_foreground").count() == 0
    assert splits.weighted_sample(only, 50).count() == 50
    assert splits.sample_weights(only).select("weight").distinct().collect() == [(1.0,)]


def test_a_set_is_copied_no_more_often_than_it_has_few_blocks(spark, monkeypatch):
    """Blocks that fit their bytes don't grow in number with the rows."""
    _, df = sited(spark, {"A": 101})
    monkeypatch.setattr(shift, "BLOCK_ROWS", 5)
    sent = shift._block_pairs(df.select("site", "item_id", "vec"), ["site"], lambda key, t: t.select(["item_id"]), "item_id " + dict(df.dtypes)["item_id"])
    assert sent.count() == shift.BLOCKS * 101
