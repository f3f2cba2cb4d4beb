import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluate as E
from gleaner.operators import voxels as V


def image(spark, x, channels=True):
    """(case, channel, z, y, x) array as a voxel table."""
    rows = [(int(c), int(k), int(z), int(i), int(j), float(x[c, k, z, i, j])) for c, k, z, i, j in np.ndindex(*x.shape)]
    return spark.createDataFrame(rows, "subject_id int, channel int, z int, y int, x int, value double").repartition(3)


def back(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["subject_id"], r["channel"], r["z"], r["y"], r["x"]] = r["value"]
    return out


@pytest.fixture(scope="module")
def scan(spark):
    x = np.random.default_rng(0).normal(size=(2, 3, 2, 4, 5))
    x[0, 1] = np.where(x[0, 1] < 0, 0, x[0, 1])
    x[1, 2] = -1.5  # constant and without positive voxels
    return x, image(spark, x)


def test_scaling_variants(scan):
    x, df = scan
    lo, hi = x.min((1, 3, 4), keepdims=True), x.max((1, 3, 4), keepdims=True)
    assert back(V.minmax_image(df), x.shape) == pytest.approx((x - lo) / (hi - lo + 1e-8))
    lo, hi = x.min((3, 4), keepdims=True), x.max((3, 4), keepdims=True)
    scaled = np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), x)
    mean, std = (np.array(v).reshape(1, 3, 1, 1, 1) for v in (V.CHANNEL_MEAN, V.CHANNEL_STD))
    assert back(V.channel_standardize(df), x.shape) == pytest.approx((scaled - mean) / std)
    m, s = x.mean((2, 3, 4), keepdims=True), x.std((2, 3, 4), keepdims=True)
    assert back(V.zscore_channels(df, nonzero_only=False), x.shape) == pytest.approx((x - m) / np.maximum(s, 1e-8), abs=1e-5)
    want = x.copy()
    for c, k in np.ndindex(2, 3):
        p = x[c, k][x[c, k] > 0]
        if len(p):
            want[c, k] = (x[c, k] - p.mean()) / max(p.std(), 1e-8)
    assert back(V.zscore_channels(df), x.shape) == pytest.approx(want)


def test_case_zscore_defaults(spark):
    x = np.zeros((3, 2, 1, 1, 2))
    x[0] = [[[[1.0, 3.0]]], [[[5.0, 0.0]]]]
    x[1] = 4.0  # deviation 0
    got = back(V.zscore_case(image(spark, x), phases=2), x.shape)
    p = np.array([1.0, 3.0, 5.0])
    assert got[0] == pytest.approx((x[0] - p.mean()) / p.std())
    assert got[1] == pytest.approx(np.zeros_like(x[1])) and got[2] == pytest.approx(x[2])


def test_crop_and_uncrop(spark):
    x = np.zeros((2, 2, 3, 5, 6))
    x[0, 0, 1, 2, 3] = 1.0
    x[0, 1, 2, 4, 1] = -2.0
    df = image(spark, x)
    box = {r["subject_id"]: tuple(r)[1:] for r in V.nonzero_bbox(df).collect()}
    assert box == {0: (1, 3, 2, 5, 1, 4), 1: (0, 3, 0, 5, 0, 6)}
    cropped = V.crop_to_nonzero(df)
    assert cropped.filter("subject_id = 0").count() == 2 * 2 * 3 * 3
    assert back(V.uncrop(cropped, V.nonzero_bbox(df)), x.shape) == pytest.approx(x)


@pytest.mark.parametrize("out", [(3, 2), (8, 10), (5, 6)])
def test_nearest_resize(spark, out):
    x = np.arange(30.0).reshape(1, 1, 1, 5, 6)
    got = back(V.nearest_resize(image(spark, x), (5, 6), out), (1, 1, 1, *out))
    rows, cols = np.arange(out[0]) * 5 // out[0], np.arange(out[1]) * 6 // out[1]
    assert got[0, 0, 0].tolist() == x[0, 0, 0][np.ix_(rows, cols)].tolist()


def test_phase_and_replicated_channel(scan):
    x, df = scan
    one = V.select_phase(df, 1)
    assert one.count() == x[:, 1].size
    got = back(V.replicate_channel(one, 3), x.shape)
    assert all(np.allclose(got[:, k], x[:, 1]) for k in range(3))


def labels(spark, rows):
    return spark.createDataFrame(rows, "subject_id string, z int, label int")


def test_label_reports(spark):
    df = labels(spark, [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("b", 0, 2), ("b", 0, -1), ("c", 0, 4), ("c", 1, 1)])
    assert {tuple(r) for r in V.label_range(df).select("subject_id", F.col("bad_labels").cast("string")).collect()} == {("b", "[-1]"), ("c", "[4]")}
    assert {r["label"]: r["valid"] for r in V.label_values(df).collect()} == {0: True, 1: True, 2: True, -1: False, 4: False}
    fixed = V.remap_labels(df, {4: 3}, negative_to=0)
    assert sorted(r["label"] for r in fixed.collect()) == [0, 0, 0, 1, 1, 2, 3]
    assert V.remap_report(df, {4: 3}, negative_to=0).first() == (2, 2)
    assert V.remap_report(df, {-1: 0}).first() == (1, 1)
    assert V.remap_report(fixed, {4: 3}, negative_to=0).first() == (0, 0)
    row = V.slice_distribution(df).first()
    assert tuple(row)[:6] == (5, 2, 2, 1, 2, 1) and row["second_ratio"] == pytest.approx(1 / 3)
    assert V.slice_distribution(df.filter("label = 0")).first()["second_ratio"] is None
    assert {tuple(r) for r in V.negative_subjects(df).collect()} == {("a", 2), ("c", 2)}
    assert {tuple(r) for r in V.foreground_slices(df, 1).select("subject_id", "z").collect()} == {("a", 0), ("b", 0), ("c", 0), ("c", 1)}
    assert V.foreground_slices(df, 2, include_all=True).filter("is_foreground").count() == 0
    slices = df.select("subject_id", "z").distinct()
    assert V.drop_empty_slices(slices, df).count() == 4


def masks(spark, rows):
    return spark.createDataFrame(rows, "run string, subject_id string, z int, pred int, gt int")


def test_dice_modes(spark):
    df = masks(spark, [("r", "both empty", 0, 0, 0), ("r", "one empty", 0, 1, 0), ("r", "half", 0, 1, 1), ("r", "half", 1, 2, 0)])
    got = {m: {r["subject_id"]: r["dice"] for r in E.dice(df, mode=m).collect()} for m in ("plain", "smooth", "eps")}
    assert got["plain"] == pytest.approx({"both empty": 1.0, "one empty": 0.0, "half": 2 / 3})
    assert got["smooth"] == pytest.approx({"both empty": 1.0, "one empty": 1e-5 / (1 + 1e-5), "half": (2 + 1e-5) / (3 + 1e-5)})
    assert got["eps"] == pytest.approx({"both empty": 0.0, "one empty": 0.0, "half": 2 / 3})
    assert {r["subject_id"]: r["num_slices"] for r in E.dice(df).collect()}["half"] == 2
    assert E.micro_dice(df).first()["dice"] == pytest.approx(2 / 3)
    assert E.micro_dice(df, cls=7).first()["dice"] == 0.0
    board = E.run_summary(E.dice(df)).first()
    assert board["std_dice"] == pytest.approx(np.std([1, 0, 2 / 3])) and board["volume_ratio"] == 3.0


def test_region_dice(spark):
    df = masks(spark, [("r", "s", z, p, g) for z, (p, g) in enumerate(zip([0, 1, 3, 3], [0, 1, 2, 3]))])
    row = E.region_dice(df).first()
    assert (row["dice_ET"], row["dice_TC"], row["dice_WT"]) == pytest.approx((2 / 3, 1, 1))
    assert row["dice_macro"] == pytest.approx((2 / 3 + 2) / 3)
    early = E.region_dice(df, max_subjects=15).first()
    assert early["is_full_val"] and early["val_size"] == 1


def test_ensemble_undoes_mirroring(spark):
    rng = np.random.default_rng(2)
    truth = rng.normal(size=(3, 4, 5))  # class, y, x
    views = {"none": truth, "h": truth[:, :, ::-1], "v": truth[:, ::-1], "hv": truth[:, ::-1, ::-1]}
    rows = [("s", 0, int(i), int(j), int(c), a, float(v[c, i, j])) for a, v in views.items() for c, i, j in np.ndindex(3, 4, 5)]
    df = spark.createDataFrame(rows, "subject_id string, z int, y int, x int, cls int, aug string, logit double")
    got = {(r["y"], r["x"]): r["pred"] for r in E.ensemble_argmax(df, 5, 4).collect()}
    assert got == {(i, j): int(truth[:, i, j].argmax()) for i, j in np.ndindex(4, 5)}


def test_fitness_modes(spark):
    df = spark.createDataFrame([(1, [0.1, 0.5, 0.3, 0.4, 0.2]), (2, []), (3, [0.7])], "cand int, val_dices array<double>")
    got = {m: {r["cand"]: r["fitness"] for r in E.topk_fitness(df, 4, m).collect()} for m in ("median", "best", "final")}
    assert got["median"] == pytest.approx({1: 0.35, 2: float("-inf"), 3: 0.7})
    assert got["best"][1] == 0.5 and got["final"][1] == 0.2 and got["final"][2] == float("-inf")
    with pytest.raises(ValueError):
        E.topk_fitness(df, 4, "other")
    log = df.select(F.col("cand").alias("run"), F.posexplode("val_dices").alias("epoch", "val_dice"))
    for mode in ("median", "best", "final"):
        long = {r["run"]: r["fitness"] for r in E.topk_log_fitness(log, 4, mode).collect()}
        assert long == pytest.approx({k: v for k, v in got[mode].items() if k != 2})
    seeds = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 0, 9.0)], "gen int, cand int, fitness double")
    assert E.aggregate_fitness(seeds, "median").first()["fitness"] == 2.0
    assert E.aggregate_fitness(seeds).first()["fitness"] == 4.0


def test_checkpoint_choice(spark):
    log = [("r", e, v) for e, v in enumerate([1.0, 5.0, 3.0, 2.0, 2.0, 4.0, 2.0], start=1)]
    df = spark.createDataFrame(log, "run string, epoch int, val_loss double")
    pick = lambda **kw: tuple(E.pick_checkpoint(df, **kw).select("epoch", "val_loss").first())
    assert pick() == (1, 1.0)
    assert pick(larger_is_better=True) == (2, 5.0)
    assert pick(mode="best_of_last") == (4, 2.0)
    assert pick(mode="last") == (7, 2.0)
    with pytest.raises(ValueError):
        pick(mode="x")


def test_generations_logs_and_quantiles(spark):
    ev = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (1, 3, 2.0), (1, 4, 2.0)], "gen int, cand int, fitness double")
    rows = E.generation_summary(ev).collect()
    assert [(r["best_fitness"], r["mean_fitness"], r["std_fitness"], r["best_cand"], r["global_best_fitness"]) for r in rows] == [
        (3.0, 2.0, 1.0, 2, 3.0), (2.0, 2.0, 0.0, 3, 3.0)
    ]
    loss = spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, batch int")
    assert E.weighted_loss(loss).first()["loss"] == pytest.approx(1.25)
    q = E.quantile_profile(spark.range(1, 12), "id").first()
    assert tuple(q) == (1, 2.0, 3.5, 6.0, 8.5, 10.0, 11)


def test_site_distribution(spark):
    m = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "site string, subject_id int")
    s = spark.createDataFrame([(1,), (2,), (3,), (9,)], "subject_id int")
    assert {tuple(r) for r in E.site_distribution(s, m).collect()} == {("A", 2, 50.0), ("B", 1, 25.0), ("UNKNOWN", 1, 25.0)}
