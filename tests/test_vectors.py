import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.operators import aggregate as A


@pytest.mark.parametrize("eps,mode,scale", [(1e-8, "max", 5.0), (1.0, "add", 6.0), (1e-12, "add", 5.0)])
def test_normalise_variants_and_zero_vector(spark, eps, mode, scale):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    rows = df.orderBy("id").select(V.l2_normalize(F.col("v"), eps, mode).alias("u")).collect()
    assert rows[0]["u"] == pytest.approx([3 / scale, 4 / scale])
    assert rows[1]["u"] == [0.0, 0.0]


def test_unknown_mode_is_an_error():
    with pytest.raises(ValueError):
        V.l2_normalize(F.lit(0), mode="other")


def test_simplex_projection(spark):
    df = spark.createDataFrame([(1, [-1.0, 0.0, 0.0]), (2, [2.0, -1.0, 2.0])], "id int, w array<double>")
    rows = df.orderBy("id").select(V.project_simplex(F.col("w")).alias("w")).collect()
    assert rows[0]["w"] == pytest.approx([1 / 3] * 3)
    assert rows[1]["w"] == pytest.approx([0.5, 0.0, 0.5])


def test_rank_weights_and_seeds(spark):
    row = spark.range(1).select(V.rank_weights(3).alias("w"), V.parse_seeds(F.lit(" 0,1, 2")).alias("s")).first()
    raw = np.log(3.5) - np.log([1, 2, 3])
    assert row["w"] == pytest.approx(raw / raw.sum())
    assert row["s"] == [0, 1, 2]


@pytest.mark.parametrize("agg,fold", [("mean", np.mean), ("max", np.max), ("sum", np.sum)])
def test_group_vectors_with_a_hot_group_and_small_batches(spark, agg, fold):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(900) < 0.4, 7, rng.integers(0, 60, 900))
    x = rng.normal(size=(900, 3))
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x)], "k int, vec array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["k"]: (r["n"], r["vec"]) for r in A.aggregate_vectors(df, "k", agg, count=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(keys.tolist())
    for k, (n, v) in got.items():
        assert n == (keys == k).sum()
        assert v == pytest.approx(fold(x[keys == k], axis=0))


def test_group_by_two_string_keys_with_null(spark):
    df = spark.createDataFrame(
        [("a", None, [1.0]), ("a", None, [3.0]), ("a", "x", [5.0]), ("b", "x", [7.0])], "p string, q string, vec array<double>"
    )
    got = {(r["p"], r["q"]): r["vec"][0] for r in A.aggregate_vectors(df, ["p", "q"]).collect()}
    assert got == {("a", None): 2.0, ("a", "x"): 5.0, ("b", "x"): 7.0}


def test_bad_vectors_are_errors(spark):
    ragged = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        A.aggregate_vectors(ragged, "k").collect()
    with pytest.raises(ValueError, match="unknown aggregation"):
        A.aggregate_vectors(ragged, "k", "median")


def test_gram_sketch_and_case_gradient(spark, vectors):
    ids, x, df = vectors(50, 6)
    assert A.gram_array(df) == pytest.approx(x.T @ x)
    table = spark.createDataFrame([(i, (i * 2 + 1) % 4, 1.0 if i % 3 else -1.0) for i in range(6)], "dim int, bucket int, sign double")
    want = np.zeros((50, 4))
    for i in range(6):
        want[:, (i * 2 + 1) % 4] += x[:, i] * (1.0 if i % 3 else -1.0)
    got = {r["item_id"]: r["vec"] for r in A.countsketch(df, 4, hash_table=table).collect()}
    assert np.array([got[i] for i in ids]) == pytest.approx(want)
    slices = df.withColumn("subject_id", F.col("item_id") % 3)
    cases = {r["subject_id"]: r["vec"] for r in A.case_gradient(slices, 4, hash_table=table).collect()}
    assert cases[1] == pytest.approx(want[1::3].mean(axis=0))


def test_hashed_sketch_keeps_inner_products_on_average(vectors):
    _, x, df = vectors(40, 64, seed=3)
    got = sorted(A.countsketch(df, 32, seed=5).collect(), key=lambda r: r["item_id"])
    y = np.array([r["vec"] for r in got])
    assert abs((y @ y.T - x @ x.T).mean()) < 0.2 * (x**2).sum(axis=1).mean()


def test_case_embedding_has_unit_length(spark, vectors):
    _, _, df = vectors(20)
    rows = A.case_embedding(df.withColumn("subject_id", F.col("item_id") % 4)).collect()
    assert [np.linalg.norm(r["vec"]) for r in rows] == pytest.approx([1.0] * 4)


def test_mean_pool_orders_channels(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 2, 5.0), (1, 10, 3.0)], "s int, channel int, value double")
    assert A.mean_pool(df, ["s"]).first()["vec"] == [5.0, 2.0]


def test_rank_weight_rows_of_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(V, "PLACES", 7)
    sizes = spark.createDataFrame([(1, 23), (None, 3), (2, 0)], "site int, mu long")
    got = {}
    for r in V.rank_weight_rows(sizes, ["site"]).collect():
        got.setdefault(r["site"], {})[r["dim"]] = r["value"]
    assert set(got) == {1, None}
    for site, mu in ((1, 23), (None, 3)):
        raw = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
        assert [got[site][i] for i in range(mu)] == pytest.approx((raw / raw.sum()).tolist())
