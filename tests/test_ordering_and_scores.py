import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.ordering import first_rows, row_number, running_total
from gleaner.operators import scores as S


@pytest.fixture(scope="module")
def tied(spark):
    """A third of all rows share one score."""
    rng = np.random.default_rng(0)
    score = np.where(rng.random(600) < 0.35, 5.0, rng.integers(0, 50, 600).astype(float))
    rows = [(int(i), "m" if i % 5 else "k", float(s)) for i, s in enumerate(score)]
    return rows, spark.createDataFrame(rows, "item_id bigint, method string, score double").repartition(6)


def test_row_number_whole_and_grouped(tied):
    rows, df = tied
    order = [F.desc("score"), F.asc("item_id")]
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))]
    assert [r["item_id"] for r in row_number(df, order).orderBy("rank").collect()] == want
    for m in ("m", "k"):
        want = [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0])) if r[1] == m]
        got = row_number(df, order, ["method"]).filter(F.col("method") == m).orderBy("rank").collect()
        assert [r["item_id"] for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_running_total(tied):
    rows, df = tied
    got = {r["item_id"]: r["before"] for r in running_total(df, [F.asc("item_id")], "score", ["method"]).collect()}
    for m in ("m", "k"):
        total = 0.0
        for i, _, s in sorted(r for r in rows if r[1] == m):
            assert got[i] == pytest.approx(total)
            total += s


def test_first_rows_beyond_the_window_limit(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"))
    got = first_rows(df, 1500, [F.desc("id")], ["g"])
    assert got.groupBy("g").agg(F.count("*"), F.min("id"), F.max("rank")).orderBy("g").collect() == [
        (0, 1500, 2000, 1500), (1, 1500, 2001, 1500),
    ]
    assert first_rows(df, 1200, [F.asc("id")]).agg(F.max("id"), F.max("rank")).first() == (1199, 1200)


def table(spark, rows):
    return spark.createDataFrame(rows, "method string, item_id string, score double")


def values(df):
    return {r["item_id"]: r["score"] for r in df.collect()}


def test_rank_normalise_ties(spark):
    df = table(spark, [("m", i, s) for i, s in zip("abcd", [5.0, 5.0, 3.0, 1.0])])
    assert values(S.rank_normalize(df)) == pytest.approx({"a": 5 / 6, "b": 5 / 6, "c": 1 / 3, "d": 0.0})
    with pytest.raises(ValueError, match="two items"):
        S.rank_normalize(table(spark, [("m", "a", 1.0)]))


def test_rank_normalise_against_average_ranks(tied):
    rows, df = tied
    got = {r["item_id"]: r["score"] for r in S.rank_normalize(df).collect()}
    for m in ("m", "k"):
        part = [(i, s) for i, k, s in rows if k == m]
        for i, s in part:
            above = sum(x > s for _, x in part)
            same = sum(x == s for _, x in part)
            assert got[i] == pytest.approx(1 - (above + (same - 1) / 2) / (len(part) - 1))


def test_minmax_of_a_constant(spark):
    df = table(spark, [("m", "a", 2.0), ("m", "b", 2.0)])
    assert values(S.minmax_normalize(df, strict=False)) == {"a": 0.5, "b": 0.5}
    with pytest.raises(ValueError, match="constant"):
        S.minmax_normalize(df)


def test_mix_strict_and_lenient(spark):
    df = table(spark, [("p", "a", 1.0), ("p", "b", 0.0), ("q", "a", 0.0), ("q", "b", 4.0), ("r", "a", 9.0), ("r", "b", 9.0)])
    assert values(S.mix(df, {"p": 2.0, "q": 1.0})) == {"a": 2.0, "b": 4.0}
    gap = df.filter("not (method = 'q' and item_id = 'a')")
    with pytest.raises(ValueError, match="different items"):
        S.mix(gap, {"p": 1.0})
    assert values(S.mix(gap, {"p": 1.0, "q": 3.0, "z": -2.0}, strict=False)) == pytest.approx({"a": 0.25, "b": 0.75})
    assert values(S.mix(df, {"p": -1.0, "q": 0.0}, strict=False)) == pytest.approx({"a": 0.5, "b": 0.5})


def test_alignment_report(spark):
    df = table(spark, [("p", "a", 1.0), ("p", "b", 0.0), ("q", "a", 0.0)])
    assert S.check_alignment(df).collect() == [("b", 1)]
    with pytest.raises(ValueError):
        S.align_scores(df, ["p", "q"], strict=True)
    swapped = table(spark, [("p", "a", 1.0), ("q", "b", 0.0)])
    with pytest.raises(ValueError):
        S.align_scores(swapped, ["p", "q"], strict=True)


def test_budgets_are_nested_and_ties_go_to_the_lowest_id(spark):
    df = table(spark, [("m", i, 1.0) for i in "dcab"])
    top = S.top_budget(df, 3)
    assert [r["item_id"] for r in top.orderBy("rank").collect()] == ["a", "b", "c"]
    nested = S.nested_budgets(top, [1, 2, 5], 1)
    assert nested.groupBy("k").count().orderBy("k").collect() == [(1, 1), (2, 2), (5, 3)]


def test_scores_from_positions(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "b", 1.0)], "rank bigint, item_id string, gain double")
    assert values(S.order_scores(df, "budget")) == {"a": 1.0, "b": 0.5}
    assert values(S.order_scores(df, "unit")) == {"a": 1.0, "b": 0.0}
    assert values(S.order_scores(df, "gain")) == {"a": 3.0, "b": 1.0}
    one = df.filter("rank = 1")
    assert values(S.order_scores(one, "unit")) == {"a": 1.0}
    rest = spark.createDataFrame([("a", 9.0), ("b", 4.0), ("c", 1.0)], "item_id string, value double")
    assert values(S.secondary_scores(rest, one, 2)) == {"b": 0.25, "c": 0.0625}
    assert values(S.secondary_scores(rest.withColumn("value", -F.col("value")), one, 2)) == {"b": 0.0, "c": 0.0}


@pytest.mark.parametrize("shipped", [100_000, 3])
def test_rank_normalising_with_a_score_that_most_items_share(spark, monkeypatch, shipped):
    from gleaner.operators import scores as S

    monkeypatch.setattr(S, "SHIPPED", shipped)
    monkeypatch.setattr(S, "HOT_SHARE", 4)
    rng = np.random.default_rng(1)
    values = {"a": np.where(rng.uniform(size=200) < 0.8, 0.0, np.round(rng.normal(size=200), 1)), "b": rng.normal(size=150)}
    rows = [(m, i, float(v)) for m, x in values.items() for i, v in enumerate(x)]
    got = {(r.method, r.item_id): r.score for r in S.rank_normalize(spark.createDataFrame(rows, "method string, item_id long, score double").repartition(4)).collect()}
    assert len(got) == len(rows)
    for m, x in values.items():
        order = np.argsort(-x, kind="stable")
        place = np.empty(len(x))
        place[order] = np.arange(len(x))
        for v in set(x.tolist()):
            same = x == v
            assert all(got[m, i] == pytest.approx(1 - place[same].mean() / (len(x) - 1)) for i in np.flatnonzero(same).tolist())
