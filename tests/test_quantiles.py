"""Counted quantiles against NumPy's."""

import numpy as np
import pytest

from gleaner.operators import quantiles as Q
from gleaner.operators.evaluate import aggregate_fitness, quantile_profile

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, 0.0, 5e-324, 1e-9, 1.0, 1.0 + 2**-52, 7.5e200, np.inf])
    bits = Q.ordered_bits(x)
    assert (np.diff(bits.astype(object)) > 0).all() and (Q.from_ordered_bits(bits) == x).all()
    assert Q.ordered_bits(np.array([-0.0])) == Q.ordered_bits(np.array([0.0]))
    assert Q.ordered_bits(np.array([np.nan])) > Q.ordered_bits(np.array([np.inf]))


@pytest.mark.parametrize("few", [True, False])
def test_groups_of_all_kinds(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(Q, "SHIPPED", 0)
    rng = np.random.default_rng(1)
    groups = {"hot": rng.normal(size=900), "ties": np.repeat([1.0, -1.0, 0.0, -0.0], 40), "one": np.array([3.25]), "two": np.array([-1e200, 1e-200]), None: rng.exponential(size=33) * 1e6}
    rows = [(g, i % 3, float(v)) for g, values in groups.items() for i, v in enumerate(values)] + [("nulls", 0, None), ("hot", 1, None)]
    df = spark.createDataFrame(rows, "g string, `part.x` int, value double").repartition(5)
    got = {r.g: [r[f"q{i}"] for i in range(len(PROBS))] for r in Q.quantiles(df, "value", PROBS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.quantile(values, PROBS), rtol=1e-12, atol=0), g
    whole = Q.quantiles(df, "value", PROBS).first()
    assert np.allclose([whole[f"q{i}"] for i in range(len(PROBS))], np.quantile(np.concatenate(list(groups.values())), PROBS), rtol=1e-12)
    two = Q.quantiles(df.filter("g = 'hot'"), "value", [0.5], ["g", "part.x"]).collect()
    assert {r["part.x"]: r.q0 for r in two} == pytest.approx({k: float(np.median(groups["hot"][k::3])) for k in range(3)})


def test_profiles_and_medians_keep_groups_of_nulls(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 5.0), (0, 2, None), (None, 1, 4.0)], "gen int, cand int, fitness double")
    got = {(r.gen, r.cand): r.fitness for r in aggregate_fitness(df, "median").collect()}
    assert got == {(0, 1): 3.5, (0, 2): None, (None, 1): 4.0}
    row = quantile_profile(df, "fitness").first()
    assert (row["min"], row["median"], row["max"]) == (2.0, 4.0, 5.0)
    empty = Q.quantiles(df.limit(0), "fitness", [0.5], ["gen"])
    assert empty.collect() == [] and aggregate_fitness(df.limit(0), "median").collect() == []


def test_no_values_meet_in_one_task(spark):
    df = spark.createDataFrame([(1, 1.0)], "g int, value double")
    plan = Q.quantiles(df, "value", [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "median" not in plan and "collect_list" not in plan
