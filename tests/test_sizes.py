"""Results must not depend on which side of a size bound the data lies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import session
from gleaner.functions import ordering
from gleaner.operators import search
from gleaner.operators.similarity import max_similarity, sum_similarity, with_similarity


@pytest.mark.parametrize("shipped", [100_000, 0])
def test_null_groups_stay_in_long_rankings(spark, monkeypatch, shipped):
    monkeypatch.setattr(ordering, "SHIPPED_GROUPS", shipped)
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 6.0), ("a", 3, 1.0), ("a", 4, 2.0)], "site string, item_id long, score double")
    order = [F.desc("score"), F.asc("item_id")]
    want = {(None, 2, 1), (None, 1, 2), ("a", 4, 1), ("a", 3, 2)}
    for limit in (ordering.WINDOW_LIMIT, ordering.WINDOW_LIMIT + 1):
        got = ordering.first_rows(df, limit, order, ["site"])
        assert {(r.site, r.item_id, r["rank"]) for r in got.collect()} == want
    before = ordering.running_total(df, order, "score", ["site"]).collect()
    assert {(r.site, r.item_id, r.before) for r in before} == {(None, 2, 0.0), (None, 1, 6.0), ("a", 4, 0.0), ("a", 3, 2.0)}


@pytest.mark.parametrize("kind", ["smallint", "string", "date"])
def test_repeated_ids_are_rows_in_every_similarity_plan(spark, kind):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 4)), rng.normal(size=(5, 4))
    ids = [1, 1, 2, 3, 3, 3]
    left = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "n int, vec array<double>")
    made = {"smallint": F.col("n").cast("smallint"), "string": F.col("n").cast("string"), "date": F.date_add(F.lit("2024-01-01"), F.col("n"))}
    left = left.withColumn("item_id", made[kind])
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "item_id int, vec array<double>")
    found = []
    for shipped in (1 << 20, 5 * 4 * 8 - 1 if len(x) < len(y) else 0):
        rows = with_similarity(left, right, [max_similarity(), sum_similarity()], keep=["n"], broadcast_bytes=shipped, block_bytes=64).collect()
        found.append(sorted((r.n, str(r.item_id), round(r.max_sim, 9), round(r.sum_sim, 9)) for r in rows))
    middle = with_similarity(right, left, [sum_similarity()], broadcast_bytes=5 * 4 * 8).collect()
    assert len(middle) == 5
    assert found[0] == found[1] and len(found[0]) == 6


def test_halves_round_the_same_for_any_chunk(spark, monkeypatch):
    scores = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5, 2.5, 1.0, 3.0])], "method string, item_id long, score double")
    weights = np.array([[1.0], [1.0], [1.0]])
    found = []
    for task_rows in (1_000_000, 1):
        monkeypatch.setattr(search, "TASK_ROWS", task_rows)
        rows = search.evaluate_population(scores, search.candidate_table(spark, ["a"], weights), 4, decimals=0).collect()
        found.append(sorted((r.cand, r["rank"], r.item_id, r.score) for r in rows))
    assert found[0] == found[1]
    assert [r[2:] for r in found[0][:4]] == [(1, 3.0), (3, 3.0), (0, 1.0), (2, 1.0)]


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            raise AssertionError(path)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
