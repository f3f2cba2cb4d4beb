import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import manifest, search
from gleaner.operators.scores import minmax_normalize
from gleaner.operators.selection import kcenter_query, rds_max
from gleaner.sources import readers as R
from gleaner.sources import writers as W

METHODS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    x = rng.random((40, 3))
    rows = [(m, i, float(x[i, j])) for j, m in enumerate(METHODS) for i in range(40)]
    return x, spark.createDataFrame(rows, "method string, item_id bigint, score double")


@pytest.mark.parametrize("task_rows", [1_000_000, 1])
def test_population_in_one_job_equals_one_by_one(spark, scored, monkeypatch, task_rows):
    monkeypatch.setattr(search, "TASK_ROWS", task_rows)
    x, scores = scored
    z = np.random.default_rng(1).normal(size=(5, 3))
    z[0] = -1.0
    got = {}
    for r in search.evaluate_population(scores, search.candidate_table(spark, METHODS, z), 7).collect():
        got.setdefault(r["cand"], {})[r["rank"]] = r["item_id"]
    for c in range(5):
        w = np.maximum(z[c], 0)
        w = w / w.sum() if w.sum() > 0 else np.full(3, 1 / 3)
        order = np.lexsort((np.arange(40), -np.round(x @ w, 12)))[:7]
        assert [got[c][i] for i in range(1, 8)] == order.tolist()


def test_corners(spark):
    rows = search.corner_candidates(spark, METHODS).orderBy("cand").collect()
    assert [r["weights"] for r in rows[:3]] == [{m: float(m == k) for m in METHODS} for k in METHODS]
    assert list(rows[3]["weights"].values()) == pytest.approx([1 / 3] * 3)


def test_search_state_moves_towards_better_weights():
    state, goal = search.SearchState.start(3), np.array([0.8, 0.1, 0.1])
    for _ in range(25):
        z = search.sample_generation(state, 16, seed=3)
        best = z[np.argsort(((z - goal) ** 2).sum(1))[:8]]
        state = search.update_state(state, best)
    assert np.abs(state.mean - goal).max() < 0.05
    report = search.state_diagnostics(state)
    assert report["condition"] >= 1 and report["trace"] == pytest.approx(sum(report["eigvals"]))
    assert search.log_rank_weights(4).sum() == pytest.approx(1.0)


def test_search_resumes_to_the_same_state(spark, scored, tmp_path):
    x, scores = scored

    def fitness(selection, candidates):
        return selection.groupBy("gen", "cand").agg(F.avg(-F.abs(F.col("item_id") - 20.0)).alias("fitness"))

    args = dict(budget=5, fitness=fitness, popsize=4, mu=2, seed=1)
    whole = search.search_weights(scores, METHODS, path=str(tmp_path / "one"), generations=2, **args)
    search.search_weights(scores, METHODS, path=str(tmp_path / "two"), generations=1, **args)
    resumed = search.search_weights(scores, METHODS, path=str(tmp_path / "two"), generations=2, **args)
    assert resumed.state.mean == pytest.approx(whole.state.mean)
    assert resumed.state.cov == pytest.approx(whole.state.cov)
    assert whole.evals.count() == resumed.evals.count() == 4 + 2 * 4
    top = search.top_k(whole.evals, 3).orderBy("rank").collect()
    assert top[0]["fitness"] == whole.evals.agg(F.max("fitness")).first()[0]
    best = [r["global_best_fitness"] for r in search.best_so_far(whole.evals).orderBy("gen").collect()]
    assert best == sorted(best)


def test_a_crash_in_a_generation_leaves_no_rows_twice(spark, scored, tmp_path):
    """The search stops while a generation is rated, and again after it is stored; the history ends up the same."""
    _, scores = scored
    calls = []

    def fitness(selection, candidates):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return selection.groupBy("gen", "cand").agg(F.avg(-F.abs(F.col("item_id") - 20.0)).alias("fitness"))

    args = dict(budget=5, fitness=fitness, popsize=4, mu=2, seed=1, generations=3)
    with pytest.raises(RuntimeError):
        search.search_weights(scores, METHODS, path=str(tmp_path / "h"), **args)
    found = search.search_weights(scores, METHODS, path=str(tmp_path / "h"), **args)
    again = spark.createDataFrame(found.evals.filter("gen = 1").collect(), found.evals.schema)
    search.append_generation(again, str(tmp_path / "h"))
    whole = search.search_weights(scores, METHODS, path=str(tmp_path / "whole"), **args)
    rows = [sorted((r.gen, r.cand, round(r.fitness, 9)) for r in spark.read.parquet(str(tmp_path / n)).collect()) for n in ("h", "whole")]
    assert rows[0] == rows[1] and len(rows[0]) == 4 + 3 * 4
    stored = spark.read.parquet(str(tmp_path / "h_states")).orderBy("gen").collect()
    assert [r.gen for r in stored] == [1, 2, 3] and stored[-1].sigma == pytest.approx(whole.state.sigma)


def test_refined_candidates_are_rated_again(spark, scored, tmp_path):
    _, scores = scored

    def near(goal):
        return lambda selection, _: selection.groupBy("gen", "cand").agg(F.avg(-F.abs(F.col("item_id") - goal)).alias("fitness"))

    run = search.search_weights(scores, METHODS, 5, near(20.0), str(tmp_path / "r"), popsize=4, mu=2, generations=1, refine_fitness=near(3.0), refined=5, kept=2)
    best = run.best.orderBy("rank").collect()
    stored = run.evals.filter(F.col("gen") == search.REFINED).collect()
    assert len(stored) == 5 and [r.fitness for r in best] == sorted((r.fitness for r in stored), reverse=True)[:2]
    first = search.top_k(run.evals.filter(F.col("gen") != search.REFINED), 5).orderBy("rank").collect()
    assert [r.weights for r in sorted(stored, key=lambda r: r.cand)] == [r.weights for r in first]


# ------------------------------------------------------------------ readers and writers


def test_embeddings_jsonl(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"image": "a", "embedding": [1.0, 2.0]}\n\n{"image": "b", "embedding": [3.0, 4.0]}\n{"image": "a", "embedding": [5.0, 6.0]}\n')
    assert R.read_embeddings(spark, str(path)).count() == 3
    got = {r["item_id"]: r["vec"] for r in R.read_embedding_map(spark, str(path)).collect()}
    assert got == {"a": [5.0, 6.0], "b": [3.0, 4.0]}
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no embeddings"):
        R.read_embeddings(spark, str(tmp_path / "none.jsonl"))


def test_lists_and_selection_json(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r[0] for r in R.read_id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    for key in ("selected", "selected_cases"):
        (tmp_path / f"{key}.json").write_text(json.dumps({key: ["x", "y"], "method": "m"}, indent=2))
        rows = R.read_selected_ids(spark, str(tmp_path / f"{key}.json")).orderBy("position").collect()
        assert [r["item_id"] for r in rows] == ["x", "y"]
    sites = tmp_path / "sites"
    sites.mkdir()
    (sites / "North.txt").write_text("s1\ns2\n")
    (sites / "South.txt").write_text("s3\n\n")
    (sites / "notes.md").write_text("no\n")
    assert {tuple(r) for r in R.read_site_lists(spark, str(sites)).collect()} == {("North", "s1"), ("North", "s2"), ("South", "s3")}
    for name in ("train", "val"):
        (sites / f"{name}_subjects.txt").write_text("s1\n")
    got = R.read_splits(spark, str(sites), "T")
    assert {tuple(r) for r in got.collect()} == {("T", "train", "s1"), ("T", "val", "s1")}
    with pytest.raises(ValueError, match="train"):
        empty = tmp_path / "empty"
        empty.mkdir()
        (empty / "val_subjects.txt").write_text("s\n")
        R.read_splits(spark, str(empty), "T")


def test_score_store(spark, scored, tmp_path):
    _, scores = scored
    path = str(tmp_path / "scores")
    both = scores.withColumn("repeat", F.lit(1)).unionByName(scores.withColumn("repeat", F.lit(2)))
    W.write_scores(minmax_normalize(scores).withColumn("repeat", F.lit(1)).unionByName(
        both.filter("repeat = 2").select("method", "item_id", "score", "repeat")), path)
    assert R.read_aligned_scores(spark, path, repeat=2).count() == 120
    assert {r[0] for r in R.detect_repeats(R.read_scores(spark, path), "a").collect()} == {1, 2}
    plan = R.read_scores(spark, path, ["a"], 1)._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert pruned and "method" in pruned[0].split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError, match="not a score table"):
        spark.range(3).write.parquet(str(tmp_path / "other"))
        R.read_scores(spark, str(tmp_path / "other"))


def test_selection_round_trip_and_subsets(spark, vectors, tmp_path):
    _, _, pool = vectors(30)
    _, _, query = vectors(4, seed=1)
    result = kcenter_query(pool, query, 6)
    W.write_selection(result, str(tmp_path / "sel"))
    again = W.read_selection(spark, str(tmp_path / "sel"))
    assert sorted(again.ranking.collect()) == sorted(result.ranking.collect())
    assert again.scores.count() == 30 and (again.method, again.budget) == ("kcenter", 6)
    W.write_subsets(rds_max(pool, query, 10).ranking, "rds", [1, 5], 2, str(tmp_path / "subsets"))
    stored = spark.read.parquet(str(tmp_path / "subsets"))
    assert {tuple(r) for r in stored.groupBy("method", "k").count().collect()} == {("rds", 1, 2), ("rds", 5, 10)}


def test_vectors_with_info_and_bundles(spark, vectors, tmp_path):
    _, _, df = vectors(12)
    path = str(tmp_path / "vec")
    W.write_vectors(df, path, "gradient")
    assert R.read_vectors(spark, path, path + "_info").count() == 12
    assert spark.read.parquet(path + "_info").first().asDict() == {"n_items": 12, "dim": 5, "kind": "gradient"}
    df.limit(5).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="expected"):
        R.read_vectors(spark, path, path + "_info")
    names = F.element_at(F.array(*[F.lit(s) for s in ("source_train", "target_train", "target_val", "target_test")]), (F.col("item_id") % 4 + 1).cast("int"))
    items = df.withColumn("split", names)
    assert R.split_bundle(items, "target_all").count() == 9 and R.split_bundle(items, "all_union").count() == 12
    assert R.split_bundle(items, "target_val").count() == 3 and R.split_bundle(items).count() == 12
    with pytest.raises(ValueError, match="not found"):
        R.split_bundle(items, "other")


def test_slice_listing(spark, tmp_path):
    for name in ("case_1_slice3.npy", "case_1_slice12.npy", "readme.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = R.read_slice_listing(spark, str(tmp_path)).collect()
    assert {(r["subject_id"], r["slice_idx"], r["slice_name"]) for r in got} == {("case_1", 3, "case_1_slice3"), ("case_1", 12, "case_1_slice12")}


def test_manifest_operators(spark):
    inv = spark.createDataFrame(
        [("a", "d1", 1, ".npz"), ("a", "d2", 2, ".npy"), ("b", "d2", 2, ".npz"), ("b", "d2", 2, ".npy"), ("c", "d1", 1, ".txt")],
        "case_id string, dir string, dir_priority int, ext string",
    )
    ask = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "case_id string")
    assert {tuple(r) for r in manifest.resolve_sources(ask, inv).collect()} == {("a", "d1", ".npz"), ("b", "d2", ".npy")}
    out = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "case_id string, kind string")
    assert {r[0] for r in manifest.pending(ask, out, ["x", "y"]).collect()} == {"b", "c", "d"}
    built = manifest.build_manifest(ask.filter("case_id = 'a'"), ask.filter("case_id in ('b', 'c')"), ask.filter("case_id = 'd'"), inv)
    counts = {r["role"]: (r["n_cases"], r["n_linked"]) for r in manifest.manifest_counts(built).collect()}
    assert counts == {"selected": (1, 1), "target_train": (2, 1), "target_val": (1, 0), "all": (4, 2)}
    labels = spark.createDataFrame([("p_seg",), ("q_seg",)], "name string")
    images = spark.createDataFrame([("p",)], "name string")
    assert {(r["image_name"], r["matched"]) for r in manifest.match_images(labels, images).collect()} == {("p", True), ("q", False)}
