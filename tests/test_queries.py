"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: One query per operator family; tools/check.py runs all of them.
NAMES = [
    "rds_budgets", "less_softmax", "craig_proxy_selection", "rds_round_robin", "kcenter_query_scores", "diversity_distsum",
    "herding", "gradmatch_mp", "craig_fl", "orient_scores", "kmeans_scores", "random_select", "subject_mean", "gram_matrix",
    "rank_norm", "mix_lenient", "population_subsets", "site_vs_rest", "subset_profile", "stratified_split", "weighted_sample",
    "manifest", "slice_distribution", "zscore_case", "nearest_resize", "dice_regions", "ensemble_argmax", "best_of_last_n",
    "kcenter_query_750", "diversity_cosine_750", "herding_250", "coreset_kcenter", "stream_rds_max", "fitness_median", "quantile_profile",
    "search_history", "search_generation", "search_update", "search_refined", "lowrank_facts", "run_fitness",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.entry(spark).columns) == {"k", "budget", "rank", "item_id", "gain"}
