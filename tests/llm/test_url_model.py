"""The URL model on hosts it has not seen, and its effect on pages that no rule decides."""

import os

import pytest

from gleaner.llm import url_filter as U


def test_labelled_table_is_small_and_outside_the_rules(spark):
    rows = U.labelled_urls()
    assert len(rows) < 3000 and len({u for u, _ in rows}) == len(rows) and {v for _, v in rows} == {"allow", "block"}
    host, path = U.split_url(U.F.col("url"))
    df = spark.createDataFrame(rows, "url string, verdict string").select(host.alias("h"), path.alias("p"))
    assert df.filter(U.rule_of(U.F.col("h"), U.F.col("p"))[0].isNotNull()).count() == 0


def test_held_out_hosts_are_judged_rightly(spark):
    got = {r.verdict: r.right / r.n for r in U.held_out_accuracy(spark).collect()}
    assert set(got) == {"allow", "block"} and min(got.values()) >= 0.85 and sum(got.values()) / 2 >= 0.9, got


def test_labels_weigh_the_same(spark):
    rows = [(f"http://good{i}.org/x", "allow") for i in range(300)] + [(f"http://evil{i}.org/x", "block") for i in range(3)]
    pages = spark.createDataFrame([(1, "http://good999.org/x"), (2, "http://evil999.org/x")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, spark.createDataFrame(rows, "url string, verdict string")).collect()}
    assert got == {1: "allow", 2: "block"}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_both_verdicts_occur_where_no_rule_fits(spark, sf):
    path = f"/root/testdata/{sf}/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    got = {r.verdict: r["count"] for r in U.judge(spark.read.parquet(path)).filter("rule IS NULL").groupBy("verdict").count().collect()}
    print(sf, got)
    assert got.get("allow", 0) > got.get("block", 0) or not got


def test_grams_are_all_substrings_of_the_sizes(spark):
    text = "a.bc/d12"
    got = spark.createDataFrame([(text,)], "t string").select(U._grams(U.F.col("t"), "h")).first()[0]
    bars = "|a.bc/d00|"
    assert sorted(got) == sorted("h" + bars[i : i + n] for n in U.SIZES for i in range(len(bars) - n + 1))
