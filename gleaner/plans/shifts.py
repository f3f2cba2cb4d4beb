"""Domain-shift queries: the embeddings' labels are the sites, label 0 is the target."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import shift
from gleaner.plans.registry import KS, SQL_ITEMS, SQL_PAIRS, items, pool, query, r6, sql_mean, target
from gleaner.operators.scores import nested_budgets
from gleaner.operators.selection import rds_max

_MEANS = """dims AS (SELECT site, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM items),
    sums AS (SELECT site, i, sum(x) AS x, count(*) AS n FROM dims GROUP BY 1, 2)"""

#: Kernel mean of two sets of sites with a given bandwidth.
_KERNEL = "avg(exp(-{gamma} * (1 - list_inner_product(a.u, b.u)) * (1 - list_inner_product(a.u, b.u))))"


@query("eligible_sites", "SELECT label AS site, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 50")
def eligible_sites(spark, sf):
    return shift.eligible_sites(items(spark, sf), 50)


@query("target_items", "SELECT vec_id AS item_id, label AS site FROM embeddings WHERE label IN (0, 3)")
def target_items(spark, sf):
    return shift.target_items(items(spark, sf), [0, 3], 10).select("item_id", "site")


@query("centroid_distance", f"""WITH {SQL_ITEMS}, {sql_mean('pool', 'v', 'a')}, {sql_mean('q', 'v', 'b')}
    SELECT round(1 - list_inner_product(a.c, b.c) / ((sqrt(list_inner_product(a.c, a.c)) + 1e-8) * (sqrt(list_inner_product(b.c, b.c)) + 1e-8)), 6) + 0.0 AS dist FROM a, b""")
def centroid_distance(spark, sf):
    dist = shift.centroid_cosine_distance(pool(spark, sf), target(spark, sf))
    return target(spark, sf).groupBy().agg(F.lit(round(dist, 6)).alias("dist"))


@query("mmd_rbf", f"""WITH {SQL_ITEMS} SELECT round((SELECT {_KERNEL.format(gamma=2)} FROM pool a, pool b)
    + (SELECT {_KERNEL.format(gamma=2)} FROM q a, q b) - 2 * (SELECT {_KERNEL.format(gamma=2)} FROM pool a, q b), 6) + 0.0 AS mmd2""")
def mmd_rbf(spark, sf):
    value = shift.mmd_rbf(pool(spark, sf), target(spark, sf), gamma=2.0)
    return target(spark, sf).groupBy().agg(F.lit(round(value, 6) + 0.0).alias("mmd2"))


#: Both bandwidth and kernel means per site.
_SITE_TARGET = f"""WITH {SQL_ITEMS}, {_MEANS}, {sql_mean('q', 'u', 't')},
    m AS (SELECT site, max(n) AS n, list(x / n ORDER BY i) AS c FROM sums WHERE site <> 0 GROUP BY 1),
    d AS (SELECT site, n, 1 - list_inner_product(m.c, t.c) / ((sqrt(list_inner_product(m.c, m.c)) + 1e-8) * (sqrt(list_inner_product(t.c, t.c)) + 1e-8)) AS centroid_dist FROM m, t),
    pr AS (SELECT s.site, a.item_id AS ai, b.item_id AS bi, a.site AS sa, b.site AS sb, 1 - list_inner_product(a.u, b.u) AS g
      FROM (SELECT DISTINCT site FROM pool) s JOIN items a ON a.site = s.site OR a.site = 0 JOIN items b ON b.site = s.site OR b.site = 0),
    gm AS (SELECT site, 1 / (pow(median(g), 2) + 1e-8) AS gamma FROM pr WHERE ai < bi AND g > 0 GROUP BY 1),
    k AS (SELECT site, sa, sb, avg(exp(-gamma * g * g)) AS k FROM pr JOIN gm USING (site) GROUP BY 1, 2, 3),
    mm AS (SELECT site, sum(CASE WHEN sa = sb THEN k ELSE -k END) AS mmd2 FROM k GROUP BY 1)"""


@query("site_to_target", f"{_SITE_TARGET} SELECT site, n, round(centroid_dist, 6) + 0.0 AS centroid_dist, round(mmd2, 6) + 0.0 AS mmd2 FROM d JOIN mm USING (site)")
def site_to_target(spark, sf):
    found = shift.site_to_target(pool(spark, sf), target(spark, sf))
    return found.select("site", "n", r6("centroid_dist").alias("centroid_dist"), r6("mmd2").alias("mmd2"))


@query("site_vs_rest", f"""WITH {SQL_ITEMS}, {_MEANS}, el AS (SELECT site FROM items GROUP BY 1 HAVING count(*) >= 10),
    es AS (SELECT * FROM sums JOIN el USING (site)), al AS (SELECT i, sum(x) AS x, sum(n) AS n FROM es GROUP BY 1),
    m AS (SELECT site, max(es.n) AS n, list(es.x / es.n ORDER BY i) AS c, list((al.x - es.x) / (al.n - es.n) ORDER BY i) AS r
      FROM es JOIN al USING (i) GROUP BY 1),
    d AS (SELECT site, n, 1 - list_inner_product(c, r) / ((sqrt(list_inner_product(c, c)) + 1e-8) * (sqrt(list_inner_product(r, r)) + 1e-8)) AS centroid_dist FROM m),
    pr AS MATERIALIZED (SELECT a.site AS sa, b.site AS sb, exp(-2 * pow(1 - list_inner_product(a.u, b.u), 2)) AS k
      FROM items a JOIN el ea ON ea.site = a.site, items b JOIN el eb ON eb.site = b.site),
    mm AS (SELECT el.site, avg(k) FILTER (sa = el.site AND sb = el.site) + avg(k) FILTER (sa <> el.site AND sb <> el.site)
      - 2 * avg(k) FILTER (sa = el.site AND sb <> el.site) AS mmd2 FROM el, pr GROUP BY 1)
    SELECT site, n, round(centroid_dist, 6) + 0.0 AS centroid_dist, round(mmd2, 6) + 0.0 AS mmd2,
      row_number() OVER (ORDER BY centroid_dist DESC, mmd2 DESC, site) AS rank,
      row_number() OVER (ORDER BY centroid_dist DESC, mmd2 DESC, site) <= 3 AS recommended FROM d JOIN mm USING (site)""")
def site_vs_rest(spark, sf):
    found = shift.site_vs_rest(items(spark, sf), gamma=2.0)
    return found.select(
        "site", "n", r6("centroid_dist").alias("centroid_dist"), r6("mmd2").alias("mmd2"), F.col("rank").cast("long").alias("rank"), "recommended"
    )


@query("site_vs_rest_auto", f"""WITH {SQL_ITEMS}, el AS (SELECT site FROM items GROUP BY 1 HAVING count(*) >= 10),
    pr AS MATERIALIZED (SELECT a.site AS sa, b.site AS sb, a.item_id AS ai, b.item_id AS bi, 1 - list_inner_product(a.u, b.u) AS g
      FROM items a JOIN el ea ON ea.site = a.site, items b JOIN el eb ON eb.site = b.site),
    gm AS (SELECT 1 / (pow(median(g), 2) + 1e-8) AS gamma FROM pr WHERE ai < bi AND g > 0),
    k AS MATERIALIZED (SELECT sa, sb, sum(exp(-gamma * g * g)) AS t, count(*) AS p FROM pr, gm GROUP BY 1, 2)
    SELECT el.site, round(sum(t) FILTER (sa = el.site AND sb = el.site) / sum(p) FILTER (sa = el.site AND sb = el.site)
      + sum(t) FILTER (sa <> el.site AND sb <> el.site) / sum(p) FILTER (sa <> el.site AND sb <> el.site)
      - 2 * sum(t) FILTER (sa = el.site AND sb <> el.site) / sum(p) FILTER (sa = el.site AND sb <> el.site), 6) + 0.0 AS mmd2 FROM el, k GROUP BY 1""")
def site_vs_rest_auto(spark, sf):
    """With the bandwidth counted from all pairs."""
    return shift.site_vs_rest(items(spark, sf)).select("site", r6("mmd2").alias("mmd2"))


@query("separability_folds", """SELECT label AS site, (row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) - 1) % 5 AS fold,
    vec_id AS item_id FROM embeddings""")
def separability_folds(spark, sf):
    return shift.separability_folds(items(spark, sf)).select("site", F.col("fold").cast("long").alias("fold"), "item_id")


@query("domain_separability")
def domain_separability(spark, sf):
    return shift.domain_separability(items(spark, sf))


def _subsets(spark, sf):
    """The nested subsets of the largest target similarity, tagged by budget."""
    ranking = rds_max(pool(spark, sf), target(spark, sf), 20 * max(KS)).ranking
    return nested_budgets(ranking, KS, 20).select(F.concat(F.col("k").cast("string"), F.lit("T")).alias("tag"), "item_id")


_PROFILE = f"""WITH {SQL_ITEMS}, {SQL_PAIRS}, av AS (SELECT item_id, avg(s) AS sim, max(s) AS top FROM pairs GROUP BY 1),
    rk AS (SELECT item_id, sim, row_number() OVER (ORDER BY round(sim, 12) DESC, item_id) AS rank,
      row_number() OVER (ORDER BY top DESC, item_id) AS place, count(*) OVER () AS n FROM av),
    sub AS (SELECT k || 'T' AS tag, rk.* FROM rk, (SELECT unnest([1, 5, 10, 15]) AS k) WHERE place <= 20 * k)"""


@query("subset_profile", f"""{_PROFILE} SELECT tag, count(*) AS n_selected, count(*) AS n_found, 0::BIGINT AS n_missing, min(rank) AS rank_min,
    quantile_cont(rank, 0.1) AS rank_p10, quantile_cont(rank, 0.25) AS rank_p25, quantile_cont(rank, 0.5) AS rank_median,
    quantile_cont(rank, 0.75) AS rank_p75, quantile_cont(rank, 0.9) AS rank_p90, max(rank) AS rank_max,
    round(avg((rank <= ceil(n * 0.1))::INT), 6) AS top10, round(avg((rank <= ceil(n * 0.2))::INT), 6) AS top20,
    round(avg((rank <= ceil(n * 0.5))::INT), 6) AS top50 FROM sub GROUP BY 1""")
def subset_profile(spark, sf):
    report = shift.subset_profile(_subsets(spark, sf), pool(spark, sf), target(spark, sf))
    rounded = {c: r6(c) for c in report.columns if c.startswith(("top", "rank_p")) or c == "rank_median"}
    return report.withColumns(rounded)


@query("subset_top", f"""{_PROFILE} SELECT tag, item_id, rank AS global_rank, round(sim, 6) + 0.0 AS mean_sim, place FROM (SELECT tag, item_id, rank, sim,
    row_number() OVER (PARTITION BY tag ORDER BY round(sim, 12) DESC, item_id) AS place FROM sub) WHERE place <= 10""")
def subset_top(spark, sf):
    found = shift.subset_top(_subsets(spark, sf), pool(spark, sf), target(spark, sf))
    return found.select("tag", "item_id", "global_rank", r6("mean_sim").alias("mean_sim"), "place")


