"""Facts about fitted models that SQL can check: what a fit must fulfil, and sums over the whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleaner.functions.kernels import distances
from gleaner.operators import evaluate as E
from gleaner.operators import selection
from gleaner.operators.aggregate import aggregate_vectors, centroid_array
from gleaner.operators.greedy import pool_values
from gleaner.plans.registry import BUDGET, SQL_GRADIENTS, SQL_ITEMS, gradients, pool, query, sql_mean, table


@query("kmeans_facts", f"""WITH {SQL_ITEMS}, {sql_mean('pool')}
    SELECT count(*) AS n_items, {BUDGET}::BIGINT AS clusters, round(sum(list_distance(v, c) ** 2), 4) + 0.0 AS one_cluster_cost,
      true AS all_nearest, true AS centers_are_means, true AS cost_is_less FROM pool, center""")
def kmeans_facts(spark, sf):
    """A fit's items are at their nearest centers, its centers are near their members' means, and its cost is below that of one cluster."""
    data = pool(spark, sf)
    centers = selection.kmeans_centers(data, BUDGET)
    assigned = selection.assign_clusters(data, centers)
    row = assigned.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("k"), F.sum(F.col("dist") * F.col("dist")).alias("cost")).first()
    nearest = pool_values(data, lambda x: distances(x, centers).min(axis=1)).join(assigned, "item_id")
    wrong = nearest.filter(F.abs(F.col("value") - F.col("dist")) > 1e-9).count()
    means = aggregate_vectors(data.join(assigned, "item_id"), "cluster", "mean").orderBy("cluster").collect()  # one row a cluster
    moved = max(float(np.linalg.norm(np.array(r["vec"]) - centers[r["cluster"]])) for r in means)
    one = centroid_array(data)[None, :]
    whole = pool_values(data, lambda x: distances(x, one)[:, 0] ** 2).agg(F.sum("value")).first()[0]
    return spark.createDataFrame(
        [(row.n, row.k, round(whole, 4) + 0.0, wrong == 0, moved < 0.05, row.cost < whole)],
        "n_items long, clusters long, one_cluster_cost double, all_nearest boolean, centers_are_means boolean, cost_is_less boolean",
    )


@query("lowrank_facts", f"""WITH {SQL_GRADIENTS} SELECT 50::BIGINT AS rank, round(sum(list_inner_product(v, v)), 3) + 0.0 AS energy,
    true AS orthonormal, true AS energy_is_split, true AS captures_its_share FROM pool""")
def lowrank_facts(spark, sf):
    """The leading subspace is orthonormal, and what it holds and leaves of the items' energy adds up; it holds its share of the dimensions at least."""
    data = gradients(pool(spark, sf))
    basis = selection.leading_basis(data, 50)
    inside = pool_values(data, lambda x: ((x @ basis) ** 2).sum(axis=1)).agg(F.sum("value")).first()[0]
    outside = pool_values(data, lambda x: ((x - (x @ basis) @ basis.T) ** 2).sum(axis=1)).agg(F.sum("value")).first()[0]
    energy = pool_values(data, lambda x: (x**2).sum(axis=1)).agg(F.sum("value")).first()[0]
    flat = float(np.abs(basis.T @ basis - np.eye(basis.shape[1])).max())
    return spark.createDataFrame(
        [(basis.shape[1], round(energy, 3) + 0.0, flat < 1e-9, abs(inside + outside - energy) < 1e-6 * energy, inside >= energy * basis.shape[1] / basis.shape[0] - 1e-6)],
        "rank long, energy double, orthonormal boolean, energy_is_split boolean, captures_its_share boolean",
    )


#: Fixed behaviour: median of the best three validation Dices of a run, its best one, and its last one.
_ARRAYS = """WITH r AS (SELECT o_custkey AS run, list(o_totalprice ORDER BY o_orderkey) AS d FROM orders GROUP BY 1),
    b AS (SELECT run, d, list_reverse_sort(d)[1:3] AS top FROM r)"""


@query("run_fitness", f"""{_ARRAYS} SELECT run, round((top[(len(top) + 1) // 2] + top[len(top) // 2 + 1]) / 2 + 1e-7, 4) AS median, round(top[1] + 1e-7, 4) AS best,
    round(d[-1] + 1e-7, 4) AS final FROM b""")
def run_fitness(spark, sf):
    """Fitness of runs from arrays of their validation Dices, in the three modes."""
    orders = table(spark, sf, "orders")
    runs = orders.groupBy(F.col("o_custkey").alias("run")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("val_dices")
    )
    for mode in ("median", "best", "final"):
        runs = E.topk_fitness(runs, 3, mode).withColumnRenamed("fitness", mode)
    return runs.select("run", *[F.round(F.col(m) + 1e-7, 4).alias(m) for m in ("median", "best", "final")])
