"""Greedy queries of real length, and greedy over core-sets beside plain greedy.

The SQL keeps one number an item in its recursion, so that a step costs one pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import coreset, selection
from gleaner.plans.registry import SQL_GRADIENTS, SQL_ITEMS, gradients, pool, query, r6, sql_mean, target

#: Picks of the reference's runs; a shorter run is the beginning of a longer one.
LONG, LONGEST = 250, 750
#: Picks of the comparison, and the share of plain greedy's objective that core-sets must reach.
COMPARED, SHARE = 100, 0.9


def _running(items: str, budget: int, update: str, start: str, best: str = "d", name: str = "g") -> str:
    """Recursive CTE ``g(step, item_id, d, pick, s)``: ``d`` is an item's running number, null once picked.

    ``update`` has the item's vector ``p``, the pick's ``b`` and the number ``d``; ``start`` selects item_id, v, u, s of the
    first pick, whose numbers come from ``update`` with ``d`` null.
    """
    first = update.replace("g.d", "NULL")
    return f"""WITH RECURSIVE {items}, {name} AS (
      SELECT 1 AS step, p.item_id, CASE WHEN p.item_id = b.item_id THEN NULL ELSE {first} END AS d, b.item_id AS pick, b.s::DOUBLE AS s FROM pool p, ({start}) b
      UNION ALL
      SELECT g.step + 1, g.item_id, CASE WHEN g.item_id = b.item_id THEN NULL WHEN g.d IS NULL THEN NULL ELSE {update} END, b.item_id, b.s
      FROM {name} g JOIN pool p ON p.item_id = g.item_id, (
        SELECT q.item_id, q.v, q.u, x.best.s AS s FROM (
          SELECT arg_min({{'id': item_id, 's': {best}}}, {{'k': -round({best}, 12), 'id': item_id}}) AS best FROM {name} WHERE d IS NOT NULL) x
        JOIN pool q ON q.item_id = x.best.id) b
      WHERE g.step < {budget})"""


_PICKS = "SELECT DISTINCT step AS rank, pick AS item_id, round(s, 6) + 0.0 AS gain FROM g"
_LOWEST = "SELECT item_id, v, u, NULL AS s FROM pool ORDER BY item_id LIMIT 1"
#: The first pick's gain is the second one's.
_SECOND = "SELECT DISTINCT step AS rank, pick AS item_id, round(coalesce(s, (SELECT max(s) FROM g WHERE step = 2)), 6) + 0.0 AS gain FROM g"
_NEAREST = f"{SQL_ITEMS}, {sql_mean('q')}"
_DISTANCE = "least(g.d, list_distance(p.v, b.v))"


def _ranking(result):
    return result.ranking.select("rank", "item_id", r6("gain").alias("gain"))


def _lowest(df):
    return df.agg(F.min("item_id")).first()[0]


@query("kcenter_query_750", f"""{_running(_NEAREST, LONGEST, _DISTANCE,
    'SELECT item_id, v, u, -list_distance(v, c) AS s FROM pool, center ORDER BY round(list_distance(v, c), 12), item_id LIMIT 1')} {_PICKS}""")
def kcenter_query_750(spark, sf):
    return _ranking(selection.kcenter_query(pool(spark, sf), target(spark, sf), LONGEST))


@query("kcenter_pool_750", f"{_running(SQL_ITEMS, LONGEST, _DISTANCE, _LOWEST)} {_SECOND}")
def kcenter_pool_750(spark, sf):
    data = pool(spark, sf)
    return _ranking(selection.kcenter_pool(data, LONGEST, start=_lowest(data)))


@query("diversity_distsum_750", f"{_running(SQL_GRADIENTS, LONGEST, 'coalesce(g.d, 0) + list_distance(p.u, b.u)', _LOWEST)} {_SECOND}")
def diversity_distsum_750(spark, sf):
    data = gradients(pool(spark, sf))
    return _ranking(selection.diversity_distsum(data, LONGEST, normalize=True, start=_lowest(data)))


@query("diversity_cosine_750", f"""{_running(SQL_ITEMS, LONGEST, 'least(g.d, abs(list_inner_product(p.u, b.u)))', _LOWEST, '-d')}
    SELECT DISTINCT step AS rank, pick AS item_id, round(coalesce(-s, 0), 6) + 0.0 AS gain FROM g""")
def diversity_cosine_750(spark, sf):
    data = pool(spark, sf)
    return _ranking(selection.diversity_cosine(data, LONGEST, start=_lowest(data)))


@query("herding_250", f"""WITH RECURSIVE {SQL_ITEMS}, {sql_mean('q')}, g AS (
      SELECT 0 AS step, []::BIGINT[] AS ids, list_transform(c, lambda x: 0::DOUBLE) AS total, NULL::BIGINT AS item_id, NULL::DOUBLE AS s FROM center
      UNION ALL
      SELECT step + 1, list_append(ids, b.id), list_transform(total, lambda x, i: x + b.v[i]), b.id, b.s FROM (
        SELECT step, ids, total, arg_min({{'id': item_id, 'v': v, 's': s}}, {{'k': round(s, 12), 'id': item_id}}) AS b FROM (
          SELECT g.step, g.ids, g.total, p.item_id, p.v, list_distance(list_transform(p.v, lambda x, i: (x + g.total[i]) / (g.step + 1)), center.c) AS s
          FROM g, pool p, center WHERE g.step < {LONG} AND NOT list_contains(g.ids, p.item_id))
        GROUP BY step, ids, total))
    SELECT step AS rank, item_id, round(s, 6) + 0.0 AS gain FROM g WHERE step > 0""")
def herding_250(spark, sf):
    return _ranking(selection.herding(pool(spark, sf), target(spark, sf), LONG))


# ------------------------------------------------------------------ core-sets

_PLAIN_KCENTER = f"""{_running(_NEAREST, COMPARED, _DISTANCE,
    'SELECT item_id, v, u, -list_distance(v, c) AS s FROM pool, center ORDER BY round(list_distance(v, c), 12), item_id LIMIT 1')}
    SELECT 'kcenter' AS method, {COMPARED}::BIGINT AS picks, round(-max(d), 6) + 0.0 AS plain, true AS near_plain FROM g WHERE step = {COMPARED}"""
_PLAIN_SUM = f"""{_running(SQL_ITEMS, COMPARED, 'coalesce(g.d, 0) + list_distance(p.v, b.v)', _LOWEST)}
    SELECT 'distsum' AS method, {COMPARED}::BIGINT AS picks, round(sum(s), 6) + 0.0 AS plain, true AS near_plain FROM (SELECT DISTINCT step, s FROM g)"""


def _compare(spark, sf, name, plain_picks):
    data, wanted = pool(spark, sf), target(spark, sf)
    plain = coreset.objective(name, data, np.stack([p.vec for p in plain_picks(data, wanted)]), wanted)
    picks = coreset.two_round(name, data, COMPARED, wanted, part_rows=2 * COMPARED)
    found = coreset.objective(name, data, np.stack([p.vec for p in picks]), wanted)
    # Negative objectives are distances: they may grow by the share.
    near = found >= SHARE * plain if plain >= 0 else found >= plain / SHARE
    return spark.createDataFrame([(name, len(picks), plain, bool(near))], "method string, picks long, plain double, near_plain boolean").select(
        "method", "picks", r6("plain").alias("plain"), "near_plain"
    )


@query("coreset_kcenter", _PLAIN_KCENTER)
def coreset_kcenter(spark, sf):
    """Plain greedy's largest distance to a pick, and whether the picks of core-sets come near it."""
    def plain(data, wanted):
        with coreset.cached_pool(data) as kept:
            return coreset.greedy(kept, coreset.FarthestFirst(coreset.centroid_array(wanted)), COMPARED)

    return _compare(spark, sf, "kcenter", plain)


@query("coreset_distsum", _PLAIN_SUM)
def coreset_distsum(spark, sf):
    """Plain greedy's sum of distances between its picks, and whether the picks of core-sets come near it."""
    def plain(data, wanted):
        row = data.orderBy("item_id").first()
        first = np.array(row["vec"], dtype=np.float64)
        with coreset.cached_pool(data) as kept:
            return coreset.greedy(kept, coreset.DistanceSum([first]), COMPARED, [coreset.Pick(row["item_id"], first, 0.0)])

    return _compare(spark, sf, "distsum", plain)
