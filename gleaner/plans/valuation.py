"""Valuation and selection methods over the embeddings table (target = label 0)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.kernels import matrix
from gleaner.functions.vectors import constant, distance, l2_normalize, parse_seeds, project_simplex, rank_weight_rows
from gleaner.operators import aggregate, selection
from gleaner.operators.scores import nested_budgets, order_scores
from gleaner.operators.similarity import (
    exp_mass,
    max_similarity,
    nearest_items,
    sum_positive,
    sum_similarity,
    with_similarity,
)
from gleaner.plans.registry import (
    BUDGET,
    KS,
    SQL_GRADIENTS,
    SQL_ITEMS,
    SQL_PAIRS,
    gradients,
    items,
    pool,
    query,
    r6,
    slices,
    sql_greedy,
    sql_mean,
    table,
    target,
)


def _ranking(result, *more):
    return result.ranking.select("rank", "item_id", r6("gain").alias("gain"), *more)


def _scores(result):
    return result.scores.select("item_id", r6("score").alias("score"), "selected")


_G = "SELECT step AS rank, item_id, round(s, 6) + 0.0 AS gain FROM g WHERE step > 0"


def _first_gain(sql: str) -> str:
    """A start item's gain is the gain of the second pick."""
    return (
        f"{sql} SELECT step AS rank, item_id, round(CASE WHEN step = 1 THEN "
        "(SELECT s FROM g WHERE step = 2) ELSE s END, 6) + 0.0 AS gain FROM g"
    )


def _sql_full(values: str, positive: str = "x > 0") -> str:
    """Order-based scores of the picks and scaled ``values`` (item_id, value) of the others."""
    return f""", picked AS (SELECT item_id, step FROM g WHERE step > 0),
    rest AS (SELECT * FROM ({values}) WHERE item_id NOT IN (SELECT item_id FROM picked)),
    top AS (SELECT max(value) AS x FROM rest)
    SELECT item_id, round(({BUDGET} - step + 1) / {BUDGET}.0::DOUBLE, 6) + 0.0 AS score, true AS selected FROM picked
    UNION ALL
    SELECT item_id, round(CASE WHEN {positive} THEN value / x * {0.5 / BUDGET} ELSE 0 END, 6) + 0.0, false FROM rest, top"""


# ------------------------------------------------------------------ similarity to the target

_RDS = f"WITH {SQL_ITEMS}, {SQL_PAIRS}, sc AS (SELECT item_id, max(s) AS s FROM pairs GROUP BY 1)"


@query("rds_max", f"""{_RDS} SELECT row_number() OVER (ORDER BY s DESC, item_id) AS rank, item_id,
    round(s, 6) + 0.0 AS gain FROM sc""")
def rds_max(spark, sf):
    return _ranking(selection.rds_max(pool(spark, sf), target(spark, sf)))


@query("rds_budgets", f"""{_RDS}, ranked AS (SELECT row_number() OVER (ORDER BY s DESC, item_id) AS rank, item_id, s FROM sc)
    SELECT k, 20 * k AS budget, rank, item_id, round(s, 6) + 0.0 AS gain
    FROM ranked, (SELECT unnest([1, 5, 10, 15]) AS k) WHERE rank <= 20 * k""")
def rds_budgets(spark, sf):
    result = selection.rds_max(pool(spark, sf), target(spark, sf), 20 * max(KS))
    return nested_budgets(_ranking(result), KS, 20)


@query("similarity_summary", f"""WITH {SQL_ITEMS}, {SQL_PAIRS} SELECT item_id, round(max(s), 6) + 0.0 AS max_sim,
    round(sum(s), 6) + 0.0 AS sum_sim, round(sum(greatest(s, 0)), 6) + 0.0 AS sum_pos FROM pairs GROUP BY 1""")
def similarity_summary(spark, sf):
    found = with_similarity(
        pool(spark, sf), target(spark, sf), [max_similarity(), sum_similarity(), sum_positive()]
    )
    return found.select("item_id", *[r6(c).alias(c) for c in ("max_sim", "sum_sim", "sum_pos")])


_NEAR = f"""WITH {SQL_ITEMS}, {SQL_PAIRS}, near AS (SELECT q_id AS query_id, item_id, s AS sim, row_number() OVER (
      PARTITION BY q_id ORDER BY round(s, 12) DESC, item_id) AS position FROM pairs)"""


def _near(spark, sf):
    return nearest_items(target(spark, sf).withColumnRenamed("item_id", "query_id"), pool(spark, sf), 20)


@query("nearest_pairs", f"""{_NEAR} SELECT query_id, item_id, position::INTEGER AS position, round(sim, 6) + 0.0 AS sim,
    round(greatest(sim, 0), 6) + 0.0 AS clipped FROM near WHERE position <= 20""")
def nearest_pairs(spark, sf):
    """Cosines of each target item with its 20 nearest pool items, as they are and clipped at 0."""
    return _near(spark, sf).select(
        "query_id", "item_id", "position", r6("sim").alias("sim"), r6(F.greatest("sim", F.lit(0.0))).alias("clipped")
    )


@query("pair_softmax", f"""WITH {SQL_ITEMS}, {SQL_PAIRS}, near AS (SELECT q_id AS query_id, item_id, row_number() OVER (
      PARTITION BY q_id ORDER BY round(s, 12) DESC, item_id) AS position, exp(5 * s) / sum(exp(5 * s)) OVER (PARTITION BY q_id) AS weight FROM pairs)
    SELECT query_id, item_id, round(weight, 6) + 0.0 AS weight FROM near WHERE position <= 20""")
def pair_softmax(spark, sf):
    """Softmax of each target item over the whole pool, for its 20 nearest pool items."""
    mass = with_similarity(target(spark, sf), pool(spark, sf), [exp_mass(5.0)]).withColumnRenamed("item_id", "query_id")
    weighted = _near(spark, sf).join(mass, "query_id").withColumn("weight", F.exp(5.0 * (F.col("sim") - 1.0)) / F.col("exp_mass"))
    return weighted.select("query_id", "item_id", r6("weight").alias("weight"))


@query("less_softmax", f"""WITH {SQL_ITEMS}, {SQL_PAIRS},
    sl AS (SELECT item_id, sum(exp(20 * s) * s) / (sum(exp(20 * s)) + 1e-8) AS s FROM pairs GROUP BY 1),
    su AS (SELECT item_id // 5 AS item_id, avg(s) AS s FROM sl GROUP BY 1)
    SELECT row_number() OVER (ORDER BY s DESC, item_id) AS rank, item_id, round(s, 6) + 0.0 AS gain FROM su""")
def less_softmax(spark, sf):
    source = pool(spark, sf).withColumn("subject_id", F.expr("item_id div 5"))
    return _ranking(selection.less_softmax(source, target(spark, sf)))


_PROXY = f"""WITH {SQL_ITEMS}, {SQL_PAIRS},
    w AS (SELECT item_id, exp(5 * s) / sum(exp(5 * s)) OVER (PARTITION BY q_id) AS w FROM pairs),
    su AS (SELECT item_id, sum(w) AS s FROM w GROUP BY 1),
    sc AS (SELECT item_id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM su)"""


@query("craig_proxy", f"""{_PROXY} SELECT item_id, round(s, 6) + 0.0 AS score FROM sc""")
def craig_proxy(spark, sf):
    result = selection.craig_proxy(pool(spark, sf), target(spark, sf), BUDGET)
    return result.scores.select("item_id", r6("score").alias("score"))


@query("craig_proxy_selection", f"""{_PROXY} SELECT row_number() OVER (ORDER BY s DESC, item_id) AS rank, item_id,
    round(s, 6) + 0.0 AS gain FROM sc ORDER BY rank LIMIT {BUDGET}""")
def craig_proxy_selection(spark, sf):
    return _ranking(selection.craig_proxy(pool(spark, sf), target(spark, sf), BUDGET))


@query("mean_sim_rank", f"""WITH {SQL_ITEMS}, {SQL_PAIRS}, sc AS (SELECT item_id, avg(s) AS s FROM pairs GROUP BY 1)
    SELECT row_number() OVER (ORDER BY round(s, 12) DESC, item_id) AS rank, item_id, round(s, 6) + 0.0 AS score FROM sc""")
def mean_sim_rank(spark, sf):
    return selection.mean_sim_rank(pool(spark, sf), target(spark, sf)).select("rank", "item_id", r6("score").alias("score"))


_ROUNDS = 5 * BUDGET
_ROBIN = f"""WITH RECURSIVE {SQL_ITEMS}, {SQL_PAIRS},
    turns AS (SELECT item_id AS q_id, row_number() OVER (ORDER BY item_id) - 1 AS turn FROM q),
    g AS (SELECT 0 AS step, []::BIGINT[] AS ids, NULL::BIGINT AS item_id, NULL::DOUBLE AS s
      UNION ALL
      SELECT step + 1, list_append(ids, b.id), b.id, b.s FROM (
        SELECT step, ids, arg_min({{'id': p.item_id, 's': p.s}}, {{'k': -round(p.s, 12), 'id': p.item_id}}) AS b
        FROM g JOIN turns t ON t.turn = g.step % (SELECT count(*) FROM q) JOIN pairs p ON p.q_id = t.q_id
        WHERE g.step < {_ROUNDS} AND NOT list_contains(g.ids, p.item_id) GROUP BY step, ids))"""


@query("rds_round_robin", f"{_ROBIN} {_G}")
def rds_round_robin(spark, sf):
    return _ranking(selection.rds_round_robin(pool(spark, sf), target(spark, sf), _ROUNDS))


@query("rds_round_robin_scores", f"""{_ROBIN}, picked AS (SELECT item_id, step FROM g WHERE step > 0),
    rest AS (SELECT item_id, max(s) AS value FROM pairs WHERE item_id NOT IN (SELECT item_id FROM picked) GROUP BY 1),
    top AS (SELECT max(value) AS x FROM rest)
    SELECT item_id, round(({_ROUNDS} - step + 1) / {_ROUNDS}.0::DOUBLE, 6) + 0.0 AS score, true AS selected FROM picked
    UNION ALL SELECT item_id, round(CASE WHEN x > 0 THEN value / x * {0.5 / _ROUNDS} ELSE 0 END, 6) + 0.0, false FROM rest, top""")
def rds_round_robin_scores(spark, sf):
    return _scores(selection.rds_round_robin(pool(spark, sf), target(spark, sf), _ROUNDS))


# ------------------------------------------------------------------ geometric greedy

_NEAREST = "list_min(list_transform(g.vs, lambda s: list_distance(p.v, s)))"
_KCENTER = f"""WITH RECURSIVE {SQL_ITEMS}, {sql_mean('q')}, {sql_greedy(
    _NEAREST, 'SELECT item_id, v, u, -list_distance(v, c) AS s FROM pool, center ORDER BY round(list_distance(v, c), 12), item_id LIMIT 1')}"""


@query("kcenter_query", f"{_KCENTER} {_G}")
def kcenter_query(spark, sf):
    return _ranking(selection.kcenter_query(pool(spark, sf), target(spark, sf), BUDGET))


@query("kcenter_query_scores", _KCENTER + _sql_full(f"""SELECT p.item_id, list_min(list_transform(l.vs,
    lambda s: list_distance(p.v, s))) AS value FROM pool p, (SELECT vs FROM g WHERE step = {BUDGET}) l"""))
def kcenter_query_scores(spark, sf):
    return _scores(selection.kcenter_query(pool(spark, sf), target(spark, sf), BUDGET))


_LOWEST = "SELECT item_id, v, u, NULL AS s FROM pool ORDER BY item_id LIMIT 1"


def _lowest(df):
    return df.agg(F.min("item_id")).first()[0]


@query("kcenter_pool", _first_gain(f"WITH RECURSIVE {SQL_ITEMS}, {sql_greedy(_NEAREST, _LOWEST)}"))
def kcenter_pool(spark, sf):
    data = pool(spark, sf)
    return _ranking(selection.kcenter_pool(data, BUDGET, start=_lowest(data)))


@query("diversity_distsum", _first_gain(f"""WITH RECURSIVE {SQL_GRADIENTS}, {sql_greedy(
    'list_sum(list_transform(g.us, lambda s: list_distance(p.u, s)))', _LOWEST)}"""))
def diversity_distsum(spark, sf):
    data = gradients(pool(spark, sf))
    return _ranking(selection.diversity_distsum(data, BUDGET, normalize=True, start=_lowest(data)))


_COSINE = f"""WITH RECURSIVE {SQL_ITEMS}, {sql_greedy(
    '-list_min(list_transform(g.us, lambda s: abs(list_inner_product(p.u, s))))', _LOWEST)}"""


@query("diversity_cosine", f"{_COSINE} SELECT step AS rank, item_id, round(coalesce(-s, 0), 6) + 0.0 AS gain FROM g")
def diversity_cosine(spark, sf):
    data = pool(spark, sf)
    return _ranking(selection.diversity_cosine(data, BUDGET, start=_lowest(data)))


@query("diversity_cosine_scores", f"""{_COSINE}, l AS (SELECT us FROM g WHERE step = {BUDGET})
    SELECT item_id, round(({BUDGET} - step + 1) / {BUDGET}.0::DOUBLE, 6) + 0.0 AS score, true AS selected FROM g
    UNION ALL SELECT item_id, round((1 - least(list_min(list_transform(l.us, lambda s: abs(list_inner_product(p.u, s)))), 1))
      * {0.5 / BUDGET}, 6) + 0.0, false FROM pool p, l WHERE item_id NOT IN (SELECT item_id FROM g)""")
def diversity_cosine_scores(spark, sf):
    data = pool(spark, sf)
    return _scores(selection.diversity_cosine(data, BUDGET, start=_lowest(data)))


_HERDING = f"""WITH RECURSIVE {SQL_ITEMS}, {sql_mean('q')}, {sql_greedy(
    '''-list_distance(list_transform(p.v, lambda x, i:
       (x + coalesce(list_sum(list_transform(g.vs, lambda s: s[i])), 0)) / (g.step + 1)), center.c)''')}"""


@query("herding", f"{_HERDING} SELECT step AS rank, item_id, round(-s, 6) + 0.0 AS gain FROM g WHERE step > 0")
def herding(spark, sf):
    return _ranking(selection.herding(pool(spark, sf), target(spark, sf), BUDGET))


@query("herding_scores", f"""{_HERDING}, picked AS (SELECT item_id, step FROM g WHERE step > 0),
    rest AS (SELECT item_id, list_distance(v, c) AS d FROM pool, center WHERE item_id NOT IN (SELECT item_id FROM picked)),
    top AS (SELECT max(d) AS x FROM rest)
    SELECT item_id, round(({BUDGET} - step + 1) / {BUDGET}.0::DOUBLE, 6) + 0.0 AS score, true AS selected FROM picked
    UNION ALL SELECT item_id, round((1 - d / x) * {0.5 / BUDGET}, 6) + 0.0, false FROM rest, top""")
def herding_scores(spark, sf):
    return _scores(selection.herding(pool(spark, sf), target(spark, sf), BUDGET))


# ------------------------------------------------------------------ gradient matching

_AIM = f"{sql_mean('q', 'v', 'mean_q')}, center AS (SELECT list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-8)) AS c FROM mean_q)"

#: Each pick's unit vector is made orthogonal to the earlier ones; the residual loses that part.
_OMP_STEP = """SELECT g.step, g.ids, g.basis, g.r, p.item_id, p.{v} AS a, list_inner_product(p.{v}, g.r) AS s
      FROM g, pool p WHERE g.step < {b} AND NOT list_contains(g.ids, p.item_id)"""


def _sql_pursuit(v: str, orthogonal: bool, budget: int = BUDGET) -> str:
    """Recursive CTE ``g`` of matching pursuit with residual ``r``; ``s`` is the inner product at the pick."""
    part = (
        """list_transform(b.a, lambda x, i: x - coalesce(list_sum(list_transform(basis,
             lambda e: list_inner_product(e, b.a) / list_inner_product(e, e) * e[i])), 0))"""
        if orthogonal
        else "b.a"
    )
    return f"""g AS (
      SELECT 0 AS step, []::BIGINT[] AS ids, []::DOUBLE[][] AS basis, c AS r, NULL::BIGINT AS item_id, NULL::DOUBLE AS s FROM center
      UNION ALL
      SELECT step + 1, list_append(ids, id), list_append(basis, e),
        list_transform(r, lambda x, i: x - list_inner_product(r, e) / list_inner_product(e, e) * e[i]), id, s FROM (
        SELECT step, ids, basis, r, b.id AS id, b.s AS s, {part} AS e FROM (
          SELECT step, ids, basis, r, arg_min({{'id': item_id, 'a': a, 's': s}}, {{'k': -round(s, 12), 'id': item_id}}) AS b
          FROM ({_OMP_STEP.format(v=v, b=budget)}) GROUP BY step, ids, basis, r)))"""


_MP = f"WITH RECURSIVE {SQL_GRADIENTS}, {_AIM}, {_sql_pursuit('u', False)}"
_OMP = f"WITH RECURSIVE {SQL_GRADIENTS}, {_AIM}, {_sql_pursuit('u', True)}"
_ALIGN = "SELECT item_id, abs(list_inner_product(u, c)) AS value FROM pool, center"


def _grads(spark, sf):
    return gradients(pool(spark, sf)), gradients(target(spark, sf))


@query("gradmatch_mp", f"""{_MP} SELECT step AS rank, item_id, round(s, 6) + 0.0 AS gain,
    round(greatest(s, 0), 6) + 0.0 AS weight FROM g WHERE step > 0""")
def gradmatch_mp(spark, sf):
    return _ranking(selection.gradmatch_mp(*_grads(spark, sf), BUDGET), r6("weight").alias("weight"))


@query("gradmatch_mp_scores", _MP + _sql_full(_ALIGN))
def gradmatch_mp_scores(spark, sf):
    return _scores(selection.gradmatch_mp(*_grads(spark, sf), BUDGET))


@query("gradmatch_omp", f"{_OMP} {_G}")
def gradmatch_omp(spark, sf):
    return _ranking(selection.gradmatch_omp(*_grads(spark, sf), BUDGET))


@query("gradmatch_omp_scores", _OMP + _sql_full(_ALIGN))
def gradmatch_omp_scores(spark, sf):
    return _scores(selection.gradmatch_omp(*_grads(spark, sf), BUDGET))


#: On these tables every weight of the least-squares fits is positive for the first picks, so
#: the non-negative fit equals the plain one; the general case is tested on fixtures.
@query("gradmatch_nnls", f"""WITH RECURSIVE {SQL_GRADIENTS}, {sql_mean('q', 'v', 'mean_q')},
    center AS (SELECT list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-12)) AS c FROM mean_q), {_sql_pursuit('u', True)}
    SELECT b.step AS rank, b.item_id, round(list_inner_product(a.r, a.r) - list_inner_product(b.r, b.r), 6) + 0.0 AS gain
    FROM g b JOIN g a ON a.step = b.step - 1""")
def gradmatch_nnls(spark, sf):
    return _ranking(selection.gradmatch_nnls(*_grads(spark, sf), BUDGET, normalize=True))


@query("less_lowrank")
def less_lowrank(spark, sf):
    return _ranking(selection.less_lowrank(*_grads(spark, sf), BUDGET))


#: With the full rank the projection is a rotation and drops out of every inner product.
@query("less_fullrank", f"""WITH RECURSIVE {SQL_GRADIENTS}, {sql_mean('q')}, {_sql_pursuit('v', False)} {_G}""")
def less_fullrank(spark, sf):
    return _ranking(selection.less_lowrank(*_grads(spark, sf), BUDGET, rank=64))


@query("less_fullrank_scores", f"WITH RECURSIVE {SQL_GRADIENTS}, {sql_mean('q')}, {_sql_pursuit('v', False)}"
       + _sql_full("SELECT item_id, abs(list_inner_product(v, c)) AS value FROM pool, center"))
def less_fullrank_scores(spark, sf):
    return _scores(selection.less_lowrank(*_grads(spark, sf), BUDGET, rank=64))


# ------------------------------------------------------------------ coverage


def _sql_coverage(similarity: str, floor: str, first: str | None = None, cap: str = "") -> str:
    """Recursive CTE ``g`` of facility location; ``similarity`` of rows i and j, ``floor`` before any pick."""
    base = (
        f"SELECT 1 AS step, [f.item_id] AS ids, f.item_id AS item_id, f.s AS s FROM ({first}) f"
        if first else "SELECT 0 AS step, []::BIGINT[] AS ids, NULL::BIGINT AS item_id, NULL::DOUBLE AS s"
    )
    return f"""k AS MATERIALIZED (SELECT i.item_id AS i, j.item_id AS j, {similarity} AS s FROM pool i, pool j {cap}),
    g AS ({base}
      UNION ALL
      SELECT step + 1, list_append(ids, b.id), b.id, b.s FROM (
        SELECT step, ids, arg_min({{'id': j, 's': s}}, {{'k': -round(s, 9), 'id': j}}) AS b FROM (
          SELECT step, ids, k.j, sum(greatest(k.s - m.reached, 0)) AS s FROM (
            SELECT g.step, g.ids, k.i, coalesce(max(k.s) FILTER (list_contains(g.ids, k.j)), {floor}) AS reached
            FROM g, k WHERE g.step < {BUDGET} GROUP BY g.step, g.ids, k.i) m JOIN k ON k.i = m.i
          WHERE NOT list_contains(m.ids, k.j) GROUP BY step, ids, k.j)
        GROUP BY step, ids))"""


_COVER = f"WITH RECURSIVE {SQL_ITEMS}, {_sql_coverage('greatest(list_inner_product(i.u, j.u), 0)', '0')}"
_COVER_G = "SELECT step AS rank, item_id, round(s, 5) + 0.0 AS gain FROM g WHERE step > 0"


def _cover_ranking(result):
    return result.ranking.select("rank", "item_id", (F.round("gain", 5) + 0.0).alias("gain"))


@query("craig_fl", f"{_COVER} {_COVER_G}")
def craig_fl(spark, sf):
    return _cover_ranking(selection.craig_fl(pool(spark, sf), BUDGET))


@query("craig_fl_unclipped", f"""WITH RECURSIVE {SQL_GRADIENTS}, {_sql_coverage(
    'list_inner_product(i.u, j.u)', '-1e300',
    '''SELECT min(a.item_id) AS item_id, (SELECT sum(list_inner_product(i.u, j.u)) FROM pool i, pool j
       WHERE j.item_id = (SELECT min(item_id) FROM pool)) AS s FROM pool a''')} {_COVER_G}""")
def craig_fl_unclipped(spark, sf):
    return _cover_ranking(selection.craig_fl_unclipped(gradients(pool(spark, sf)), BUDGET, compat_first=True))


@query("craig_scores", _COVER + _sql_full("""SELECT i AS item_id, max(s) AS value FROM k
    WHERE j IN (SELECT item_id FROM g WHERE step > 0) GROUP BY 1"""))
def craig_scores(spark, sf):
    return _scores(selection.craig_fl_unclipped(pool(spark, sf), BUDGET))


_ORIENT = f"""WITH RECURSIVE {SQL_ITEMS}, {SQL_PAIRS}, caps AS (SELECT item_id, greatest(max(s), 0) AS c FROM pairs GROUP BY 1),
    {_sql_coverage('least(greatest(list_inner_product(i.u, j.u), 0), caps.c)', '0', cap='JOIN caps ON caps.item_id = i.item_id')}"""


@query("orient_flmi", f"{_ORIENT} {_COVER_G}")
def orient_flmi(spark, sf):
    return _cover_ranking(selection.orient_flmi(pool(spark, sf), target(spark, sf), BUDGET))


@query("orient_scores", f"""{_ORIENT}, rel AS (SELECT item_id, avg(greatest(s, 0)) AS v FROM pairs GROUP BY 1),
    placed AS (SELECT rel.item_id, v, coalesce(1 - (step - 1) / {BUDGET - 1}.0::DOUBLE, 0) AS p, step IS NOT NULL AS selected
      FROM rel LEFT JOIN g ON g.item_id = rel.item_id AND step > 0), top AS (SELECT max(v) AS x FROM placed WHERE p = 0)
    SELECT item_id, round(CASE WHEN p > 0 THEN p ELSE v / x * {0.5 / BUDGET} END, 6) + 0.0 AS score, selected FROM placed, top""")
def orient_scores(spark, sf):
    return _scores(selection.orient_flmi(pool(spark, sf), target(spark, sf), BUDGET))


@query("orient_set", f"{_ORIENT} SELECT item_id FROM g WHERE step > 0")
def orient_set(spark, sf):
    return selection.orient_set(pool(spark, sf), target(spark, sf), BUDGET)


# ------------------------------------------------------------------ k-means and random

_ASSIGNED = f"""WITH {SQL_ITEMS}, dims AS (SELECT site, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pool),
    centers AS (SELECT site - 1 AS cluster, list(m ORDER BY i) AS c FROM (SELECT site, i, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1),
    near AS (SELECT item_id, cluster, list_distance(v, c) AS d,
      row_number() OVER (PARTITION BY item_id ORDER BY round(list_distance(v, c), 12), cluster) AS o FROM pool, centers),
    a AS (SELECT item_id, cluster, d FROM near WHERE o = 1),
    reps AS (SELECT cluster, count(*) AS size, arg_min(item_id, {{'d': round(d, 9), 'i': item_id}}) AS item_id, min(d) AS d FROM a GROUP BY 1)"""


def _site_centers(spark, sf):
    """The mean vector of each site of the pool, as fixed centers (one per site)."""
    means = aggregate.aggregate_vectors(pool(spark, sf), "site").orderBy("site").toArrow()
    return matrix(means.column("vec"))


@query("kmeans_reps", f"""{_ASSIGNED} SELECT row_number() OVER (ORDER BY cluster) AS rank, item_id, round(d, 6) + 0.0 AS gain FROM reps""")
def kmeans_reps(spark, sf):
    centers = _site_centers(spark, sf)
    return _ranking(selection.kmeans_select(pool(spark, sf), len(centers), centers=centers))


@query("kmeans_scores", f"""{_ASSIGNED}, n AS (SELECT count(*) AS b FROM centers), far AS (SELECT max(d) AS x FROM a),
    ranked AS (SELECT item_id, row_number() OVER (ORDER BY cluster) AS r FROM reps),
    raw AS (SELECT a.item_id, coalesce(1 + (b - (r - 1)) / b::DOUBLE, 1 - d / x) AS s, r IS NOT NULL AS selected
      FROM a LEFT JOIN ranked USING (item_id), n, far)
    SELECT item_id, round(s / (SELECT max(s) FROM raw), 6) + 0.0 AS score, selected FROM raw""")
def kmeans_scores(spark, sf):
    centers = _site_centers(spark, sf)
    return _scores(selection.kmeans_select(pool(spark, sf), len(centers), centers=centers))


@query("kmeans_by_size", f"""{_ASSIGNED}, ranked AS (SELECT item_id, row_number() OVER (ORDER BY size DESC, cluster) AS r FROM reps)
    SELECT item_id, round(coalesce(1 - (r - 1) / ((SELECT count(*) FROM reps) - 1)::DOUBLE, 0), 6) + 0.0 AS score,
      r IS NOT NULL AS selected FROM pool LEFT JOIN ranked USING (item_id)""")
def kmeans_by_size(spark, sf):
    centers = _site_centers(spark, sf)
    return _scores(selection.kmeans_by_size(pool(spark, sf), len(centers), centers=centers))


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    return _ranking(selection.kmeans_select(pool(spark, sf), BUDGET))


@query("random_select", f"""WITH {SQL_ITEMS}, o AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) AS r FROM pool)
    SELECT item_id, round(CASE WHEN r <= {BUDGET} THEN ({BUDGET} - r + 1) / {BUDGET}.0::DOUBLE
      ELSE ('0x' || md5('43:' || item_id)[1:8])::BIGINT / 4294967296.0::DOUBLE * {0.5 / BUDGET} END, 6) + 0.0 AS score, r <= {BUDGET} AS selected FROM o""")
def random_select(spark, sf):
    return _scores(selection.random_select(pool(spark, sf), BUDGET))


@query("score_all", f"""WITH RECURSIVE {SQL_ITEMS}, {SQL_PAIRS}, {sql_mean('q')},
    o AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) AS r FROM pool),
    w AS (SELECT item_id, exp(5 * s) / sum(exp(5 * s)) OVER (PARTITION BY q_id) AS w FROM pairs),
    su AS (SELECT item_id, sum(w) AS s FROM w GROUP BY 1)
    SELECT 'random' AS method, item_id, round(CASE WHEN r <= {BUDGET} THEN ({BUDGET} - r + 1) / {BUDGET}.0::DOUBLE
      ELSE ('0x' || md5('43:' || item_id)[1:8])::BIGINT / 4294967296.0::DOUBLE * {0.5 / BUDGET} END, 6) + 0.0 AS score FROM o
    UNION ALL SELECT 'craig_proxy', item_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) + 0.0 FROM su""")
def score_all(spark, sf):
    found = selection.score_all(["random", "craig_proxy"], BUDGET, pool=pool(spark, sf), query=target(spark, sf))
    return found.select("method", "item_id", r6("score").alias("score"))


@query("score_all_methods", """WITH pool AS (SELECT vec_id FROM embeddings WHERE label <> 0)
    SELECT m AS method, count(DISTINCT vec_id) AS n_items, count(*) AS n_scores FROM pool,
      (SELECT unnest(['craig', 'craig_proxy', 'diversity', 'gradmatch', 'gradmatch_mp', 'herding', 'kcenter', 'kmeans', 'less', 'orient', 'random', 'rds']) AS m) GROUP BY 1""")
def score_all_methods(spark, sf):
    """Every registered method gives every pool item exactly one score."""
    data, aim = pool(spark, sf), target(spark, sf)
    found = selection.score_all(selection.methods(), BUDGET, pool=data, query=aim, pool_grads=gradients(data), query_grads=gradients(aim))
    scored = found.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.groupBy("method").agg(F.count_distinct("item_id").alias("n_items"), F.count(F.lit(1)).alias("n_scores"))


@query("order_by_gain", f"""WITH {SQL_ITEMS}, {SQL_PAIRS} SELECT item_id, round(max(s), 6) + 0.0 AS score FROM pairs GROUP BY 1 ORDER BY max(s) DESC, item_id LIMIT {BUDGET}""")
def order_by_gain(spark, sf):
    found = order_scores(selection.rds_max(pool(spark, sf), target(spark, sf), BUDGET).ranking, "gain")
    return found.select("item_id", r6("score").alias("score"))


# ------------------------------------------------------------------ vector aggregation


def _sql_aggregate(fn: str) -> str:
    return f"""WITH d AS (SELECT vec_id // 5 AS subject_id, unnest(embedding::DOUBLE[]) AS x,
      generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT subject_id, i - 1 AS dim, round({fn}(x), 6) + 0.0 AS value FROM d GROUP BY 1, 2"""


def _long(df, *keys):
    """A vector column as rows (dim, value)."""
    return df.select(*keys, F.posexplode("vec").alias("dim", "value")).withColumn("value", r6("value"))


@query("subject_mean", _sql_aggregate("avg"))
def subject_mean(spark, sf):
    return _long(aggregate.aggregate_vectors(slices(spark, sf), "subject_id", "mean"), "subject_id")


@query("subject_max", _sql_aggregate("max"))
def subject_max(spark, sf):
    return _long(aggregate.aggregate_vectors(slices(spark, sf), "subject_id", "max"), "subject_id")


@query("subject_sum", _sql_aggregate("sum"))
def subject_sum(spark, sf):
    return _long(aggregate.aggregate_vectors(slices(spark, sf), "subject_id", "sum"), "subject_id")


@query("case_embedding", """WITH d AS (SELECT vec_id // 5 AS subject_id, unnest(embedding::DOUBLE[]) AS x,
      generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT subject_id, i, avg(x) AS x FROM d GROUP BY 1, 2)
    SELECT subject_id, i - 1 AS dim, round(x / (sqrt(sum(x * x) OVER (PARTITION BY subject_id)) + 1e-8), 6) + 0.0 AS value FROM m""")
def case_embedding(spark, sf):
    return _long(aggregate.case_embedding(slices(spark, sf)), "subject_id")


@query("l2_normalize", """WITH d AS (SELECT vec_id AS item_id, unnest(embedding::DOUBLE[]) * (1 + vec_id % 7) AS x,
      generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT item_id, i - 1 AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-8), 6) + 0.0 AS value FROM d""")
def l2_normalize_items(spark, sf):
    return _long(gradients(items(spark, sf)).select("item_id", l2_normalize(F.col("vec")).alias("vec")), "item_id")


@query("centroid", f"WITH {SQL_ITEMS}, {sql_mean('items')} SELECT generate_subscripts(c, 1) - 1 AS dim, round(unnest(c), 6) + 0.0 AS value FROM center")
def centroid(spark, sf):
    return _long(aggregate.centroid(items(spark, sf)))


@query("distance_to_centroid", f"WITH {SQL_ITEMS}, {sql_mean('q')} SELECT item_id, round(list_distance(v, c), 6) + 0.0 AS dist FROM pool, center")
def distance_to_centroid(spark, sf):
    center = constant(aggregate.centroid_array(target(spark, sf)))
    return pool(spark, sf).select("item_id", r6(distance(F.col("vec"), center)).alias("dist"))


@query("gram_matrix", """WITH d AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT a.i - 1 AS row, b.i - 1 AS dim, round(sum(a.x * b.x), 6) + 0.0 AS value FROM d a JOIN d b USING (vec_id) GROUP BY 1, 2""")
def gram_matrix(spark, sf):
    return _long(aggregate.gram_matrix(items(spark, sf)).withColumnRenamed("dim", "row"), "row")


def _sketch_table(spark, width=64):
    dims = spark.range(width).select(F.col("id").cast("int").alias("dim"))
    return dims.select(
        "dim", ((F.col("dim") * 7 + 3) % 16).alias("bucket"), F.when(F.col("dim") * 5 % 3 == 0, -1.0).otherwise(1.0).alias("sign")
    )


_SKETCH = """SELECT {key}, ((i - 1) * 7 + 3) % 16 AS dim,
      round(sum(x * CASE WHEN (i - 1) * 5 % 3 = 0 THEN -1 ELSE 1 END), 6) + 0.0 AS value FROM d GROUP BY 1, 2"""


@query("countsketch", "WITH d AS (SELECT vec_id AS item_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) "
       + _SKETCH.format(key="item_id"))
def countsketch(spark, sf):
    return _long(aggregate.countsketch(items(spark, sf), 16, hash_table=_sketch_table(spark)), "item_id")


@query("countsketch_hashed", """WITH d AS (SELECT vec_id AS item_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    h AS (SELECT i, ('0x' || md5('1:' || i)[1:8])::BIGINT % 16 AS dim, CASE WHEN ('0x' || md5('1:' || i)[9:16])::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign
      FROM (SELECT DISTINCT i FROM d)),
    cells AS (SELECT item_id, dim, sum(x * sign) AS v FROM d JOIN h USING (i) GROUP BY 1, 2),
    every AS (SELECT vec_id AS item_id, unnest(range(16)) AS dim FROM embeddings)
    SELECT item_id, dim, round(coalesce(v, 0), 6) + 0.0 AS value FROM every LEFT JOIN cells USING (item_id, dim)""")
def countsketch_hashed(spark, sf):
    return _long(aggregate.countsketch(items(spark, sf), 16, seed=1), "item_id")


@query("case_gradient", """WITH e AS (SELECT vec_id // 5 AS subject_id, unnest(embedding::DOUBLE[]) AS x,
      generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT subject_id, i, avg(x) AS x FROM e GROUP BY 1, 2) """
       + _SKETCH.format(key="subject_id"))
def case_gradient(spark, sf):
    return _long(aggregate.case_gradient(slices(spark, sf), 16, hash_table=_sketch_table(spark)), "subject_id")


@query("simplex_weights", """WITH d AS (SELECT vec_id AS item_id, greatest(unnest(embedding::DOUBLE[]), 0) AS x,
      generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT item_id, i - 1 AS dim, round(x / sum(x) OVER (PARTITION BY item_id), 6) + 0.0 AS value FROM d""")
def simplex_weights(spark, sf):
    return _long(items(spark, sf).select("item_id", project_simplex(F.col("vec")).alias("vec")), "item_id")


@query("rank_weights", """WITH n AS (SELECT label AS site, count(*) AS mu FROM embeddings GROUP BY 1),
    w AS (SELECT site, mu, unnest(range(1, mu + 1)) AS i FROM n), r AS (SELECT site, i, ln(mu + 0.5) - ln(i) AS x FROM w)
    SELECT site, i - 1 AS dim, round(x / sum(x) OVER (PARTITION BY site), 6) + 0.0 AS value FROM r""")
def rank_weights_by_site(spark, sf):
    sizes = items(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("mu"))
    return rank_weight_rows(sizes, ["site"]).withColumn("value", r6("value"))


@query("parse_seeds", """SELECT o_custkey AS item_id, list_sum(list_transform(string_split(o_custkey || ', ' || o_orderkey, ', '),
    lambda s: s::BIGINT))::BIGINT AS total, 2::INTEGER AS n FROM orders""")
def parse_seeds_query(spark, sf):
    text = F.concat_ws(", ", "o_custkey", "o_orderkey")
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("item_id"), parse_seeds(text).alias("seeds"))
    return seeds.select(
        "item_id", F.aggregate("seeds", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("seeds").alias("n")
    )


