"""Score normalising, mixing and budgets over customers; weight search over their scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gleaner.operators import scores as S
from gleaner.operators import search
from gleaner.plans.registry import (
    KS,
    SQL_PARTIAL,
    SQL_SCORES,
    partial_scores,
    query,
    r6,
    scores,
    table,
)

METHODS = ["acctbal", "n_orders", "spend"]
WEIGHTS = {"acctbal": 0.5, "n_orders": 0.3, "spend": 0.2}


def _out(df, *keys):
    return df.select(*keys, "item_id", r6("score").alias("score"))


_RANKED = f"""WITH {SQL_SCORES}, r AS (SELECT method, item_id, score, rank() OVER (PARTITION BY method ORDER BY score DESC) AS first,
      count(*) OVER (PARTITION BY method, score) AS ties, count(*) OVER (PARTITION BY method) AS n FROM scores),
    norm AS (SELECT method, item_id, 1 - (first - 1 + (ties - 1) / 2.0::DOUBLE) / (n - 1) AS score FROM r)"""


@query("rank_norm", f"{_RANKED} SELECT method, item_id, round(score, 6) + 0.0 AS score FROM norm")
def rank_norm(spark, sf):
    return _out(S.rank_normalize(scores(spark, sf)), "method")


_MINMAX = f"""WITH {SQL_SCORES}, norm AS (SELECT method, item_id, (score - min(score) OVER (PARTITION BY method)) /
      (max(score) OVER (PARTITION BY method) - min(score) OVER (PARTITION BY method)) AS score FROM scores)"""


@query("minmax_norm", f"{_MINMAX} SELECT method, item_id, round(score, 6) + 0.0 AS score FROM norm")
def minmax_norm(spark, sf):
    return _out(S.minmax_normalize(scores(spark, sf)), "method")


@query("minmax_lenient", f"""WITH {SQL_SCORES}, x AS (SELECT * FROM scores UNION ALL SELECT item_id, 'flat', 1 FROM scores WHERE method = 'spend'),
    m AS (SELECT method, min(score) AS lo, max(score) AS hi FROM x GROUP BY 1)
    SELECT method, item_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END, 6) + 0.0 AS score FROM x JOIN m USING (method)""")
def minmax_lenient(spark, sf):
    known = scores(spark, sf)
    flat = known.filter(F.col("method") == "spend").select("item_id", F.lit("flat").alias("method"), F.lit(1.0).alias("score"))
    return _out(S.minmax_normalize(known.unionByName(flat), strict=False), "method")


@query("score_alignment", f"WITH {SQL_PARTIAL} SELECT item_id, count(DISTINCT method) AS n_methods FROM part GROUP BY 1 HAVING count(DISTINCT method) <> 3")
def score_alignment(spark, sf):
    return S.check_alignment(partial_scores(spark, sf))


@query("align_scores", f"""WITH {SQL_PARTIAL} SELECT item_id, round(coalesce(max(score) FILTER (method = 'acctbal'), 0), 6) + 0.0 AS acctbal,
    round(coalesce(max(score) FILTER (method = 'n_orders'), 0), 6) + 0.0 AS n_orders,
    round(coalesce(max(score) FILTER (method = 'spend'), 0), 6) + 0.0 AS spend FROM part GROUP BY 1""")
def align_scores(spark, sf):
    wide = S.align_scores(partial_scores(spark, sf), METHODS)
    return wide.select("item_id", *[r6(m).alias(m) for m in METHODS])


_MIX = f"""{_RANKED}, mixed AS (SELECT item_id, sum(score * CASE method WHEN 'acctbal' THEN 0.5::DOUBLE WHEN 'n_orders' THEN 0.3 ELSE 0.2 END) AS score
    FROM norm GROUP BY 1)"""


@query("mix_strict", f"{_MIX} SELECT item_id, round(score, 6) + 0.0 AS score FROM mixed")
def mix_strict(spark, sf):
    return _out(S.mix(S.rank_normalize(scores(spark, sf)), WEIGHTS))


_LENIENT = f"""WITH {SQL_PARTIAL}, wide AS (SELECT item_id, coalesce(max(score) FILTER (method = 'acctbal'), 0) AS a,
      coalesce(max(score) FILTER (method = 'n_orders'), 0) AS n, coalesce(max(score) FILTER (method = 'spend'), 0) AS s FROM part GROUP BY 1),
    scaled AS (SELECT item_id, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a,
      (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) AS n, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM wide),
    mixed AS (SELECT item_id, (2 * a + 1 * s) / 3 + 0 * n AS score FROM scaled)"""


@query("mix_lenient", f"{_LENIENT} SELECT item_id, round(score, 6) + 0.0 AS score FROM mixed")
def mix_lenient(spark, sf):
    return _out(S.mix(partial_scores(spark, sf), {"acctbal": 2.0, "n_orders": -1.0, "spend": 1.0}, strict=False))


@query("final_selection", f"{_LENIENT} SELECT item_id, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM mixed ORDER BY rank LIMIT 50")
def final_selection(spark, sf):
    return _out(search.final_selection(partial_scores(spark, sf), {"acctbal": 2.0, "n_orders": -1.0, "spend": 1.0}, 50), "rank")


@query("top_budget", f"""WITH {SQL_SCORES} SELECT * FROM (SELECT method, item_id, score,
    row_number() OVER (PARTITION BY method ORDER BY score DESC, item_id) AS rank FROM scores) WHERE rank <= 100""")
def top_budget(spark, sf):
    return S.top_budget(scores(spark, sf), 100, ["method"]).select("method", "item_id", "score", "rank")


@query("rank_all", f"WITH {SQL_SCORES} SELECT method, item_id, row_number() OVER (PARTITION BY method ORDER BY score DESC, item_id) AS rank FROM scores")
def rank_all(spark, sf):
    return S.rank_all(scores(spark, sf), ["method"]).select("method", "item_id", "rank")


@query("nested_budgets", f"""{_MIX}, ranked AS (SELECT item_id, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank FROM mixed)
    SELECT k, 30 * k AS budget, item_id, rank FROM ranked, (SELECT unnest([1, 5, 10, 15]) AS k) WHERE rank <= 30 * k""")
def nested_budgets(spark, sf):
    mixed = S.mix(S.rank_normalize(scores(spark, sf)), WEIGHTS).withColumn("score", F.round("score", 9))
    return S.nested_budgets(S.top_budget(mixed, 30 * max(KS)), KS, 30).select("k", "budget", "item_id", "rank")


def _order_sql(expr: str) -> str:
    return f"""WITH {SQL_SCORES}, ranked AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank,
      count(*) OVER () AS n FROM scores WHERE method = 'spend') SELECT item_id, round({expr}, 6) + 0.0 AS score FROM ranked"""


def _spend_ranking(spark, sf):
    return S.rank_all(scores(spark, sf).filter(F.col("method") == "spend"))


@query("order_scores_budget", _order_sql("(n - rank + 1) / n::DOUBLE"))
def order_scores_budget(spark, sf):
    return _out(S.order_scores(_spend_ranking(spark, sf), "budget"))


@query("order_scores_unit", _order_sql("1 - (rank - 1) / (n - 1)::DOUBLE"))
def order_scores_unit(spark, sf):
    return _out(S.order_scores(_spend_ranking(spark, sf), "unit"))


@query("secondary_scores", f"""WITH {SQL_SCORES}, s AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank
      FROM scores WHERE method = 'spend'), rest AS (SELECT item_id, score FROM s WHERE rank > 100)
    SELECT item_id, round(score / max(score) OVER () * 0.5::DOUBLE / 100, 6) + 0.0 AS score FROM rest""")
def secondary_scores(spark, sf):
    spend = scores(spark, sf).filter(F.col("method") == "spend")
    values = spend.select("item_id", F.col("score").alias("value"))
    return _out(S.secondary_scores(values, S.top_budget(spend, 100), 100))


# ------------------------------------------------------------------ weight search


def _sql_population(candidates: str, budget: int) -> str:
    return f"""{_RANKED}, cand AS ({candidates}),
    mixed AS (SELECT cand, item_id, sum(score * CASE method WHEN 'acctbal' THEN a WHEN 'n_orders' THEN n ELSE s END) AS score
      FROM norm, cand GROUP BY 1, 2),
    ranked AS (SELECT cand, item_id, score, row_number() OVER (PARTITION BY cand ORDER BY round(score, 9) DESC, item_id) AS rank FROM mixed)
    SELECT cand, rank, item_id, round(score, 6) + 0.0 AS score FROM ranked WHERE rank <= {budget}"""


def _subsets(spark, sf, candidates, budget):
    found = search.evaluate_population(S.rank_normalize(scores(spark, sf)), candidates, budget, decimals=9)
    return found.select("cand", "rank", "item_id", r6("score").alias("score"))


#: Candidates from the market segments: mean balance and counts, shifted so that some weights clip.
_SEGMENTS = """SELECT (row_number() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS cand, avg(c_acctbal) / 4000 - 1 AS a,
      count(*) / 1000.0::DOUBLE AS n, max(c_acctbal) / 10000 AS s FROM customer GROUP BY c_mktsegment"""


@query("population_subsets", _sql_population(f"""SELECT cand, greatest(a, 0) / t AS a, greatest(n, 0) / t AS n, greatest(s, 0) / t AS s
    FROM (SELECT *, greatest(a, 0) + greatest(n, 0) + greatest(s, 0) AS t FROM ({_SEGMENTS}))""", 40))
def population_subsets(spark, sf):
    segments = table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        (F.avg("c_acctbal") / 4000 - 1).alias("a"), (F.count(F.lit(1)) / 1000.0).alias("n"), (F.max("c_acctbal") / 10000).alias("s")
    ).orderBy("c_mktsegment").toArrow()
    weights = list(zip(*[segments.column(c).to_pylist() for c in ("a", "n", "s")]))
    return _subsets(spark, sf, search.candidate_table(spark, METHODS, weights), 40)


@query("corner_subsets", _sql_population("""SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 1.0, 0.0),
    (2, 0.0, 0.0, 1.0), (3, 1/3.0::DOUBLE, 1/3.0::DOUBLE, 1/3.0::DOUBLE)) t(cand, a, n, s)""", 40))
def corner_subsets(spark, sf):
    return _subsets(spark, sf, search.corner_candidates(spark, METHODS), 40)


#: Size of a generation, and its parents.
POPSIZE, PARENTS = 20, 10

#: The first generation: equal weights plus 0.3 times normal draws from hashes.
_UNIT = "((('0x' || substr(md5('0:0:' || i || ':{j}:{k}'), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
_DRAWS = ", ".join(
    f"1 / 3.0::DOUBLE + 0.3::DOUBLE * sqrt(-2 * ln({_UNIT.format(j=j, k=1)})) * cos(2 * pi() * {_UNIT.format(j=j, k=2)}) AS {w}" for j, w in enumerate("ans")
)
_DRAWN = f"SELECT i::INTEGER AS cand, {_DRAWS} FROM range({POPSIZE}) t(i)"
_PROJECTED = f"""SELECT cand, CASE WHEN t > 0 THEN greatest(a, 0) / t ELSE 1 / 3.0::DOUBLE END AS a, CASE WHEN t > 0 THEN greatest(n, 0) / t ELSE 1 / 3.0::DOUBLE END AS n,
    CASE WHEN t > 0 THEN greatest(s, 0) / t ELSE 1 / 3.0::DOUBLE END AS s FROM (SELECT *, greatest(a, 0) + greatest(n, 0) + greatest(s, 0) AS t FROM ({_DRAWN}))"""


def _first_generation(spark, sf):
    """(candidates, their subsets, fitness = mean spend of the subset)."""
    known = S.rank_normalize(scores(spark, sf))
    state = search.SearchState.start(len(METHODS))
    candidates = search.candidate_table(spark, METHODS, search.sample_generation(state, POPSIZE, seed=0), state.gen)
    found = search.evaluate_population(known, candidates, 40, decimals=9)
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.sum("o_totalprice").alias("value"))
    rated = found.join(spend, "item_id").groupBy("gen", "cand").agg(F.avg("value").alias("fitness"))
    return candidates, found, rated


@query("search_generation", _sql_population(_PROJECTED, 40))
def search_generation(spark, sf):
    """The first whole generation, drawn and evaluated to subsets."""
    found = _first_generation(spark, sf)[1]
    return found.select("cand", "rank", "item_id", r6("score").alias("score"))


def _sql_update() -> str:
    """Mean, step size and trace of the covariance after one generation, from the tutorial's formulas."""
    n, mu = 3, PARENTS
    raw = [math.log(mu + 0.5) - math.log(i) for i in range(1, mu + 1)]
    share = [x / sum(raw) for x in raw]
    eff = 1 / sum(x * x for x in share)
    cs, cc = (eff + 2) / (n + eff + 5), (4 + eff / n) / (n + 4 + 2 * eff / n)
    c1 = 2 / ((n + 1.3) ** 2 + eff)
    cmu = min(1 - c1, 2 * (eff - 2 + 1 / eff) / ((n + 2) ** 2 + eff))
    damps = 1 + cs + 2 * max(0.0, math.sqrt((eff - 1) / (n + 1)) - 1)
    chi = math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
    subsets = _sql_population(_PROJECTED, 40)
    return f"""WITH subsets AS ({subsets}),
    spend AS (SELECT o_custkey AS item_id, sum(o_totalprice) AS value FROM orders GROUP BY 1),
    rated AS (SELECT cand, avg(value) AS fitness FROM subsets JOIN spend USING (item_id) GROUP BY 1),
    placed AS (SELECT cand, row_number() OVER (ORDER BY fitness DESC, cand) AS r FROM rated),
    parents AS (SELECT d.a, d.n, d.s, ([{", ".join(map(repr, share))}]::DOUBLE[])[r] AS w FROM placed JOIN ({_DRAWN}) d USING (cand) WHERE r <= {mu}),
    y AS (SELECT w, [(a - 1 / 3.0::DOUBLE) / 0.3::DOUBLE, (n - 1 / 3.0::DOUBLE) / 0.3::DOUBLE, (s - 1 / 3.0::DOUBLE) / 0.3::DOUBLE] AS z FROM parents),
    m AS (SELECT [sum(w * z[1]), sum(w * z[2]), sum(w * z[3])] AS step, sum(w * list_inner_product(z, z)) AS spread FROM y),
    p AS (SELECT step, spread, list_inner_product(step, step) AS ss, sqrt({cs * (2 - cs) * eff!r}::DOUBLE * list_inner_product(step, step)) AS len FROM m),
    h AS (SELECT *, CASE WHEN len / {math.sqrt(1 - (1 - cs) ** 2)!r}::DOUBLE < {(1.4 + 2 / (n + 1)) * chi!r}::DOUBLE THEN 1 ELSE 0 END AS moving FROM p)
    SELECT 1 AS gen, unnest(['acctbal', 'n_orders', 'spend']) AS method, round(unnest(list_transform(step, lambda x: 1 / 3.0::DOUBLE + 0.3::DOUBLE * x)), 6) + 0.0 AS mean,
      round(greatest(0.3::DOUBLE * exp({cs / damps!r}::DOUBLE * (len / {chi!r}::DOUBLE - 1)), 0.02::DOUBLE), 6) + 0.0 AS sigma,
      round((1 - {c1 + cmu!r}::DOUBLE + {c1 * cc * (2 - cc)!r}::DOUBLE * (1 - moving)) * 3 + {c1 * cc * (2 - cc) * eff!r}::DOUBLE * moving * ss + {cmu!r}::DOUBLE * spread, 6) + 0.0 AS trace
    FROM h"""


@query("search_update", _sql_update())
def search_update(spark, sf):
    """The search distribution after the first generation and its diagnostics, from the ten fittest of twenty."""
    candidates, _, rated = _first_generation(spark, sf)
    parents = search.parents_of(candidates.join(rated, ["gen", "cand"]), METHODS, PARENTS)
    state = search.update_state(search.SearchState.start(len(METHODS)), parents)
    facts = search.state_diagnostics(state)
    rows = [(facts["gen"], m, float(x), facts["sigma"], facts["trace"]) for m, x in zip(METHODS, state.mean)]
    out = spark.createDataFrame(rows, "gen int, method string, mean double, sigma double, trace double")
    return out.select("gen", "method", *[r6(c).alias(c) for c in ("mean", "sigma", "trace")])


@query("search_refined", f"""WITH subsets AS ({_sql_population(_PROJECTED, 40)}), o AS (SELECT o_custkey AS item_id, sum(o_totalprice) AS spend, count(*) AS orders FROM orders GROUP BY 1),
    rated AS (SELECT cand, avg(spend) AS fitness, avg(spend / orders) AS again FROM subsets JOIN o USING (item_id) GROUP BY 1),
    best AS (SELECT row_number() OVER (ORDER BY fitness DESC, cand) - 1 AS cand, again FROM rated ORDER BY fitness DESC, cand LIMIT 8)
    SELECT cand::INTEGER AS cand, round(again, 4) + 0.0 AS fitness, row_number() OVER (ORDER BY again DESC, cand) AS rank FROM best ORDER BY rank LIMIT 3""")
def search_refined(spark, sf):
    """The eight fittest candidates of a generation rated again by another measure, of which three are kept."""
    candidates, _, rated = _first_generation(spark, sf)
    each = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg((F.sum("o_totalprice") / F.count(F.lit(1))).alias("value"))

    def again(selection, _):
        return selection.join(each, "item_id").groupBy("gen", "cand").agg(F.avg("value").alias("fitness"))

    _, best = search.refine(S.rank_normalize(scores(spark, sf)), candidates.join(rated, ["gen", "cand"]), METHODS, 40, again)
    return best.select("cand", (F.round("fitness", 4) + 0.0).alias("fitness"), "rank")


def evals(spark, sf):
    """Orders as evaluations: a generation per year, three seeds, fitness = price."""
    return table(spark, sf, "orders").select(
        (F.year("o_orderdate") - 1995).cast("int").alias("gen"), F.col("o_orderkey").alias("cand"),
        (F.col("o_orderkey") % 3).cast("int").alias("seed"), F.col("o_totalprice").alias("fitness"),
    )


SQL_EVALS = """evals AS (SELECT year(o_orderdate) - 1995 AS gen, o_orderkey AS cand, o_orderkey % 3 AS seed, o_totalprice AS fitness FROM orders)"""


@query("running_best", f"""WITH {SQL_EVALS}, g AS (SELECT gen, max(fitness) AS best_fitness FROM evals GROUP BY 1)
    SELECT gen, best_fitness, max(best_fitness) OVER (ORDER BY gen) AS global_best_fitness FROM g""")
def running_best(spark, sf):
    return search.best_so_far(evals(spark, sf))


@query("refine_candidates", f"""WITH {SQL_EVALS} SELECT gen, cand, fitness, row_number() OVER (ORDER BY fitness DESC, gen, cand) AS rank
    FROM evals ORDER BY rank LIMIT 8""")
def refine_candidates(spark, sf):
    return search.top_k(evals(spark, sf), 8).select("gen", "cand", "fitness", "rank")
