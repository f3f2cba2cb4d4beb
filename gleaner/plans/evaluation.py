"""Dice, leaderboards, fitness and logs. Predictions and truths come from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import evaluate as E
from gleaner.plans.images import SQL_IMAGES, images
from gleaner.plans.registry import query, r6, table
from gleaner.plans.scoring import SQL_EVALS, evals


def r4(name: str):
    """Four decimals of a mean of prices; the shift keeps exact halves on one side."""
    return F.round(F.col(name) + 1e-7, 4)


def voxels(spark, sf):
    gt = (F.col("l_suppkey") % 4).cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("subject_id"), F.col("l_linenumber").alias("z"), gt.alias("gt"),
        F.when(F.col("l_quantity") > 10, gt).otherwise((F.col("l_partkey") % 4).cast("int")).alias("pred"),
    )


SQL_VOXELS = """vox AS (SELECT l_returnflag AS run, l_orderkey AS subject_id, l_linenumber AS z, l_suppkey % 4 AS gt,
    CASE WHEN l_quantity > 10 THEN l_suppkey % 4 ELSE l_partkey % 4 END AS pred FROM lineitem)"""

_CASES = f"""WITH {SQL_VOXELS}, c AS (SELECT run, subject_id, count(*) FILTER (pred > 0 AND gt > 0) AS i, count(*) FILTER (pred > 0) AS p,
    count(*) FILTER (gt > 0) AS g, count(DISTINCT z) AS s FROM vox GROUP BY 1, 2)"""


def _sql_dice(expr: str) -> str:
    return f"""{_CASES} SELECT run, subject_id, round({expr}, 6) AS dice, s AS num_slices, g AS gt_volume, p AS pred_volume FROM c"""


def _dice(spark, sf, mode):
    return E.dice(voxels(spark, sf), mode=mode).withColumn("dice", r6("dice"))


@query("dice_case", _sql_dice("CASE WHEN p + g = 0 THEN 1 ELSE 2 * i / (p + g)::DOUBLE END"))
def dice_case(spark, sf):
    return _dice(spark, sf, "plain")


@query("dice_case_smooth", _sql_dice("(2 * i + 1e-5::DOUBLE) / (p + g + 1e-5::DOUBLE)"))
def dice_case_smooth(spark, sf):
    return _dice(spark, sf, "smooth")


@query("dice_case_eps", _sql_dice("2 * i / (p + g + 1e-8::DOUBLE)"))
def dice_case_eps(spark, sf):
    return _dice(spark, sf, "eps")


_REGION = {
    "ET": ("pred = 3", "gt = 3"),
    "TC": ("pred IN (2, 3)", "gt IN (2, 3)"),
    "WT": ("pred > 0", "gt > 0"),
}
_REGION_CASES = "SELECT run, subject_id, " + ", ".join(
    f"2 * count(*) FILTER ({p} AND {g}) / (count(*) FILTER ({p}) + count(*) FILTER ({g}) + 1e-8::DOUBLE) AS {n}" for n, (p, g) in _REGION.items()
) + " FROM vox {where} GROUP BY 1, 2"
_REGION_MEANS = """SELECT run, round(avg(ET), 6) AS "dice_ET", round(avg(TC), 6) AS "dice_TC", round(avg(WT), 6) AS "dice_WT", count(*) AS num_subjects,
    round((avg(ET) + avg(TC) + avg(WT)) / 3, 6) AS dice_macro"""


def _rounded(df):
    return df.withColumns({c: r6(c) for c in df.columns if c.startswith("dice")})


@query("dice_regions", f"WITH {SQL_VOXELS}, c AS ({_REGION_CASES.format(where='')}) {_REGION_MEANS} FROM c GROUP BY 1")
def dice_regions(spark, sf):
    return _rounded(E.region_dice(voxels(spark, sf)))


@query("dice_region_cases", f"""WITH {SQL_VOXELS}, c AS ({_REGION_CASES.format(where='')})
    SELECT run, subject_id, round(ET, 6) AS "dice_ET", round(TC, 6) AS "dice_TC", round(WT, 6) AS "dice_WT" FROM c""")
def dice_region_cases(spark, sf):
    return _rounded(E.region_dice_cases(voxels(spark, sf)))


@query("dice_early", f"""WITH {SQL_VOXELS}, ch AS (SELECT subject_id AS s FROM (SELECT DISTINCT subject_id FROM vox) ORDER BY md5('0:' || subject_id), subject_id LIMIT 15),
    c AS ({_REGION_CASES.format(where='WHERE subject_id IN (SELECT s FROM ch)')}), n AS (SELECT count(DISTINCT subject_id) AS v FROM vox)
    {_REGION_MEANS}, any_value(v) AS val_size, 15 >= any_value(v) AS is_full_val FROM c, n GROUP BY 1""")
def dice_early(spark, sf):
    return _rounded(E.region_dice(voxels(spark, sf), max_subjects=15))


@query("dice_micro", f"""WITH {SQL_VOXELS} SELECT run, round(2 * count(*) FILTER (pred = 1 AND gt = 1) / (count(*) FILTER (pred = 1) + count(*) FILTER (gt = 1))::DOUBLE, 6) AS dice
    FROM vox GROUP BY 1""")
def dice_micro(spark, sf):
    return _rounded(E.micro_dice(voxels(spark, sf), by=["run"]))


@query("leaderboard", f"""{_CASES}, d AS (SELECT *, CASE WHEN p + g = 0 THEN 1 ELSE 2 * i / (p + g)::DOUBLE END AS dice FROM c)
    SELECT run, round(avg(dice), 6) AS mean_dice, round(stddev_pop(dice), 6) AS std_dice, sum(g)::BIGINT AS gt_volume, sum(p)::BIGINT AS pred_volume,
      count(*) AS n_cases, round(sum(p) / sum(g)::DOUBLE, 6) AS volume_ratio FROM d GROUP BY 1""")
def leaderboard(spark, sf):
    board = E.run_summary(E.dice(voxels(spark, sf)))
    return board.withColumns({c: r6(c) for c in ("mean_dice", "std_dice", "volume_ratio")})


@query("ensemble_argmax", f"""WITH {SQL_IMAGES}, l AS (SELECT subject_id // 4 AS subject_id, z, y, x, channel AS cls, subject_id % 4 AS aug, value FROM vox),
    u AS (SELECT subject_id, z, cls, value, CASE WHEN aug IN (1, 3) THEN 7 - x ELSE x END AS x, CASE WHEN aug IN (2, 3) THEN 7 - y ELSE y END AS y FROM l),
    m AS (SELECT subject_id, z, y, x, cls, round(avg(value), 9) AS m FROM u GROUP BY ALL)
    SELECT subject_id, z, y, x, arg_max(cls, {{'m': m, 'c': -cls}}) AS pred FROM m GROUP BY 1, 2, 3, 4""")
def ensemble_argmax(spark, sf):
    """Four cases are the four mirrored passes of one; their channels are class logits."""
    passes = F.array(F.lit("none"), F.lit("h"), F.lit("v"), F.lit("hv"))
    logits = images(spark, sf).select(
        F.expr("subject_id div 4").alias("subject_id"), "z", "y", "x", F.col("channel").alias("cls"),
        F.element_at(passes, (F.col("subject_id") % 4 + 1).cast("int")).alias("aug"), F.col("value").alias("logit"),
    )
    return E.ensemble_argmax(logits, 8, 8).select("subject_id", *[F.col(c).cast("long").alias(c) for c in ("z", "y", "x", "pred")])


# ------------------------------------------------------------------ fitness and logs


@query("generation_summary", f"""WITH {SQL_EVALS}, g AS (SELECT gen, max(fitness) AS best_fitness, avg(fitness) AS mean_fitness, stddev_pop(fitness) AS std_fitness,
      arg_max(cand, {{'f': fitness, 'c': -cand}}) AS best_cand FROM evals GROUP BY 1)
    SELECT gen, best_fitness, round(mean_fitness + 1e-7, 4) AS mean_fitness, round(std_fitness + 1e-7, 4) AS std_fitness, best_cand,
      max(best_fitness) OVER (ORDER BY gen) AS global_best_fitness FROM g""")
def generation_summary(spark, sf):
    found = E.generation_summary(evals(spark, sf))
    return found.withColumns({c: r4(c) for c in ("mean_fitness", "std_fitness")})


def _fitness(spark, sf, mode):
    runs = evals(spark, sf).withColumn("cand", F.col("cand") % 100)
    return E.aggregate_fitness(runs, mode).withColumn("fitness", r4("fitness"))


_FITNESS = "WITH {evals} SELECT gen, cand % 100 AS cand, round({fn}(fitness) + 1e-7, 4) AS fitness FROM evals GROUP BY 1, 2"


@query("fitness_mean", _FITNESS.format(evals=SQL_EVALS, fn="avg"))
def fitness_mean(spark, sf):
    return _fitness(spark, sf, "mean")


@query("fitness_median", _FITNESS.format(evals=SQL_EVALS, fn="median"))
def fitness_median(spark, sf):
    return _fitness(spark, sf, "median")


def _runs(spark, sf):
    """A customer's orders by key are the epochs of a run."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("val_loss")
    )


SQL_RUNS = """runs AS (SELECT o_custkey AS run, o_orderkey AS epoch, o_totalprice AS val_loss FROM orders)"""


def _topk(spark, sf, mode):
    return E.topk_log_fitness(_runs(spark, sf), 4, mode, "val_loss").select("run", r4("fitness").alias("fitness"))


@query("topk_median_fitness", f"""WITH {SQL_RUNS}, t AS (SELECT run, val_loss, row_number() OVER (PARTITION BY run ORDER BY val_loss DESC) AS r FROM runs)
    SELECT run, round(median(val_loss) + 1e-7, 4) AS fitness FROM t WHERE r <= 4 GROUP BY 1""")
def topk_median_fitness(spark, sf):
    return _topk(spark, sf, "median")


@query("best_fitness", f"WITH {SQL_RUNS} SELECT run, round(max(val_loss) + 1e-7, 4) AS fitness FROM runs GROUP BY 1")
def best_fitness(spark, sf):
    return _topk(spark, sf, "best")


@query("final_fitness", f"WITH {SQL_RUNS} SELECT run, round(arg_max(val_loss, epoch) + 1e-7, 4) AS fitness FROM runs GROUP BY 1")
def final_fitness(spark, sf):
    return _topk(spark, sf, "final")


@query("best_checkpoint", f"WITH {SQL_RUNS} SELECT run, val_loss, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS r FROM runs) WHERE r = 1")
def best_checkpoint(spark, sf):
    return E.pick_checkpoint(_runs(spark, sf))


@query("best_dice_checkpoint", f"WITH {SQL_RUNS} SELECT run, val_loss, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss DESC, epoch) AS r FROM runs) WHERE r = 1")
def best_dice_checkpoint(spark, sf):
    return E.pick_checkpoint(_runs(spark, sf), larger_is_better=True)


@query("best_of_last_n", f"""WITH {SQL_RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS b FROM runs)
    SELECT run, val_loss, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS r FROM l WHERE b <= 5) WHERE r = 1""")
def best_of_last_n(spark, sf):
    return E.pick_checkpoint(_runs(spark, sf), mode="best_of_last", n=5)


@query("last_checkpoint", f"WITH {SQL_RUNS} SELECT run, arg_max(val_loss, epoch) AS val_loss, max(epoch) AS epoch FROM runs GROUP BY 1")
def last_checkpoint(spark, sf):
    return E.pick_checkpoint(_runs(spark, sf), mode="last")


@query("loss_curve_mean", f"WITH {SQL_RUNS} SELECT run % 10 AS run, epoch % 12 AS iter, round(avg(val_loss) + 1e-7, 4) AS loss FROM runs GROUP BY 1, 2")
def loss_curve_mean(spark, sf):
    curves = _runs(spark, sf).select((F.col("run") % 10).alias("run"), (F.col("epoch") % 12).alias("iter"), F.col("val_loss").alias("loss"))
    return E.mean_curve(curves).withColumn("loss", r4("loss"))


@query("weighted_loss", "SELECT l_returnflag AS run, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY 1")
def weighted_loss(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("batch"))
    return E.weighted_loss(lines, ["run"]).withColumn("loss", r6("loss"))


@query("quantile_profile", """SELECT o_orderpriority AS run, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
    round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.9), 4) AS p90,
    max(o_totalprice) AS max FROM orders GROUP BY 1""")
def quantile_profile(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "run")
    found = E.quantile_profile(orders, "o_totalprice", by=["run"])
    return found.withColumns({c: F.round(c, 4) for c in ("p10", "p25", "median", "p75", "p90")})
