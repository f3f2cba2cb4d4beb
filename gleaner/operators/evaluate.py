"""Segmentation metrics, leaderboards, fitness and training-log summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.ordering import first_rows
from gleaner.operators.quantiles import attach, quantiles
from gleaner.operators.splits import attach_site, sample_subjects

#: Label sets of the tumour regions; whole tumour is every positive label.
REGIONS = {"ET": (3,), "TC": (2, 3), "WT": None}


def dice_score(inter: Column, total: Column, mode: str = "plain") -> Column:
    """2I/U: ``plain`` gives 1 for two empty masks, ``smooth`` adds 1e-5 to both, ``eps`` 1e-8 below."""
    if mode == "plain":
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * inter / total)
    if mode == "smooth":
        return (2.0 * inter + F.lit(1e-5)) / (total + F.lit(1e-5))
    if mode == "eps":
        return 2.0 * inter / (total + F.lit(1e-8))
    raise ValueError(f"mode must be 'plain', 'smooth' or 'eps', not {mode!r}")


def _overlap(pred: Column, gt: Column) -> list[Column]:
    return [
        F.count_if(pred & gt).alias("inter"),
        F.count_if(pred).alias("pred_volume"),
        F.count_if(gt).alias("gt_volume"),
    ]


def dice(voxels: DataFrame, by: Sequence[str] = ("run", "subject_id"), mode: str = "plain") -> DataFrame:
    """Binary Dice (label > 0) per case with volumes and the number of slices."""
    counted = voxels.groupBy(*by).agg(
        *_overlap(F.col("pred") > 0, F.col("gt") > 0), F.countDistinct("z").alias("num_slices")
    )
    score = dice_score(F.col("inter"), F.col("pred_volume") + F.col("gt_volume"), mode)
    return counted.select(*by, score.alias("dice"), "num_slices", "gt_volume", "pred_volume")


def _in_region(label: Column, labels) -> Column:
    return label > 0 if labels is None else label.isin(list(labels))


def region_dice_cases(
    voxels: DataFrame, regions: Mapping = REGIONS, by: Sequence[str] = ("run", "subject_id")
) -> DataFrame:
    """Dice per case and region, one column per region, in one aggregation."""
    aggs = []
    for name, labels in regions.items():
        p, g = _in_region(F.col("pred"), labels), _in_region(F.col("gt"), labels)
        aggs += [F.count_if(p & g).alias(f"__i_{name}"), (F.count_if(p) + F.count_if(g)).alias(f"__t_{name}")]
    counted = voxels.groupBy(*by).agg(*aggs)
    return counted.select(
        *by, *[dice_score(F.col(f"__i_{n}"), F.col(f"__t_{n}"), "eps").alias(f"dice_{n}") for n in regions]
    )


def region_dice(
    voxels: DataFrame, regions: Mapping = REGIONS, max_subjects: int | None = None, seed: int = 0,
    run: Sequence[str] = ("run",), subject: str = "subject_id",
) -> DataFrame:
    """Subject mean per region and the macro mean; ``max_subjects`` evaluates a seeded subset."""
    total = voxels.select(subject).distinct().agg(F.count(F.lit(1))).scalar() if max_subjects is not None else None
    rows = voxels if max_subjects is None else sample_subjects(voxels, max_subjects, seed, subject)
    cases = region_dice_cases(rows, regions, [*run, subject])
    means = cases.groupBy(*run).agg(
        *[F.avg(f"dice_{n}").alias(f"dice_{n}") for n in regions], F.count(F.lit(1)).alias("num_subjects")
    )
    macro = sum((F.col(f"dice_{n}") for n in regions), F.lit(0.0)) / F.lit(float(len(regions)))
    out = means.withColumn("dice_macro", macro)
    if max_subjects is not None:
        out = out.withColumn("val_size", total).withColumn("is_full_val", F.lit(max_subjects) >= total)
    return out


def micro_dice(voxels: DataFrame, cls: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Dice of one class over sums of the whole set; 0 when it never occurs."""
    counted = voxels.groupBy(*by).agg(*_overlap(F.col("pred") == cls, F.col("gt") == cls))
    total = F.col("pred_volume") + F.col("gt_volume")
    return counted.select(*by, F.when(total > 0, 2.0 * F.col("inter") / total).otherwise(F.lit(0.0)).alias("dice"))


def run_summary(case_metrics: DataFrame, dice: str = "dice", run: str = "run") -> DataFrame:
    """Leaderboard: mean and population deviation of Dice, volumes and their ratio, best first."""
    summary = case_metrics.groupBy(run).agg(
        F.coalesce(F.avg(dice), F.lit(0.0)).alias("mean_dice"),
        F.coalesce(F.stddev_pop(dice), F.lit(0.0)).alias("std_dice"),
        F.sum("gt_volume").alias("gt_volume"),
        F.sum("pred_volume").alias("pred_volume"),
        F.count(F.lit(1)).alias("n_cases"),
    )
    ratio = F.try_divide(F.col("pred_volume"), F.col("gt_volume"))
    return summary.withColumn("volume_ratio", ratio).orderBy(F.desc("mean_dice"), run)


def ensemble_argmax(logits: DataFrame, width: int, height: int, by: Sequence[str] = ("subject_id", "z")) -> DataFrame:
    """Mean of the class logits over mirrored passes, then the class with the largest mean.

    ``aug`` names the mirroring of a pass (none, h = x, v = y, hv = both), which is undone
    on the coordinates. Equal means go to the lowest class.
    """
    x = F.when(F.col("aug").isin("h", "hv"), F.lit(width - 1) - F.col("x")).otherwise(F.col("x"))
    y = F.when(F.col("aug").isin("v", "hv"), F.lit(height - 1) - F.col("y")).otherwise(F.col("y"))
    keys = [*by, "y", "x"]
    means = (
        logits.withColumns({"x": x, "y": y}).groupBy(*keys, "cls").agg(F.round(F.avg("logit"), 9).alias("m"))
    )
    best = F.max_by("cls", F.struct(F.col("m"), -F.col("cls"))).alias("pred")
    return means.groupBy(*keys).agg(best)


# ------------------------------------------------------------------ sites


def site_distribution(selection: DataFrame, membership: DataFrame, id: str = "subject_id") -> DataFrame:
    """Count and percent of a subset per site; subjects without one are UNKNOWN."""
    counted = attach_site(selection.select(id), membership, id=id).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("pct", 100.0 * F.col("n") / total).orderBy(F.desc("n"), "site")


# ------------------------------------------------------------------ logs and fitness


def aggregate_fitness(evals: DataFrame, mode: str = "mean", by: Sequence[str] = ("gen", "cand")) -> DataFrame:
    """Fitness of a candidate over its seeds."""
    if mode not in ("mean", "median"):
        raise ValueError(f"mode must be 'mean' or 'median', not {mode!r}")
    if mode == "mean":
        return evals.groupBy(*by).agg(F.avg("fitness").alias("fitness"))
    groups = evals.groupBy(*by).agg(F.count("fitness").alias("__n"))
    return attach(groups, quantiles(evals, "fitness", [0.5], by), by).select(*by, F.col("q0").alias("fitness"))


def topk_fitness(evals: DataFrame, k: int = 3, mode: str = "median", dices: str = "val_dices") -> DataFrame:
    """Fitness of a run from its validation Dices: median of the best k, the best or the last.

    -inf when there are none.
    """
    best = F.slice(F.sort_array(F.col(dices), asc=False), 1, k)
    n = F.size(best)
    low = F.element_at(best, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(best, (F.floor(n / 2) + 1).cast("int"))
    value = {"median": (low + high) / 2.0, "best": F.element_at(best, 1), "final": F.element_at(dices, -1)}
    if mode not in value:
        raise ValueError(f"mode must be one of {sorted(value)}, not {mode!r}")
    empty = F.coalesce(F.size(dices), F.lit(0)) <= 0
    return evals.withColumn("fitness", F.when(empty, F.lit(float("-inf"))).otherwise(value[mode]))


def topk_log_fitness(
    train_log: DataFrame, k: int = 3, mode: str = "median", value: str = "val_dice", run: str = "run", epoch: str = "epoch"
) -> DataFrame:
    """The same from a log with one row per epoch, for runs of any length."""
    if mode == "best":
        return train_log.groupBy(run).agg(F.max(value).alias("fitness"))
    if mode == "final":
        return train_log.groupBy(run).agg(F.max_by(value, epoch).alias("fitness"))
    if mode != "median":
        raise ValueError(f"mode must be 'median', 'best' or 'final', not {mode!r}")
    best = first_rows(train_log, k, [F.desc(value), F.asc(epoch)], [run], "__place")
    return best.groupBy(run).agg(F.median(value).alias("fitness"))


def mean_curve(train_log: DataFrame, by: Sequence[str] = ("run", "iter"), value: str = "loss") -> DataFrame:
    """Mean over seeds per iteration."""
    return train_log.groupBy(*by).agg(F.avg(value).alias(value))


def weighted_loss(batches: DataFrame, by: Sequence[str] = (), loss: str = "loss", size: str = "batch") -> DataFrame:
    """Loss per sample: batch losses weighted by batch size."""
    return batches.groupBy(*by).agg((F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("loss"))


def quantile_profile(df: DataFrame, col: str, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), by: Sequence[str] = ()) -> DataFrame:
    """Minimum, exact interpolated quantiles and maximum."""
    ends = df.groupBy(*by).agg(F.min(col).alias("min"), F.max(col).alias("max"))
    q = attach(ends, quantiles(df, col, probs, by), by)
    names = [("median" if p == 0.5 else f"p{round(100 * p)}") for p in probs]
    return q.select(*by, "min", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)], "max")


def generation_summary(evals: DataFrame) -> DataFrame:
    """Best, mean and population deviation of each generation, its best weights, and the best so far."""
    per_gen = evals.groupBy("gen").agg(
        F.max("fitness").alias("best_fitness"),
        F.avg("fitness").alias("mean_fitness"),
        F.stddev_pop("fitness").alias("std_fitness"),
        F.max_by("cand", F.struct(F.col("fitness"), -F.col("cand"))).alias("best_cand"),
    )
    so_far = Window.orderBy("gen").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per generation
    return per_gen.withColumn("global_best_fitness", F.max("best_fitness").over(so_far)).orderBy("gen")


def pick_checkpoint(
    train_log: DataFrame, metric: str = "val_loss", mode: str = "best", n: int = 5, larger_is_better: bool = False,
    run: str = "run", epoch: str = "epoch",
) -> DataFrame:
    """One epoch per run: the first best, the first best of the last ``n``, or the last."""
    value = -F.col(metric) if larger_is_better else F.col(metric)
    if mode == "last":
        return train_log.groupBy(run).agg(F.max_by(metric, epoch).alias(metric), F.max(epoch).alias(epoch))
    rows = train_log
    if mode == "best_of_last":
        rows = first_rows(train_log, n, [F.desc(epoch)], [run], "__back")
    elif mode != "best":
        raise ValueError(f"mode must be 'best', 'best_of_last' or 'last', not {mode!r}")
    first = F.min(F.struct(value.alias("v"), F.col(epoch).alias("e"), F.col(metric).alias("m")))
    return rows.groupBy(run).agg(first.alias("__best")).select(
        run, F.col("__best.m").alias(metric), F.col("__best.e").alias(epoch)
    )
