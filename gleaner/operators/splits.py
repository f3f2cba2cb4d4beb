"""Source pools, splits, random budgets and weighted sampling. All orders are hash orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.ordering import first_rows, row_number
from gleaner.functions.vectors import hash_order, hash_uniform
from gleaner.operators.scores import nested_budgets


def attach_site(
    subjects: DataFrame, membership: DataFrame, default: str = "UNKNOWN", site_order: str | None = None,
    id: str = "subject_id", site: str = "site",
) -> DataFrame:
    """Site of every subject: the first by ``site_order`` (by name without one), else ``default``."""
    order = F.col(site_order) if site_order else F.col(site)
    first = membership.groupBy(id).agg(F.min(F.struct(order.alias("o"), F.col(site).alias("s"))).alias("__first"))
    joined = subjects.join(first, id, "left")
    return joined.withColumn(site, F.coalesce("__first.s", F.lit(default))).drop("__first")


def source_pool(
    membership: DataFrame, exclude: Sequence[str], mode: str = "subject", id: str = "subject_id", site: str = "site"
) -> DataFrame:
    """Subjects outside the excluded sites, each once.

    ``mode='file'`` drops only the excluded sites' rows, so a subject listed elsewhere too
    stays; ``'subject'`` drops every subject of the excluded sites.
    """
    banned = F.col(site).isin(list(exclude))
    if mode == "file":
        return membership.filter(~banned).select(id).distinct()
    if mode == "subject":
        targets = membership.filter(banned).select(id)
        return membership.select(id).distinct().join(targets, id, "left_anti")
    raise ValueError(f"mode must be 'file' or 'subject', not {mode!r}")


def target_set(splits: DataFrame, include_val: bool = True) -> DataFrame:
    """Subjects of the target's train split, with validation unless told otherwise."""
    wanted = ["train", "val"] if include_val else ["train"]
    return splits.filter(F.col("split").isin(wanted))


def _place(subjects: DataFrame, seed: int, by: Sequence[str], id: str) -> DataFrame:
    return row_number(subjects, [hash_order(id, seed), F.col(id)], by, "__place")


def three_way_split(
    subjects: DataFrame, n_train: int, n_val: int, seed: int = 2025, id: str = "subject_id"
) -> DataFrame:
    """Fixed sizes for train and validation in seeded random order; the rest is test."""
    total = subjects.count()
    if n_train + n_val > total:
        raise ValueError(f"{n_train} + {n_val} subjects asked of {total}")
    place = F.col("__place")
    name = F.when(place <= n_train, "train").when(place <= n_train + n_val, "val").otherwise("test")
    return _place(subjects, seed, [], id).withColumn("split", name).drop("__place")


def stratum_quotas(sizes: Mapping[str, int], strata: Sequence[str], total: int, n_train: int) -> dict[str, tuple[int, int]]:
    """Per stratum how many of the ``total`` subjects it gives and how many of them train.

    The first stratum gets its proportional share, rounded half to even, the second the
    remainder; what does not train is validation.
    """
    first, second = strata
    take = round(total * sizes[first] / (sizes[first] + sizes[second]))
    train = round(n_train * take / total)
    return {first: (take, train), second: (total - take, n_train - train)}


def stratified_split(
    subjects: DataFrame, strata: Sequence[str], total: int, n_train: int, seed: int = 2025,
    id: str = "subject_id", stratum: str = "stratum",
) -> DataFrame:
    """Train and validation of ``total`` subjects in proportion to two strata, the rest is test."""
    chosen = subjects.filter(F.col(stratum).isin(list(strata)))
    sizes = dict(chosen.groupBy(stratum).count().collect())
    quotas = stratum_quotas(sizes, strata, total, n_train)
    short = [s for s, (take, _) in quotas.items() if take > sizes[s]]
    if short:
        raise ValueError(f"strata with too few subjects: {short}")

    def quota(part: int) -> Column:
        return F.create_map(*[F.lit(v) for n, q in quotas.items() for v in (n, q[part])])[F.col(stratum)]

    place = F.col("__place")
    name = F.when(place <= quota(1), "train").when(place <= quota(0), "val").otherwise("test")
    return _place(chosen, seed, [stratum], id).withColumn("split", name).drop("__place")


def split_summary(splits: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Counts per split and stratum with subtotals (null = all)."""
    return splits.rollup("split", stratum).agg(F.count(F.lit(1)).alias("n"))


def random_budgets(subjects: DataFrame, seeds: Sequence[int], ks: Sequence[int], t: int, id: str = "subject_id") -> DataFrame:
    """For every seed nested random subsets of k*t subjects."""
    ordered = subjects.select(id, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    ranked = first_rows(ordered, max(ks) * t, [hash_order(id, F.col("seed")), F.col(id)], ["seed"])
    return nested_budgets(ranked, ks, t)


def sample_subjects(rows: DataFrame, n: int, seed: int = 0, id: str = "subject_id") -> DataFrame:
    """All rows of ``n`` subjects drawn in seeded order."""
    chosen = rows.select(id).distinct().orderBy(hash_order(id, seed), id).limit(n)
    return rows.join(chosen, id, "left_semi")


def cap_slices(slices: DataFrame, max_slices: int, seed: int = 0, by: str = "subject_id", z: str = "slice_idx") -> DataFrame:
    """At most ``max_slices`` random slices per case, without replacement."""
    key = F.concat(F.col(by).cast("string"), F.lit("/"), F.col(z).cast("string"))
    return first_rows(slices, max_slices, [hash_order(key, seed), F.col(z)], [by], "__place").drop("__place")


def sample_weights(slices: DataFrame, foreground_fraction: float = 0.33, flag: str = "is_foreground") -> DataFrame:
    """Weight of each slice so that foreground draws have the given mass; 1 if a class is empty."""
    counts = slices.agg(
        F.count_if(F.col(flag)).alias("fg"), F.count_if(~F.col(flag)).alias("bg")
    )
    fg, bg = counts.select("fg").scalar(), counts.select("bg").scalar()
    weight = (
        F.when((fg == 0) | (bg == 0), F.lit(1.0))
        .when(F.col(flag), F.lit(foreground_fraction) / fg)
        .otherwise((1.0 - F.lit(foreground_fraction)) / bg)
    )
    return slices.withColumn("weight", weight)


def weighted_sample(
    slices: DataFrame, n: int, seed: int = 0, foreground_fraction: float = 0.33,
    id: str = "item_id", flag: str = "is_foreground",
) -> DataFrame:
    """``n`` draws with replacement, foreground with probability ``foreground_fraction``.

    All slices of a class weigh the same, so a draw is a class and a position in it: an
    equi-join on both replaces a search in cumulative weights.
    """
    numbered = row_number(slices, [F.col(id)], [flag], "__place")
    sizes = dict(slices.groupBy(flag).count().collect())
    fg, bg = sizes.get(True, 0), sizes.get(False, 0)
    mass = foreground_fraction if fg and bg else float(fg > 0)
    draws = slices.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        (hash_uniform(F.col("id"), seed) < mass).alias(flag),
        hash_uniform(F.col("id"), seed + 1).alias("__u"),
    )
    size = F.when(F.col(flag), F.lit(fg)).otherwise(F.lit(bg))
    draws = draws.withColumn("__place", (F.floor(F.col("__u") * size) + 1).cast("long"))
    return draws.join(numbered, [flag, "__place"]).select("draw", *slices.columns)
