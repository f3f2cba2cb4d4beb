"""Distribution shift between sites: centroid distance, MMD and their rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.kernels import matrix, row_slices, unit_rows
from gleaner.functions.ordering import first_rows, row_number
from gleaner.functions.vectors import constant, dot, hash_order, l2_normalize
from gleaner.operators.aggregate import aggregate_vectors, centroid_array
from gleaner.operators.quantiles import attach, quantiles
from gleaner.operators.selection import mean_similarity
from gleaner.operators.scores import rank_all
from gleaner.session import BLOCK_BYTES, freeze

# ------------------------------------------------------------------ sites


def eligible_sites(items: DataFrame, min_n: int = 0, exclude: str = "UNKNOWN", site: str = "site") -> DataFrame:
    """Sites with at least ``min_n`` items."""
    return (
        items.groupBy(site)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= min_n) & (F.col(site).cast("string") != F.lit(exclude)))
    )


def target_items(items: DataFrame, target_sites: Sequence, min_n: int = 0, site: str = "site") -> DataFrame:
    """Items of the named sites; an absent, unknown or too small site is an error."""
    found = {r[0] for r in eligible_sites(items, min_n, site=site).filter(F.col(site).isin(list(target_sites))).collect()}
    missing = [s for s in target_sites if s not in found]
    if missing:
        raise ValueError(f"target sites not found or too small: {missing}")
    return items.filter(F.col(site).isin(list(target_sites)))


# ------------------------------------------------------------------ centroid distance


def _cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(l2_normalize(a, 1e-8, "add"), l2_normalize(b, 1e-8, "add"))


def centroid_cosine_distance(a: DataFrame, b: DataFrame) -> float:
    """1 - cos of the two mean vectors."""
    x, y = (c / (np.linalg.norm(c) + 1e-8) for c in (centroid_array(a), centroid_array(b)))
    return float(1.0 - x @ y)


# ------------------------------------------------------------------ MMD


#: A set of more rows is cut into blocks: a few for the tasks to share, more where they would not fit ``BLOCK_BYTES``.
#: Each row is sent once for every block, so a set of up to ``BLOCKS`` full blocks sends the same number of copies at any size.
BLOCK_ROWS = 2000
BLOCKS = 8

#: Bins of one histogram of distances, and passes of it.
BINS = 4096
PASSES = 3


def _attach(rows: DataFrame, table: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row per set; nulls are a key like any other."""
    keys = {c: f"__key{i}" for i, c in enumerate(by)}
    other = table.select(*[F.col(c).alias(keys.get(c, c)) for c in table.columns])
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return rows.join(F.broadcast(other), match, how).drop(*keys.values())


def _block_pairs(rows: DataFrame, by: Sequence[str], fn, schema) -> DataFrame:
    """``fn`` over every pair of blocks of each group; ``rows`` holds ``by``, ``item_id``, ``vec`` and more.

    A group's table comes with ``__left``/``__right`` and each row's ``__block``. A kernel statistic of n rows
    takes n * n / 2 products; the blocks only bound what one task holds, which multiplies them slice by slice.
    """
    by = list(by)
    n, size = F.count(F.lit(1)), F.sum(F.size("vec").cast("long") * 8)
    blocks = F.least(F.ceil(n / BLOCK_ROWS), F.greatest(F.lit(BLOCKS).cast("long"), F.ceil(size / BLOCK_BYTES)))
    sizes = rows.groupBy(*by).agg(blocks.cast("int").alias("__blocks"))
    blocked = _attach(rows, sizes, by).withColumn("__block", F.pmod(F.xxhash64("item_id"), F.col("__blocks")).cast("int"))
    spread = blocked.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    spread = spread.withColumns({"__left": F.least("__block", "__other"), "__right": F.greatest("__block", "__other")}).drop("__other")
    return spread.groupBy(*by, "__left", "__right").applyInArrow(fn, schema)


def _sides(table: pa.Table):
    """(unit rows, places of the left block, places of the right block, whether they are one block)."""
    x, block = unit_rows(matrix(table.column("vec")), 1e-12), np.asarray(table.column("__block"))
    left, right = table.column("__left")[0].as_py(), table.column("__right")[0].as_py()
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    return x, a, b, left == right


def _gaps(x: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Slices of both blocks with their distances 1 - cos."""
    for rows in row_slices(len(a)):
        part = x[a[rows]]
        for cols in row_slices(len(b), 2048):
            gap = part @ x[b[cols]].T
            yield rows, cols, np.subtract(1.0, gap, out=gap)


def _histogram(gap: np.ndarray, low: float, high: float) -> np.ndarray:
    """Counts of the positive distances: below the interval, in its bins, above it."""
    positive = gap.size - np.count_nonzero(gap <= 0)
    out = np.zeros(BINS + 2, dtype=np.int64)
    out[0] = max(np.count_nonzero(gap < low) - (gap.size - positive), 0)
    inside = gap[(gap >= low) & (gap <= high) & (gap > 0)]
    at = np.minimum((inside - low) / (high - low) * BINS, BINS).astype(np.int64)
    out[1:] += np.bincount(at, minlength=BINS + 1)
    out[-1] += positive - out[0] - len(inside)
    return out


def bandwidths(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, gamma``: 1 / (median distance 1 - cos)^2 over the different, not equal pairs of each group.

    The median is found by counting: each pass sums a histogram over the interval that holds
    the middle value, then looks closer. Distances are never kept; groups without such pairs get 1.
    """
    by = list(by)
    kinds = [rows.schema[c] for c in by]
    fields = kinds + [T.StructField("which", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())]

    def count(key, table):
        x, a, b, same = _sides(table)
        limits = [tuple(table.column(f"{end}{which}")[0].as_py() for end in ("low", "high")) for which in (0, 1)]
        counts = {limit: np.zeros(BINS + 2, dtype=np.int64) for limit in limits}  # mostly one interval for both places
        for rows, cols, gap in _gaps(x, a, b):
            if same and cols.stop <= rows.start + 1:
                continue
            if same and cols.start <= rows.stop:
                gap = gap[np.arange(cols.start, cols.stop)[None, :] > np.arange(rows.start, rows.stop)[:, None]]
            for limit, held in counts.items():
                held += _histogram(gap, *limit)
        which = np.concatenate([np.full(np.count_nonzero(counts[limit]), w) for w, limit in enumerate(limits)])
        found = np.concatenate([np.flatnonzero(counts[limit]) - 1 for limit in limits])
        n = np.concatenate([counts[limit][counts[limit] > 0] for limit in limits])
        keys = [pa.array([k.as_py()] * len(found), k.type) for k in key[: len(by)]]
        return pa.table([*keys, pa.array(which, pa.int32()), pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=[f.name for f in fields])

    state = rows.select(*by).distinct().withColumns({"low0": F.lit(0.0), "high0": F.lit(2.0 + 1e-9), "low1": F.lit(0.0), "high1": F.lit(2.0 + 1e-9)})
    for _ in range(PASSES):
        counted = _block_pairs(_attach(rows, state, by), by, count, T.StructType(fields)).groupBy(*by, "which", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*by, "which").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("n").over(Window.partitionBy(*by, "which"))
        wanted = F.floor((total - 1 + F.col("which")) / 2) + 1  # the two middle places
        middle = counted.withColumns({"upto": F.sum("n").over(upto), "wanted": wanted}).filter("upto >= wanted")
        middle = middle.groupBy(*by, "which").agg(F.min("bin").alias("bin"))
        wide = middle.groupBy(*by).agg(*[F.max(F.when(F.col("which") == w, F.col("bin"))).alias(f"bin{w}") for w in (0, 1)])
        nearer = {}
        for w in (0, 1):
            width = (F.col(f"high{w}") - F.col(f"low{w}")) / BINS
            nearer[f"low{w}"] = F.col(f"low{w}") + width * F.col(f"bin{w}")
            nearer[f"high{w}"] = F.col(f"low{w}") + width * (F.col(f"bin{w}") + 1)
        state = freeze(_attach(wide, state, by).select(*by, *[v.alias(k) for k, v in nearer.items()]))
    median = (F.col("low0") + F.col("high0") + F.col("low1") + F.col("high1")) / 4
    gamma = F.coalesce(1.0 / (median * median + 1e-8), F.lit(1.0))
    return _attach(rows.select(*by).distinct(), state, by, "left").select(*by, gamma.alias("gamma"))


def kernel_sums(rows: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    """``by, side_a, side_b, total, pairs``: sums of exp(-gamma (1 - cos)^2) over all ordered pairs of rows.

    ``rows`` holds ``by``, ``side``, ``item_id``, ``vec`` and ``gamma``; every pair of the group counts, a row with itself too.
    """
    by = list(by)
    kind = rows.schema[side].dataType
    fields = [rows.schema[c] for c in by] + [T.StructField("side_a", kind), T.StructField("side_b", kind), T.StructField("total", T.DoubleType()), T.StructField("pairs", T.LongType())]

    def sums(key, table):
        x, a, b, same = _sides(table)
        gamma = table.column("gamma")[0].as_py()
        values = table.column(side)
        names, code = np.unique(np.array([str(v) for v in values.to_pylist()]), return_inverse=True)
        first = [int(np.flatnonzero(code == i)[0]) for i in range(len(names))]
        ones_a, ones_b = np.eye(len(names))[code[a]], np.eye(len(names))[code[b]]
        total = np.zeros((len(names), len(names)))
        for rows, cols, k in _gaps(x, a, b):
            np.multiply(k, k, out=k)
            np.multiply(k, -gamma, out=k)
            total += ones_a[rows].T @ (np.exp(k, out=k) @ ones_b[cols])
        pairs = np.outer(ones_a.sum(0), ones_b.sum(0))
        if not same:
            total, pairs = total + total.T, pairs + pairs.T
        i, j = np.nonzero(pairs)
        keys = [pa.array([x.as_py()] * len(i), x.type) for x in key[: len(by)]]
        sides = [pa.array([values[first[x]].as_py() for x in at], table.schema.field(side).type) for at in (i, j)]
        return pa.table([*keys, *sides, pa.array(total[i, j]), pa.array(pairs[i, j].astype(np.int64))], names=[f.name for f in fields])

    found = _block_pairs(rows, by, sums, T.StructType(fields))
    return found.groupBy(*by, "side_a", "side_b").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def _with_gamma(rows: DataFrame, by: Sequence[str], gamma: float | None) -> DataFrame:
    if gamma is not None:
        return rows.withColumn("gamma", F.lit(float(gamma)))
    return _attach(rows, freeze(bandwidths(rows, by)), by)


def _mmd_of(sums: DataFrame, by: Sequence[str], inside) -> DataFrame:
    """mean Kaa + mean Kbb - 2 mean Kab, where ``inside(side)`` says whether a side is a."""
    a, b = inside("side_a"), inside("side_b")

    def mean(which):
        return F.sum(F.when(which, F.col("total"))) / F.sum(F.when(which, F.col("pairs")))

    return sums.groupBy(*by).agg((mean(a & b) + mean(~a & ~b) - 2 * mean(a & ~b)).alias("mmd2"))


def mmd_rbf(a: DataFrame, b: DataFrame, gamma: float | None = None, id: str = "item_id") -> float:
    """MMD of two sets over all their rows; without ``gamma`` the bandwidth is the median distance."""
    sides = [s.select(F.lit(0).alias("__set"), F.lit(name).alias("side"), F.concat(F.lit(name), F.col(id).cast("string")).alias("item_id"), "vec")
             for name, s in (("a", a), ("b", b))]
    rows = _with_gamma(sides[0].union(sides[1]), ["__set"], gamma)
    found = _mmd_of(kernel_sums(rows, ["__set"], "side"), ["__set"], lambda c: F.col(c) == "a").first()
    return float(found["mmd2"])


# ------------------------------------------------------------------ rankings


def _eligible_units(items: DataFrame, min_n: int, site: str, id: str) -> DataFrame:
    sites = eligible_sites(items, min_n, site=site).select(site)
    return items.join(sites, site, "left_semi").select(
        site, id, l2_normalize(F.col("vec"), 1e-8, "add").alias("vec")
    )


def site_to_target(
    items: DataFrame, target: DataFrame, min_n: int = 0, gamma: float | None = None, site: str = "site", id: str = "item_id",
) -> DataFrame:
    """Every eligible site against the pooled target, nearest first; all rows of both sets count."""
    aim = target.select(id, l2_normalize(F.col("vec"), 1e-8, "add").alias("vec"))
    center = constant(centroid_array(aim))
    unit = freeze(_eligible_units(items, min_n, site, id))
    centers = aggregate_vectors(unit, site, "mean", count=True).select(
        site, "n", _cosine_distance(F.col("vec"), center).alias("centroid_dist")
    )
    names = [r[0] for r in centers.select(site).collect()]
    own = unit.select(site, F.lit("own").alias("side"), F.concat(F.lit("own"), F.col(id).cast("string")).alias("item_id"), "vec")
    # The target stands beside every site: its rows are repeated once per site.
    aims = aim.withColumn(site, F.explode(F.array(*[F.lit(x).cast(unit.schema[site].dataType) for x in names]))).select(
        site, F.lit("aim").alias("side"), F.concat(F.lit("aim"), F.col(id).cast("string")).alias("item_id"), "vec"
    )
    rows = _with_gamma(own.union(aims), [site], gamma)
    mmd = _mmd_of(kernel_sums(rows, [site], "side"), [site], lambda c: F.col(c) == "own")
    ranked = freeze(centers.join(mmd, site))  # one row per site
    return ranked.orderBy("centroid_dist", "mmd2", site)


def _own_and_rest(unit: DataFrame, site: str) -> DataFrame:
    """Centroid distance of every site's mean to the mean of all other sites: total minus own."""
    sums = freeze(aggregate_vectors(unit, site, "sum", count=True))  # one row per site
    total = aggregate_vectors(sums.withColumn("__all", F.lit(0)), "__all", "sum").first()
    whole = constant(total["vec"])
    others = F.lit(sums.agg(F.sum("n")).first()[0]) - F.col("n")
    rest = F.zip_with(whole, F.col("vec"), lambda t, x: (t - x) / others)
    own = F.transform("vec", lambda x: x / F.col("n"))
    return sums.select(site, "n", _cosine_distance(own, rest).alias("centroid_dist"))


def site_vs_rest(
    items: DataFrame, min_n: int = 10, topk: int = 3, gamma: float | None = None, site: str = "site", id: str = "item_id",
) -> DataFrame:
    """Each eligible site against all other eligible sites, most shifted first; all rows count.

    The union of a site and its rest is the same for all sites, and so is its bandwidth: one
    pass sums the kernel for every pair of sites.
    """
    unit = freeze(_eligible_units(items, min_n, site, id))
    rows = unit.select(F.lit(0).alias("__set"), F.col(site).alias("side"), F.col(id).alias("item_id"), "vec")
    sums = freeze(kernel_sums(_with_gamma(rows, ["__set"], gamma), ["__set"], "side"))  # one row per pair of sites
    whole = sums.agg(F.sum("total").alias("t"), F.sum("pairs").alias("p")).first()
    per_site = sums.groupBy(F.col("side_a").alias(site)).agg(
        F.sum("total").alias("row"), F.sum("pairs").alias("row_pairs"),
        F.sum(F.when(F.col("side_a") == F.col("side_b"), F.col("total"))).alias("own"), F.sum(F.when(F.col("side_a") == F.col("side_b"), F.col("pairs"))).alias("own_pairs"),
    )
    rest = F.lit(whole.t) - 2 * F.col("row") + F.col("own")
    rest_pairs = F.lit(whole.p) - 2 * F.col("row_pairs") + F.col("own_pairs")
    cross = (F.col("row") - F.col("own")) / (F.col("row_pairs") - F.col("own_pairs"))
    mmd = per_site.select(site, (F.col("own") / F.col("own_pairs") + rest / rest_pairs - 2 * cross).alias("mmd2"))
    ranked = freeze(_own_and_rest(unit, site).join(mmd, site))  # one row per site
    place = Window.orderBy(F.desc("centroid_dist"), F.desc("mmd2"), F.asc(site))  # one row per site
    return (
        ranked.withColumn("rank", F.row_number().over(place))
        .withColumn("recommended", F.col("rank") <= topk)
        .orderBy("rank")
    )


def separability_folds(items: DataFrame, folds: int = 5, seed: int = 0, site: str = "site", id: str = "item_id") -> DataFrame:
    """Stratified folds: within each site, position in hash order modulo the number of folds."""
    placed = row_number(items, [hash_order(id, seed), F.col(id)], [site], "__place")
    return placed.withColumn("fold", ((F.col("__place") - 1) % folds).cast("int")).drop("__place")


def domain_separability(
    items: DataFrame, folds: int = 5, seed: int = 0, max_iter: int = 2000, site: str = "site", id: str = "item_id"
) -> DataFrame:
    """Mean and population std of the held-out accuracy of predicting the site."""
    placed = separability_folds(items, folds, seed, site, id)
    indexer = StringIndexer(inputCol="__site", outputCol="label")
    rows = placed.withColumn("__site", F.col(site).cast("string")).withColumn("features", array_to_vector("vec"))
    rows = indexer.fit(rows).transform(rows).select("fold", "label", "features").persist()
    try:
        sizes = dict(rows.groupBy("fold").count().collect())
        parts = []
        for fold in sorted(sizes):
            # Unit penalty on the summed loss is 1/n on Spark's mean loss.
            model = LogisticRegression(
                maxIter=max_iter, regParam=1.0 / max(1, sum(sizes.values()) - sizes[fold]), standardization=False
            )
            fitted = model.fit(rows.filter(F.col("fold") != fold))
            hit = (F.col("prediction") == F.col("label")).cast("double")
            parts.append(fitted.transform(rows.filter(F.col("fold") == fold)).agg(F.avg(hit)).first()[0])
    finally:
        rows.unpersist()
    return items.sparkSession.createDataFrame(
        [(float(np.mean(parts)), float(np.std(parts)), folds)], "accuracy_mean double, accuracy_std double, folds int"
    )


# ------------------------------------------------------------------ subset diagnostic


def subset_profile(selection: DataFrame, source: DataFrame, target: DataFrame, id: str = "item_id") -> DataFrame:
    """Where a subset lies in the order of mean similarity to the target.

    One row per subset (``tag``): rank quantiles, share within the top 10, 20 and 50 % of
    the source, and the number of ids that the source does not have.
    """
    ranked = rank_all(mean_similarity(source, target))
    size = ranked.agg(F.count(F.lit(1))).scalar()
    placed = freeze(selection.select("tag", id).join(ranked.select(id, "rank", F.col("score").alias("sim")), id, "left"))

    def share(fraction):
        inside = F.col("rank") <= F.ceil(size * F.lit(fraction))
        return F.avg(F.when(F.col("rank").isNotNull(), inside.cast("double")))

    report = placed.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.count("rank").alias("n_found"),
        F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"),
        share(0.1).alias("top10"),
        share(0.2).alias("top20"),
        share(0.5).alias("top50"),
    )
    names = ("p10", "p25", "median", "p75", "p90")
    report = attach(report, quantiles(placed, "rank", (0.1, 0.25, 0.5, 0.75, 0.9), ["tag"]), ["tag"])
    return report.select(
        "tag", "n_selected", "n_found", (F.col("n_selected") - F.col("n_found")).alias("n_missing"),
        "rank_min", *[F.col(f"q{i}").alias(f"rank_{n}") for i, n in enumerate(names)], "rank_max",
        "top10", "top20", "top50",
    )


def subset_top(selection: DataFrame, source: DataFrame, target: DataFrame, n: int = 10, id: str = "item_id") -> DataFrame:
    """The ``n`` items of each subset most similar to the target, with their global rank."""
    ranked = rank_all(mean_similarity(source, target)).select(id, F.col("rank").alias("global_rank"), F.col("score").alias("mean_sim"))
    placed = selection.select("tag", id).join(ranked, id)
    return first_rows(placed, n, [F.desc("mean_sim"), F.asc(id)], ["tag"], "place")
