"""Images as long tables of voxels: label checks, scaling, cropping and resizing.

Statistics are aggregated per case first and joined back, so the voxels themselves are
only moved by the join, where Spark splits a case that holds much of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channel means and deviations used to shift scaled images.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


# ------------------------------------------------------------------ slices and labels


def slice_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Subject and slice index parsed from names like ``<subject>_slice<idx>.npy``."""
    pattern = r"([^/]*)_slice(\d+)(?:\.\w+)?$"
    return files.filter(F.col(path).rlike(pattern)).select(
        F.regexp_extract(path, pattern, 1).alias("subject_id"),
        F.regexp_extract(path, pattern, 2).cast("int").alias("slice_idx"),
        F.concat_ws("_slice", F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)).alias("slice_name"),
    )


def drop_empty_slices(slices: DataFrame, voxels: DataFrame, by: Sequence[str] = ("subject_id", "z"), label: str = "label") -> DataFrame:
    """Slices that hold at least one positive label."""
    positive = voxels.filter(F.col(label) > 0).select(*by).distinct()
    return slices.join(positive, list(by), "left_semi")


def foreground_slices(
    voxels: DataFrame, min_pixels: int = 100, include_all: bool = False,
    by: Sequence[str] = ("subject_id", "z"), label: str = "label",
) -> DataFrame:
    """Slices with at least ``min_pixels`` positive pixels; ``include_all`` only flags them."""
    counted = voxels.groupBy(*by).agg(F.count_if(F.col(label) > 0).alias("n_positive"))
    flagged = counted.withColumn("is_foreground", F.col("n_positive") >= min_pixels)
    return flagged if include_all else flagged.filter("is_foreground")


def label_range(voxels: DataFrame, lo: int = 0, hi: int = 3, by: str = "subject_id", label: str = "label") -> DataFrame:
    """Items with a label outside [lo, hi] and which labels those are."""
    outside = voxels.filter((F.col(label) < lo) | (F.col(label) > hi))
    return outside.groupBy(by).agg(F.sort_array(F.collect_set(label)).alias("bad_labels"))


def label_values(voxels: DataFrame, lo: int = 0, hi: int = 3, label: str = "label") -> DataFrame:
    """Distinct label values, their counts, and whether they are allowed."""
    return voxels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("valid", F.col(label).between(lo, hi))


def remap_label(label: Column, mapping: Mapping[int, int], negative_to: int | None = None) -> Column:
    """Replace label values; all negative ones by ``negative_to`` when given."""
    out = F.when(label < 0, F.lit(negative_to)) if negative_to is not None else None
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)) if out is None else out.when(label == old, F.lit(new))
    return label if out is None else out.otherwise(label)


def remap_labels(voxels: DataFrame, mapping: Mapping[int, int], negative_to: int | None = None, label: str = "label") -> DataFrame:
    return voxels.withColumn(label, remap_label(F.col(label), mapping, negative_to))


def remap_report(
    voxels: DataFrame, mapping: Mapping[int, int], negative_to: int | None = None,
    by: Sequence[str] = ("subject_id", "z"), label: str = "label",
) -> DataFrame:
    """One row: files touched and pixels changed by a remap."""
    changed = remap_label(F.col(label), mapping, negative_to) != F.col(label)
    return voxels.filter(changed).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("fixed_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("fixed_pixels")
    )


def slice_distribution(
    voxels: DataFrame, first: int = 1, second: int = 2, by: Sequence[str] = ("subject_id", "z"), label: str = "label"
) -> DataFrame:
    """One row: slices by content (background, first class only, second class) and pixel totals."""
    per_slice = voxels.groupBy(*by).agg(
        F.count_if(F.col(label) == first).alias("a"), F.count_if(F.col(label) == second).alias("b")
    )
    report = per_slice.agg(
        F.count(F.lit(1)).alias("total_slices"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("background_only"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("first_only"),
        F.count_if(F.col("b") > 0).alias("second_slices"),
        F.sum("a").alias("first_pixels"),
        F.sum("b").alias("second_pixels"),
    )
    return report.withColumn(
        "second_ratio", F.try_divide(F.col("second_pixels"), F.col("first_pixels") + F.col("second_pixels"))
    )


def negative_subjects(voxels: DataFrame, cls: int = 2, by: str = "subject_id", z: str = "z", label: str = "label") -> DataFrame:
    """Subjects without a single pixel of ``cls``, with their number of slices."""
    per_slice = voxels.groupBy(by, z).agg(F.bool_or(F.col(label) == cls).alias("has"))
    return (
        per_slice.groupBy(by)
        .agg(F.bool_or("has").alias("has"), F.count(F.lit(1)).alias("n_slices"))
        .filter(~F.col("has"))
        .select(by, "n_slices")
    )


# ------------------------------------------------------------------ intensities


def minmax_image(voxels: DataFrame, by: Sequence[str] = ("subject_id", "z"), eps: float = 1e-8) -> DataFrame:
    """(x - min)/(max - min + eps) over all channels of an image."""
    span = voxels.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    scaled = (F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(eps))
    return voxels.join(span, list(by)).withColumn("value", scaled).drop("__lo", "__hi")


def channel_standardize(
    voxels: DataFrame, mean: Sequence[float] = CHANNEL_MEAN, std: Sequence[float] = CHANNEL_STD,
    by: Sequence[str] = ("subject_id", "z"),
) -> DataFrame:
    """Min-max per channel (left alone when constant), then the channel's fixed shift and scale."""
    keys = [*by, "channel"]
    span = voxels.groupBy(*keys).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))

    def pick(values):
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("channel") % len(values) + 1).cast("int"))

    width = F.col("__hi") - F.col("__lo")
    scaled = F.when(width > 0, (F.col("value") - F.col("__lo")) / width).otherwise(F.col("value"))
    return voxels.join(span, keys).withColumn("value", (scaled - pick(mean)) / pick(std)).drop("__lo", "__hi")


def zscore_channels(voxels: DataFrame, nonzero_only: bool = True, by: str = "subject_id") -> DataFrame:
    """Z-score per case and channel, deviation floored at 1e-8.

    ``nonzero_only`` takes the statistics over voxels above 0 and leaves a channel without
    any untouched.
    """
    counted = F.when(F.col("value") > 0, F.col("value")) if nonzero_only else F.col("value")
    stats = voxels.groupBy(by, "channel").agg(F.avg(counted).alias("__m"), F.stddev_pop(counted).alias("__s"))
    scaled = (F.col("value") - F.col("__m")) / F.greatest("__s", F.lit(1e-8))
    return voxels.join(stats, [by, "channel"]).withColumn("value", F.coalesce(scaled, F.col("value"))).drop("__m", "__s")


def zscore_case(voxels: DataFrame, phases: int = 3, by: str = "subject_id") -> DataFrame:
    """Z-score with statistics pooled over the first ``phases`` channels, voxels above 0.

    Without such voxels nothing changes; with deviation 0 only the mean is subtracted.
    """
    used = F.when((F.col("value") > 0) & (F.col("channel") < phases), F.col("value"))
    stats = voxels.groupBy(by).agg(
        F.coalesce(F.avg(used), F.lit(0.0)).alias("__m"), F.coalesce(F.stddev_pop(used), F.lit(1.0)).alias("__s")
    )
    shifted = F.col("value") - F.col("__m")
    scaled = F.when(F.col("__s") > 0, shifted / F.col("__s")).otherwise(shifted)
    return voxels.join(stats, by).withColumn("value", scaled).drop("__m", "__s")


def select_phase(voxels: DataFrame, phase: int = 1) -> DataFrame:
    """One acquisition phase; cases without it drop out."""
    return voxels.filter(F.col("channel") == phase)


def replicate_channel(voxels: DataFrame, n: int = 3) -> DataFrame:
    """Repeat a single-channel image over ``n`` channels."""
    return voxels.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


# ------------------------------------------------------------------ geometry


def nonzero_bbox(voxels: DataFrame, by: str = "subject_id", axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Per case [lo, hi) on each axis around the nonzero voxels of any channel; all when none."""
    inside = F.col("value") != 0
    aggs = []
    for a in axes:
        aggs.append(F.coalesce(F.min(F.when(inside, F.col(a))), F.lit(0)).alias(f"{a}_lo"))
        aggs.append(
            F.coalesce(F.max(F.when(inside, F.col(a))), F.max(a)).alias(f"__{a}_hi")
        )
    box = voxels.groupBy(by).agg(*aggs)
    return box.select(by, *[c for a in axes for c in (F.col(f"{a}_lo"), (F.col(f"__{a}_hi") + 1).alias(f"{a}_hi"))])


def crop_to_nonzero(voxels: DataFrame, bbox: DataFrame | None = None, by: str = "subject_id", axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Voxels inside the bounding box, with coordinates that start at it."""
    box = nonzero_bbox(voxels, by, axes) if bbox is None else bbox
    joined = voxels.join(box, by)
    for a in axes:
        joined = joined.filter((F.col(a) >= F.col(f"{a}_lo")) & (F.col(a) < F.col(f"{a}_hi")))
    return joined.select(
        *[(F.col(c) - F.col(f"{c}_lo")).alias(c) if c in axes else F.col(c) for c in voxels.columns]
    )


def uncrop(pred: DataFrame, bbox: DataFrame, by: str = "subject_id", axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Move a cropped prediction back to its place; voxels outside stay absent, that is 0."""
    joined = pred.join(bbox, by)
    return joined.select(*[(F.col(c) + F.col(f"{c}_lo")).alias(c) if c in axes else F.col(c) for c in pred.columns])


def nearest_resize(labels: DataFrame, in_size: tuple[int, int], out_size: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize of (y, x): output pixel d shows input pixel floor(d * in / out).

    Every input pixel lists the output pixels that show it, so no join is needed.
    """
    out = labels
    for axis, size_in, size_out in (("y", in_size[0], out_size[0]), ("x", in_size[1], out_size[1])):
        src = F.col(axis).cast("long")
        first = F.ceil(src * size_out / F.lit(size_in)).cast("long")
        last = (F.ceil((src + 1) * size_out / F.lit(size_in)) - 1).cast("long")
        span = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(axis, F.explode(span.cast("array<int>")))
    return out
