"""Joins between requests and what is on disk: sources, manifests, missing and pending work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.voxels import drop_empty_slices


def filter_ids(items: DataFrame, ids: DataFrame, id: str = "item_id") -> DataFrame:
    """Items whose id is listed."""
    return items.join(ids.select(id), id, "left_semi")


def filter_report(items: DataFrame, ids: DataFrame, id: str = "item_id") -> DataFrame:
    """One row: ids requested, items kept."""
    kept = filter_ids(items, ids, id).agg(F.count(F.lit(1)).alias("kept"))
    asked = ids.select(id).distinct().agg(F.count(F.lit(1))).scalar()
    return kept.select(asked.alias("requested"), "kept")


def filter_subjects(slices: DataFrame, ids: DataFrame, id: str = "id", subject: str = "subject_id", name: str = "slice_name") -> DataFrame:
    """Slices whose own name or whose subject is listed."""
    listed = ids.select(F.col(id).alias("__id")).distinct()
    by_name = slices.join(listed, F.col(name) == F.col("__id"), "left_semi")
    others = slices.join(listed, F.col(name) == F.col("__id"), "left_anti")
    return by_name.unionByName(others.join(listed, F.col(subject) == F.col("__id"), "left_semi"))


def subset_slices(selection: DataFrame, slices: DataFrame, id: str = "subject_id") -> DataFrame:
    """Slices of the selected subjects."""
    return slices.join(selection.select(id), id)


def missing_ids(requests: DataFrame, found: DataFrame, id: str = "subject_id") -> DataFrame:
    """Requested ids that are not there."""
    return requests.select(id).distinct().join(found.select(id), id, "left_anti")


def missing_report(requests: DataFrame, found: DataFrame, id: str = "subject_id") -> DataFrame:
    """One row: how many requested ids exist and how many do not."""
    there = found.select(id).distinct().withColumn("__there", F.lit(1))
    return (
        requests.select(id).distinct().join(there, id, "left")
        .agg(
            F.count(F.lit(1)).alias("requested"),
            F.count("__there").alias("found"),
            F.count_if(F.col("__there").isNull()).alias("missing"),
        )
    )


def pair_images_labels(images: DataFrame, labels: DataFrame, id: str = "item_id") -> DataFrame:
    """Inner pairs by key."""
    return images.join(labels, id)


def unpaired(images: DataFrame, labels: DataFrame, id: str = "item_id") -> DataFrame:
    """Keys present on one side only, with the side that has them."""
    left = images.select(id).distinct().withColumn("__i", F.lit(True))
    right = labels.select(id).distinct().withColumn("__l", F.lit(True))
    both = left.join(right, id, "full")
    return both.filter(F.col("__i").isNull() | F.col("__l").isNull()).select(
        id, F.when(F.col("__i").isNull(), "label").otherwise("image").alias("side")
    )


def match_images(labels: DataFrame, images: DataFrame, name: str = "name", suffix: str = "_seg") -> DataFrame:
    """Image of every label, matched by the label's name without ``suffix``; null when missing."""
    keyed = labels.withColumn("image_name", F.regexp_replace(name, suffix, ""))
    there = images.select(F.col(name).alias("image_name")).distinct().withColumn("matched", F.lit(True))
    return keyed.join(there, "image_name", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def resolve_sources(
    requests: DataFrame, inventory: DataFrame, ext_priority: Sequence[str] = (".npy", ".npz"), id: str = "case_id"
) -> DataFrame:
    """The one source of each requested case: first directory, then first extension."""
    order = F.coalesce(
        F.array_position(F.array(*[F.lit(e) for e in ext_priority]), F.col("ext")), F.lit(0)
    )
    known = inventory.filter(order > 0)
    best = known.groupBy(id).agg(
        F.min(F.struct(F.col("dir_priority"), order.alias("o"), F.col("dir"), F.col("ext"))).alias("__best")
    )
    return requests.select(id).distinct().join(best, id).select(
        id, F.col("__best.dir").alias("dir"), F.col("__best.ext").alias("ext")
    )


def pending(requests: DataFrame, outputs: DataFrame, required: Sequence[str], id: str = "case_id") -> DataFrame:
    """Requests that do not have every required kind of output yet."""
    wanted = F.col("kind").isin(list(required))
    done = (
        outputs.filter(wanted).groupBy(id).agg(F.countDistinct("kind").alias("__n"))
        .filter(F.col("__n") == len(set(required))).select(id)
    )
    return requests.join(done, id, "left_anti")


def build_manifest(
    selected: DataFrame, target_train: DataFrame, target_val: DataFrame, inventory: DataFrame, id: str = "case_id"
) -> DataFrame:
    """Every requested case with its role, split and the directory it is linked from."""
    roles = [(selected, "selected", "train"), (target_train, "target_train", "train"), (target_val, "target_val", "val")]
    asked = reduce(
        DataFrame.unionByName,
        [df.select(id, F.lit(r).alias("role"), F.lit(s).alias("split")) for df, r, s in roles],
    )
    source = resolve_sources(asked, inventory.filter(F.col("ext") == ".npy"), [".npy"], id)
    return asked.join(source.select(id, "dir"), id, "left").withColumn("linked", F.col("dir").isNotNull())


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """Per role: cases asked for and linked; ``role = 'all'`` is the number of training cases."""
    counts = manifest.rollup("role").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if("linked").alias("n_linked")
    )
    return counts.withColumn("role", F.coalesce("role", F.lit("all")))


def domain_union(slices: DataFrame, domains: Sequence[Mapping], voxels: DataFrame | None = None) -> DataFrame:
    """Union of the slices of several domains.

    A domain is ``{"name", "split", "skip_empty"}``; with ``skip_empty`` slices without
    any positive label in ``voxels`` are left out.
    """
    parts = []
    for d in domains:
        part = slices.filter((F.col("domain") == d["name"]) & (F.col("split") == d["split"]))
        if d.get("skip_empty"):
            if voxels is None:
                raise ValueError("skip_empty needs the label voxels")
            part = drop_empty_slices(part, voxels)
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def training_rows(selection: DataFrame, source: DataFrame, target: DataFrame, id: str = "subject_id") -> DataFrame:
    """Slices of the selected source subjects and all target slices."""
    chosen = subset_slices(selection, source, id).select(*source.columns)
    return chosen.withColumn("origin", F.lit("source")).unionByName(target.withColumn("origin", F.lit("target")))
