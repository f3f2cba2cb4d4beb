"""Readers: embeddings, id lists, score sets, split bundles, slice listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.scores import check_alignment
from gleaner.operators.voxels import slice_names

_EMBEDDING = "image string, embedding array<double>"


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"image", "embedding"}`` as ``item_id, vec``; no rows is an error."""
    items = (
        spark.read.schema(_EMBEDDING).option("mode", "FAILFAST").json(path)
        .select(F.col("image").alias("item_id"), F.col("embedding").alias("vec"))
    )
    if items.isEmpty():
        raise ValueError(f"no embeddings in {path}")
    return items


def read_embedding_map(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_embeddings` with one row per key: the last line wins."""
    at = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")
    )
    rows = spark.read.schema(_EMBEDDING).json(path).select("image", "embedding", at.alias("at"))
    return rows.groupBy(F.col("image").alias("item_id")).agg(F.max_by("embedding", "at").alias("vec"))


def read_selected_ids(spark: SparkSession, path: str, keys: Sequence[str] = ("selected_cases", "selected")) -> DataFrame:
    """Ids listed under the first of ``keys`` that a selection JSON holds."""
    schema = ", ".join(f"{k} array<string>" for k in keys)
    found = spark.read.schema(schema).json(path, multiLine=True)
    return found.select(F.posexplode(F.coalesce(*[F.col(k) for k in keys])).alias("position", "item_id"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; blanks around ids and empty lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("item_id")).filter(F.col("item_id") != "")


def read_site_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of ``<site>.txt`` files, one subject per line, as ``site, subject_id``."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder)
    return lines.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("site"),
        F.trim("value").alias("subject_id"),
    ).filter(F.col("subject_id") != "")


def read_splits(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """``{train,val,test}_subjects.txt`` as ``target, split, subject_id``; train must exist."""
    lines = spark.read.option("pathGlobFilter", "*_subjects.txt").text(folder)
    splits = lines.select(
        F.lit(target).alias("target"),
        F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)_subjects\.txt$", 1).alias("split"),
        F.trim("value").alias("subject_id"),
    ).filter((F.col("subject_id") != "") & F.col("split").isin("train", "val", "test"))
    if splits.filter(F.col("split") == "train").isEmpty():
        raise ValueError(f"no train split in {folder}")
    return splits


def read_scores(spark: SparkSession, path: str, methods: Sequence[str] | None = None, repeat: int | None = None) -> DataFrame:
    """Score table partitioned by method and repeat; only the wanted folders are read."""
    scores = spark.read.parquet(path)
    missing = {"method", "item_id", "score"} - set(scores.columns)
    if missing:
        raise ValueError(f"{path} is not a score table, it lacks {sorted(missing)}")
    if methods is not None:
        scores = scores.filter(F.col("method").isin(list(methods)))
    if repeat is not None:
        if "repeat" not in scores.columns:
            raise ValueError(f"{path} has no repeats")
        scores = scores.filter(F.col("repeat") == repeat)
    return scores


def read_aligned_scores(spark: SparkSession, path: str, methods: Sequence[str] | None = None, repeat: int | None = None) -> DataFrame:
    """Score sets of all methods, which must cover the same items."""
    scores = read_scores(spark, path, methods, repeat)
    if check_alignment(scores).head(1):
        raise ValueError("methods score different items")
    return scores


def detect_repeats(scores: DataFrame, method: str | None = None) -> DataFrame:
    """Repeats present, from the partition values."""
    rows = scores if method is None else scores.filter(F.col("method") == method)
    return rows.select("repeat").distinct()


def split_bundle(items: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of a split; ``target_all`` and ``all_union`` are unions, None means all rows.

    ``items`` has a ``split`` column with source_train, target_train, target_val, target_test.
    """
    groups = {
        "target_all": ["target_train", "target_val", "target_test"],
        "all_union": ["source_train", "target_train", "target_val", "target_test"],
    }
    if split is None:
        return items
    wanted = groups.get(split, [split])
    rows = items.filter(F.col("split").isin(wanted))
    if rows.isEmpty():
        raise ValueError(f"split {split!r} not found")
    return rows


def read_vectors(spark: SparkSession, path: str, info_path: str | None = None) -> DataFrame:
    """Stored vectors; with the info table the number of rows must agree."""
    items = spark.read.parquet(path)
    if info_path is not None:
        expected = spark.read.parquet(info_path).first()["n_items"]
        found = items.count()
        if found != expected:
            raise ValueError(f"{path} has {found} rows, {expected} expected")
    return items


def read_slice_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Subject and slice index of the files in a folder; contents are not read."""
    return slice_names(spark.read.format("binaryFile").load(folder).select("path"))
