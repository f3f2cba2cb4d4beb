"""Writers. Spark's committer publishes a table as a whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.scores import nested_budgets
from gleaner.operators.selection import Selection


def write_selection(result: Selection, path: str) -> None:
    """A selection as three tables: ranking, scores and meta."""
    spark = result.ranking.sparkSession
    result.ranking.withColumn("method", F.lit(result.method)).write.mode("overwrite").parquet(f"{path}/ranking")
    result.scores.withColumn("method", F.lit(result.method)).write.mode("overwrite").parquet(f"{path}/scores")
    meta = [(result.method, result.budget, {k: str(v) for k, v in result.meta.items()})]
    spark.createDataFrame(meta, "method string, budget int, meta map<string,string>").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/meta")


def read_selection(spark: SparkSession, path: str) -> Selection:
    meta = spark.read.schema("method string, budget int, meta map<string,string>").json(f"{path}/meta").first()
    ranking = spark.read.parquet(f"{path}/ranking").drop("method")
    return Selection(
        ranking, lambda: spark.read.parquet(f"{path}/scores").drop("method"), meta["method"], meta["budget"], meta["meta"] or {}
    )


def write_subsets(ranking: DataFrame, method: str, ks: Sequence[int], t: int, path: str) -> None:
    """One folder per method and budget factor k."""
    subsets = nested_budgets(ranking, ks, t).withColumn("method", F.lit(method))
    subsets.write.mode("overwrite").partitionBy("method", "k").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Score table partitioned by method, and by repeat where there is one."""
    keys = [c for c in ("method", "repeat") if c in scores.columns]
    scores.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_vectors(items: DataFrame, path: str, kind: str = "embedding") -> None:
    """Vectors and a one-row info table beside them."""
    items.write.mode("overwrite").parquet(path)
    stored = items.sparkSession.read.parquet(path)
    info = stored.agg(F.count(F.lit(1)).alias("n_items"), F.max(F.size("vec")).alias("dim")).withColumn("kind", F.lit(kind))
    info.write.mode("overwrite").parquet(f"{path.rstrip('/')}_info")


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("target", "split").parquet(path)
