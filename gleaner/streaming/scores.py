"""Scores of arriving pool rows against a fixed query set, with Structured Streaming.

Largest cosine, softmax-weighted cosine and mean cosine look at one pool row at a time, so a
stream of rows is scored by the map that scores a table: the query vectors are shipped once, when the
stream starts, and must fit the broadcast bound. Row scores go to Spark's file sink, which commits each
micro-batch once. Subject scores are running means kept in the stream's state; each
micro-batch writes the subjects it changed to a folder of its own, so a batch that is run again after a
crash replaces what it wrote before. Both start again from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gleaner.operators.scores import rank_all
from gleaner.operators.selection import less_slice_scores, mean_similarity
from gleaner.operators.similarity import fetch_bounded, max_similarity, with_similarity

Score = Callable[[DataFrame, DataFrame], DataFrame]


def _rds(rows: DataFrame, query: DataFrame) -> DataFrame:
    return with_similarity(rows, query, [max_similarity("score")], keep=_others(rows), eps=1e-12)


def _less(rows: DataFrame, query: DataFrame) -> DataFrame:
    return less_slice_scores(rows, query, keep=_others(rows))


def _mean(rows: DataFrame, query: DataFrame) -> DataFrame:
    if _others(rows):
        raise ValueError("the mean cosine carries no further columns")
    return mean_similarity(rows, query)


def _others(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("item_id", "vec")]


#: Methods whose score of a row depends on the query set alone.
METHODS: dict[str, Score] = {"rds_max": _rds, "less": _less, "mean_similarity": _mean}


def row_scores(arriving: DataFrame, query: DataFrame, method: str = "rds_max") -> DataFrame:
    """``item_id``, ``score`` and the other columns of ``arriving(item_id, vec, ..)``, a stream or a table.

    ``query(vec)`` is read when the stream starts. A query set beyond the broadcast bound is an error, since
    a stream can't be joined with it block by block.
    """
    if method not in METHODS:
        raise ValueError(f"{method!r} is not among the streaming methods: {', '.join(sorted(METHODS))}")
    if arriving.isStreaming and fetch_bounded(query, "vec") is None:
        raise ValueError("the query set of a stream must fit the broadcast bound")
    return METHODS[method](arriving, query)


def arriving_files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they appear there."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def store_row_scores(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the scores of all rows that have arrived and stop; a later call goes on from ``checkpoint``."""
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subject_scores(scored: DataFrame, by: str = "subject_id") -> DataFrame:
    """Mean score of each subject over all its rows so far; a stream keeps one sum and count a subject."""
    return scored.groupBy(by).agg(F.avg("score").alias("score"))


def store_changes(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that each micro-batch changed to ``out/batch=N``, replacing what an earlier try left."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, out: str, by: str = "subject_id") -> DataFrame:
    """The last stored row of each key."""
    stored = spark.read.option("basePath", out).parquet(out)
    values = [c for c in stored.columns if c not in (by, "batch")]
    newest = stored.groupBy(by).agg(F.max_by(F.struct(*values), F.col("batch")).alias("row"))
    return newest.select(by, "row.*")


def ranked(spark: SparkSession, out: str) -> DataFrame:
    """All stored row scores in order: ``rank, item_id, score``."""
    return rank_all(spark.read.parquet(out).select("item_id", "score"))
