"""Queries that feed a table in portions and score it as it arrives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans import valuation  # noqa: F401  (their SQL is used here)
from gleaner.plans.registry import ORACLES, items, pool, query, r6, target
from gleaner.session import ensure_checkpoint_dir
from gleaner.streaming import scores as streaming

#: Portions that arrive one after another; the stream stops and starts again in between.
PORTIONS = 3


def _fed(spark: SparkSession, rows: DataFrame, run) -> str:
    """Folder of results after all portions of ``rows`` went through ``run(stream, out, checkpoint)``."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for portion in range(PORTIONS):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(PORTIONS)) == portion)
        part.write.mode("append").parquet(f"{root}/in")
        stream = streaming.arriving_files(spark, f"{root}/in", rows.schema, 4)
        run(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return f"{root}/out"


@query("stream_rds_max", ORACLES["rds_max"])
def stream_rds_max(spark, sf):
    """Largest cosine of rows that arrive in portions, over restarts: the ranking of the whole table."""
    wanted = target(spark, sf)
    out = _fed(spark, pool(spark, sf).select("item_id", "vec"), lambda s, out, state: streaming.store_row_scores(
        streaming.row_scores(s, wanted), out, state
    ))
    return streaming.ranked(spark, out).select("rank", "item_id", r6("score").alias("gain"))


@query("stream_mean_sim_rank", ORACLES["mean_sim_rank"])
def stream_mean_sim_rank(spark, sf):
    wanted = target(spark, sf)
    out = _fed(spark, pool(spark, sf).select("item_id", "vec"), lambda s, out, state: streaming.store_row_scores(
        streaming.row_scores(s, wanted, "mean_similarity"), out, state
    ))
    return streaming.ranked(spark, out).select("rank", "item_id", r6("score").alias("score"))


@query("stream_less_softmax", ORACLES["less_softmax"])
def stream_less_softmax(spark, sf):
    """Mean slice score of each subject, updated as its slices arrive in different portions."""
    wanted = target(spark, sf)
    slices = items(spark, sf).filter("site <> 0").select("item_id", "vec", F.expr("item_id div 5").alias("subject_id"))

    def run(stream, out, state):
        return streaming.store_changes(streaming.subject_scores(streaming.row_scores(stream, wanted, "less")), out, state)

    found = streaming.latest(spark, _fed(spark, slices, run)).withColumnRenamed("subject_id", "item_id")
    return streaming.rank_all(found).select("rank", "item_id", r6("score").alias("gain"))
