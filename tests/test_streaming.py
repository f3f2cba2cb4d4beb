"""Streams against the same computation over the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import selection
from gleaner.session import ensure_checkpoint_dir
from gleaner.streaming import scores as streaming


def folder(spark, name):
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@pytest.fixture
def tables(vectors):
    _, _, rows = vectors(240, 6, seed=1)
    _, _, query = vectors(30, 6, seed=2)
    return rows, query.select("vec")


@pytest.mark.parametrize("method", ["rds_max", "mean_similarity"])
def test_portions_and_restarts_give_the_batch_scores(spark, tables, method):
    rows, query = tables
    root = folder(spark, "stream")
    for part in range(4):
        rows.filter(F.col("item_id") % 4 == part).write.mode("append").parquet(f"{root}/in")
        arriving = streaming.arriving_files(spark, f"{root}/in", rows.schema, 1)
        stream = streaming.store_row_scores(streaming.row_scores(arriving, query, method), f"{root}/out", f"{root}/state")
        stream.awaitTermination()
    got = {r.item_id: r.score for r in spark.read.parquet(f"{root}/out").collect()}
    want = {r.item_id: r.score for r in streaming.row_scores(rows, query, method).collect()}
    assert got == pytest.approx(want) and len(got) == 240
    again = streaming.store_row_scores(streaming.row_scores(streaming.arriving_files(spark, f"{root}/in", rows.schema), query, method), f"{root}/out", f"{root}/state")
    again.awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 240  # nothing is scored twice


def test_subject_means_follow_their_rows(spark, tables):
    rows, query = tables
    rows = rows.withColumn("subject_id", F.expr("item_id div 5"))
    root = folder(spark, "subjects")
    for part in range(3):
        rows.filter(F.col("item_id") % 3 == part).write.mode("append").parquet(f"{root}/in")
        scored = streaming.row_scores(streaming.arriving_files(spark, f"{root}/in", rows.schema, 2), query, "less")
        streaming.store_changes(streaming.subject_scores(scored), f"{root}/out", f"{root}/state").awaitTermination()
    got = {r.subject_id: r.score for r in streaming.latest(spark, f"{root}/out").collect()}
    want = {r.item_id: r.score for r in selection.less_softmax(rows, query).scores.collect()}
    assert got == pytest.approx(want)


def test_a_batch_that_failed_after_writing_is_replaced(spark, tables, monkeypatch):
    rows, query = tables
    rows = rows.withColumn("subject_id", F.expr("item_id div 5"))
    root = folder(spark, "crash")
    rows.write.parquet(f"{root}/in")

    def changes():
        return streaming.subject_scores(streaming.row_scores(streaming.arriving_files(spark, f"{root}/in", rows.schema), query, "less"))

    def crash(frame, number):
        frame.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        raise RuntimeError("executor lost")

    failed = changes().writeStream.outputMode("update").foreachBatch(crash).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception):
        failed.awaitTermination()
    streaming.store_changes(changes(), f"{root}/out", f"{root}/state").awaitTermination()
    stored = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")
    assert stored.count() == stored.select("subject_id").distinct().count() == 48


def test_methods_and_bounds_are_checked(spark, tables, monkeypatch):
    rows, query = tables
    with pytest.raises(ValueError, match="streaming methods"):
        streaming.row_scores(rows, query, "herding")
    root = folder(spark, "bound")
    rows.write.parquet(f"{root}/in")
    arriving = streaming.arriving_files(spark, f"{root}/in", rows.schema)
    monkeypatch.setattr(streaming, "fetch_bounded", lambda *a: None)
    with pytest.raises(ValueError, match="broadcast bound"):
        streaming.row_scores(arriving, query)
    assert np.isfinite(streaming.row_scores(rows, query).agg(F.sum("score")).first()[0])
