"""Vector aggregation: groups of vectors to one vector, centroids, second moments, sketches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.kernels import matrix, vector_array
from gleaner.functions.vectors import hash_order, l2_normalize

_FOLD = {"mean": np.add, "sum": np.add, "max": np.maximum}


#: Partial groups a task holds back so that groups seen in several batches are merged.
_PENDING_ROWS = 4096


def _runs(keys: pa.Table) -> np.ndarray:
    """Start of every run of equal keys."""
    change = np.zeros(keys.num_rows, dtype=bool)
    change[0] = True
    for column in keys.columns:
        codes = np.asarray(column.combine_chunks().dictionary_encode().indices.fill_null(-1))
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _batch(keys: pa.Table, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    columns = [c.combine_chunks() for c in keys.columns]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(n.astype(np.int64)), vector_array(x)], names=[*keys.column_names, "n", "vec"]
    )


def _reduce_sorted(keys: pa.Table, n: np.ndarray, x: np.ndarray, fold):
    starts = _runs(keys)
    return keys.take(pa.array(starts)), np.add.reduceat(n, starts), fold.reduceat(x, starts, axis=0)


def _reduce_any(keys: pa.Table, n: np.ndarray, x: np.ndarray, fold):
    order = keys.append_column("__i", pa.array(np.arange(len(x)))).sort_by(
        [(c, "ascending") for c in keys.column_names]
    ).column("__i")
    at = np.asarray(order)
    return _reduce_sorted(keys.take(pa.array(at)), n[at], x[at], fold)


def _read(batch: pa.RecordBatch, by: list[str]):
    table = pa.Table.from_batches([batch])
    return table.select(by), np.asarray(table.column("n"), dtype=np.int64), matrix(table.column("vec"))


def _partial_groups(by: list[str], agg: str):
    """Reduce the rows of a task to few rows per group, in any input order."""
    fold = _FOLD[agg]

    def reduce(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_reduce_any(*_read(batch, by), fold))
            if sum(len(h[1]) for h in held) >= 2 * _PENDING_ROWS:
                held = [_merge(held)]
                if len(held[0][1]) >= _PENDING_ROWS:
                    yield _batch(*held.pop())
        if held:
            yield _batch(*_merge(held))

    def _merge(parts):
        keys = pa.concat_tables([p[0] for p in parts])
        return _reduce_any(keys, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), fold)

    return reduce


def _final_groups(by: list[str], agg: str):
    """Merge partial rows that arrive sorted by group; a group may span batches."""
    fold = _FOLD[agg]

    def finished(keys, n, x):
        return _batch(keys, n, x / n[:, None] if agg == "mean" else x)

    def reduce(batches):
        open_group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n, x = _reduce_sorted(*_read(batch, by), fold)
            if open_group is not None:
                if open_group[0].to_pylist() == keys.slice(0, 1).to_pylist():
                    n[0] += open_group[1][0]
                    x[0] = fold(x[0], open_group[2][0])
                else:
                    yield finished(*open_group)
            last = len(n) - 1
            if last:
                yield finished(keys.slice(0, last), n[:last], x[:last])
            open_group = keys.slice(last, 1), n[last:], x[last:]
        if open_group is not None:
            yield finished(*open_group)

    return reduce


def aggregate_vectors(
    df: DataFrame, by: str | Sequence[str], agg: str = "mean", vec: str = "vec", count: bool = False
) -> DataFrame:
    """Element-wise mean, max or sum of the vectors of each group.

    Every batch is reduced to one row per group before the shuffle, so a group that
    holds a large share of all rows sends only a few rows; the second step merges the
    sorted partial rows as a stream.
    """
    if agg not in _FOLD:
        raise ValueError(f"unknown aggregation {agg!r}; use one of {sorted(_FOLD)}")
    by = [by] if isinstance(by, str) else list(by)
    schema = T.StructType(
        [df.schema[c] for c in by]
        + [T.StructField("n", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]
    )
    rows = df.select(*by, F.lit(1).cast("long").alias("n"), F.col(vec).cast("array<double>").alias("vec"))
    partial = rows.mapInArrow(_partial_groups(by, agg), schema)
    grouped = partial.repartition(*by).sortWithinPartitions(*by)
    merged = grouped.mapInArrow(_final_groups(by, agg), schema)
    return merged if count else merged.drop("n")


def centroid(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: the mean vector of all rows."""
    return aggregate_vectors(df.withColumn("__all", F.lit(0)), "__all", "mean", vec).drop("__all")


def centroid_array(df: DataFrame, vec: str = "vec") -> np.ndarray:
    """The mean vector as numbers on the driver (d values)."""
    rows = centroid(df, vec).collect()
    if not rows:
        raise ValueError("empty vector table")
    return np.array(rows[0]["vec"])


def case_embedding(slices: DataFrame, by: str = "subject_id", eps: float = 1e-8) -> DataFrame:
    """Mean over the slices of a case, then unit length (norm + eps)."""
    return aggregate_vectors(slices, by, "mean").select(
        by, l2_normalize(F.col("vec"), eps, "add").alias("vec")
    )


def hashed_coordinates(spark: SparkSession, width: int, proj_dim: int, seed: int = 0) -> DataFrame:
    """Bucket and sign of every coordinate from two parts of its hash."""
    key = hash_order(F.col("id"), seed)

    def bits(start):
        return F.conv(F.substring(key, start, 8), 16, 10).cast("long")

    return spark.range(width).select(
        F.col("id").cast("int").alias("dim"),
        (bits(1) % proj_dim).cast("int").alias("bucket"),
        F.when(bits(9) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"),
    )


def countsketch(items: DataFrame, proj_dim: int, seed: int = 0, hash_table: DataFrame | None = None,
                id: str = "item_id", vec: str = "vec") -> DataFrame:
    """Project to ``proj_dim`` values: coordinate j is added with its sign to its bucket.

    ``hash_table(dim, bucket, sign)`` has one row per input coordinate; it is read to the
    driver (its size is the vector length) and applied as a signed gather inside tasks.
    """
    if hash_table is None:
        width = items.select(F.size(vec).alias("d")).first()["d"]
        hash_table = hashed_coordinates(items.sparkSession, width, proj_dim, seed)
    table = hash_table.orderBy("dim").toArrow()
    dims = np.asarray(table.column("dim"))
    if len(dims) != len(np.unique(dims)):
        raise ValueError("hash table repeats a coordinate")
    buckets = np.asarray(table.column("bucket"))
    signs = np.asarray(table.column("sign"), dtype=np.float64)

    def project(batches):
        for batch in batches:
            x = matrix(batch.column(vec))
            if not len(x):
                continue
            out = np.zeros((proj_dim, len(x)))
            np.add.at(out, buckets, (x[:, dims] * signs).T)
            yield pa.RecordBatch.from_arrays([batch.column(id), vector_array(out.T.copy())], names=[id, "vec"])

    schema = T.StructType([items.schema[id], T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return items.select(id, vec).mapInArrow(project, schema)


def case_gradient(slices: DataFrame, proj_dim: int, seed: int = 0, hash_table: DataFrame | None = None,
                  by: str = "subject_id") -> DataFrame:
    """Mean of the sketched slice gradients of each case; cases without slices are absent.

    The sketch is linear, so it is applied to the mean: one projection per case.
    """
    return countsketch(aggregate_vectors(slices, by, "mean"), proj_dim, seed, hash_table, id=by)


def gram_matrix(items: DataFrame, vec: str = "vec", prepare=None) -> DataFrame:
    """Second moment X'X, one row per matrix row: ``dim``, ``vec``; ``prepare`` maps the rows first."""
    def moments(batches):
        gram = None
        for batch in batches:
            x = matrix(batch.column(vec))
            if len(x):
                x = x if prepare is None else prepare(x)
                gram = x.T @ x if gram is None else gram + x.T @ x
        if gram is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(gram), dtype=np.int32)), vector_array(gram)], names=["dim", "vec"]
            )

    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    tasks = 4 * items.sparkSession.sparkContext.defaultParallelism
    partial = items.select(vec).coalesce(tasks).mapInArrow(moments, schema)
    return aggregate_vectors(partial, "dim", "sum")


def gram_array(items: DataFrame, vec: str = "vec", prepare=None) -> np.ndarray:
    """X'X on the driver (d x d values)."""
    table = gram_matrix(items, vec, prepare).toArrow().sort_by("dim")
    return matrix(table.column("vec"))


def mean_pool(feature_map: DataFrame, by: Sequence[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """Spatial mean of each channel, gathered to one vector per slice in channel order."""
    per_channel = feature_map.groupBy(*by, channel).agg(F.avg(value).alias("__mean"))
    return per_channel.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col("__mean").alias("m")))),
            lambda x: x["m"],
        ).alias("vec")
    )
