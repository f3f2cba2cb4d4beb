"""Cosine similarity between two vector tables, reduced on the fly.

No operator here emits the pairs. Three physical plans give the same result:

* the right side fits the broadcast bound: one map over the left side, no shuffle;
* the left side fits: one map over the right side, partial results per left row are
  then merged by a small aggregation;
* neither fits: both sides are cut into blocks of bounded size by a hash of the id and
  every block pair is one task group; partial results are merged per left row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.functions.kernels import id_values, matrix, row_slices, unit_rows
from gleaner.functions.ordering import first_rows
from gleaner.session import BLOCK_BYTES, BROADCAST_BYTES, freeze


@dataclass(frozen=True)
class Measure:
    """One number per left row: ``reduce`` maps an (n, m) cosine block to n values."""

    name: str
    reduce: Callable[[np.ndarray, np.ndarray], np.ndarray]
    merge: str  # 'max' or 'sum'


def max_similarity(name: str = "max_sim") -> Measure:
    return Measure(name, lambda s, w: s.max(axis=1), "max")


def sum_similarity(name: str = "sum_sim") -> Measure:
    return Measure(name, lambda s, w: s.sum(axis=1), "sum")


def sum_positive(name: str = "sum_pos") -> Measure:
    return Measure(name, lambda s, w: np.maximum(s, 0.0).sum(axis=1), "sum")


def exp_mass(beta: float, name: str = "exp_mass") -> Measure:
    """Sum of w * exp(beta * (cos - 1)); the shift keeps it in range for any beta."""
    return Measure(name, lambda s, w: (np.exp(beta * (s - 1.0)) * w).sum(axis=1), "sum")


def exp_weighted(beta: float, name: str = "exp_sim") -> Measure:
    return Measure(name, lambda s, w: (np.exp(beta * (s - 1.0)) * s).sum(axis=1), "sum")


def fetch_bounded(df: DataFrame, vec: str, extra: Sequence[str] = (), limit_bytes: int = BROADCAST_BYTES):
    """The rows as an Arrow table when they fit ``limit_bytes``, else None."""
    first = df.select(F.size(vec).alias("d")).head(1)
    if not first:
        raise ValueError("empty vector table")
    cap = max(1, limit_bytes // (8 * max(1, first[0]["d"])))
    table = df.select(vec, *extra).limit(cap + 1).toArrow()
    return None if table.num_rows > cap else table


def _accumulate(measures, sims, weights, out):
    for i, m in enumerate(measures):
        value = m.reduce(sims, weights)
        out[i] = np.maximum(out[i], value) if m.merge == "max" else out[i] + value


def _start(measures, n):
    return [np.full(n, -np.inf) if m.merge == "max" else np.zeros(n) for m in measures]


def _compare(measures, left: np.ndarray, right: np.ndarray, weights: np.ndarray):
    """All measures for the rows of ``left`` against all rows of ``right``."""
    out = _start(measures, len(left))
    for rows in row_slices(len(left)):
        part = [o[rows] for o in out]
        for cols in row_slices(len(right)):
            _accumulate(measures, left[rows] @ right[cols].T, weights[cols], part)
        for o, p in zip(out, part):
            o[rows] = p
    return out


def _weights_of(table, weight):
    return np.asarray(table.column(weight), dtype=np.float64) if weight else None


def _merged(partials: DataFrame, id: str, measures) -> DataFrame:
    return partials.groupBy(id).agg(
        *[(F.max if m.merge == "max" else F.sum)(m.name).alias(m.name) for m in measures]
    )


def with_similarity(
    left: DataFrame,
    right: DataFrame,
    measures: Sequence[Measure],
    *,
    id: str = "item_id",
    vec: str = "vec",
    weight: str | None = None,
    keep: Sequence[str] = (),
    eps: float = 1e-8,
    mode: str = "max",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``left`` ids with one column per measure over the cosines to all of ``right``.

    ``keep`` names further columns of ``left`` to carry along; ``weight`` a column of
    ``right`` given to the measures.
    """
    measures = tuple(measures)
    fields = [T.StructField(m.name, T.DoubleType()) for m in measures]
    extra = [weight] if weight else []
    small = fetch_bounded(right, vec, extra, broadcast_bytes)
    if small is not None:
        points = unit_rows(matrix(small.column(vec)), eps, mode)
        shares = _weights_of(small, weight)
        shares = np.ones(len(points)) if shares is None else shares
        carried = [id, *[c for c in keep if c != id]]

        def score_batches(batches):
            for batch in batches:
                x = matrix(batch.column(vec))
                if not len(x):
                    continue
                values = _compare(measures, unit_rows(x, eps, mode), points, shares)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in carried] + [pa.array(v) for v in values],
                    names=carried + [m.name for m in measures],
                )

        schema = T.StructType([left.schema[c] for c in carried] + fields)
        source = left.select(*dict.fromkeys([*carried, vec]))
        return source.mapInArrow(score_batches, schema)

    # Partial results are merged by a row number, so that repeated ids stay rows of their own.
    whole, out_id, id = freeze(left.select(*dict.fromkeys([id, vec, *keep])).withColumn("__row", F.monotonically_increasing_id())), id, "__row"
    left = whole.select(id, vec)
    mine = fetch_bounded(left, vec, [id], broadcast_bytes)
    schema = T.StructType([left.schema[id]] + fields)
    names = [id] + [m.name for m in measures]
    if mine is not None:
        anchors = unit_rows(matrix(mine.column(vec)), eps, mode)
        anchor_ids = mine.column(id).combine_chunks()

        def partial_batches(batches):
            out, seen = _start(measures, len(anchors)), False
            for batch in batches:
                x = matrix(batch.column(vec))
                if not len(x):
                    continue
                seen = True
                w = _weights_of(batch, weight)
                part = _compare(
                    measures, anchors, unit_rows(x, eps, mode), np.ones(len(x)) if w is None else w
                )
                for i, m in enumerate(measures):
                    out[i] = np.maximum(out[i], part[i]) if m.merge == "max" else out[i] + part[i]
            if seen:
                yield pa.RecordBatch.from_arrays([anchor_ids, *[pa.array(o) for o in out]], names=names)

        # Few tasks: each sends one row per left row.
        tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
        partials = right.select(vec, *extra).coalesce(tasks).mapInArrow(partial_batches, schema)
        merged = _merged(partials, id, measures)
    else:
        left_blocks = block_count(left, vec, block_bytes)
        right_blocks = block_count(right, vec, block_bytes)

        def block_pair(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({n: [] for n in names}, schema=arrow_schema)
            w = _weights_of(b, weight)
            values = _compare(
                measures,
                unit_rows(matrix(a.column(vec)), eps, mode),
                unit_rows(matrix(b.column(vec)), eps, mode),
                np.ones(b.num_rows) if w is None else w,
            )
            return pa.table([a.column(id), *[pa.array(v) for v in values]], names=names)

        arrow_schema = pa.schema(
            [id_field_of(left, id)] + [pa.field(m.name, pa.float64()) for m in measures]
        )
        a = spread(left.select(id, vec), F.xxhash64(id), "__a", left_blocks, "__b", right_blocks)
        b = spread(right.select(vec, *extra), F.xxhash64(vec), "__b", right_blocks, "__a", left_blocks)
        pairs = a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b"))
        merged = _merged(pairs.applyInArrow(block_pair, schema), id, measures)
    carried = list(dict.fromkeys([out_id, *keep]))
    return whole.select("__row", *carried).join(merged, "__row").drop("__row")


def id_field_of(df: DataFrame, column: str) -> pa.Field:
    """Arrow field of an id column of any type."""
    return pa.field(column, to_arrow_type(df.schema[column].dataType))


def block_count(df: DataFrame, vec: str, block_bytes: int) -> int:
    size = df.agg(F.sum(F.size(vec).cast("long") * 8).alias("b")).first()["b"] or 0
    return max(1, math.ceil(size / block_bytes))


def spread(df: DataFrame, key, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Assign each row to one block and repeat it for every block of the other side."""
    return df.withColumn(own, F.pmod(key, F.lit(own_blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
    )


def nearest_items(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    id: str = "item_id",
    vec: str = "vec",
    exclude: Sequence = (),
    eps: float = 1e-8,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For every query its ``k`` most similar pool items, ties by lowest id.

    Output: query id, item id, ``sim`` and ``position`` (1 = nearest).
    """
    schema = T.StructType(
        [queries.schema[query_id], pool.schema[id], T.StructField("sim", T.DoubleType())]
    )
    names = [query_id, id, "sim"]
    banned = np.asarray(list(exclude))

    def merge(held, qx, x, ids):
        """Best ``k`` (query, item, sim) of what is held and a batch, sorted by query and place."""
        keep = ~np.isin(ids, banned) if len(banned) else np.ones(len(ids), dtype=bool)
        x, ids = x[keep], ids[keep]
        for cols in row_slices(len(x), 2048):
            block = np.round(qx @ x[cols].T, 12)
            n = block.shape[1]
            floor = np.full(len(qx), -np.inf) if n <= k else np.partition(block, n - k, axis=1)[:, n - k]
            if held is not None:  # a full list is only entered by its last value or better
                queries_held, counts = np.unique(held[0], return_counts=True)
                last = np.cumsum(counts) - 1
                full = counts == k
                floor[queries_held[full]] = np.maximum(floor[queries_held[full]], held[2][last[full]])
            q, at = np.nonzero(block >= floor[:, None])
            i, s = ids[cols][at], block[q, at]
            if held is not None:
                q, i, s = (np.concatenate(pair) for pair in zip(held, (q, i, s)))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            first = np.r_[True, q[1:] != q[:-1]]
            place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            held = tuple(v[place < k] for v in (q, i, s))
        return held

    def merge_slices(held, qx, x, ids):
        """The same for any number of queries, a slice of them at a time: ``held`` has one entry a slice."""
        return [merge(h, qx[rows], x, ids) for h, rows in zip(held, row_slices(len(qx)))]

    def rows_of(held, q_ids):
        for h, rows in zip(held, row_slices(len(q_ids))):
            if h is not None and len(h[0]):
                yield batch_of(h, q_ids[rows.start : rows.stop])

    def batch_of(held, q_ids):
        q, i, s = held
        return pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), pa.array(i), pa.array(s + 0.0)], names=names)

    small = fetch_bounded(queries, vec, [query_id], broadcast_bytes)
    if small is not None:
        points = unit_rows(matrix(small.column(vec)), eps)
        point_ids = small.column(query_id).combine_chunks()

        def scan(batches):
            held = [None for _ in row_slices(len(points))]
            for batch in batches:
                x = matrix(batch.column(vec))
                if len(x):
                    held = merge_slices(held, points, unit_rows(x, eps), id_values(batch.column(id)))
            yield from rows_of(held, point_ids)

        found = pool.select(id, vec).mapInArrow(scan, schema)
    else:
        q_blocks = block_count(queries, vec, block_bytes)
        p_blocks = block_count(pool, vec, block_bytes)
        arrow_schema = pa.schema(
            [id_field_of(queries, query_id), id_field_of(pool, id), pa.field("sim", pa.float64())]
        )

        def block_pair(a: pa.Table, b: pa.Table) -> pa.Table:
            held = [None for _ in row_slices(a.num_rows)]
            if a.num_rows and b.num_rows:
                held = merge_slices(
                    held, unit_rows(matrix(a.column(vec)), eps), unit_rows(matrix(b.column(vec)), eps), id_values(b.column(id))
                )
            return pa.Table.from_batches(rows_of(held, a.column(query_id).combine_chunks()), schema=arrow_schema)

        a = spread(queries.select(query_id, vec), F.xxhash64(query_id), "__q", q_blocks, "__p", p_blocks)
        b = spread(pool.select(id, vec), F.xxhash64(id), "__p", p_blocks, "__q", q_blocks)
        found = a.groupBy("__q", "__p").cogroup(b.groupBy("__q", "__p")).applyInArrow(block_pair, schema)
    placed = first_rows(found, k, [F.desc("sim"), F.asc(id)], [query_id], "position")
    return placed.withColumn("position", F.col("position").cast("int"))


def softmax(df: DataFrame, value: str, by: Sequence[str], temperature: float = 1.0, name: str = "weight") -> DataFrame:
    """exp(x / temperature) over its sum within each group; groups are aggregated, not gathered."""
    scaled = F.col(value) / F.lit(float(temperature))
    tops = df.groupBy(*by).agg(F.max(scaled).alias("__top"))
    shifted = df.join(tops, list(by)).withColumn("__e", F.exp(scaled - F.col("__top"))).drop("__top")
    sums = shifted.groupBy(*by).agg(F.sum("__e").alias("__sum"))
    return shifted.join(sums, list(by)).withColumn(name, F.col("__e") / F.col("__sum")).drop("__e", "__sum")
