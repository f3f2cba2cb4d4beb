"""Positions in a global order without sending everything to one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import freeze

#: Groups whose starts are shipped to every task.
SHIPPED_GROUPS = 100_000

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits

#: Window top-k below this size is cut before the shuffle by Spark itself.
WINDOW_LIMIT = 1000


def _numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in global order with partition number and index, frozen to files.

    The sort splits the data by the whole order key, so many rows with equal scores
    still spread over partitions when an id is part of the key.
    """
    marked = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    return freeze(marked).select(
        "*",
        F.shiftright("__at", _INDEX_BITS).alias("__part"),
        F.col("__at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).alias("__index"),
    )


def _with_offsets(rows: DataFrame, totals: Column) -> DataFrame:
    """Attach what precedes each partition; the offset table has one row per partition."""
    per_part = rows.groupBy("__part").agg(totals.alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")
    )
    return rows.join(F.broadcast(offsets), "__part")


def _with_starts(rows: DataFrame, starts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach each group's start; a null is a group of its own, as in a window."""
    keys = [f"__key{i}" for i in range(len(by))]
    named = starts.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "__start")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)])
    # Few groups of many rows: shipped where their number allows it, else joined.
    few = named.limit(SHIPPED_GROUPS + 1).count() <= SHIPPED_GROUPS
    return rows.join(F.broadcast(named) if few else named, same).drop(*keys)


def row_number(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """``row_number() over (partition by .. order by ..)`` for groups of any size.

    ``order`` should end in a unique key.
    """
    by = list(by)
    rows = _with_offsets(
        _numbered(df, [F.col(c).asc() for c in by] + list(order)), F.count(F.lit(1))
    )
    rows = rows.withColumn("__row", F.col("__offset") + F.col("__index") + 1)
    if by:
        starts = rows.groupBy(*by).agg(F.min("__row").alias("__start"))
        rows = _with_starts(rows, starts, by).withColumn("__row", F.col("__row") - F.col("__start") + 1)
    return rows.select(*df.columns, F.col("__row").cast("long").alias(name))


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    value: str,
    by: Sequence[str] = (),
    name: str = "before",
) -> DataFrame:
    """Sum of ``value`` over the rows that come strictly earlier in the group's order."""
    by = list(by)
    rows = _with_offsets(
        _numbered(df, [F.col(c).asc() for c in by] + list(order)), F.sum(value)
    )
    inside = Window.partitionBy("__part").orderBy("__index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "__before", F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    )
    if by:
        starts = rows.groupBy(*by).agg(F.min("__before").alias("__start"))
        rows = _with_starts(rows, starts, by).withColumn("__before", F.col("__before") - F.col("__start"))
    return rows.select(*df.columns, F.col("__before").alias(name))


def first_rows(
    df: DataFrame,
    limit: int,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """The first ``limit`` rows in order, whole or per group, with their position.

    Small limits are cut inside every task; larger ones number all rows by a distributed sort.
    """
    by = list(by)
    if by:
        if limit <= WINDOW_LIMIT:
            ranked = df.withColumn(
                name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
            )
        else:
            ranked = row_number(df, order, by, name)
        return ranked.filter(F.col(name) <= limit)
    if limit <= WINDOW_LIMIT:
        top = df.orderBy(*order).limit(limit)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return row_number(df, order, (), name).filter(F.col(name) <= limit)
