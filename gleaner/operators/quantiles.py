"""Exact quantiles of groups of any size by counting.

A double becomes a 64-bit number of the same order. Each of four passes counts the values of every group by
their next 16 bits, among those that share the bits found so far, and narrows each wanted place to
one count; after the last pass the bits are the value. Tasks send counts, at most 65,536 for
a group and prefix, never values, and a group with most of the rows is no problem.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import freeze

BITS, PASSES = 16, 4
#: Rows of a table of groups that are shipped to every task.
SHIPPED = 100_000
_SIGN = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; NaN is the largest, -0.0 equals 0.0."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_ordered_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SHIPPED + 1).count() <= SHIPPED else df


def _same(columns: Sequence[str]) -> Column:
    """Equality of ``columns`` with their ``__of_`` twins; nulls are a group like any other."""
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in columns], F.lit(True))


def _twins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__of_{c}" for c in columns})


def order_statistics(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, prob, low, high, share``: the values on both sides of each quantile's place and its way between them.

    The place of p among n values in order is (n - 1) p. Null values are left out, so a group of nulls is absent.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{value}`").cast("double").alias("__value")).filter("__value IS NOT NULL")

    def encode(batches):
        for batch in batches:
            bits = ordered_bits(np.asarray(batch.column(len(keys)), dtype=np.float64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(bits)], names=[*keys, "__bits"])

    fields = [rows.schema[k] for k in keys]
    coded = freeze(rows.mapInArrow(encode, T.StructType([*fields, T.StructField("__bits", T.LongType())])))
    sizes = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    place = (F.col("__n") - 1) * F.col("__p")
    slots = sizes.withColumn("__p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "__slot", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), f(place).cast("long").alias("left")) for s, f in (("low", F.floor), ("high", F.ceil))]))
    )
    state = freeze(slots.select(
        *keys, "__p", (place - F.floor(place)).alias("__share"), F.col("__slot.side").alias("__side"), F.col("__slot.left").alias("__left"), F.lit(0).cast("long").alias("__prefix")
    ))
    for number in range(PASSES):
        shift = 64 - BITS * (number + 1)
        digit = F.shiftrightunsigned("__bits", shift).bitwiseAND(F.lit((1 << BITS) - 1)).alias("__digit")
        if number:
            # Only values under a prefix that is still looked for are counted.
            marked = coded.withColumn("__prefix", F.shiftrightunsigned("__bits", shift + BITS))
            looked = _twins(_few(state.select(*keys, "__prefix").distinct()), [*keys, "__prefix"])
            marked = marked.join(looked, _same([*keys, "__prefix"]), "left_semi")
        else:
            marked = coded.withColumn("__prefix", F.lit(0).cast("long"))
        counts = marked.groupBy(*keys, "__prefix", digit).agg(F.count(F.lit(1)).alias("__count"))
        upto = Window.partitionBy(*keys, "__prefix").orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__count").over(upto), F.lit(0)))
        counts = _twins(counts, [*keys, "__prefix"])
        inside = (F.col("__left") >= F.col("__before")) & (F.col("__left") < F.col("__before") + F.col("__count"))
        found = counts.join(_few(state), _same([*keys, "__prefix"]) & inside)
        state = freeze(found.select(
            *keys, "__p", "__share", "__side", (F.col("__left") - F.col("__before")).alias("__left"),
            F.shiftleft("__prefix", BITS).bitwiseOR(F.col("__digit")).alias("__prefix"),
        ))

    def decode(batches):
        for batch in batches:
            values = from_ordered_bits(np.asarray(batch.column(len(keys) + 3)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 3], pa.array(values)], names=[*keys, "__p", "__share", "__side", "__value"])

    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in (("__p", T.DoubleType()), ("__share", T.DoubleType()), ("__side", T.StringType()), ("__value", T.DoubleType()))]])
    values = state.select(*keys, "__p", "__share", "__side", "__prefix").mapInArrow(decode, schema)
    sides = [F.max(F.when(F.col("__side") == s, F.col("__value"))).alias(s) for s in ("low", "high")]
    return values.groupBy(*keys, "__p").agg(*sides, F.max("__share").alias("share")).select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("__p").alias("prob"), "low", "high", "share"
    )


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and one column ``q0, q1, ..`` per prob: the exact quantile, interpolated between neighbours."""
    found = order_statistics(df, value, sorted(set(map(float, probs))), by)
    at = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    return found.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*[F.max(F.when(F.col("prob") == float(p), at)).alias(f"q{i}") for i, p in enumerate(probs)])


def attach(df: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df``, one row a group, with the columns of ``found``; groups that ``found`` lacks get nulls."""
    if not by:
        return df.join(F.broadcast(found), F.lit(True), "left")
    return df.join(_twins(found, by), _same(by), "left").drop(*[f"__of_{c}" for c in by])
