"""Vector arithmetic on ``array<double>`` columns, built from Spark's own functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_vector(col: Column | str) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2_normalize(a: Column, eps: float = 1e-8, mode: str = "max") -> Column:
    """Unit vector; ``mode='max'`` divides by max(norm, eps), ``'add'`` by norm + eps."""
    if mode not in ("max", "add"):
        raise ValueError(f"mode must be 'max' or 'add', not {mode!r}")
    size = norm(a)
    scale = F.greatest(size, F.lit(eps)) if mode == "max" else size + F.lit(eps)
    return F.transform(a, lambda x: x / scale)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def constant(values: Sequence[float]) -> Column:
    """A vector known on the driver as a literal column."""
    return F.array(*[F.lit(float(x)) for x in values])


def project_simplex(a: Column) -> Column:
    """Negative entries become 0, then the entries sum to 1; uniform when none is positive."""
    clipped = F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))
    mass = total(clipped)
    return F.when(mass > 0, F.transform(clipped, lambda x: x / mass)).otherwise(
        F.transform(a, lambda _: F.lit(1.0) / F.size(a))
    )


def rank_weights(mu: Column | int) -> Column:
    """Log-decreasing weights ln(mu + 1/2) - ln(i), i = 1..mu, scaled to sum to 1."""
    count = F.lit(mu) if isinstance(mu, int) else mu
    raw = F.transform(F.sequence(F.lit(1), count), lambda i: F.log(count + 0.5) - F.log(i))
    # The sum is an element of an array of its own: inside the outer function it would be taken anew for every weight.
    return F.element_at(F.transform(F.array(total(raw)), lambda s: F.transform(raw, lambda x: x / s)), 1)


#: Places of one row before it is dealt out, so that a group of any size is the work of many tasks.
PLACES = 4096


def rank_weight_rows(sizes: DataFrame, by: Sequence[str], mu: str = "mu") -> DataFrame:
    """``rank_weights`` of ``sizes(by, mu)`` as rows ``by, dim, value``, one a place, for groups of any size."""
    by = list(by)
    starts = sizes.filter(F.col(mu) > 0).select(*by, mu, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mu).cast("long"), F.lit(PLACES).cast("long"))).alias("__start"))
    upto = F.least(F.col("__start") + PLACES - 1, F.col(mu).cast("long"))
    raw = starts.repartition(*by, "__start").select(*by, mu, F.explode(F.sequence(F.col("__start"), upto)).alias("__i")).withColumn(
        "__raw", F.log(F.col(mu) + 0.5) - F.log("__i")
    )
    sums = raw.groupBy(*by).agg(F.sum("__raw").alias("__sum"))
    keys = {c: f"__key{i}" for i, c in enumerate(by)}
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    named = sums.select(*[F.col(c).alias(k) for c, k in keys.items()], "__sum")
    return raw.join(named, same).select(*by, (F.col("__i") - 1).cast("int").alias("dim"), (F.col("__raw") / F.col("__sum")).alias("value"))


def parse_seeds(text: Column) -> Column:
    """``"0,1 2"`` becomes ``[0, 1, 2]``."""
    parts = F.filter(F.split(text, "[,\\s]+"), lambda s: s != "")
    return F.transform(parts, lambda s: s.cast("int"))


def hash_order(item: Column | str, seed: int | Column) -> Column:
    """A reproducible random order that does not depend on partitioning."""
    item = F.col(item) if isinstance(item, str) else item
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), item.cast("string")))


def hash_uniform(item: Column | str, seed: int | Column) -> Column:
    """A reproducible draw from [0, 1) with 32 random bits."""
    bits = F.conv(F.substring(hash_order(item, seed), 1, 8), 16, 10).cast("double")
    return bits / F.lit(math.pow(2.0, 32))
