"""Score tables: normalising, mixing, ranking and budgets. Scores are kept in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.ordering import first_rows, row_number, running_total
from gleaner.session import freeze


#: Rows of a table that are shipped to every task; a score counts as hot beyond this part of its method's items.
SHIPPED, HOT_SHARE = 100_000, 1000


def _is_small(df: DataFrame) -> bool:
    return df.limit(SHIPPED + 1).count() <= SHIPPED


def _shipped(df: DataFrame) -> DataFrame:
    """A table of methods, shipped where its number of rows allows it."""
    return F.broadcast(df) if _is_small(df) else df


def rank_normalize(scores: DataFrame, by: str = "method", id: str = "item_id", score: str = "score") -> DataFrame:
    """Best score 1, worst 0; equal scores share the mean of their positions.

    Equal scores are counted before anything is ordered, so the ordered table has one
    row per distinct score and heavy ties cost nothing.
    """
    ties = scores.groupBy(by, score).agg(F.count(F.lit(1)).alias("__ties"))
    placed = freeze(running_total(ties, [F.desc(score)], "__ties", [by], "__before"))
    sizes = placed.groupBy(by).agg(F.max(F.col("__before") + F.col("__ties")).alias("__n"))
    small = sizes.filter(F.col("__n") < 2).select(by).head(1)
    if small:
        raise ValueError(f"rank normalisation needs at least two items ({small[0][0]!r})")
    normal = freeze(placed.join(_shipped(sizes), by).select(
        by,
        score,
        (1.0 - (F.col("__before") + (F.col("__ties") - 1) / 2.0) / (F.col("__n") - 1)).alias("__norm"),
        (F.col("__ties") * HOT_SHARE > F.col("__n")).alias("__hot"),
    ))
    rows = scores.select(by, id, score)
    if _is_small(normal):
        found = rows.join(F.broadcast(normal), [by, score])
    else:
        # A score that many items share (zero, mostly) would be one task's work: at most HOT_SHARE scores a method are shipped.
        hot = normal.filter("__hot").select(F.col(by).alias("__by"), F.col(score).alias("__score"), F.col("__norm").alias("__known"))
        match = (F.col(by) == F.col("__by")) & (F.col(score) == F.col("__score"))
        marked = rows.join(F.broadcast(hot), match, "left").drop("__by", "__score")
        rest = marked.filter("__known IS NULL").drop("__known").join(normal.filter("NOT __hot"), [by, score])
        found = marked.filter("__known IS NOT NULL").select(by, id, F.col("__known").alias("__norm")).unionByName(rest.select(by, id, "__norm"))
    return found.select(by, id, F.col("__norm").alias("score"))


def minmax_normalize(
    scores: DataFrame, strict: bool = True, by: str = "method", id: str = "item_id", score: str = "score"
) -> DataFrame:
    """Scale each method to [0, 1]; a constant method is an error or 0.5 (``strict=False``)."""
    spans = scores.groupBy(by).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    if strict:
        flat = spans.filter(span < 1e-12).select(by).head(1)
        if flat:
            raise ValueError(f"constant scores cannot be scaled ({flat[0][0]!r})")
    scaled = F.when(span > 0, (F.col(score) - F.col("__lo")) / span).otherwise(F.lit(0.5))
    return scores.join(_shipped(spans), by).select(by, id, scaled.alias("score"))


def check_alignment(scores: DataFrame, by: str = "method", id: str = "item_id") -> DataFrame:
    """Items that not every method has scored, with the number of methods that did."""
    methods = scores.select(by).distinct().agg(F.count(F.lit(1)))
    seen = scores.groupBy(id).agg(F.countDistinct(by).alias("n_methods"))
    return seen.filter(F.col("n_methods") != methods.scalar())


def _scored_by(by: str) -> Column:
    """The methods that scored an item, as a sorted list."""
    return F.array_sort(F.collect_set(by)).alias("__methods")


def require_aligned(per_item: DataFrame) -> DataFrame:
    """Check that all items were scored by the same methods, then drop the evidence.

    ``per_item`` should be frozen: it is read for the check and again for the result.
    """
    lists = per_item.agg(F.min("__methods").alias("a"), F.max("__methods").alias("b")).first()
    if lists["a"] != lists["b"]:
        raise ValueError("methods score different items")
    return per_item.drop("__methods")


def align_scores(
    scores: DataFrame, methods: Sequence[str], strict: bool = False, fill: float = 0.0,
    by: str = "method", id: str = "item_id", score: str = "score",
) -> DataFrame:
    """One row per item and one column per method; gaps are ``fill`` or, if strict, an error."""
    columns = [F.max(F.when(F.col(by) == m, F.col(score))).alias(m) for m in methods]
    if strict:
        chosen = scores.filter(F.col(by).isin(list(methods)))
        return require_aligned(freeze(chosen.groupBy(id).agg(*columns, _scored_by(by))))
    return scores.groupBy(id).agg(*columns).fillna(fill, subset=list(methods))


def _weight(weights: Mapping[str, float], by: Column) -> Column:
    pairs = [F.lit(v) for kv in ((m, float(w)) for m, w in weights.items()) for v in kv]
    return F.create_map(*pairs)[by]


def simplex(weights: Mapping[str, float]) -> dict[str, float]:
    """Negative weights become 0, then all sum to 1; uniform when none is positive."""
    clipped = {m: max(float(w), 0.0) for m, w in weights.items()}
    mass = sum(clipped.values())
    return {m: (w / mass if mass > 0 else 1.0 / len(clipped)) for m, w in clipped.items()}


def mix(
    scores: DataFrame, weights: Mapping[str, float], strict: bool = True,
    by: str = "method", id: str = "item_id", score: str = "score",
) -> DataFrame:
    """Weighted sum of the methods' scores per item.

    Strict: every method must score the same items, weights are used as given. Otherwise
    a missing score counts as 0, each method is scaled to [0, 1] over all items, and the
    weights are projected to the simplex.
    """
    if strict:
        # A method without a weight has a null product, which the sum leaves out.
        mixed = F.sum(_weight(weights, F.col(by)) * F.col(score))
        return require_aligned(freeze(scores.groupBy(id).agg(mixed.alias("score"), _scored_by(by))))
    weights = simplex(weights)
    wide = align_scores(scores, list(weights), by=by, id=id, score=score)
    limits = wide.agg(
        *[f(m).alias(f"{n}{i}") for i, m in enumerate(weights) for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    total = F.lit(0.0)
    for i, (m, w) in enumerate(weights.items()):
        lo, hi = limits[f"lo{i}"], limits[f"hi{i}"]
        scaled = (F.col(m) - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.5)
        total = total + F.lit(w) * scaled
    return wide.select(id, total.alias("score"))


def top_budget(
    scores: DataFrame, budget: int, by: Sequence[str] = (), id: str = "item_id", score: str = "score"
) -> DataFrame:
    """The ``budget`` best items, ties by lowest id, with ``rank`` from 1."""
    return first_rows(scores, budget, [F.desc(score), F.asc(id)], by)


def rank_all(scores: DataFrame, by: Sequence[str] = (), id: str = "item_id", score: str = "score") -> DataFrame:
    """Every item with its rank by score, ties by lowest id."""
    return row_number(scores, [F.desc(score), F.asc(id)], by)


def nested_budgets(ranking: DataFrame, ks: Sequence[int], t: int) -> DataFrame:
    """One subset per budget k*t; a smaller budget's subset is a prefix of a larger one's."""
    budgets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k * t).cast("long").alias("budget")) for k in ks])
    rows = ranking.filter(F.col("rank") <= max(ks) * t).withColumn("__b", F.explode(budgets))
    return rows.filter(F.col("rank") <= F.col("__b.budget")).select(
        F.col("__b.k").alias("k"), F.col("__b.budget").alias("budget"), *ranking.columns
    )


def order_scores(ranking: DataFrame, mode: str = "budget", size: int | None = None, id: str = "item_id") -> DataFrame:
    """Score from the position: (B - r)/B, 1 - r/(L - 1) or the marginal gain; r counts from 0."""
    r = F.col("rank") - 1
    if mode == "gain":
        return ranking.select(id, F.col("gain").alias("score"))
    length = F.lit(size) if size is not None else ranking.agg(F.count(F.lit(1))).scalar()
    if mode == "budget":
        return ranking.select(id, ((length - r) / length).alias("score"))
    if mode == "unit":
        return ranking.select(id, (1.0 - r / F.greatest(length - 1, F.lit(1))).alias("score"))
    raise ValueError(f"mode must be 'budget', 'unit' or 'gain', not {mode!r}")


def secondary_scores(values: DataFrame, selected: DataFrame, budget: int, id: str = "item_id", value: str = "value") -> DataFrame:
    """Scores of unselected items, scaled to at most 0.5/budget so they sort after the selected."""
    rest = freeze(values.join(selected.select(id), id, "left_anti"))  # the vectors are read once
    top = rest.agg(F.max(value)).scalar()
    scaled = F.when(top > 0, F.col(value) / top * F.lit(0.5 / budget)).otherwise(F.lit(0.0))
    return rest.select(id, scaled.alias("score"))


def full_scores(values: DataFrame, selected: DataFrame, budget: int, id: str = "item_id") -> DataFrame:
    """Selected items scored by order, all others by ``values``; ``selected`` flags them."""
    chosen = order_scores(selected, "budget", budget, id).withColumn("selected", F.lit(True))
    rest = secondary_scores(values, selected, budget, id).withColumn("selected", F.lit(False))
    return chosen.unionByName(rest)
