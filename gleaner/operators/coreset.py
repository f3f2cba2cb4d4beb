"""Greedy selection in rounds: picks of bounded parts first, then an exact greedy over their union.

Greedy over a large pool needs a pass a pick. Here the pool is dealt by a hash of the id into parts
of at most about ``PART_ROWS`` rows; a task picks ``budget`` items of its part by the same rule, and only these
go on (Mirzasoleiman et al., GreeDi, 2013). Rounds are repeated while the union is larger than
``FINAL_ROWS``, then the distributed greedy runs over it. The objective is near that of
greedy over the whole pool, not equal to it; ``objective`` measures both on all rows. A part holds ``budget`` rows
several times over, so every round leaves a fraction of the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.kernels import best_rows, distances, id_values, matrix, nearest_distance, unit_rows
from gleaner.functions.vectors import norm
from gleaner.operators.aggregate import centroid_array
from gleaner.operators.facility import facility_location
from gleaner.operators.greedy import (
    TIE_DECIMALS,
    DistanceSum,
    FarthestFirst,
    LeastAligned,
    MeanMatching,
    Pick,
    Rule,
    RunningRule,
    cached_pool,
    greedy,
    pool_values,
    unit,
)
from gleaner.operators.similarity import max_similarity, with_similarity
from gleaner.session import discard, stored

#: Rows of a part, for rules that compare rows with picks and for those that compare all rows of a part.
PART_ROWS, PART_ROWS_SQUARE = 20_000, 3000
#: Parts hold at least so many times the budget; the last round starts at so many rows.
PART_BUDGETS, FINAL_ROWS = 4, 100_000

Local = Callable[[np.ndarray, np.ndarray, np.ndarray | None, int], np.ndarray]


def _by_rule(make: Callable[[np.ndarray, np.ndarray], Rule], ids: np.ndarray, x: np.ndarray, cap: np.ndarray | None, budget: int) -> np.ndarray:
    """Greedy picks of one part (positions) by a rule; ``make`` may start it with the lowest id."""
    rule = make(ids, x)
    x = rule.prepare(x)
    alive = np.ones(len(ids), dtype=bool)
    out: list[int] = []
    state = None
    if isinstance(rule, RunningRule):
        state = np.full(len(x), rule.blank)
        if rule.picked:
            first = int(np.argmin(ids))
            out, alive[first] = [first], False
            state = rule.fold(state, x, np.stack(rule.picked))
    while len(out) < min(budget, len(ids)):
        value = rule.value(state) if state is not None and rule.picked else rule.scorer()(x)
        score = np.where(alive, np.round(value, TIE_DECIMALS) + 0.0, -np.inf)
        at = int(best_rows(score, ids, 1)[0])
        out.append(at)
        alive[at] = False
        rule.accept(x[at])
        if state is not None:
            state = rule.fold(state, x, x[at : at + 1])
    return np.array(out, dtype=np.int64)


def _by_coverage(ids: np.ndarray, x: np.ndarray, cap: np.ndarray | None, budget: int) -> np.ndarray:
    """Facility location inside a part, lazily: a gain can only fall, so the best fresh one is picked."""
    u = unit_rows(x)
    similar = np.maximum(u @ u.T, 0.0)
    if cap is not None:
        similar = np.minimum(similar, cap[:, None])
    reached = np.zeros(len(ids))
    order = np.argsort(ids, kind="stable")
    heap = [(-g, place, at, 0) for place, (at, g) in enumerate(zip(order.tolist(), similar.sum(axis=0)[order].tolist()))]
    heapq.heapify(heap)
    out: list[int] = []
    while heap and len(out) < budget:
        gain, place, at, step = heapq.heappop(heap)
        if step == len(out):
            out.append(at)
            reached = np.maximum(reached, similar[:, at])
        else:
            heapq.heappush(heap, (-float(np.maximum(similar[:, at] - reached, 0.0).sum()), place, at, len(out)))
    return np.array(out, dtype=np.int64)


def core_set(pool: DataFrame, local: Local, budget: int, part_rows: int, seed: int = 0, cap: str | None = None) -> DataFrame:
    """The rows that ``local`` picks in each part of ``pool(item_id, vec[, cap])``."""
    rows = pool.count()
    parts = max(-(-rows // max(part_rows, PART_BUDGETS * budget)), 1)
    columns = ["item_id", "vec", *([cap] if cap else [])]

    def pick(table: pa.Table) -> pa.Table:
        ids, x = id_values(table.column("item_id")), matrix(table.column("vec"))
        caps = np.asarray(table.column(cap)) if cap else None
        return table.select(columns).take(pa.array(np.sort(local(ids, x, caps, budget))))

    dealt = pool.select(*columns, F.pmod(F.xxhash64(F.lit(seed), "item_id"), F.lit(parts)).alias("__part"))
    return dealt.groupBy("__part").applyInArrow(pick, pool.select(*columns).schema)


def _union(pool: DataFrame, local: Local, budget: int, part_rows: int, final_rows: int, cap: str | None = None) -> tuple[DataFrame, str]:
    """Core-sets of core-sets until few rows are left, written once, with their path."""
    rows, path, number = None, None, 0
    while rows is None or rows > final_rows:
        chosen, new = stored(core_set(pool, local, budget, part_rows, number, cap))
        discard(pool.sparkSession, path)
        left = chosen.count()
        pool, path, number = chosen, new, number + 1
        if rows is not None and left > 0.9 * rows:
            break  # a budget near the pool's size leaves nothing to cut
        rows = left
    return pool, path


def _nearest_first(anchor, ids, x):
    return FarthestFirst(anchor)


def _from_lowest(kind, prepare, ids, x):
    first = prepare(x[np.argmin(ids)][None, :])[0]
    return FarthestFirst(first, prepare, [first]) if kind == "kcenter_pool" else DistanceSum([first], prepare) if kind == "distsum" else LeastAligned([first])


def _mean(target, ids, x):
    return MeanMatching(target, np.inf)


def two_round(
    name: str, pool: DataFrame, budget: int, query: DataFrame | None = None, eta: float = 1.0, part_rows: int | None = None, final_rows: int = FINAL_ROWS,
) -> list[Pick]:
    """Picks of ``kcenter, kcenter_pool, distsum, diversity, herding, craig`` or ``orient`` over core-sets.

    Rules that start from an item start from the lowest id. ``kcenter, herding`` and ``orient`` need ``query(vec)``.
    """
    if name in ("kcenter", "herding", "orient") and query is None:
        raise ValueError(f"{name} needs query")
    spark, path = pool.sparkSession, None
    try:
        if name in ("craig", "orient"):
            cap = None
            if name == "orient":
                caps = with_similarity(pool, query, [max_similarity("cap")], keep=["vec"], eps=1e-12)
                pool, cap = caps.select("item_id", "vec", (F.greatest("cap", F.lit(0.0)) * F.lit(eta)).alias("cap")), "cap"
            union, path = _union(pool, _by_coverage, budget, part_rows or PART_ROWS_SQUARE, final_rows, cap)
            return facility_location(union, budget, cap=cap)
        prepare = unit(1e-8, "max") if name == "diversity" else Rule.prepare
        if name in ("kcenter", "herding"):
            target = centroid_array(query)
            make = partial(_nearest_first if name == "kcenter" else _mean, target)
        else:
            make = partial(_from_lowest, name, prepare)
        union, path = _union(pool, partial(_by_rule, make), budget, part_rows or PART_ROWS, final_rows)
        with cached_pool(union) as data:
            if name == "kcenter":
                return greedy(data, FarthestFirst(target), budget)
            if name == "herding":
                return greedy(data, MeanMatching(target, data.agg(F.max(norm(F.col("vec")))).first()[0] or 0.0), budget)
            row = data.orderBy("item_id").limit(1).first()
            first = prepare(np.array(row["vec"], dtype=np.float64)[None, :])
            rule = _from_lowest(name, prepare, np.array([0]), np.array([row["vec"]], dtype=np.float64))
            return greedy(data, rule, budget, [Pick(row["item_id"], first[0], 0.0)])
    finally:
        discard(spark, path)


def objective(name: str, pool: DataFrame, picks: np.ndarray, query: DataFrame | None = None) -> float:
    """What the picks reach on all rows of ``pool``; ``picks`` are prepared vectors, larger is better.

    Minus the largest distance to a pick (``kcenter*``), the sum of the picks' distances (``distsum``), minus the mean of the picks' absolute
    cosines (``diversity``), minus the distance of the means (``herding``), the sum of the largest cosines (``craig``).
    """
    if name == "distsum":
        return float(distances(picks, picks).sum() / 2)
    if name == "diversity":
        cosines = np.abs(picks @ picks.T)
        return -float((cosines.sum() - np.trace(cosines)) / max(len(picks) * (len(picks) - 1), 1))
    if name == "herding":
        return -float(np.linalg.norm(picks.mean(axis=0) - centroid_array(query)))
    if name == "craig":
        covered = pool_values(pool, lambda x: np.maximum((x @ picks.T).max(axis=1), 0.0), prepare=unit(1e-8, "max"))
        return float(covered.agg(F.sum("value")).first()[0])
    far = pool_values(pool, lambda x: nearest_distance(x, picks))
    return -float(far.agg(F.max("value")).first()[0])
