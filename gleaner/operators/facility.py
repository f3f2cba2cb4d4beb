"""Facility-location greedy over cosine similarities, exact and without the n x n matrix.

The gain of an item is the sum over the pool of what it adds to each row's coverage. The
coverage of a row is rebuilt in the task from the picked vectors, so nothing is stored per
row. Gains only shrink as picks are added, so an old gain bounds a new one: candidates are
re-evaluated in batches, best bound first, until the best fresh gain beats every bound.

The first bound needs no pass over pairs: with S the sum of the unit vectors and G their
second moment, sum_i max(cos_ij, 0) <= (x_j.S + sqrt(n x_j'G x_j)) / 2 by Cauchy-Schwarz.
Candidates are read from the pool in the order of that bound, a block at a time.

Pools of more than two blocks of candidates keep their bounds in files (``gain_bounds``), where they are brought
up to date block of rows by block of rows, only as far as an item may still win.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.kernels import id_values, matrix, packed, row_slices, unit_rows
from gleaner.operators.aggregate import gram_array
from gleaner.operators.gain_bounds import BlockBounds
from gleaner.operators.greedy import Pick, pool_values, scan_top, unit

#: Decimals kept of a gain, a sum over the pool.
GAIN_DECIMALS = 9

#: Candidates read by one pass, and evaluated by one pass: a step starts small and widens
#: for good once a step has needed a second pass.
READ_BLOCK = 8192
EVALUATE_FIRST = 512
EVALUATE_MOST = 8192

#: Vectors of candidates that the driver holds at once, where bounds are kept in files.
REMEMBERED_BYTES = 64 << 20

#: Items that look best on one block of rows, whose gains are taken first.
GUESSES = 256

#: Products of a pass over the pool that cost no more than another rewriting of the bounds.
FEW_PRODUCTS = 1 << 30


@dataclass
class Coverage:
    """What counts as coverage: clipped at 0 or not, and an optional cap column per row."""

    clip: bool = True
    cap: str | None = None

    def similarity(self, x: np.ndarray, points: np.ndarray, cap: np.ndarray | None) -> np.ndarray:
        s = x @ points.T
        if self.clip:
            s = np.maximum(s, 0.0)
        return s if cap is None else np.minimum(s, cap[:, None])

    def reached(self, x: np.ndarray, picked: np.ndarray, cap: np.ndarray | None) -> np.ndarray:
        """Coverage of each row by the picks."""
        if not len(picked):
            return np.zeros(len(x))
        return self.similarity(x, picked, cap).max(axis=1)


def _cap_of(batch, name):
    return np.asarray(batch.column(name), dtype=np.float64) if name else None


def evaluate_gains(
    pool: DataFrame, cover: Coverage, picked: np.ndarray, candidates: np.ndarray, eps: float, vec: str,
    are_packed: bool = False,
) -> np.ndarray:
    """Gain of each candidate: one pass over the pool, one small aggregation.

    ``are_packed`` tells that ``vec`` holds packed unit vectors.
    """

    def gains(batches):
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = packed(batch.column(vec), np.float64) if are_packed else unit_rows(matrix(batch.column(vec)), eps)
            cap = _cap_of(batch, cover.cap)
            out = np.zeros(len(candidates)) if out is None else out
            for rows in row_slices(len(x)):
                c = cap[rows] if cap is not None else None
                base = cover.reached(x[rows], picked, c)[:, None]
                for cols in row_slices(len(candidates)):
                    new = x[rows] @ candidates[cols].T
                    if c is not None:
                        np.minimum(new, c[:, None], out=new)
                    new -= base  # where coverage is clipped, base is 0 at least and clips as well
                    out[cols] += np.maximum(new, 0.0, out=new).sum(axis=0)
        if out is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "gain"]
            )

    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("gain", T.DoubleType())])
    columns = [vec, *([cover.cap] if cover.cap else [])]
    found = pool.select(*columns).mapInArrow(gains, schema).groupBy("at").agg(F.sum("gain").alias("gain"))
    table = found.toArrow()
    out = np.zeros(len(candidates))
    out[np.asarray(table.column("at"))] = np.asarray(table.column("gain"))
    return np.round(out, GAIN_DECIMALS) + 0.0


def first_bound(pool: DataFrame, offset: float, eps: float, vec: str):
    """Pool size and a function giving an upper bound of an item's first gain from its unit vector.

    One pass gathers n, S and G as the second moment of the unit vectors extended by a 1.
    """

    def extended(x):
        return np.hstack([unit_rows(x, eps), np.ones((len(x), 1))])

    moment = gram_array(pool, vec, extended)
    square, total, n = moment[:-1, :-1], moment[-1, :-1], moment[-1, -1]

    def bound(x):
        out = np.empty(len(x))
        for rows in row_slices(len(x)):
            part = x[rows]
            spread = np.sqrt(np.maximum(n * np.einsum("ij,ij->i", part @ square, part), 0.0))
            out[rows] = (part @ total + spread) / 2.0
        return np.round(out * (1 + 1e-9) + offset + 1e-9, 6)

    return round(n), bound


class _Candidates:
    """Items read so far with the best known bound of their gain and whether it is exact now."""

    def __init__(self, pool, bound_of, eps, id, vec):
        self.pool, self.bound_of = pool, bound_of
        self.eps, self.id, self.vec = eps, id, vec
        self.ids, self.x = None, None
        self.bound, self.fresh = np.zeros(0), np.zeros(0, dtype=bool)
        self.cursor = None
        self.ceiling = np.inf  # bound of the best item not read yet

    def next_step(self):
        self.fresh[:] = False

    def read(self, taken):
        """Add the next block of items in the order of the first bound."""
        table, complete = scan_top(
            self.pool, self.bound_of, READ_BLOCK, taken, unit(self.eps, "max"), self.id, self.vec, self.cursor
        )
        if not table.num_rows:
            self.ceiling = -np.inf
            return
        ids, bound = id_values(table.column(self.id)), np.asarray(table.column("score")).copy()
        self.cursor = float(bound[-1]), ids[-1].item()
        self.ceiling = -np.inf if complete else float(bound[-1])
        x = unit_rows(matrix(table.column(self.vec)), self.eps)
        if self.ids is not None:
            ids, bound, x = (
                np.concatenate([self.ids, ids]),
                np.concatenate([self.bound, bound]),
                np.concatenate([self.x, x]),
            )
        fresh = np.concatenate([self.fresh, np.zeros(len(ids) - len(self.fresh), dtype=bool)])
        self.ids, self.bound, self.x, self.fresh = ids, bound, x, fresh

    def remove(self, at):
        keep = np.arange(len(self.ids)) != at
        self.ids, self.x, self.bound, self.fresh = self.ids[keep], self.x[keep], self.bound[keep], self.fresh[keep]


def facility_location(
    pool: DataFrame,
    budget: int,
    *,
    cap: str | None = None,
    first=None,
    leave: int | None = None,
    stop_if_negative: bool = False,
    eps: float = 1e-8,
    id: str = "item_id",
    vec: str = "vec",
    remembered_bytes: int = REMEMBERED_BYTES,
) -> list[Pick]:
    """Greedy picks with marginal gains; ``pool`` should be cached, each evaluation reads it.

    Coverage is max(cos, 0), capped per row by the column ``cap`` when given. With ``first``
    that item is picked before the loop and negative cosines count: a row's gain is then at
    most max(cos, 0) plus what the first pick left negative, so the bounds rise by the sum
    of the latter. ``leave`` items of the pool stay unpicked.
    """
    cover = Coverage(first is None, cap)
    picks: list[Pick] = []
    offset = 0.0
    if first is not None:
        start = unit_rows(pool_vector(pool, first, id, vec)[None, :], eps)
        cos = pool_values(pool, lambda x: (x @ start.T)[:, 0], "cos", lambda x: unit_rows(x, eps), id, vec)
        sums = cos.agg(F.sum("cos").alias("all"), F.sum(F.least("cos", F.lit(0.0))).alias("below")).first()
        offset = -sums["below"]
        picks.append(Pick(first, start[0], round(sums["all"], GAIN_DECIMALS)))
    n, bound_of = first_bound(pool, offset, eps, vec)
    budget = min(budget, n if leave is None else n - leave)
    if n > 2 * READ_BLOCK:
        return _pick_in_blocks(pool, n, cover, picks, budget, stop_if_negative, eps, id, vec, remembered_bytes)
    seen = _Candidates(pool, bound_of, eps, id, vec)
    seen.read([p.item for p in picks])
    width = EVALUATE_FIRST
    while len(picks) < budget:
        picked = np.stack([p.vec for p in picks]) if picks else np.zeros((0, 1))
        seen.next_step()
        size = width
        while True:
            best = seen.bound[seen.fresh].max() if seen.fresh.any() else -np.inf
            stale = np.flatnonzero(~seen.fresh & (seen.bound >= best))
            if len(stale):
                order = np.lexsort((seen.ids[stale], -seen.bound[stale]))
                batch = stale[order][:size]
                seen.bound[batch] = evaluate_gains(pool, cover, picked, seen.x[batch], eps, vec)
                seen.fresh[batch] = True
                if size == EVALUATE_MOST:
                    width = EVALUATE_MOST
                size = EVALUATE_MOST
            elif seen.ceiling >= best and seen.ceiling > -np.inf:
                seen.read([p.item for p in picks])
            else:
                break
        if not seen.fresh.any():
            break
        at = np.lexsort((seen.ids, -np.where(seen.fresh, seen.bound, -np.inf)))[0]
        if stop_if_negative and seen.bound[at] < 0:
            break
        picks.append(Pick(seen.ids[at].item(), seen.x[at], float(seen.bound[at])))
        seen.remove(at)
    return picks


def _pick_in_blocks(pool, n, cover, picks, budget, stop_if_negative, eps, id, vec, remembered_bytes):
    """The same picks where bounds are kept in files.

    Of each step's bounds one block is refreshed for all items. Exact gains of the items that look best there give
    a gain to beat; the other blocks are refreshed for items whose bound is not below it, and what is left of them
    is evaluated.
    """
    width = pool.select(F.size(vec)).first()[0]
    most = max(1, min(EVALUATE_MOST, remembered_bytes // (8 * width)))
    few = min(most, max(EVALUATE_FIRST, FEW_PRODUCTS // n))
    kept = replace(cover, cap="cap" if cover.cap else None)

    def picked():
        return np.stack([p.vec for p in picks]) if picks else np.zeros((0, width))

    bounds = BlockBounds(pool, n, width, cover, picked(), eps, id, vec)
    try:
        while len(picks) < budget:
            points, taken = picked(), [p.item for p in picks]
            best = -np.inf, None, None

            def evaluate(found):
                ids, x, place = found
                gain = evaluate_gains(bounds.state, kept, points, x, eps, "x", are_packed=True)
                at = np.lexsort((ids, -gain))[0]
                if best[1] is None or gain[at] > best[0] or (gain[at] == best[0] and ids[at] < best[1]):
                    return (gain[at], ids[at], x[at]), place
                return best, place

            bounds.refresh(bounds.groups[0][:1], points, -np.inf)
            found = bounds.read(taken, -np.inf, min(GUESSES, most), "latest")
            if found is None:
                break
            best, _ = evaluate(found)
            for group in list(bounds.groups):
                if bounds.count(taken, best[0]) <= few:
                    break
                bounds.refresh(group, points, best[0])
                bounds.used(group)
            place = None
            while (found := bounds.read(taken, best[0], most, after=place)) is not None:
                best, place = evaluate(found)
            if stop_if_negative and best[0] < 0:
                break
            picks.append(Pick(best[1].item(), best[2], float(best[0])))
    finally:
        bounds.close()
    return picks


def pool_vector(pool: DataFrame, item, id: str, vec: str) -> np.ndarray:
    row = pool.filter(F.col(id) == F.lit(item)).select(vec).first()
    if row is None:
        raise ValueError(f"item {item!r} is not in the pool")
    return np.array(row[vec], dtype=np.float64)
