"""Distributed greedy ranking: one pass over the pool yields as many picks as can be proven.

A pass returns the best few hundred items under the current score and the score of the
best item left outside (``tau``). The driver goes on picking among those candidates as long
as the best one beats every score an outside item can have reached since the pass, which a
rule bounds by ``slack``. The result is the same as a pass per pick. The pool itself never
leaves the executors. Rules that compare an item with every pick keep one number an item, the
running minimum or sum over the picks so far: it is written with the pool after every
``STORE_EVERY`` picks, so a pass looks at the picks since then only and k picks cost k times the pool,
not k * k / 2 times. Between two writings a task rebuilds what it needs from the picked vectors, so an
executor's loss costs nothing but its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.kernels import (
    best_rows,
    distances,
    id_values,
    matrix,
    nearest_distance,
    row_slices,
    unit_rows,
    vector_array,
)
from gleaner.session import discard, stored

#: Decimals kept before scores are compared, so that equal values tie in any engine.
TIE_DECIMALS = 12

#: Candidates brought back by one pass, and the bytes their vectors may take.
CANDIDATES = 4096
CANDIDATE_BYTES = 32 << 20

#: Fewest candidates of a pass by a rule whose bound may allow more than one pick; passes that yield one pick shrink to it.
FEWEST = 64

#: Picks after which the running state is written with the pool.
STORE_EVERY = 64
STATE = "__state"

Scorer = Callable[[np.ndarray], np.ndarray]


@dataclass
class Pick:
    item: object
    vec: np.ndarray
    gain: float


def identity(x: np.ndarray) -> np.ndarray:
    return x


def unit(eps: float, mode: str) -> Scorer:
    return lambda x: unit_rows(x, eps, mode)


class Rule:
    """Score of an item given the picks so far; higher is better.

    Vectors are passed through ``prepare`` first, in tasks and on the driver alike.
    """

    prepare: Scorer = staticmethod(identity)
    #: Whether ``slack`` is ever finite; without a bound a pass yields one pick.
    bounded = True

    def scorer(self) -> Scorer:
        raise NotImplementedError

    def accept(self, vec: np.ndarray) -> None:
        raise NotImplementedError

    def mark(self) -> None:
        """Remember the state a pass was run with."""

    def slack(self) -> float:
        """How much any outside score may have risen since ``mark``."""
        return np.inf

    def gain(self, vec: np.ndarray, score: float) -> float:
        return score


class RunningRule(Rule):
    """A rule whose score follows from one number an item, folded over the picks.

    ``picked`` are all picks; those before ``kept`` are in the stored number.
    """

    blank = 0.0
    kept = 0

    def fold(self, state: np.ndarray, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def value(self, state: np.ndarray) -> np.ndarray:
        return state

    def scorer(self, kept: int = 0):
        """Score from a batch and its state that holds the first ``kept`` picks."""
        points = np.stack(self.picked[kept:]) if len(self.picked) > kept else None

        def score(x, state=None):
            held = np.full(len(x), self.blank) if state is None else state
            return self.value(held if points is None else self.fold(held, x, points))

        return score

    def accept(self, vec):
        self.picked.append(vec)


@dataclass
class FarthestFirst(RunningRule):
    """Distance to the nearest pick; the first pick is the item nearest ``anchor``."""

    anchor: np.ndarray
    prepare: Scorer = identity
    picked: list = field(default_factory=list)
    _seen: int = 0

    blank = np.inf

    def fold(self, state, x, points):
        return np.minimum(state, nearest_distance(x, points))

    def scorer(self, kept=0):
        if not self.picked:
            anchor = self.anchor[None, :]
            return lambda x, state=None: -nearest_distance(x, anchor)
        return super().scorer(kept)

    def mark(self):
        self._seen = len(self.picked)

    def slack(self):
        return 0.0 if self._seen else np.inf  # distances to the picks only shrink


@dataclass
class DistanceSum(RunningRule):
    """Sum of the distances to all picks."""

    picked: list
    prepare: Scorer = identity
    bounded = False

    def fold(self, state, x, points):
        out = np.array(state, dtype=np.float64)
        for rows in row_slices(len(x)):
            # One pick after the other, so that the sum doesn't depend on where the state was written.
            for column in distances(x[rows], points).T:
                out[rows] += column
        return out


@dataclass
class LeastAligned(RunningRule):
    """The smallest absolute cosine to any pick; the smallest wins."""

    picked: list
    prepare: Scorer = field(default_factory=lambda: unit(1e-8, "max"))
    blank = np.inf
    bounded = False

    def fold(self, state, x, points):
        return np.minimum(state, np.abs(x @ points.T).min(axis=1))

    def value(self, state):
        return -state

    def gain(self, vec, score):
        return -score


@dataclass
class MeanMatching(Rule):
    """The item that brings the mean of the picks nearest to ``target``.

    |S + v - t m|^2 differs from |v|^2 + 2 v (S - t m) only by a constant of the step.
    """

    target: np.ndarray
    max_norm: float = np.inf

    def __post_init__(self):
        self.sum = np.zeros_like(self.target)
        self.count = 0

    def offset(self):
        return self.sum - (self.count + 1) * self.target

    def scorer(self):
        offset = self.offset()
        return lambda x: -(np.einsum("ij,ij->i", x, x) + 2.0 * (x @ offset))

    def mark(self):
        self._marked = self.offset()

    def slack(self):
        """By Cauchy-Schwarz: a score moves by at most twice the offset's move times the item's length."""
        moved = float(np.linalg.norm(self.offset() - self._marked))
        return 2.0 * moved * self.max_norm if moved else 0.0

    def accept(self, vec):
        self.sum = self.sum + vec
        self.count += 1

    def gain(self, vec, score):
        return float(np.linalg.norm((self.sum + vec) / (self.count + 1) - self.target))


@dataclass
class ResidualMatching(Rule):
    """Inner product with a residual that each pick updates through ``refit``.

    ``refit(picked vectors) -> (direction to score with, weights of the picks)``.
    An outside score moves by at most |change of direction| * largest vector length.
    """

    direction: np.ndarray
    refit: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]
    prepare: Scorer = identity
    max_norm: float = 1.0
    picked: list = field(default_factory=list)
    weights: np.ndarray | None = None

    def scorer(self):
        direction = self.direction
        return lambda x: x @ direction

    def accept(self, vec):
        self.picked.append(vec)
        self.direction, self.weights = self.refit(self.picked)

    def mark(self):
        self._marked = self.direction

    def slack(self):
        return float(np.linalg.norm(self.direction - self._marked)) * self.max_norm


def scan_top(
    pool: DataFrame, scorer: Scorer, limit: int, exclude: Sequence, prepare: Scorer, id: str, vec: str,
    after: tuple | None = None, state: str | None = None,
) -> tuple[pa.Table, bool]:
    """The first items (id, score, vec) by score descending and id, and whether that is all of them.

    A task sends its share of ``limit`` with some room, not ``limit`` rows, so that what
    meets in the last step stays small on many tasks. The last row of a task that holds
    back more is marked: everything it kept comes later in the order, so the list is cut
    behind the first marked row and is always a true beginning of the order.
    ``after = (score, id)`` continues behind that item.
    """
    banned = np.asarray(list(exclude))
    tasks = pool.sparkSession.sparkContext.defaultParallelism
    share = min(limit, max(16, -(-4 * limit // tasks)))

    def best_of_task(batches):
        held, more = None, False
        for batch in batches:
            x = matrix(batch.column(vec))
            if not len(x):
                continue
            ids = id_values(batch.column(id))
            held_state = np.asarray(batch.column(state)) if state else None
            if len(banned):
                keep = ~np.isin(ids, banned)
                x, ids = x[keep], ids[keep]
                held_state = held_state[keep] if state else None
                if not len(x):
                    continue
            found = scorer(prepare(x), held_state) if state else scorer(prepare(x))
            score = np.round(found, TIE_DECIMALS) + 0.0
            if after is not None:
                later = (score < after[0]) | ((score == after[0]) & (ids > after[1]))
                ids, score, x = ids[later], score[later], x[later]
                if not len(x):
                    continue
            if held is not None:
                ids, score, x = (
                    np.concatenate([held[0], ids]),
                    np.concatenate([held[1], score]),
                    np.concatenate([held[2], x]),
                )
            best = best_rows(score, ids, share)
            more = more or len(ids) > len(best)
            held = ids[best], score[best], x[best]
        if held is not None:
            edge = np.zeros(len(held[0]), dtype=bool)
            edge[-1] = more
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0]), pa.array(held[1]), pa.array(edge), vector_array(held[2])],
                names=[id, "score", "edge", vec],
            )

    schema = T.StructType([
        pool.schema[id],
        T.StructField("score", T.DoubleType()),
        T.StructField("edge", T.BooleanType()),
        T.StructField(vec, T.ArrayType(T.DoubleType())),
    ])
    found = pool.select(id, vec, *([state] if state else [])).mapInArrow(best_of_task, schema)
    table = found.orderBy(F.desc("score"), F.asc(id)).limit(limit + 1).toArrow()
    edges = np.flatnonzero(np.asarray(table.column("edge"))) if table.num_rows else []
    complete = not len(edges) and table.num_rows <= limit
    keep = min(limit, int(edges[0]) + 1 if len(edges) else limit)
    return table.slice(0, keep), complete


def greedy(
    pool: DataFrame,
    rule: Rule,
    budget: int,
    start: Sequence[Pick] = (),
    *,
    id: str = "item_id",
    vec: str = "vec",
    candidates: int = CANDIDATES,
) -> list[Pick]:
    """``budget`` picks in order (fewer when the pool ends); ``start`` counts as picked."""
    spark = pool.sparkSession
    picks = list(start)
    limit = candidates
    running = isinstance(rule, RunningRule)
    data, kept, path = pool, 0, None
    rows = None
    while len(picks) < budget:
        if running and len(rule.picked) - kept >= STORE_EVERY:
            data, kept, path = _with_state(data, rule, kept, path, id, vec)
        rule.mark()
        scorer = rule.scorer(kept) if running else rule.scorer()
        found, complete = scan_top(
            data, scorer, limit, [p.item for p in picks], rule.prepare, id, vec, state=STATE if kept else None
        )
        if not found.num_rows:
            break
        ids = id_values(found.column(id))
        raw = matrix(found.column(vec))
        most = max(1, min(candidates, CANDIDATE_BYTES // (8 * raw.shape[1])))
        limit, before = min(limit, most), len(picks)
        tau = -np.inf if complete else float(found.column("score")[-1].as_py())
        x = rule.prepare(raw)
        alive = np.ones(len(ids), dtype=bool)
        first = True
        # On the driver the candidates' own numbers are kept up to date pick by pick.
        state = rule.fold(np.full(len(x), rule.blank), x, np.stack(rule.picked)) if running and rule.picked else None
        while len(picks) < budget and alive.any():
            value = rule.value(state) if state is not None else rule.scorer()(x)
            score = np.where(alive, np.round(value, TIE_DECIMALS) + 0.0, -np.inf)
            at = best_rows(score, ids, 1)[0]
            if not first and not complete and not score[at] > tau + rule.slack():
                break
            picks.append(Pick(ids[at].item(), x[at], rule.gain(x[at], float(score[at]))))
            alive[at] = False
            rule.accept(x[at])
            if running:
                state = rule.fold(state if state is not None else np.full(len(x), rule.blank), x, x[at : at + 1])
            if first and not complete and rule.slack() == np.inf:
                break
            first = False
        if complete:
            limit = most
            continue
        # No more candidates are sent than a pass can make use of, until all that are left can be sent.
        rows = data.count() if rows is None else rows
        if rows - len(picks) <= most:
            limit = most
        elif not rule.bounded:
            limit = 1
        elif len(picks) - before > 1:
            limit = min(most, 8 * limit)
        elif rule.slack() < np.inf:
            limit = min(most, max(FEWEST, limit // 8))
    discard(spark, path)
    return picks


def _with_state(data: DataFrame, rule: RunningRule, kept: int, old: str | None, id: str, vec: str) -> tuple[DataFrame, int, str]:
    """The pool with the running number over all picks so far, written once."""
    points = np.stack(rule.picked[kept:])
    has = STATE in data.columns

    def fold(batches):
        for batch in batches:
            x = matrix(batch.column(vec))
            if len(x):
                held = np.asarray(batch.column(STATE)) if has else np.full(len(x), rule.blank)
                out = rule.fold(held, rule.prepare(x), points)
                yield pa.RecordBatch.from_arrays([batch.column(id), batch.column(vec), pa.array(out)], names=[id, vec, STATE])

    schema = T.StructType([data.schema[id], data.schema[vec], T.StructField(STATE, T.DoubleType())])
    written, path = stored(data.select(id, vec, *([STATE] if has else [])).mapInArrow(fold, schema))
    discard(data.sparkSession, old)
    return written, len(rule.picked), path


class cached_pool:
    """Keep the pool on the executors (memory, then their disks) while a loop runs."""

    def __init__(self, pool: DataFrame, id: str = "item_id", vec: str = "vec"):
        self.pool = pool.select(id, F.col(vec).cast("array<double>").alias(vec))

    def __enter__(self) -> DataFrame:
        self.pool.persist(StorageLevel.MEMORY_AND_DISK)
        return self.pool

    def __exit__(self, *exc):
        self.pool.unpersist()


def pool_values(
    pool: DataFrame, value: Scorer, name: str = "value", prepare: Scorer = identity, id: str = "item_id", vec: str = "vec"
) -> DataFrame:
    """One number per pool item from its vector: a map without shuffle."""

    def evaluate(batches):
        for batch in batches:
            x = matrix(batch.column(vec))
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id), pa.array(np.asarray(value(prepare(x)), dtype=np.float64))], names=[id, name]
                )

    schema = T.StructType([pool.schema[id], T.StructField(name, T.DoubleType())])
    return pool.select(id, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(evaluate, schema)
