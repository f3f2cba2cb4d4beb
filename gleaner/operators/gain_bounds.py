"""Upper bounds of facility-location gains for pools that the driver can't remember.

The bound of an item's gain is a sum over blocks of rows. Each part was once the gain over its block, and the
step at which it was is kept with it, so a refresh looks only at the rows that later picks cover better:
the gain has fallen by what lies between the two coverages. Items whose bound falls below a gain that is known
are left where they are, and their other blocks aren't looked at. The items with their bounds are files that a
pass rewrites; blocks of rows are shipped to the tasks, as many at once as fit the bound of a broadcast.

Parts are sums in single precision with the largest error that its rounding allows added, so they are true
bounds: only exact gains, taken of the few items whose bound stays above, decide.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.kernels import SLICE_ROWS, id_values, matrix, packed, packed_array, row_slices, unit_rows
from gleaner.session import BROADCAST_BYTES, discard, stored

#: Blocks of rows, each a part of the bound; more where a block would pass half of a broadcast.
BLOCKS = 16

#: Points of a slice of products.
SLICE_POINTS = 256

#: Half a unit in the last place of a single, and what the sum of a slice may lose by rounding.
ROUNDING = 2.0**-24
SUM_ERROR = 1.05 * SLICE_ROWS * ROUNDING

#: Items of a task at least, as long as there are fewer tasks than cores can use.
TASK_ROWS = 1024

_INDEX_BITS = 33


def clipped_sums(x: np.ndarray, low: np.ndarray, high: np.ndarray | None, points: np.ndarray) -> np.ndarray:
    """Sum over the rows of min(max(cos, low), high) - low for each point, in single precision."""
    out, ones = np.zeros(len(points)), np.ones(SLICE_ROWS, dtype=np.float32)
    left = np.hstack([x, -low[:, None]], dtype=np.float32)
    right = np.hstack([points, np.ones((len(points), 1))], dtype=np.float32)
    # Whole slices of limits: NumPy compares with a number or a column several times slower.
    space, zeros, room = (np.zeros(SLICE_ROWS * SLICE_POINTS, dtype=np.float32) for _ in range(3))
    for rows in row_slices(len(x)):
        n = rows.stop - rows.start
        if high is not None:
            room.reshape(SLICE_ROWS, SLICE_POINTS)[:n] = (high[rows] - low[rows])[:, None]
        for cols in row_slices(len(points), SLICE_POINTS):
            k = cols.stop - cols.start
            s = np.matmul(left[rows], right[cols].T, out=space[: n * k].reshape(n, k))
            np.maximum(s, zeros[: n * k].reshape(n, k), out=s)
            if high is not None:
                np.minimum(s, room.reshape(SLICE_ROWS, SLICE_POINTS)[:n, :k], out=s)
            out[cols] += ones[:n] @ s
    return out


def row_error(width: int) -> float:
    """How far one row's share in ``clipped_sums`` may be off: the product with the coverage, and both coverages."""
    return (2 * width + 16) * ROUNDING


class _Block:
    """Rows of a block on a task, and their coverage by the first picks."""

    def __init__(self, rows, cover, picked):
        self.x, self.cap = rows
        self.cover, self.picked = cover, picked
        self.reached = lru_cache(4)(self._reached)

    def _reached(self, count):
        out = np.empty(len(self.x))
        for rows in row_slices(len(self.x)):
            cap = None if self.cap is None else self.cap[rows].astype(np.float64)
            out[rows] = self.cover.reached(self.x[rows].astype(np.float64), self.picked[:count], cap)
        return out

    def refreshed(self, points, part, stage):
        """Parts of items that all hold the gain as it was after ``stage`` picks (-1: never)."""
        now = self.reached(len(self.picked))
        error = row_error(self.x.shape[1])
        if stage >= 0:
            then = self.reached(stage)
            better = np.flatnonzero(now > then)
            if 4 * len(better) < 3 * len(now):
                lost = clipped_sums(self.x[better], then[better], now[better], points)
                return np.maximum(part - np.maximum(lost * (1 - SUM_ERROR) - error * len(better), 0.0), 0.0)
        if self.cap is None:
            found = clipped_sums(self.x, now, None, points)
        else:
            open_ = np.flatnonzero(self.cap > now)
            found = clipped_sums(self.x[open_], now[open_], self.cap[open_], points)
        return np.minimum(part, found * (1 + SUM_ERROR) + error * len(now))


def _moments(x, reached):
    """Second moment of the rows extended by their coverage and a 1."""
    rows = np.hstack([x.astype(np.float64), reached[:, None], np.ones((len(x), 1))])
    return rows.T @ rows


def _first_parts(x, moments):
    """sum max(u, 0) <= (sum u + sqrt(n sum u^2)) / 2 for u = cos - coverage, by Cauchy-Schwarz."""
    points = np.hstack([x, np.full((len(x), 1), -1.0)])
    out = np.empty((len(x), len(moments)))
    for at, m in enumerate(moments):
        n = m[-1, -1]
        spread = np.sqrt(np.maximum(n * np.einsum("ij,ij->i", points @ m[:-1, :-1], points), 0.0))
        out[:, at] = (points @ m[:-1, -1] + spread) / 2.0 * (1 + 1e-9) + row_error(x.shape[1]) * n
    return np.maximum(out, 0.0)


class BlockBounds:
    """The items of a pool as unit vectors with the parts of their bounds, in files."""

    def __init__(self, pool: DataFrame, n: int, width: int, cover, picked: np.ndarray, eps: float, id: str, vec: str):
        self.spark, self.cover, self.id, self.width = pool.sparkSession, cover, id, width
        size = 4 * (width + 1)
        self.blocks = max(BLOCKS, -(-2 * n * size // BROADCAST_BYTES))
        most = max(1, BROADCAST_BYTES // (-(-n // self.blocks) * size))
        #: Blocks that are shipped together; groups that were refreshed go to the end.
        self.groups = [list(range(b, min(b + most, self.blocks))) for b in range(0, self.blocks, most)]
        self.shipped, self.shipped_group = None, None
        self.state, self.path = stored(self._spread(pool, n, eps, vec))
        moments = []
        for group in self.groups:
            rows = self._rows(group)
            for b in group:
                block = _Block(rows[b], cover, picked)
                moments.append(_moments(block.x, block.reached(len(picked))))
        self._replace(self._started(moments))

    def _columns(self):
        cap = [T.StructField("cap", T.DoubleType())] if self.cover.cap else []
        return [
            self.id_field, T.StructField("row", T.LongType()), T.StructField("block", T.IntegerType()), *cap,
            T.StructField("x", T.BinaryType()),
        ]

    def _spread(self, pool, n, eps, vec):
        """Equal shares of the items, dealt over the blocks in turn; files fix which is where."""
        self.id_field = pool.schema[self.id]
        blocks, name, cap, id = self.blocks, vec, self.cover.cap, self.id
        tasks = min(4 * self.spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
        columns = self._columns()

        def spread(batches):
            part, done = TaskContext.get().partitionId(), 0
            for batch in batches:
                x = matrix(batch.column(name))
                if not len(x):
                    continue
                index = np.arange(done, done + len(x))
                done += len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id), pa.array((part << _INDEX_BITS) + index),
                        pa.array(((part + index) % blocks).astype(np.int32)), *([batch.column(cap)] if cap else []),
                        packed_array(unit_rows(x, eps)),
                    ],
                    names=[c.name for c in columns],
                )

        return pool.select(id, vec, *([cap] if cap else [])).repartition(tasks).mapInArrow(spread, T.StructType(columns))

    def _rows(self, group):
        """Rows of the group's blocks on the driver, in single precision."""
        cap = self.cover.cap

        def single(batches):
            for batch in batches:
                x = packed_array(packed(batch.column("x"), np.float64).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column("block"), x, *batch.columns[2:]], names=batch.schema.names)

        kept = self.state.filter(F.col("block").isin(group)).select("block", "x", *(["cap"] if cap else []))
        table = kept.mapInArrow(single, kept.schema).toArrow().combine_chunks()
        at = np.asarray(table.column("block"))
        x = packed(table.column("x"), np.float32).reshape(len(at), self.width)
        caps = np.asarray(table.column("cap"), dtype=np.float64) if cap else None
        return {b: (x[at == b], caps[at == b] if cap else None) for b in group}

    def _ship(self, group):
        if self.shipped_group != group:
            self._unship()
            self.shipped, self.shipped_group = self.spark.sparkContext.broadcast(self._rows(group)), group
        return self.shipped

    def _unship(self):
        if self.shipped is not None:
            self.shipped.destroy()
        self.shipped, self.shipped_group = None, None

    def _bound_columns(self):
        return T.StructType([
            *self._columns(), T.StructField("parts", T.BinaryType()), T.StructField("stage", T.BinaryType()),
            T.StructField("bound", T.DoubleType()), T.StructField("latest", T.DoubleType()),
        ])

    def _replace(self, state):
        old = self.path
        self.state, self.path = stored(state)
        discard(self.spark, old)

    def _started(self, moments):
        columns = self._bound_columns()

        def start(batches):
            for batch in batches:
                if batch.num_rows:
                    parts = _first_parts(packed(batch.column("x"), np.float64), moments)
                    stage = np.full(parts.shape, -1, dtype=np.int32)
                    yield _with_bounds(batch.columns, parts, stage, parts[:, 0], columns.names)

        return self.state.mapInArrow(start, columns)

    def refresh(self, blocks: list[int], picked: np.ndarray, least: float) -> None:
        """Bring the parts of these blocks, all of one group, up to date where the bound is ``least`` or more."""
        group = next(g for g in self.groups if blocks[0] in g)
        shipped, cover, columns = self._ship(group), self.cover, self._bound_columns()

        def refreshed(batches):
            held = {b: _Block(shipped.value[b], cover, picked) for b in blocks}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = packed(batch.column("x"), np.float64).astype(np.float32)
                parts = packed(batch.column("parts"), np.float64).copy()
                stage = packed(batch.column("stage"), np.int32).copy()
                alive = np.flatnonzero(parts.sum(axis=1) >= least)
                # The blocks that hold most of the bounds first: they are the longest out of date.
                for b in sorted(blocks, key=lambda b: -parts[alive, b].sum()):
                    for old in np.unique(stage[alive, b]):
                        at = alive[stage[alive, b] == old]
                        if old < len(picked):
                            parts[at, b] = held[b].refreshed(x[at], parts[at, b], int(old))
                            stage[at, b] = len(picked)
                    alive = alive[parts[alive].sum(axis=1) >= least]
                    if not len(alive):
                        break
                kept = [batch.column(c) for c in columns.names[: -4]]
                yield _with_bounds(kept, parts, stage, parts[:, blocks[0]], columns.names)

        self._replace(self.state.mapInArrow(refreshed, columns))

    def _open(self, taken, least):
        return self.state.filter(F.col(self.id).isNotNull() & ~F.col(self.id).isin(taken) & (F.col("bound") >= least))

    def count(self, taken, least: float) -> int:
        return self._open(taken, least).count()

    def read(self, taken, least: float, limit: int, by: str = "bound", after: tuple | None = None):
        """Ids, vectors and the last row's place of the next items in the order of ``by``."""
        found = self._open(taken, least)
        if after is not None:
            found = found.filter((F.col(by) < after[0]) | ((F.col(by) == after[0]) & (F.col("row") > after[1])))
        table = found.select(self.id, "x", by, "row").orderBy(F.desc(by), F.asc("row")).limit(limit).toArrow().combine_chunks()
        if not table.num_rows:
            return None
        place = table.column(by)[-1].as_py(), table.column("row")[-1].as_py()
        return id_values(table.column(self.id)), packed(table.column("x"), np.float64), place

    def used(self, group: list[int]) -> None:
        self.groups.remove(group)
        self.groups.append(group)

    def close(self) -> None:
        self._unship()
        discard(self.spark, self.path)


def _with_bounds(kept, parts, stage, latest, names):
    bound = parts.sum(axis=1)
    return pa.RecordBatch.from_arrays(
        [*kept, packed_array(parts), packed_array(stage), pa.array(bound), pa.array(np.ascontiguousarray(latest))], names=names
    )
