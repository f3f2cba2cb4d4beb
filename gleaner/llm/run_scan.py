"""Periodic runs of words: a suffix automaton whose suffix-link tree is a link-cut tree.

A run is a stretch of consecutive words with smallest period q, as long as max(6, 4 q) at least,
that no neighbouring word extends. Words are appended one by one to a suffix automaton. Every
preferred path of the link-cut tree holds states with one last occurrence, its colour. Appending
word i recolours the path from the new state to the root: where it leaves a path of colour e at a
state of length L, the last L words also ended at e, so the distance i - e <= L gives a square, and
the words from e - L + 1 to i are as far as its period reaches to the left. The last i with the same
start and distance is the run's end. All recolourings are O(n log n) amortised.

Most texts have no run. In a run of period q all but the first q of its windows of three words have an equal
window at most q before them, in a row of max(3, 3 q - 2) or more; only stretches around such rows are given to the
automaton. Every run lies in one of them as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.text import Words, pieces, window_hashes

#: A run is this long at least, in words and in periods (fixed by what a run is).
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of a window of the search for stretches.
WINDOW = 3
SPACE = r"[\x20\x09-\x0D]+"

Run = tuple[int, int, int]  # start, length, period


class SuffixRuns:
    """Runs of a sequence of word codes; ``append`` takes the next one."""

    def __init__(self) -> None:
        # State 0 stands for "none", state 1 is the root. Most states have one way on: ``code`` and ``to``; others are in ``more``.
        self.length, self.link = [0, 0], [0, 0]
        self.code, self.to = [-1, -1], [0, 0]
        self.more: dict[int, dict[int, int]] = {}
        # Splay trees of the preferred paths; the colour of a path stands at its tree's root.
        self.up, self.left, self.right, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last = 1
        self.n = 0
        self.ends: dict[tuple[int, int], int] = {}

    def _state(self, length: int) -> int:
        self.length.append(length)
        for column, value in ((self.link, 0), (self.code, -1), (self.to, 0), (self.up, 0), (self.left, 0), (self.right, 0), (self.colour, -1)):
            column.append(value)
        return len(self.length) - 1

    def _next(self, state: int, code: int) -> int:
        if self.code[state] == code:
            return self.to[state]
        ways = self.more.get(state)
        return ways.get(code, 0) if ways else 0

    def _set(self, state: int, code: int, to: int) -> None:
        if self.code[state] in (-1, code):
            self.code[state], self.to[state] = code, to
        else:
            self.more.setdefault(state, {})[code] = to

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if not p or left[p] != x and right[p] != x:
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p)
            elif inner:
                self._rotate(x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                self.colour[x] = self.colour[p]
        else:
            self.colour[x] = self.colour[p]
        up[x], up[p] = g, x

    def append(self, code: int) -> None:
        at, self.n = self.n, self.n + 1
        new = self._state(at + 1)
        p = self.last
        while p and not self._next(p, code):
            self._set(p, code, new)
            p = self.link[p]
        if not p:
            under = 1
        else:
            under = self._next(p, code)
            if self.length[p] + 1 != self.length[under]:
                under = self._split(p, code, under)
        self.link[new] = self.up[new] = under
        self.last = new
        self._recolour(new, at)

    def _split(self, p: int, code: int, state: int) -> int:
        """A clone of ``state`` for its shorter words, between it and its link, on the same path."""
        clone = self._state(self.length[p] + 1)
        self.code[clone], self.to[clone] = self.code[state], self.to[state]
        if state in self.more:
            self.more[clone] = dict(self.more[state])
        self.link[clone], self.link[state] = self.link[state], clone
        self._splay(state)
        above = self.left[state]
        self.left[clone], self.left[state], self.up[clone] = above, clone, state
        if above:
            self.up[above] = clone
        while p and self._next(p, code) == state:
            self._set(p, code, clone)
            p = self.link[p]
        return clone

    def _recolour(self, new: int, at: int) -> None:
        up, right, colour = self.up, self.right, self.colour
        below, x = 0, new
        while x:
            self._splay(x)
            end = colour[x]
            if end >= 0:
                distance, length = at - end, self.length[x]
                if length + distance >= LEAST_WORDS and length >= (LEAST_PERIODS - 1) * distance:
                    self.ends[end - length + 1, distance] = at
            cut = right[x]
            if cut:
                colour[cut] = end
            right[x] = below
            below, x = x, up[x]
        self._splay(new)
        colour[new] = at

    def runs(self) -> list[Run]:
        """Runs by start and then period."""
        return [(start, end - start + 1, period) for (start, period), end in sorted(self.ends.items())]


def runs_of(codes: list[int]) -> list[Run]:
    search = SuffixRuns()
    for code in codes:
        search.append(code)
    return search.runs()


def _rows_of(flags: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each row of set flags; ``start`` marks places that begin a new row."""
    first = flags & (start | ~np.concatenate(([False], flags[:-1])))
    begin = np.flatnonzero(first)
    end = flags & np.concatenate((start[1:] | ~flags[1:], [True]))
    return begin, np.flatnonzero(end) + 1


def stretches(windows: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places [a, b) of windows, in order and apart, outside of which no run has words.

    ``windows`` are hashes of consecutive windows and ``owner`` the text of each; equal hashes of different windows only
    make stretches longer.
    """
    if not len(windows):
        return
    order = np.lexsort((windows, owner))
    same = (windows[order[1:]] == windows[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    back = np.zeros(len(windows), np.int64)  # 0: no equal window before
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    start = np.concatenate(([True], owner[1:] != owner[:-1]))
    flags = back > 0
    while True:
        begin, end = _rows_of(flags, start)
        size = end - begin
        widest = np.where(size >= 3, (size + 2) // 3, 0)  # the largest period that a row of this size allows
        bound = np.zeros(len(windows), np.int64)
        bound[flags] = np.repeat(widest, size)
        fewer = flags & (back <= bound)
        if fewer.sum() == flags.sum():
            break
        flags = fewer
    if not len(begin):
        return
    first = np.flatnonzero(start)
    begin = np.maximum(begin - widest, first[np.searchsorted(first, begin, "right") - 1])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    # Stretches that overlap are one; those of two texts can't.
    apart = np.concatenate(([True], begin[1:] >= end[:-1]))
    last = np.concatenate((apart[1:], [True]))
    yield from zip(begin[apart].tolist(), end[last].tolist())


def piece_runs(words: Words) -> dict[int, list[Run]]:
    """Runs of each row of a piece that has some, by row."""
    size = WINDOW
    hashes = words.hashes()
    # Windows over the border of two texts are not looked at.
    owner = words.rows[: max(len(hashes) - size + 1, 0)]
    inside = owner == words.rows[size - 1 :] if len(hashes) >= size else owner.astype(bool)
    place = np.flatnonzero(inside)
    out: dict[int, list[Run]] = {}
    for a, b in stretches(window_hashes(hashes, size)[inside], owner[inside]):
        first, last = int(place[a]), int(place[b - 1]) + size
        row = int(words.rows[first])
        codes = _codes(words, first, last)
        found = [(start + first - int(words.bounds[row]), length, period) for start, length, period in runs_of(codes)]
        if found:
            out.setdefault(row, []).extend(found)
    return {row: sorted(found, key=lambda r: (r[0], r[2])) for row, found in out.items()}  # by start and then period


def _codes(words: Words, first: int, last: int) -> list[int]:
    """A number for each different word, told apart by all its bytes."""
    seen: dict[bytes, int] = {}
    text = memoryview(words.data)
    return [
        seen.setdefault(bytes(text[a:b]), len(seen)) for a, b in zip(words.starts[first:last].tolist(), words.ends[first:last].tolist())
    ]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _joined(words: Words, keep: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    place = np.flatnonzero(keep)
    starts, ends, rows = words.starts[place], words.ends[place].copy(), words.rows[place]
    followed = np.flatnonzero(rows[1:] == rows[:-1])
    data = words.data.copy()
    data[ends[followed]] = 0x20  # the byte after a word is a space of some kind
    ends[followed] += 1
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    taken = np.cumsum(edge[:-1]) > 0
    bounds = np.concatenate(([0], np.cumsum(taken, dtype=np.int64)))[offsets].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data[taken])]).cast(pa.string())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, runs, collapsed) of each (key, text)."""
    for batch in batches:
        for first, data, offsets in pieces(batch.column(1)):
            words = Words(data, offsets, lower=False)
            found = piece_runs(words)
            keep = np.ones(len(words), bool)
            for row, runs in found.items():
                a, b = int(words.bounds[row]), int(words.bounds[row + 1])
                keep[a:b] = kept_words(b - a, runs)
            n_rows = len(offsets) - 1
            sizes = np.zeros(n_rows + 1, np.int32)
            for row, runs in found.items():
                sizes[row + 1] = len(runs)
            flat = np.array([r for row in sorted(found) for r in found[row]], np.int64).reshape(-1, 3)
            run = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n_rows), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), run), _joined(words, keep, offsets)],
                names=["key", "runs", "collapsed"],
            )


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the ``runs`` of each text and the text without repetitions, for every row of ``docs``.

    ``runs`` is an array of ``start, length, period`` in words from 0, by start and then period; ``collapsed`` has the words that
    no run contains after its first period, joined by one space. Null and empty texts have no runs and an empty ``collapsed``.
    Whole texts are searched; the automaton takes some hundred bytes a word of a periodic stretch. Repeated rows and null
    keys are searched like any other; an empty table gives an empty one. Other columns are not looked at.
    """
    schema = f"key {docs.schema[key].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_scan, schema)


def _longest(runs: Column) -> Column:
    """The run of greatest length over period, of equal ones the first by start and period; null where there is none."""
    # Fractions are compared by products of whole numbers.
    return F.aggregate(
        runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of ``find``'s rows: number of runs, the most repetitive one, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = found.select("key", "runs", _longest(F.col("runs")).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return best.select(
        F.col("key").alias(key), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where a tenth of the texts repeat some of their words to the end.

    With ``h = crc32(doc_id)`` a multiple of 10 and ``g = h / 10``, word i of n from ``a = g % n`` on is the original word
    ``a + (i - a) % p``, ``p = 1 + (n - a) / (3 + g % 8)``; the words are joined by one space.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select(
        "doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).cast("long").alias("g"),
    ).withColumn("words", F.when(F.col("chosen"), F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE), "")))
    sized = words.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = F.sequence(F.col("a"), F.col("n") - 1)
    again = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.transform(at, lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text").cast("string")).alias("text"))
