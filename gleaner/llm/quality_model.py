"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

``statistics`` turns each whole text into a short vector in one pass. Random cosine features
approximate a Gaussian kernel over the standardised vectors; every task sums its part of the normal
equations, and the driver solves one small system. A fold of the training rows that the
ridge never saw calibrates its scores by pooling adjacent violators over a fine histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.kernels import matrix
from gleaner.llm.scratch import Scratch
from gleaner.llm.text import Words, pieces, window_hashes

COSINES = 256
RIDGE = 1e-3
#: Steps of the calibration histogram over raw scores from -0.5 to 1.5.
STEPS = 2000
#: Weight of the overall share of good rows in each step, so that no step is quite certain.
SMOOTHING = 0.05
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
NAMES = (
    "log_words", "word_bytes", "capitals", "digits", "marks", "symbols", "wide", "spaces", "words_per_line",
    "repeated_lines", "different_words", "repeated_grams", "short_words", "long_words", "sentence_ends", "most_frequent",
)


def _flags(codes: str | list[int]) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[ord(c) for c in codes] if isinstance(codes, str) else codes] = True
    return flags


_CAPITALS, _DIGITS = _flags(list(range(0x41, 0x5B))), _flags(list(range(0x30, 0x3A)))
_MARKS, _SYMBOLS, _WIDE, _ENDS = _flags("!?"), _flags("#*$%&|<>@^~=+_\\/{}[]"), _flags(list(range(0x80, 0x100))), _flags(".")
_NOT_LINE = _flags("\n")


def _by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return np.diff(total[offsets]).astype(float)


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)) of one piece; texts without words are all zeros."""
    words = Words(data, offsets)
    lines = Words(data, offsets, other=_NOT_LINE)
    hashes, grams, line_hashes = words.hashes(), None, lines.hashes()
    grams = window_hashes(hashes, 4)
    n, size = np.diff(words.bounds).astype(float), np.diff(offsets).astype(float)
    length = words.ends - words.starts
    letters = np.maximum(np.add.reduceat(np.append(length, 0), np.minimum(words.bounds[:-1], len(length))) * (n > 0), 1)
    some = np.maximum(n, 1)
    rows = len(n)
    different, frequent, repeated, again, n_lines = (np.zeros(rows) for _ in range(5))
    for r in range(rows):
        a, b = words.bounds[r], words.bounds[r + 1]
        if b > a:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            different[r], frequent[r] = len(counts) / (b - a), counts.max() / (b - a)
        if b - a > 4:
            repeated[r] = 1 - len(np.unique(grams[a : b - 3])) / (b - a - 3)
        a, b = lines.bounds[r], lines.bounds[r + 1]
        n_lines[r] = b - a
        if b > a:
            again[r] = 1 - len(np.unique(line_hashes[a:b])) / (b - a)
    short = np.concatenate(([0], np.cumsum(length <= 3)))[words.bounds]
    long = np.concatenate(([0], np.cumsum(length >= 15)))[words.bounds]
    columns = [
        np.log1p(n), letters / some, _by_row(_CAPITALS[data], offsets) / letters, _by_row(_DIGITS[data], offsets) / letters,
        _by_row(_MARKS[data], offsets) / some, _by_row(_SYMBOLS[data], offsets) / some, _by_row(_WIDE[data], offsets) / letters,
        (size - letters) / np.maximum(size, 1), n / np.maximum(n_lines, 1), again, different, repeated,
        np.diff(short) / some, np.diff(long) / some, _by_row(_ENDS[data], offsets) / some, frequent,
    ]
    return np.where(n[:, None] > 0, np.stack(columns, 1), 0.0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in pieces(batch.column(1)):
            values = text_statistics(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(values)), flat], names=["doc_id", "stats"])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` for every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        _measure, "doc_id long, stats array<double>"
    )


@dataclass(frozen=True)
class Cosines:
    """Random features of standardised vectors, with a constant in front."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, n: int, seed: int) -> Cosines:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(size=(len(mean), n)) / np.sqrt(len(mean)), rng.uniform(0, 2 * np.pi, n))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase)])


@dataclass(frozen=True)
class Model:
    features: Cosines
    coefficients: np.ndarray
    at: np.ndarray
    chance: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coefficients

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.chance), 0, 1)


def isotonic(weight: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The non-decreasing shares nearest to ``good / weight`` by weighted squares: adjacent violators are pooled."""
    blocks: list[list[float]] = []  # good, weight, steps
    for g, w in zip(good.tolist(), weight.tolist()):
        blocks.append([g, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g1, w1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g1, blocks[-1][1] + w1, blocks[-1][2] + n1]
    shares = [g / w for g, w, _ in blocks]
    return np.repeat(np.maximum.accumulate(shares), [int(n) for _, _, n in blocks])


def calibrated(weight: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic shares of a histogram that is smoothed first, so that smoothing can't undo the order."""
    overall = good.sum() / weight.sum()
    return isotonic(weight + SMOOTHING, good + SMOOTHING * overall)


def normal_equations(rows: DataFrame, prepare) -> np.ndarray:
    """``X'X`` of all rows of ``rows(vec)``, each batch mapped by ``prepare``: d rows a task, summed by row."""

    def of_task(batches):
        moments = None
        for batch in batches:
            x = prepare(matrix(batch.column(0))) if batch.num_rows else None
            if x is not None:
                moments = x.T @ x if moments is None else moments + x.T @ x
        if moments is not None:
            d = len(moments)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(moments.ravel()), d).cast(pa.list_(pa.float64()))
            task = np.full(d, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(task), flat], names=["dim", "task", "vec"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:  # sorted by task: the same sums in every run
            for dim, row in zip(batch.column(0).to_pylist(), matrix(batch.column(1))):
                total[dim] = total[dim] + row if dim in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["dim", "vec"])

    parts = rows.select("vec").mapInArrow(of_task, "dim int, task int, vec array<double>")
    found = parts.repartition("dim").sortWithinPartitions("task", "dim").select("dim", "vec").mapInArrow(summed, "dim int, vec array<double>").toArrow()
    return matrix(found.sort_by("dim").column("vec"))


def fit(labelled: DataFrame, n: int = COSINES, ridge: float = RIDGE, seed: int = 10) -> Model | float:
    """A model of ``labelled(stats, quality, fold)``, or the share of good rows when all labels agree (0.5 without any)."""
    train = labelled.filter(F.col("fold") != CALIBRATION)
    width = len(NAMES)
    row = train.agg(
        F.count(F.lit(1)).alias("n"), F.avg("quality").alias("good"),
        *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(width)],
    ).first()
    if not row.n or row.good in (0.0, 1.0):
        return float(row.good) if row.n else 0.5
    mean, scale = (np.array([row[f"{k}{i}"] for i in range(width)]) for k in "ms")
    features = Cosines.draw(mean, np.maximum(scale, 1e-6), n, seed)

    def equations(x: np.ndarray) -> np.ndarray:
        return np.hstack([features(x[:, 1:]), x[:, :1]])

    moments = normal_equations(train.select(F.concat(F.array(F.col("quality").cast("double")), F.col("stats")).alias("vec")), equations)
    inner, target = moments[:-1, :-1], moments[:-1, -1]
    coefficients = np.linalg.solve(inner + ridge * row.n * np.diag([0.0] + [1.0] * n) / n, target)
    raw = Model(features, coefficients, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def bins(batches):
        for batch in batches:
            x = matrix(batch.column(0)).reshape(-1, width)
            step = np.clip(((raw.raw(x) + 0.5) / 2 * STEPS).astype(np.int64), 0, STEPS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], names=["step", "quality"])

    counted = labelled.filter(F.col("fold") == CALIBRATION).select("stats", F.col("quality").cast("double")).mapInArrow(bins, "step long, quality double")
    found = counted.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).orderBy("step").toPandas()
    if not len(found):
        return raw
    chance = calibrated(found["n"].to_numpy(float), found["good"].to_numpy(float))
    return Model(features, coefficients, (found["step"].to_numpy() + 0.5) / STEPS * 2 - 0.5, chance)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, quality)`` of ids whose ``crc32(doc_id as text) mod 4`` is not 2; of an id with several
    labels the mean counts, nulls are left out. A null or empty text is scored by its all-zero
    statistics. A row without id is held out. Repeated rows are scored alike; other columns are
    ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    stats = scratch.save(statistics(docs), "stats")
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    known = stats.join(marks, "doc_id").withColumn("fold", fold).filter(F.col("fold") != HELD_OUT)
    model = fit(scratch.save(known.select("stats", "quality", "fold"), "labelled"))
    width = len(NAMES)

    def apply(batches):
        for batch in batches:
            x = matrix(batch.column(1)).reshape(-1, width)
            values = np.full(len(x), model) if isinstance(model, float) else model(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    return stats.mapInArrow(apply, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
