"""Parts of the quality model against brute force."""

import re
from collections import Counter

import numpy as np

from gleaner.llm import quality_model as Q


def brute_isotonic(weight, good):
    n = len(weight)
    mean = lambda a, b: good[a : b + 1].sum() / weight[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(1)
    for _ in range(60):
        weight = rng.integers(1, 200, rng.integers(1, 25)).astype(float)
        good = rng.binomial(weight.astype(int), rng.uniform(0, 1, len(weight))).astype(float)
        assert np.allclose(Q.isotonic(weight, good), brute_isotonic(weight, good))


def test_smoothing_keeps_the_order():
    for weight, good in (([100, 1], [95, 1]), ([50, 2, 1], [45, 2, 1])):
        assert (np.diff(Q.calibrated(np.array(weight, float), np.array(good, float))) >= 0).all()
    rng = np.random.default_rng(2)
    for _ in range(200):
        weight = rng.integers(1, 300, 40).astype(float)
        good = rng.binomial(weight.astype(int), rng.beta(0.3, 0.3, 40)).astype(float)
        got = Q.calibrated(weight, good)
        assert (np.diff(got) >= 0).all() and 0 < got[0] and got[-1] < 1 or good.sum() in (0, weight.sum())


def brute_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    if not words:
        return [0.0] * len(Q.NAMES)
    raw, size, n = t.encode(), len(t.encode()), len(words)
    letters = sum(len(w.encode()) for w in words)
    lines = [x for x in t.lower().split("\n") if x]
    grams = [tuple(words[i : i + 4]) for i in range(n - 3)]
    some = lambda chars: sum(c in chars.encode() for c in raw)
    return [
        np.log1p(n), letters / n, sum(65 <= c <= 90 for c in raw) / letters, sum(48 <= c <= 57 for c in raw) / letters,
        some("!?") / n, some("#*$%&|<>@^~=+_\\/{}[]") / n, sum(c >= 128 for c in raw) / letters, (size - letters) / size,
        n / max(len(lines), 1), 1 - len(set(lines)) / len(lines), len(set(words)) / n, 1 - len(set(grams)) / len(grams) if n > 4 else 0.0,
        sum(len(w.encode()) <= 3 for w in words) / n, sum(len(w.encode()) >= 15 for w in words) / n, some(".") / n, max(Counter(words).values()) / n,
    ]


def test_statistics_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    alphabet = list("abcDE 1 9!?#|. \n\té漢") + [" ", " "]
    texts = ["", " \n ", "A", "one two\none two\n\n", "x " * 30_000] + ["".join(rng.choice(alphabet, rng.integers(0, 300))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.stats for r in Q.statistics(rows).collect()}
    for i, t in enumerate([*texts, ""]):
        assert np.allclose(got[i], brute_statistics(t)), (i, t[:50])


def test_normal_equations_are_the_sums_of_all_rows(spark):
    x = np.random.default_rng(4).normal(size=(700, 5))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(6)
    got = Q.normal_equations(rows, lambda v: np.hstack([v, v[:, :1] ** 2]))
    y = np.hstack([x, x[:, :1] ** 2])
    assert np.allclose(got, y.T @ y)


def test_scores_equal_a_direct_solution(spark):
    """With everything on one machine: the same features, ridge solution and calibration."""
    rng = np.random.default_rng(5)
    stats = rng.normal(size=(900, len(Q.NAMES)))
    quality = (stats[:, 0] + 0.3 * rng.normal(size=900) > 0).astype(int)
    fold = rng.choice([0, 1, 3], 900)
    rows = spark.createDataFrame([(v.tolist(), int(q), int(f)) for v, q, f in zip(stats, quality, fold)], "stats array<double>, quality int, fold int").repartition(4)
    model = Q.fit(rows, n=40)
    train, held = fold != Q.CALIBRATION, fold == Q.CALIBRATION
    cosines = Q.Cosines.draw(stats[train].mean(0), stats[train].std(0), 40, 10)
    x = cosines(stats[train])
    want = np.linalg.solve(x.T @ x + Q.RIDGE * train.sum() * np.diag([0.0] + [1.0] * 40) / 40, x.T @ quality[train])
    assert np.allclose(model.coefficients, want)
    step = np.clip(((cosines(stats[held]) @ want + 0.5) / 2 * Q.STEPS).astype(int), 0, Q.STEPS - 1)
    weight, good = np.bincount(step, minlength=Q.STEPS), np.bincount(step, quality[held], Q.STEPS)
    at = np.flatnonzero(weight)
    smooth = Q.SMOOTHING
    chance = brute_isotonic(weight[at] + smooth, good[at] + smooth * good.sum() / weight.sum())
    assert np.allclose(model.chance, chance)
    order = np.argsort(model.raw(stats))
    assert (np.diff(model(stats)[order]) >= 0).all()
