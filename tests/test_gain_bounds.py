import numpy as np
import pytest

from gleaner.operators import facility as FL
from gleaner.operators import gain_bounds as GB


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-8)[:, None]


def plain(x, budget, cap=None, first=None):
    """Picks, their gains, and every item's gain after them."""
    k = unit(x) @ unit(x).T
    k = np.maximum(k, 0) if first is None else k
    k = k if cap is None else np.minimum(k, cap[:, None])
    picks, gains = ([], []) if first is None else ([first], [k[:, first].sum()])
    while True:
        covered = k[:, picks].max(1) if picks else np.zeros(len(x))
        gain = np.round(np.maximum(k - covered[:, None], 0).sum(0), 9)
        if len(picks) == budget:
            return picks, gains, gain
        gain[picks] = -np.inf
        picks.append(int(np.lexsort((np.arange(len(x)), -gain))[0]))
        gains.append(gain[picks[-1]])


@pytest.fixture
def clustered(spark):
    def make(n, seed, copies=0, ids=None, width=6):
        rng = np.random.default_rng(seed)
        x = rng.standard_normal((n, width)) * rng.integers(1, 5, n)[:, None]
        x[: n // 3] += 4 * rng.standard_normal(width)
        x[n - copies :] = x[0]
        cap = rng.uniform(0.1, 0.9, n)
        names = list(range(n)) if ids is None else ids
        rows = [(i, v.tolist(), float(c)) for i, v, c in zip(names, x, cap)]
        kind = "bigint" if ids is None else "string"
        return x, cap, spark.createDataFrame(rows, f"item_id {kind}, vec array<double>, cap double").persist()

    return make


@pytest.fixture
def in_files(monkeypatch):
    """Bounds of all but the smallest pools go to files, in several groups of blocks, and little is evaluated at once."""
    for name, value in {"READ_BLOCK": 8, "EVALUATE_FIRST": 1, "EVALUATE_MOST": 50, "GUESSES": 3, "FEW_PRODUCTS": 0}.items():
        monkeypatch.setattr(FL, name, value)
    monkeypatch.setattr(GB, "BROADCAST_BYTES", 3000)
    monkeypatch.setattr(GB, "TASK_ROWS", 90)


@pytest.mark.parametrize("case", ["plain", "copies", "cap", "first"])
def test_picks_and_gains_equal_plain_greedy(clustered, in_files, case):
    x, cap, df = clustered(120, seed=len(case), copies=40 if case == "copies" else 0)
    kind = {"cap": {"cap": cap}, "first": {"first": 3}}.get(case, {})
    picks, gains, _ = plain(x, 4, **kind)
    got = FL.facility_location(df, 4, **(kind | {"cap": "cap"} if case == "cap" else kind))
    assert [p.item for p in got] == picks
    assert np.allclose([p.gain for p in got], gains, atol=1e-6)
    assert np.allclose([p.vec for p in got], unit(x)[picks])


def test_gains_are_not_taken_anew_where_the_driver_cannot_remember_them(clustered, in_files, monkeypatch):
    """Every step evaluated the whole pool when more candidates than the driver remembers were in the way."""
    x, _, df = clustered(180, seed=3)
    asked, evaluate = [], FL.evaluate_gains
    monkeypatch.setattr(FL, "evaluate_gains", lambda *a, **b: asked.append(len(a[3])) or evaluate(*a, **b))
    got = FL.facility_location(df, 6, remembered_bytes=3 * 8 * 6)
    assert [p.item for p in got] == plain(x, 6)[0]
    assert sum(asked) < 180


@pytest.mark.parametrize("case", ["plain", "cap", "first"])
def test_bounds_hold_and_are_close_after_a_refresh(clustered, in_files, case):
    x, cap, df = clustered(120, seed=9)
    kind = {"cap": {"cap": cap}, "first": {"first": 3}}.get(case, {})
    cover = FL.Coverage(case != "first", "cap" if case == "cap" else None)
    picks = plain(x, 4, **kind)[0]
    start = 1 if case == "first" else 0
    u = unit(x)
    bounds = GB.BlockBounds(df, 120, 6, cover, u[picks[:start]], 1e-8, "item_id", "vec")
    try:
        for step in range(start, 5):
            least = -np.inf if step != 2 else 5.0
            for group in list(bounds.groups):
                bounds.refresh(group, u[picks[:step]], least)
            gain = plain(x, step, **kind)[2]
            rows = bounds.state.select("item_id", "bound").collect()
            bound = np.array([b for _, b in sorted(map(tuple, rows))])
            assert (bound >= gain).all()
            exact = bound >= least
            assert np.allclose(bound[exact], gain[exact], atol=2e-3)
    finally:
        bounds.close()


def test_text_ids_and_a_pool_that_ends_before_the_budget(clustered, in_files):
    names = [f"item {i:03d}" for i in range(18)]
    x, _, df = clustered(18, seed=4, copies=6, ids=names)
    got = FL.facility_location(df, 99)
    assert sorted(p.item for p in got) == names
    assert [p.item for p in got][:5] == [names[i] for i in plain(x, 5)[0]]


def test_vectors_are_packed_and_read_again_in_slices():
    from gleaner.functions.kernels import packed, packed_array

    rows = np.arange(15, dtype=np.float64).reshape(5, 3)
    column = packed_array(rows)
    assert (packed(column, np.float64) == rows).all()
    assert (packed(column.slice(1, 3), np.float64) == rows[1:4]).all()
    assert packed(column.slice(0, 0), np.float64).shape == (0, 0)
