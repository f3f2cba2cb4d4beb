"""Sampling over the whole lattice: every piece can be drawn, and chances are those of all segmentations."""

import math
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import pieces, text


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def all_paths(vocabulary, t):
    """Each segmentation as piece numbers (-1: bytes) with its chance, by trying all."""
    names = {n: i for i, n in enumerate(vocabulary.names)}
    out = {}

    def go(i, path, total):
        if i == len(t):
            out[path] = total
            return
        char = int(pieces._LENGTH[t[i]])
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in names:
                go(j, (*path, names[t[i:j]]), total + pieces.ALPHA * vocabulary.scores[names[t[i:j]]])
        if t[i : i + char] not in names:
            go(i + char, (*path, -1), total + pieces.ALPHA * vocabulary.scores[-1] * (char + 1))

    go(0, (), 0.0)
    norm = np.logaddexp.reduce(list(out.values()))
    return {p: math.exp(x - norm) for p, x in out.items()}


def draw(vocabulary, t, n, k):
    lattices = pieces.Lattices(vocabulary, pieces.ALPHA)
    data, offsets = np.frombuffer(t * n, np.uint8), np.arange(n + 1) * len(t)
    found = pieces.sample_piece(lattices, data, offsets, text.mix(np.arange(n).astype(np.uint64)), k)
    return lattices, [[(tuple(lattices.edge_piece[p.edges].tolist()), float(lattices.edge_log[p.edges].sum())) for p in paths] for paths, _ in found]


@pytest.mark.parametrize("t", ["a--b", "x...", "  a", "f();", "a//b", "日本語", "née", "**x", "é𝛑!"])
def test_chances_are_those_of_all_segmentations(vocabulary, t):
    want, n = all_paths(vocabulary, t.encode()), 3000
    _, drawn = draw(vocabulary, t.encode(), n, 1)
    for (path, log), in drawn:
        assert math.isclose(math.exp(log), want[path], rel_tol=1e-6)
    seen = Counter(d[0][0] for d in drawn)
    common = {p: c for p, c in want.items() if n * c > 5}
    assert sum((seen[p] - n * c) ** 2 / (n * c) for p, c in common.items()) < 3 * len(common) + 20


def test_no_piece_crosses_a_cut(vocabulary):
    names = vocabulary.names
    offsets = np.concatenate(([0], np.cumsum([len(n) for n in names])))
    begin, size = pieces.split_units(np.frombuffer(b"".join(names), np.uint8), offsets, vocabulary)
    assert begin.tolist() == offsets[:-1].tolist() and size.tolist() == [len(n) for n in names]


def test_cuts_stay_close_in_ordinary_text(vocabulary):
    t = ("The quick brown fox, 12 of them, jumped over it; naïve façade!\n" * 50).encode()
    _, size = pieces.split_units(np.frombuffer(t, np.uint8), np.array([0, len(t)]), vocabulary)
    assert size.max() <= 12


def test_all_paths_are_found_before_none_is_left(vocabulary):
    want = all_paths(vocabulary, b"a--")
    _, drawn = draw(vocabulary, b"a--", 20, len(want) + 3)
    assert all({p for p, _ in d} == set(want) and len(d) == len(want) for d in drawn)


def test_a_long_run_without_a_cut_and_texts_beyond_a_piece(spark):
    texts = ["a" * 20_000, "- " * 700_000, "née" * 3000, "x" + " " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = pieces.sample(docs).collect()
    assert len(got) == 8 and all(r.exact for r in got)


def test_decode_replaces_text_and_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "so -- it goes", 7)], "doc_id long, text string, `a.b` int")
    ids = pieces.sample(docs, k=1).select("ids").first().ids
    back = pieces.decode(spark.createDataFrame([(ids, "old", 7), (None, "old", 8)], "ids array<int>, text string, `a.b` int"))
    assert back.columns == ["text", "a.b"] and sorted(map(tuple, back.collect()), key=lambda r: r[1]) == [("so -- it goes", 7), (None, 8)]


def test_wrong_ids_are_not_called_exact(vocabulary):
    by_text = {t: i for i, t in enumerate(vocabulary.texts) if t}
    texts = [b"the cat", b"", b"a--b"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    one = [by_text[b"the"], by_text[b" c"], by_text[b"at"]]
    lists = [one, one[:2], [*one, by_text[b"at"]], [by_text[b"the"], by_text[b" c"], by_text[b"it"]], [], [by_text[b"a"], by_text[b"--"], by_text[b"b"]]]
    owner = np.array([0, 0, 0, 0, 1, 2])
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    got = pieces._exact(vocabulary, np.array([i for x in lists for i in x], np.int64), bounds, data, offsets, owner)
    assert got.tolist() == [True, False, False, False, True, True]
