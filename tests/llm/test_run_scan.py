"""Runs by suffix automaton against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from gleaner.llm import run_scan as R
from gleaner.llm.text import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(6, 4 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        k, size = rnd.choice([1, 2, 3, 5, 40]), rnd.randrange(70)
        w = [rnd.randrange(k) for _ in range(size)]
        for _ in range(rnd.randrange(3)):
            if size > 6:
                a = rnd.randrange(size)
                b, p = rnd.randrange(a, size), 1 + (size - a) // rnd.randrange(3, 11)
                w[a:b] = [w[a + i % p] for i in range(b - a)]
        yield w


def test_automaton_equals_brute_force():
    for w in sequences(4000, 1):
        assert R.runs_of(w) == brute(w), w


def test_stretches_hold_all_runs():
    for seed in range(8):
        given = list(sequences(200, seed + 10))
        texts = [" ".join(map(str, w)).encode() for w in given]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = R.piece_runs(Words(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=False))
        for row, w in enumerate(given):
            assert got.get(row, []) == brute(w), w


def test_texts_without_runs_are_not_searched():
    rnd = random.Random(4)
    w = [rnd.randrange(3000) for _ in range(4000)]
    text = " ".join(map(str, w + w[500:1500] + [9999] + w[:900])).encode()  # copies far apart are no runs
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=False)
    assert list(R.stretches(R.window_hashes(words.hashes(), R.WINDOW), words.rows[: len(words) - R.WINDOW + 1])) == []


def test_long_periodic_texts_take_linear_time():
    assert R.runs_of([1] * 60_000) == [(0, 60_000, 1)]
    assert R.runs_of([i % 7000 for i in range(60_000)]) == [(0, 60_000, 7000)]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_digests_equal_brute_force(spark):
    rows = [(i, " ".join(f"é{x}" if x % 2 else f"A{x}" for x in w)) for i, w in enumerate(sequences(300, 3))]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "a b\ta\x0ba " * 9), (None, "x " * 8), (None, None), (1004, "a a a a a A"), (1004, "b b b b b b")]
    rows += [(5000 + i, "p q r s t u v w x y z " * 3) for i in range(40)]
    got = R.digest(R.find(R.with_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(*r)) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 60


def test_a_text_longer_than_a_piece(spark):
    lines = "".join(f"w{i} " for i in range(400_000)) + "la " * 900_000
    row = R.find(spark.createDataFrame([(1, "x"), (2, lines), (3, "y y y y y y")], "doc_id long, text string").coalesce(1)).filter("key = 2").first()
    assert [tuple(r) for r in row.runs] == [(400_000, 900_000, 1)] and row.collapsed == lines[: -3 * 899_999 - 1]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("k", "a a a a a a", 1, 2, 3)], ["id", "body", "key", "runs", "text"])
    row = R.find(df, key="id", text="body").first()
    assert (row.key, [tuple(r) for r in row.runs], row.collapsed) == ("k", [(0, 6, 1)], "a")
    assert R.digest(R.find(df.limit(0), key="id", text="body"), "id").collect() == []
