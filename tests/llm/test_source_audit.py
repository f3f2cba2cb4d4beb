"""The source audit against a plain comparison of every term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from gleaner.llm import source_audit as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        words = [w.translate(LOWER) for w in TERM.findall(text)]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {lang for lang, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-(p[s][t] - q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items)]
    return sorted(out)


def some_rows(n, langs, sources, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß漢𝛑") for _ in range(rnd.randrange(1, 4))) for _ in range(180)]
    pick = lambda: words[int(rnd.random() ** 3 * len(words))]
    rows = []
    for _ in range(n):
        # One group holds a third of all rows.
        lang, source = ("en", "s0") if rnd.random() < 0.33 else (rnd.choice(langs), rnd.choice(sources))
        text = "".join((pick().upper() if rnd.random() < 0.2 else pick()) + rnd.choice([" ", "-", "1", "\n", "  _"]) for _ in range(rnd.randrange(30)))
        rows.append((lang, source, text))
    return rows


def audit(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    return sorted(map(tuple, S.divergence(df, **kw).collect()))


def test_equals_brute_force_with_nulls_and_groups_without_terms(spark):
    rows = some_rows(500, ["en", "de", None], ["s0", "é", "s10", "s9", None], 1)
    rows += [("xx", "only", "a b"), ("yy", "a", "1 2 3"), ("yy", "b", None), ("yy", "", ""), ("en", "empty", ""), ("en", None, "12"), ("en", "long", "ab cé " * 40_000)]
    rows += rows[:40]  # repeated rows count again
    for least, top in ((30, 50), (2, 5), (1, 1000)):
        assert audit(spark, rows, least=least, top=top) == brute(rows, least, top)


def test_more_sources_than_a_block_and_ties(spark):
    rows = some_rows(600, ["en"], [f"s{i}" for i in range(2 * S.BLOCK + 5)], 2)
    rows += [("en", f"same{i}", "tie tie a b") for i in range(6)]
    assert audit(spark, rows, least=4, top=7) == brute(rows, 4, 7)


def test_many_terms_take_several_lots(spark):
    rnd = random.Random(3)
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [("en", f"s{k % 3}", " ".join(name(rnd.randrange(2500)) for _ in range(400))) for k in range(60)]
    assert len({t for *_, text in rows for t in text.split()}) > 2 * S.CHUNK * S.LOT
    assert audit(spark, rows, least=1, top=50) == brute(rows, 1, 50)


def test_joint_cells_in_slices(monkeypatch):
    rnd = np.random.default_rng(4)
    counts = rnd.integers(0, 4, (9, S.CHUNK))
    share = lambda c: np.asarray(c) ** 2 * 7 + 3
    def side(rows):
        out = [(i, share(c), sum(1 << int(t) for t in np.flatnonzero(row == c))) for i, row in enumerate(rows) for c in set(row.tolist()) - {0}]
        return tuple(np.array(x, t) for x, t in zip(zip(*out), (np.int64, np.int64, np.uint64)))
    a, b = counts[:4], counts[4:]
    want = [[int(np.abs(share(x) - share(y)).sum()) for y in b] for x in a]
    for cells in (1 << 20, 1, 40):
        monkeypatch.setattr(S, "CELLS", cells)
        got = S._levels_product(side(a), side(b), np.full(4, 3), np.full(5, 3), S.CHUNK)
        assert got.tolist() == want


def test_empty_table_and_clashing_columns(spark):
    names = ["n", "docs", "term", "i", "bits", "id", "p", "value", "rank", "a.b"]
    df = spark.createDataFrame([("en", "s", "a", *range(len(names))), ("en", "t", "b", *range(len(names)))], ["lang", "source", "text", *names])
    assert sorted(map(tuple, S.divergence(df, least=1).collect())) == brute([("en", "s", "a"), ("en", "t", "b")], 1, 50)
    assert S.divergence(df.limit(0)).collect() == []


def test_large_counts_stay_whole_numbers(spark):
    n, total, terms = 10**15, 10**17 + 1, 3 * 10**6
    row = spark.range(1).select(S.share(*[S.F.lit(x).cast("long") for x in (n, total, terms)])).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)
