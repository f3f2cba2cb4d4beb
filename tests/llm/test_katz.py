"""Katz scores against a dictionary model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import katz

START, END = "<s>", "</s>"


def discounts(counts, least):
    out = [0.0] * least
    for r in range(least, katz.DISCOUNTED + 1):
        ratio = (r + 1) * counts[r + 1] / (r * counts[r]) if counts[r] and counts[r + 1] else 1.0
        out.append(min(max(ratio, 0.1), 1.0))
    return lambda n: n * (out[n] if n <= katz.DISCOUNTED else 1.0)


class Model:
    def __init__(self, texts):
        chains = [[START, *(t or "").encode().lower().split(), END] for t in texts]
        self.c = Counter(w for x in chains for w in x[1:])
        self.n = sum(self.c.values())
        kept = discounts(Counter(self.c.values()), 1)
        freed = self.n - sum(kept(x) for x in self.c.values())
        self.unseen = max(freed, 0.5) / (self.n + (0.5 if freed < 0.5 else 0))
        self.p = {w: kept(x) / self.n * (1 - self.unseen) * self.n / (self.n - freed) for w, x in self.c.items()}
        pairs = Counter(p for x in chains for p in zip(x, x[1:]))
        kept = discounts(Counter(pairs.values()), katz.LEAST)
        first = Counter(v for x in chains for v in x[:-1])
        self.next = {}
        for (v, w), x in pairs.items():
            if x >= katz.LEAST:
                self.next.setdefault(v, {})[w] = kept(x) / first[v]
        self.back = {}
        for v, ws in self.next.items():
            used, room = sum(ws.values()), 1 / (first[v] + 1)
            if 1 - used < room:
                self.next[v] = ws = {w: p * (1 - room) / used for w, p in ws.items()}
            self.back[v] = (1 - sum(ws.values())) / max(1 - sum(self.p[w] for w in ws), 1e-12)

    def chance(self, v, w):
        if w in self.next.get(v, ()):
            return self.next[v][w]
        return self.back.get(v, 1.0) * self.p.get(w, self.unseen)

    def score(self, text):
        x = [START, *(text or "").encode().lower().split(), END]
        return sum(math.log10(self.chance(*p)) for p in zip(x, x[1:]))


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "THE", "the"]
    chance = 1 / np.arange(1, len(words) + 1)
    out = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=chance / chance.sum()))) for i in range(120)]
    return out + [(500, None), (501, ""), (502, "unheard of words \t only"), (3, out[3][1])]


@pytest.mark.parametrize("shipped", [katz.SHIPPED, 10])
def test_scores_match_a_dictionary_model(spark, rows, monkeypatch, shipped):
    monkeypatch.setattr(katz, "SHIPPED", shipped)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(katz, "PIECE", 400)
    monkeypatch.setattr(katz, "HOT", 0.05)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = Model([t for i, t in rows if not held(i)])
    got = katz.score(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for row in got:
        tokens = [*(texts[row.doc_id] or "").encode().lower().split(), END]
        assert row.held_out == held(row.doc_id)
        assert row.n_tokens == len(tokens) and row.n_known == sum(w in model.c for w in tokens)
        assert row.train_tokens == model.n
        base = sum(math.log10((model.c[w] + 1) / (model.n + len(model.c) + 1)) for w in tokens)
        assert row.base_score == pytest.approx(base)
        assert row.score == pytest.approx(model.score(texts[row.doc_id]))


def test_each_context_sums_to_one(rows):
    model = Model([t for i, t in rows if not held(i)])
    for v in [*model.next, "never seen"]:
        assert sum(model.chance(v, w) for w in model.p) + model.chance(v, None) == pytest.approx(1)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score int")
    assert katz.score(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = katz.score(odd).collect()
    assert len(got) == 3 and sum(r.doc_id is None and r.held_out for r in got) == 1
