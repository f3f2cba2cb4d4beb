"""Text operators against brute force, and their edge cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gleaner.llm import license_scan, mixing, near_dedup, pieces, pii, quality_model, quality_rules, text, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    """Ordinary texts, copies, near copies of two large groups, chains, and everything odd."""
    rng = np.random.default_rng(1)
    out = [(i, prose(rng, int(rng.integers(1, 120))), "en", f"s{i % 5}", 0) for i in range(60)]
    base = prose(rng, 200).split()
    for i in range(60, 110):  # near copies of one text
        changed = list(base)
        for j in rng.integers(0, 200, int(rng.integers(0, 9))):
            changed[j] = f"x{rng.integers(1000)}"
        out.append((i, " ".join(changed), "en", "s0", 0))
    out += [(i, out[5][1], "de", "s0", 0) for i in range(110, 130)]  # exact copies
    long = prose(rng, 4000)
    chain = [f"c{i}" for i in range(100)]
    for i in range(130, 136):  # each next one is near the last, the ends are far apart
        out.append((i, " ".join(chain), "fr", None, 0))
        chain = chain[5:] + [f"d{i}-{j}" for j in range(5)]
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n", "en", "s1", 0), (203, "One two", "en", "s1", 0), (204, "oNE  TWO", "en", "s1", 0),
            (205, long, "en", "s2", 0), (206, long + " and more", "en", "s2", 0), (None, "no id here", "en", "s2", 0), (3, out[3][1], "en", "s3", 0)]
    return out


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(4)


# ------------------------------------------------------------------ near copies


def sets_of(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 7])
def test_near_copies_match_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    if block == 7:
        monkeypatch.setattr(near_dedup, "SHIPPED_IDS", 0)
    sets = {i: sets_of(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), top(row.doc_id))
            assert row.kept == (row.doc_id == row.component_id)
    kept = near_dedup.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, {i for i in sets if top(i) == i} | {None}))


def test_registers_estimate_similarity_and_merge():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.9):
        a = np.sort(text.mix(rng.integers(0, 2**62, 3000).astype(np.uint64)))
        b = np.sort(np.concatenate((a[: int(3000 * share)], text.mix(rng.integers(0, 2**62, 3000 - int(3000 * share)).astype(np.uint64)))))
        both = np.unique(np.concatenate((a, b)))
        sets = np.concatenate((a, b, both))
        r = near_dedup.registers(sets, np.array([0, 3000, 6000, len(sets)]))
        assert (np.maximum(r[0], r[1]) == r[2]).all()
        more, fewer = np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()])
        best, _ = near_dedup.likely_similarity(more, fewer, np.array([3000]), np.array([3000]), 0.75)
        assert abs(best[0] - 3000 * share / (6000 - 3000 * share)) < 0.12


# ------------------------------------------------------------------ quality rules


def counts_of(t):
    w = words_of(t)
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_rules(spark):
    rng = np.random.default_rng(3)
    good = [(i, prose(rng, int(rng.integers(25, 90)), 5000) + ".\nünd wörter") for i in range(240)]
    bad = [(i, " ".join(f"W{j}!!" for j in rng.integers(0, 5000, 60))) for i in range(240, 300)]
    odd = [(400, None), (401, ""), (402, "a b c " * 40), (403, "x\nx\n \nx y # * $"), (404, "one two three four five six seven eight nine " * 3 + prose(rng, 60, 9999)), (None, good[0][1])]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in good + bad + odd])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(0, 1), (None, 0), (5, None)], "doc_id long, quality int")
    texts = dict(good + bad + odd)
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(good) + len(bad) + len(odd)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_of(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id < 240)
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == {r.doc_id for r in got if r.kept}
    for none in (labels.limit(0), labels.filter("quality = 1")):
        assert all(r.kept != r.base_failed for r in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(docs.limit(0), labels).collect() == []
    plan = quality_rules.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("ArrowEvalPython", "Python"))


# ------------------------------------------------------------------ personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_of(t):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(4)
    pieces_ = ["a@b.c", "a.b+c@d-e.f.g", "@x.y", "q@r", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "é", " ", ".", "-", "7", "\n", "ab"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces_, rng.integers(1, 9)))
        assert pii.span_string(pii.base_spans(t)) == spans_of(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 1000) == []


def test_terms_that_disclose_an_entity(spark):
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, 30), "en", "s", 0) for i in range(300)]
    rows += [(300 + i, f"{prose(rng, 12)} Zebulon 77x mail zeb@corp.example {prose(rng, 12)}", "en", "s", 0) for i in range(4)]
    rows += [(400 + i, f"copied Quentin wrote from q@corp.example {rows[0][1]}", "en", "s", 0) for i in range(3)]  # one context
    rows += [(500, None, "en", "s", 0), (None, "x@y.z", "en", "s", 0), (501, "", None, None, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    texts = {i: t for i, t, *_ in rows}
    for i, r in got.items():
        base = spans_of(texts[i])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    for i in range(300, 304):
        at = texts[i].index("Zebulon")
        assert f"term:{at}:{at + 7}" in got[i].spans
    assert all("term" not in got[i].spans for i in (*range(300), 400, 401, 402))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zebulon" not in clean[301] and "zeb@" not in clean[301] and "[EMAIL]" in clean[301]
    assert clean[5] == texts[5] and clean[500] is None and clean[None] == "[EMAIL]"
    assert pii.sanitise(docs).columns == docs.columns
    assert pii.detect(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ licenses


def test_license_places_and_labels(spark):
    rng = np.random.default_rng(6)
    notice = "Licensed under the Apache License, Version 2.0"
    bent = "licensed under the new apache license version 2.0"
    rows = [(1, f"{prose(rng, 50)} {notice}. {prose(rng, 5)} MIT-license CC BY", 1), (2, None, 0), (3, "", 0), (4, prose(rng, 300), 0), (5, f"é {bent}", 1),
            (6, "the GNU General Public License " * 30, 1), (None, "mit license", 0), (7, "apache\nlicense", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = {r.doc_id: r for r in license_scan.licenses(docs).collect()}
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
        places = sorted((j, label) for p, label in license_scan.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "apache-2.0" in got[1].labels and got[1].score == 1.0
    assert "apache-2.0" in got[5].labels and 0.8 <= got[5].score <= 1
    assert got[4].labels == "" and got[4].score == 0
    assert license_scan.licenses(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ URLs


def judged_by_rules(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.split("[?#]", rest)[0][len(host) :]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_url_rules_and_model(spark):
    urls = ["http://example.com/en/1", "https://www.Example.com/en/1", "ftp://a.example.com/en/x?q=/es/", "http://x.net/es/1", "http://x.net/de/1", "http://x.org?a#b", "http://x.com#/en/",
            "http://É.net/fr/é", "no scheme/com/", "://com/", "a://b://com/", None, "", "http://com/", "http://notcom/x"]
    urls += [f"http://site{i}.net/{p}/{i}" for i in range(40) for p in ("fr", "en")] + [f"http://shop{i}.com/{i}" for i in range(40)]
    rows = [(i, u, "<html>") for i, u in enumerate(urls)] + [(0, urls[0], "again"), (None, urls[3], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    by_id = {i: u for i, u, _ in rows}
    for r in got:
        host, path, rule, verdict = judged_by_rules(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    labelled = spark.createDataFrame([(f"http://a{i}.xyz/buy{i}", "block") for i in range(50)] + [(f"http://b{i}.xyz/read{i}", "allow") for i in range(50)] + [(None, "block"), ("x", None)], "url string, verdict string")
    new = spark.createDataFrame([(1, "http://a99.xyz/buy99"), (2, "http://b99.xyz/read99")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(new, labelled).collect()} == {1: "block", 2: "allow"}
    assert {r.verdict for r in url_filter.judge(new, labelled.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0)).collect() == []


# ------------------------------------------------------------------ mixing


def test_mix_matches_sql(spark, rows):
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    con = duckdb.connect()
    table = docs.toArrow()
    con.register("documents", table)
    want = con.execute(mixing.SQL).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want) == len(rows)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(round(r[4] / r[1]) for r in got if r[1]) + taken.filter("regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') = 0").count()
    assert mixing.mix(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ pieces


def lattice(vocabulary, t, alpha):
    names = {n: i for i, n in enumerate(vocabulary.names)}
    out = []

    def go(i, path, total):
        if i == len(t):
            out.append((path, total))
            return
        char = int(pieces._LENGTH[t[i]])
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in names:
                go(j, (*path, names[t[i:j]]), total + alpha * vocabulary.scores[names[t[i:j]]])
        if t[i : i + char] not in names:
            go(i + char, (*path, -1), total + alpha * vocabulary.scores[-1] * (char + 1))

    go(0, (), 0.0)
    norm = np.logaddexp.reduce([x for _, x in out])
    return {p: math.exp(x - norm) for p, x in out}


def test_samples_without_replacement_follow_the_lattice():
    vocabulary = pieces.load()
    t, n = b"hell", 6000
    chance = lattice(vocabulary, t, pieces.ALPHA)
    lattices = pieces.Lattices(vocabulary, pieces.ALPHA)
    found = pieces.sample_piece(lattices, np.frombuffer(t * n, np.uint8), np.arange(n + 1) * len(t), text.mix(np.arange(n).astype(np.uint64)), 2)
    drawn = [[tuple(lattices.edge_piece[p.edges].tolist()) for p in paths] for paths, _ in found]
    assert all(len(set(d)) == 2 for d in drawn)
    second = {b: sum(chance[a] * chance[b] / (1 - chance[a]) for a in chance if a != b) for b in chance}
    for number, want in ((0, chance), (1, second)):
        seen = Counter(d[number] for d in drawn)
        assert sum((seen[k] - n * p) ** 2 / (n * p) for k, p in want.items()) < 30


def test_pieces_round_trip_and_reruns(spark, rows):
    odd = [(900, "▁ mark  twice\n\n tab\tend ", "x", "y", 1), (901, "日本語 emoji 🎉 \u0000 é" + "a" * 100 + "ü" * 50, "x", "y", 1)]
    docs = frame(spark, rows + odd)
    got = pieces.sample(docs, k=3).collect()
    assert all(r.exact for r in got)
    texts = {i: t for i, t, *_ in rows + odd}
    back = pieces.decode(spark.createDataFrame(got).select("doc_id", "sample", "ids")).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    again = pieces.sample(docs.repartition(7), k=3).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.log_probability, r.ids)
    assert sorted(map(key, got)) == sorted(map(key, again))
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, set()).add(tuple(r.ids))
        assert r.log_inclusion <= 0
    assert by_doc[200] == {()} and len(by_doc[901]) == 3
    assert pieces.sample(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ quality model


def test_quality_model_learns_and_calibrates(spark):
    rng = np.random.default_rng(7)
    good = [(i, prose(rng, int(rng.integers(20, 200)), 3000), 1) for i in range(600)]
    bad = [(i, " ".join(f"{w.upper()} |" for w in prose(rng, int(rng.integers(10, 100))).split()), 0) for i in range(600, 900)]
    odd = [(1000, None, 5), (1001, "", 5), (None, "some words", 5), (7, good[7][1], 5)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.score(docs, labels).collect()
    assert len(got) == len(good) + len(bad) + len(odd)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id < 600) for r in held]) > 0.97
    for marks, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0)):
        assert {r.score for r in quality_model.score(docs, marks).collect()} == {want}
    assert quality_model.score(docs.limit(0), labels).collect() == []


def test_isotonic_pools_violators():
    got = quality_model.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(got) >= 0).all() and got[1] == got[2]
