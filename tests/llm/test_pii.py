"""Words that go with an entity, over whole documents."""

import numpy as np
import pytest

from gleaner.llm import pii


def words(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 400, n))


def terms_of(spans):
    return {tuple(map(int, s.split(":")[1:])) for s in (spans or "").split(",") if s.startswith("term:")}


def place(text, word, at=0):
    at = text.index(word, at)
    return at, at + len(word)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("shipped", [pii.SHIPPED, 1, 0])
def test_terms_far_from_the_entity_and_in_texts_without_it(spark, monkeypatch, shipped):
    monkeypatch.setattr(pii, "SHIPPED", shipped)
    rng = np.random.default_rng(1)
    rows = [(i, f"é mail {words(rng, 200)}") for i in range(200)]
    # The name stands at the top, the address 150 words below, and the name again at the bottom.
    rows += [(300 + i, f"é Zebulon Quixada {words(rng, 150)} mail zeb@corp.example {words(rng, 80)} Zebulon") for i in range(3)]
    rows += [(400, f"{words(rng, 20)} ñ zebulon {words(rng, 5)}"), (400, f"{words(rng, 20)} ñ zebulon {words(rng, 5)}"), (None, "Quixada"), (401, None), (402, "")]
    rows += [rows[-5]] * 2
    docs = frame(spark, rows)
    got = [(r.doc_id, r.spans) for r in pii.detect(docs).collect()]
    assert len(got) == len(rows)
    by_id = dict(got)
    for i, text in rows[200:203]:
        assert terms_of(by_id[i]) == {place(text, "Zebulon"), place(text, "Quixada"), place(text, "Zebulon", 30)}
    assert all(len(terms_of(s)) == 1 for i, s in got if i == 400 or i is None)
    assert not any(terms_of(by_id[i]) for i in (*range(200), 401, 402))
    clean = pii.sanitise(docs).collect()
    assert len(clean) == len(rows)
    assert not any("zebulon" in r.text.lower() or "Quixada" in r.text for r in clean if r.text)


def test_documents_with_the_same_signature_are_different_and_copies_are_not(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"mail {words(rng, 200)}") for i in range(200)]
    mark = "Best wishes Zebulon Quixada Head of Sales Corp Hall 7 Long Lane Farville write to zeb@corp.example"
    rows += [(300 + i, f"{words(rng, 30)} {mark}") for i in range(4)]
    original = f"Oriole Vex {words(rng, 40)} vex@corp.example".split(" ")
    for i in range(4):  # near copies: two other words changed in each
        copy = list(original)
        copy[8 * i + 5], copy[8 * i + 9] = f"w{i}", f"w{i + 9}"
        rows.append((400 + i, " ".join(copy)))
    rows += [(404, rows[-1][1])]
    docs = frame(spark, rows)
    got = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    for i, text in rows[200:204]:
        assert {place(text, w) for w in ("Zebulon", "Quixada", "Farville")} <= terms_of(got[i])
    assert not any(terms_of(got[i]) for i in (*range(200), *range(400, 405)))


def test_long_documents_of_one_vocabulary_are_different(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"mail {words(rng, 300)}") for i in range(60)]
    rows += [(300 + i, f"Zebulon {words(rng, 1000)} zeb@corp.example {words(rng, 1000)} Quixada") for i in range(4)]
    body = words(rng, 2000).split(" ")
    for i in range(4):  # near copies of a long one, with edits all over
        copy = list(body)
        for at in range(3 + i, 2000, 40):
            copy[at] = f"w{rng.integers(0, 400)}"
        rows.append((400 + i, f"Oriole {' '.join(copy)} vex@corp.example"))
    got = {r.doc_id: r.spans for r in pii.detect(frame(spark, rows)).collect()}
    for i, text in rows[60:64]:
        assert {place(text, "Zebulon"), place(text, "Quixada")} <= terms_of(got[i])
    assert not any(terms_of(got[i]) for i in (*range(60), *range(400, 404)))


@pytest.mark.parametrize("blocks", [(64, 1024), (3, 7)])
def test_a_page_with_many_entities_is_dealt_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(pii, "ENTITY_BLOCK", blocks[0])
    monkeypatch.setattr(pii, "TERM_BLOCK", blocks[1])
    rng = np.random.default_rng(4)
    rows = [(i, f"mail {words(rng, 100)}") for i in range(150)]
    page = " ".join(f"Name{i} a{i}@corp.example {words(rng, 2)}" for i in range(400))
    rows += [(300, page), (301, f"{words(rng, 50)} Name7 {words(rng, 20)} a7@corp.example"), (302, f"Name9 {words(rng, 60)} a9@corp.example")]
    got = {r.doc_id: r.spans for r in pii.detect(frame(spark, rows)).collect()}
    for i, name in ((301, "Name7"), (302, "Name9")):
        assert place(dict(rows)[i], name) in terms_of(got[i])
    assert {place(page, "Name7 "), place(page, "Name9 ")} <= {(a, b + 1) for a, b in terms_of(got[300])}
    assert not any(terms_of(got[i]) for i in range(150))


def test_terms_with_empty_tables_and_clashing_columns(spark):
    docs = frame(spark, [(1, "Zeb a@b.example")])
    assert pii.detect(docs.limit(0)).collect() == [] and pii.sanitise(docs.limit(0)).collect() == []
    names = ["key", "extra", "entities", "terms", "context", "__key", "c0", "a.b"]
    wide = spark.createDataFrame([(i, f"Zebulon w{i} w{i + 1} w{i + 7} a@b.example", *range(len(names))) for i in range(3)], ["doc_id", "text", *names])
    found = pii.sanitise(wide)
    assert found.columns == wide.columns and {tuple(r)[2:] for r in found.collect()} == {tuple(range(len(names)))}
