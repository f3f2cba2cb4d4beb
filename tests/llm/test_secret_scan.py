"""Secret scans against a plain search that counts each window anew."""

import hashlib
import math
import random
import re
from collections import Counter

from gleaner.llm import secret_scan as S

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PYTHON = [p.replace("(?i:", "(?ai:") for p in S.ALLOWED]


def brute(text):
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    hits = set()
    for m in re.finditer(r"[0-9A-Za-z+/_=-]{20,}", text):
        if any(re.fullmatch(p, m.group(), re.S) for p in PYTHON):
            continue
        for k in S.CLASSES:
            for run in re.finditer(k.pattern, m.group()):
                for w in range(run.start(), run.end() - k.window + 1):
                    part = m.group()[w : w + k.window]
                    total = sum(round(c * math.log2(c) * S.UNIT) for c in Counter(part).values())
                    lower, upper = sum("a" <= c <= "z" for c in part), sum("A" <= c <= "Z" for c in part)
                    if total <= k.most and sum(c.isdigit() for c in part) >= k.digits and lower >= k.lower and upper >= k.upper and lower + upper >= k.letters:
                        hits.add((m.start() + w, m.start() + w + k.window))
    ranges = []
    for a, b in sorted(hits):
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(b, ranges[-1][1])
        else:
            ranges.append([a, b])
    new = [(a, 3, b) for a, b in ranges if not any(k in (1, 2) and x <= a and y >= b for x, k, y in base)]
    name = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*counts, hashlib.sha256(name(base).encode()).hexdigest(), name(base + new))


def texts():
    rnd = random.Random(5)
    key = lambda n, chars=S.ALPHABET[:62]: "".join(rnd.choice(chars) for _ in range(n))
    out = [
        None, "", " ", "secret=token: abcdefgh", "Password = 'hunter22' and PASSWD:short token==x1y2z3", "api_key:'é' apikey=\"aé",
        "AKIA" + "A" * 15, "xAKIAAKIA" + key(16, "ABC123"), "0" * 23, "é𝛑 " + "0123456789abcdef" * 2, "f" * 24 + "G" + "a" * 23,
        "123e4567-e89b-12d3-a456-426614174000", "the-quick-brown-fox-jumps-over-the-lazy-dog", "2024/05/06T12:00:00Z 20240506120000112233",
        "internationalization2021 /docs/v2/internationalization-guide-2021", "𝛑" + key(40) + " " + key(20, S.ALPHABET[:36]), key(19), key(64, S.ALPHABET),
        "TOKEN = \"" + key(40, "0123456789ABCDEF") + "\"!!", "abcdefghijklmnopqrstuvwxyz0123456789", "ſecret=abcdefgh toKen=abcdefgh", "a\x00b token:\n=abcdef",
        " ".join("token=" + key(8) for _ in range(700)), key(3000) + "!" + key(30),
    ]
    parts = ["token", "secret", "=", ":", " ", "'", "AKIA", "é", "ab", "0f", "-", "/", "+", "\n"]
    for _ in range(150):
        out.append("".join(rnd.choice(parts) if rnd.random() < 0.7 else key(rnd.randrange(1, 45), S.ALPHABET[: rnd.choice([16, 36, 62, 67])]) for _ in range(rnd.randrange(30))))
    return out


def test_scans_equal_brute_force(spark):
    given = texts()
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in S.secrets(rows).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        assert got[i] == brute(text or ""), text
    assert sum("entropy" in v[4] for v in got.values()) > 20


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "token=abcdef"), (1, "token=abcdef"), (None, "x"), (None, None)], "doc_id long, text string")
    got = S.secrets(rows).collect()
    assert sorted(r.n_assign for r in got) == [0, 0, 1, 1]
    assert S.secrets(rows.limit(0)).collect() == []


def test_extra_columns_stay_whatever_their_names(spark):
    names = ["row", "t", "assign", "access", "hex", "candidates", "values", "ranges", "base", "spans", "a.b"]
    rows = spark.createDataFrame([(1, "token=abcdef", *range(len(names)))], ["doc_id", "text", *names])
    got = S.find(rows)
    assert got.columns == ["doc_id", "text", *[n for n in names if n not in ("base", "spans")], "base", "spans"]
    row = got.first()
    assert row["assign"] == 2 and row["a.b"] == 10 and [tuple(s) for s in row["base"]] == [(0, 0, 12)]


def test_allow_list_is_a_parameter(spark):
    rows = spark.createDataFrame([(1, "id 7fK29xQm4LpZ81vTb6Wn03Rc")], "doc_id long, text string")
    assert len(S.find(rows).first().spans) == 1
    assert S.find(rows, allowed=("7fK.*",)).first().spans == []
    assert len(S.find(rows, allowed=()).first().spans) == 1


def test_no_python_and_no_shuffle_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = S.secrets(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
