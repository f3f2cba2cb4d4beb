"""Secrets in texts: fixed patterns, and strings whose characters look drawn at random.

Everything is a DataFrame expression inside the row: no shuffle, no Python. The patterns give the
base spans. Besides, every run of 20 or more key characters is a candidate string. For each
character class in ``CLASSES`` its runs inside the candidate are folded character by character:
the fold holds the counts of the window's characters and the sum of ``c * log2 c`` over them, and
a character that enters or leaves changes two counts and two terms of the sum. Windows whose Shannon entropy
reaches the class's bound and which mix digits and letters as it asks are joined to spans of kind
``entropy``. Candidates that fit an allow-list (identifiers, slugs, numbers, placeholders) are left
out, and so are spans inside an access or hex span, which mark the same string. Inside an assignment a span says that
the value is random.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

# Fixed patterns. Those of access and hex match runs, so that the least length can be part of them.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Digits, lower-case and upper-case letters, signs: the code of a character is its place.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = "[0-9A-Za-z+/_=-]{20,}"


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars``; a window needs the entropy (bits) and so many characters of each sort."""

    chars: str
    window: int
    entropy: float
    digits: int
    lower: int
    upper: int
    letters: int

    @property
    def pattern(self) -> str:
        return f"{self.chars}{{{self.window},}}"

    @property
    def most(self) -> int:
        """Largest sum of ``c * log2 c`` (in millionths) of a window that is random enough."""
        return math.floor((math.log2(self.window) - self.entropy) * self.window * UNIT)


UNIT = 1_000_000
CLASSES = (
    CharClass("[0-9A-Fa-f]", 20, 3.0, digits=2, lower=0, upper=0, letters=2),
    CharClass("[0-9A-Za-z]", 20, 3.6, digits=3, lower=0, upper=0, letters=6),
    CharClass("[0-9A-Za-z+/_=-]", 24, 3.9, digits=1, lower=3, upper=3, letters=6),
)

#: Candidates that are no secrets: each pattern is for the whole string.
ALLOWED = (
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUID
    r"[0-9TZ/_=+-]+",  # numbers, dates, times
    r"[A-Za-z/_=+-]+[0-9]*",  # words, paths and slugs, with a number at most
    r"/?[A-Za-z]*(/[a-z0-9]+(-[a-z0-9]+)*)+/?",  # paths of words
    r"[0-9a-z]+(-[a-z]+)+(-[0-9]+)*",  # slugs
    r".*(?i:example|placeholder|0123456789|abcdefghij|qwertyuiop|xxxxxxxx).*",
)

_PLACE = "array<struct<start:int,end:int,text:string>>"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_RANGE = "array<struct<start:int,end:int>>"
#: Matches whose places are summed in one fold; the folds of a text are joined block by block.
BLOCK = 256


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _places(text: Column, pattern: str, found: Column, value: Column) -> Column:
    """``start``, ``end`` (code points) of the matches ``found`` in order, each with its ``value``.

    A match starts after all gaps and matches before it; splitting by the same pattern gives the gaps.
    """
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), F.length).alias("gap"),
        F.transform(found, F.length).alias("length"),
        value.alias("text"),
    )
    blocks = F.transform(F.sequence(F.lit(1), F.size(found), F.lit(BLOCK)), lambda i: F.slice(parts, i, BLOCK))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        here = F.struct(start.alias("start"), (start + part["length"]).alias("end"), part["text"].alias("text"))
        return F.struct(F.concat(state["done"], F.array(here)).alias("done"), (start + part["length"]).alias("at"))

    def join(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(F.array().cast(_PLACE).alias("done"), state["at"].alias("at")), step)
        return F.struct(F.concat(state["done"], inner["done"]).alias("done"), inner["at"].alias("at"))

    none = F.struct(F.array().cast(_PLACE).alias("done"), F.lit(0).alias("at"))
    return F.when(F.size(found) > 0, F.aggregate(blocks, none, join)["done"]).otherwise(F.array().cast(_PLACE))


def _random_windows(text: Column, kind: CharClass) -> Column:
    """Joined windows of a run of the class's characters that are random enough."""
    # Entropy of a window = log2 W - (sum of c * log2 c) / W; the terms are whole numbers, so sums are exact.
    terms = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(kind.window + 1)])
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET), x) - 1)
    moves = F.transform(
        codes, lambda x, i: F.struct(x.alias("enter"), F.coalesce(F.get(codes, i - kind.window), F.lit(-1)).alias("leave"), i.alias("at"))
    )

    def within(code: Column, low: int, high: int) -> Column:
        return ((code >= low) & (code < high)).cast("int")

    def step(state: Column, move: Column) -> Column:
        enter, leave, counts = move["enter"], move["leave"], state["counts"]
        into, out_of = F.get(counts, enter), F.coalesce(F.get(counts, leave), F.lit(0))
        change = F.when(enter == leave, F.lit(0).cast("long")).otherwise(
            F.get(terms, into + 1) - F.get(terms, into) + F.get(terms, F.greatest(out_of - 1, F.lit(0))) - F.get(terms, out_of)
        )
        return F.struct(
            F.transform(counts, lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int")).alias("counts"),
            (state["total"] + change).alias("total"),
            (state["digits"] + within(enter, 0, 10) - within(leave, 0, 10)).alias("digits"),
            (state["lower"] + within(enter, 10, 36) - within(leave, 10, 36)).alias("lower"),
            (state["upper"] + within(enter, 36, 62) - within(leave, 36, 62)).alias("upper"),
            F.when(state["hit"], _joined(state["found"], state["at"] - kind.window + 1, state["at"] + 1)).otherwise(state["found"]).alias("found"),
            move["at"].alias("at"),
            _enough(kind, move["at"], state, enter, leave, change).alias("hit"),
        )

    def _enough(kind: CharClass, at: Column, state: Column, enter: Column, leave: Column, change: Column) -> Column:
        digits = state["digits"] + within(enter, 0, 10) - within(leave, 0, 10)
        lower = state["lower"] + within(enter, 10, 36) - within(leave, 10, 36)
        upper = state["upper"] + within(enter, 36, 62) - within(leave, 36, 62)
        return (
            (at >= kind.window - 1) & (state["total"] + change <= kind.most) & (digits >= kind.digits)
            & (lower >= kind.lower) & (upper >= kind.upper) & (lower + upper >= kind.letters)
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("digits"),
        F.lit(0).alias("lower"), F.lit(0).alias("upper"), F.array().cast(_RANGE).alias("found"), F.lit(-1).alias("at"), F.lit(False).alias("hit"),
    )
    # A window is added by the step after it.
    return F.aggregate(
        moves, start, step,
        lambda s: F.when(s["hit"], _joined(s["found"], s["at"] - kind.window + 1, s["at"] + 1)).otherwise(s["found"]),
    )


def _joined(found: Column, start: Column, end: Column) -> Column:
    """``found`` with one more range, joined to the last one where they touch; starts ascend."""
    last = F.element_at(found, -1)
    touches = (F.size(found) > 0) & (F.coalesce(F.try_element_at(found, F.lit(-1))["end"], F.lit(-1)) >= start)
    new = F.array(F.struct(start.alias("start"), end.alias("end")))
    grown = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end")))
    return F.when(touches, F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), grown)).otherwise(F.concat(found, new))


def _shifted(ranges: Column, by: Column) -> Column:
    return F.transform(ranges, lambda r: F.struct((r["start"] + by).alias("start"), (r["end"] + by).alias("end")))


def _runs(text: Column, pattern: str) -> Column:
    found = _matches(text, pattern)
    return _places(text, pattern, found, found)


def _entropy_ranges(candidates: Column) -> Column:
    """Ranges in the text of what is random in any class, joined over the classes."""
    def of(candidate: Column) -> Column:
        per_class = [
            F.flatten(F.transform(_runs(candidate["text"], kind.pattern), lambda run: _shifted(_random_windows(run["text"], kind), run["start"] + candidate["start"])))
            for kind in CLASSES
        ]
        return F.concat(*per_class)

    every = F.sort_array(F.flatten(F.transform(candidates, of)))
    return F.aggregate(every, F.array().cast(_RANGE), lambda found, r: _joined(found, r["start"], r["end"]))


def _spans(places: Column, kind: int) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")))


def span_string(spans: Column) -> Column:
    """``kind:start:end`` in the array's order, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``start, kind, end``, ordered by start and kind.

    Positions are code points, ``end`` is exclusive, ``kind`` is a place in ``KINDS``. Nulls and empty texts have no spans;
    whole texts are scanned, however long. Repeated rows are judged each on its own, an empty table gives an empty one. All
    columns stay; own columns called ``base`` and ``spans`` are replaced, and no other name matters.
    ``allowed`` are patterns of whole candidate strings that are no secrets; base spans stay whatever they hold.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans")]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidates": CANDIDATE}
    # The matches are columns of their own, so that each pattern is searched once.
    row = row.select("row", "t", *[_matches(F.col("t"), p).alias(name) for name, p in patterns.items()])
    row = row.withColumn("values", F.when(F.size("assign") > 0, _matches(F.col("t"), ASSIGN, 2)))
    row = row.select("row", *[
        _places(F.col("t"), p, F.col(name), F.col("values" if name == "assign" else name)).alias(name) for name, p in patterns.items()
    ])
    listed = "^(?:" + "|".join(allowed) + ")$"
    row = row.select(
        "row",
        F.sort_array(F.concat(
            _spans(F.filter("assign", lambda p: F.length(p["text"]) >= LEAST_VALUE), 0), _spans(F.col("access"), 1), _spans(F.col("hex"), 2),
        )).alias("base"),
        (F.filter("candidates", lambda p: ~p["text"].rlike(listed)) if allowed else F.col("candidates")).alias("candidates"),
    )
    row = row.select("row", "base", F.when(F.size("candidates") > 0, _entropy_ranges(F.col("candidates"))).otherwise(F.array().cast(_RANGE)).alias("ranges"))
    known = F.filter("base", lambda s: s["kind"] > 0)
    new = F.filter("ranges", lambda r: ~F.exists(known, lambda s: (s["start"] <= r["start"]) & (s["end"] >= r["end"])))
    return row.select("row.*", "base", F.sort_array(F.concat("base", _spans(new, 3))).alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as a string, for every row of ``docs(doc_id, text)``.

    Cases are those of ``find``: null and empty texts give zeros, the digest of the empty string, and an empty string.
    """
    found = find(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(span_string(F.col("base")), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in SQL, where each window's entropy is counted from its characters."""

    def places(name: str, source: str, key: str, text: str, pattern: str, group: int = 0) -> str:
        p = pattern.replace("'", "''")
        return f"""
{name}_m AS (SELECT {key}, regexp_extract_all({text}, '{p}', 0) AS m, regexp_extract_all({text}, '{p}', {group}) AS g, string_split_regex({text}, '{p}') AS gaps FROM {source}),
{name}_i AS (SELECT {key}, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name} AS (
  SELECT {key}, g[i] AS s, length(m[i]) AS n,
    coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
  FROM {name}_i)"""

    steps = [
        "d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents)",
        places("assign", "d", "r", "t", ASSIGN, 2), places("access", "d", "r", "t", ACCESS), places("hex", "d", "r", "t", HEX),
        places("cand", "d", "r", "t", CANDIDATE),
        f"""
base AS (
  SELECT r, start, 0 AS kind, start + n AS stop FROM assign WHERE length(s) >= {LEAST_VALUE}
  UNION ALL SELECT r, start, 1, start + n FROM access UNION ALL SELECT r, start, 2, start + n FROM hex)""",
        "c AS (SELECT r, start AS c0, s AS cs FROM cand WHERE NOT regexp_matches(s, '^(?:" + "|".join(ALLOWED) + ")$'))",
    ]
    windows = []
    for k, kind in enumerate(CLASSES):
        terms = ", ".join(str(round(c * math.log2(c) * UNIT)) for c in range(1, kind.window + 1))
        steps += [
            places(f"run{k}", "c", "r, c0", "cs", kind.pattern),
            f"win{k} AS (SELECT r, c0 + start AS o, s, unnest(range(0, n - {kind.window} + 1)) AS w FROM run{k})",
            f"chr{k} AS (SELECT r, o + w AS a, unnest(string_split(substr(s, w + 1, {kind.window}), '')) AS ch FROM win{k})",
            f"cnt{k} AS (SELECT r, a, ch, count(*) AS c FROM chr{k} GROUP BY r, a, ch)",
            f"""
hit{k} AS (
  SELECT r, a, a + {kind.window} AS b FROM cnt{k} GROUP BY r, a
  HAVING sum(([{terms}])[c]) <= {kind.most} AND sum(CASE WHEN regexp_matches(ch, '[0-9]') THEN c ELSE 0 END) >= {kind.digits}
    AND sum(CASE WHEN regexp_matches(ch, '[a-z]') THEN c ELSE 0 END) >= {kind.lower} AND sum(CASE WHEN regexp_matches(ch, '[A-Z]') THEN c ELSE 0 END) >= {kind.upper}
    AND sum(CASE WHEN regexp_matches(ch, '[A-Za-z]') THEN c ELSE 0 END) >= {kind.letters})""",
        ]
        windows.append(f"SELECT r, a, b FROM hit{k}")
    steps += [
        f"hits AS ({' UNION '.join(windows)})",
        "edges AS (SELECT r, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM hits)",
        "islands AS (SELECT r, a, b, sum(first) OVER (PARTITION BY r ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM edges)",
        "ranges AS (SELECT r, min(a) AS start, 3 AS kind, max(b) AS stop FROM islands GROUP BY r, island)",
        """
every AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM ranges x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.kind > 0 AND b.start <= x.start AND b.stop >= x.stop))""",
        f"named AS (SELECT *, (['{KINDS[0]}', '{KINDS[1]}', '{KINDS[2]}', '{KINDS[3]}'])[kind + 1] || ':' || start || ':' || stop AS span FROM every)",
        """
found AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY r)""",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (r)"""


SQL = _sql()
