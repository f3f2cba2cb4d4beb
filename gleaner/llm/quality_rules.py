"""Quality rules as a learned decision list, in DataFrame functions only.

``measure`` counts what the rules look at, inside each row and without a shuffle. ``learn`` grows
rules by sequential covering: a conjunction of thresholds gets the condition with the
largest information gain (FOIL) on the growing part, is cut back to its best prefix on the pruning
part, and is kept while it is precise there. ``verdict`` is the ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Largest number of labelled documents that rules are learned from, the first by hash of the id.
LABELLED = 20_000
#: Cuts of each feature, at its quantiles among the good and among the bad.
CUTS = 32
MAX_RULES, MAX_CONDITIONS = 16, 4
#: A rule is kept when it covers this many bad documents of the pruning part, this precisely.
LEAST_COVERED, LEAST_PRECISION = 5, 0.97

#: What rules may look at, from the counts of ``measure``.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "capitals": "n_capitals / word_chars",
    "digits": "n_digits / word_chars",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "words_per_line": "n_words / n_lines",
    "different_words": "n_different / n_words",
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts in columns of two underscores before the name; null texts count as empty.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` as the query defines them, and ``n_lines`` (lines with
    a word), ``n_marks`` (``!`` and ``?``), ``n_capitals`` (A-Z), ``n_digits`` (0-9), ``n_different`` (different words).
    """
    df = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    starts = F.when(F.size("__h") >= WINDOW, F.sequence(F.lit(0), F.size("__h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__s", F.transform(starts, lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(WINDOW)])))
    # Windows in order of their hash: those next to an equal one occur twice or more.
    repeats = F.size(F.array_distinct("__s")) < F.size("__s")
    df = df.withColumn("__o", F.when(repeats, F.sort_array(F.transform("__s", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.transform(
        F.filter("__o", lambda x, k: (x["h"] == F.get("__o", k + 1)["h"]) | (k > 0) & (x["h"] == F.get("__o", F.greatest(k - 1, F.lit(0)))["h"])),
        lambda x: x["i"],
    )
    df = df.withColumn("__p", F.sort_array(at))
    # A word is counted once, however many of its windows repeat.
    covered = F.aggregate(
        F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )

    def count(pattern: str) -> Column:
        return F.regexp_count("__t", F.lit(pattern)).cast("long")

    counts = (
        F.size("__w").cast("long").alias("__n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("__word_chars"),
        count(r"[#*$%&|<>]").alias("__n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("__n_repeat_words"),
        F.size("__l").cast("long").alias("__n_lines"),
        count("[!?]").alias("__n_marks"),
        count("[A-Z]").alias("__n_capitals"),
        count("[0-9]").alias("__n_digits"),
        F.size(F.array_distinct("__h")).cast("long").alias("__n_different"),
    )
    # The row number keeps filters on the counts above them: pushed down, they would count again.
    return df.select(*docs.columns, *counts, F.monotonically_increasing_id().alias("__row"))


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))


def feature(name: str) -> Column:
    """A feature from the counts of ``measure``; 0 for texts without words."""
    above, _, below = FEATURES[name].partition(" / ")
    value = F.col(f"__{above}").cast("double")
    return F.coalesce(value / F.nullif(F.col(f"__{below}").cast("double"), F.lit(0.0)), F.lit(0.0)) if below else value


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


def _gain(good0: int, bad0: int, good: int, bad: int) -> float:
    """FOIL's gain of narrowing a rule for the bad."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[Condition, int]]:
    """Conditions with the bin that each one stands for; one histogram of bounded size a step."""
    rule: list[tuple[Condition, int]] = []
    names = list(FEATURES)
    covered = rows
    while len(rule) < MAX_CONDITIONS:
        found = covered.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(
            F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")
        ).collect()
        table = {(r.f, r.bin): (r.good, r.bad) for r in found}
        good0, bad0 = (sum(v[i] for (f, _), v in table.items() if f == 0) for i in (0, 1))
        if not bad0 or not good0:
            break
        best = (1e-9, None)
        for f, name in enumerate(names):
            good = bad = 0
            for b, cut in enumerate(cuts[name]):
                good, bad = (x + y for x, y in zip((good, bad), table.get((f, b), (0, 0))))
                below, beyond = _gain(good0, bad0, good, bad), _gain(good0, bad0, good0 - good, bad0 - bad)
                if below > best[0]:
                    best = (below, (f, b, False, cut))
                # Of equally good cuts the one that rejects least.
                if beyond > best[0] or beyond == best[0] and best[1] and best[1][0] == f and best[1][2]:
                    best = (beyond, (f, b, True, cut))
        if best[1] is None:
            break
        f, b, above, cut = best[1]
        rule.append((Condition(names[f], above, cut), b))
        value = F.get("bins", F.lit(f))
        covered = covered.filter(value > b if above else value <= b)
    return rule


def _between(rules: list[list[Condition]], rows: DataFrame) -> list[list[Condition]]:
    """The same rules with each cut moved midway between the labelled values on both sides of it."""
    conditions = [c for rule in rules for c in rule]
    if not conditions:
        return rules
    row = rows.agg(*[
        edge(F.when(F.col(c.feature) > c.cut if above else F.col(c.feature) <= c.cut, F.col(c.feature))).alias(f"{i}{above}")
        for i, c in enumerate(conditions) for edge, above in ((F.max, False), (F.min, True))
    ]).first()
    moved = iter([
        c if row[f"{i}False"] is None or row[f"{i}True"] is None else Condition(c.feature, c.above, (row[f"{i}False"] + row[f"{i}True"]) / 2)
        for i, c in enumerate(conditions)
    ])
    return [[next(moved) for _ in rule] for rule in rules]


def _meets(rule: list[tuple[Condition, int]]) -> Column:
    names, out = list(FEATURES), F.lit(True)
    for condition, b in rule:
        value = F.get("bins", F.lit(names.index(condition.feature)))
        out = out & (value > b if condition.above else value <= b)
    return out


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> list[list[Condition]]:
    """Rules for documents to reject, the first that fits decides.

    Learned from at most ``LABELLED`` ids of ``labels(doc_id, quality)``; an id with several labels
    counts as bad if any is 0, nulls are left out. Two thirds grow the rules and
    one third prunes them. Without good or without bad labels there are no rules.
    """
    sample = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")
    )
    sample = scratch.save(sample.orderBy(F.xxhash64("__id"), "__id").limit(LABELLED), "sample")
    known = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(sample), "__id")
    rows = scratch.save(measure(known).select("__id", "bad", base_failed().alias("failed"), *[feature(n).alias(n) for n in FEATURES]), "labelled").filter("NOT failed")
    grow = F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(3)) > 0
    quantiles = [i / CUTS for i in range(CUTS)]
    # Where most good documents have none of something, only the bad ones' quantiles tell amounts apart.
    found = rows.filter(grow).groupBy("bad").agg(*[F.percentile_approx(n, quantiles, 10_000).alias(n) for n in FEATURES]).collect()
    if len(found) < 2:
        return []
    cuts = {n: sorted({x for row in found for x in row[n]}) for n in FEATURES}
    bins = F.array(*[
        F.aggregate(F.array(*[(F.col(n) > c).cast("int") for c in cuts[n]]), F.lit(0), lambda a, x: a + x) for n in FEATURES
    ])
    rows = scratch.save(rows.select(bins.alias("bins"), "bad", grow.alias("grow"), *FEATURES), "binned")
    rules, left = [], rows
    while len(rules) < MAX_RULES:
        rule = _grow(left.filter("grow"), cuts)
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        row = left.filter("NOT grow").agg(*[
            F.sum(F.when(_meets(p), value).otherwise(0)).alias(f"{kind}{i}")
            for i, p in enumerate(prefixes) for kind, value in (("bad", F.col("bad")), ("all", F.lit(1)))
        ]).first()
        scores = [(row[f"bad{i}"] or 0, row[f"all{i}"] or 0) for i in range(len(prefixes))]
        worth = [(2 * bad - n) / n if n else -1.0 for bad, n in scores]
        i = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        bad, n = scores[i]
        if bad < LEAST_COVERED or bad < LEAST_PRECISION * n:
            break
        rules.append([condition for condition, _ in prefixes[i]])
        left = left.filter(~_meets(prefixes[i]))
    rules = _between(rules, rows)
    scratch.drop("sample", "labelled", "binned")
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered conditional expression: false where the first rule that fits rejects."""
    out = F.lit(True)
    for rule in reversed(rules):
        fits = F.lit(True)
        for condition in rule:
            fits = fits & condition.column()
        out = F.when(fits, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base counts, ``base_failed`` and ``kept`` for every row of ``docs(doc_id, text)``.

    A null or empty text has no words and fails. Repeated rows and rows without id are judged
    like any other. Other columns are ignored; an empty table gives an empty one.
    """
    rules = learn(docs, labels, Scratch(docs.sparkSession))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measure(docs.select("doc_id", "text")).select(
        "doc_id", *[F.col(f"__{c}").alias(c) for c in base], base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rules = learn(docs, labels, Scratch(docs.sparkSession))
    return measure(docs).filter((F.col("__row") >= 0) & ~base_failed() & verdict(rules)).select(*docs.columns)
