"""Mixing sources to target weights by hash-threshold histograms, without a sort.

Each source gets a target number of words; the targets are filled from the weights like water
under ceilings of ``most`` times the source's size. A source takes all of its documents
``floor(target / size)`` times and, for the rest, those whose hash lies at or below a threshold.
The threshold comes from histograms: words are summed by source and leading hash bits, the bucket
in which the running sum passes the rest is found, and only the documents of that bucket are
summed again by the next bits. All of this is aggregation; nothing is ordered but one source's
``2 ** BITS`` buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.ordering import row_number
from gleaner.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, BITS = 60, 10
#: Sources shipped to every task; a longer list is joined.
SHIPPED_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def position_of(doc_id: Column, text: Column, seed: str) -> Column:
    """The document's place in its source's random order: the first 60 bits of an MD5.

    A document without id is placed by its text.
    """
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _shipped(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SHIPPED_SOURCES else df


def targets(sizes: DataFrame, weights: tuple[float, ...], percent: int, most: float) -> DataFrame:
    """``source, source_size, weight, target`` from ``sizes(source, source_size)``.

    Weights go round by the sources' order by code point, null last. A target above ``most``
    times the source's size stops there, and what it leaves is shared again by weight. Each
    round is one aggregate that sends one row to the driver.
    """
    ranked = row_number(sizes, [F.col("source").asc_nulls_last()], name="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"))
    ceiling = F.col("source_size") * float(most)
    level, capped = 0.0, -1
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    while True:
        full = F.lit(level) * F.col("weight") >= ceiling if capped >= 0 else F.lit(False)
        row = ranked.agg(
            F.sum(full.cast("long")).alias("n"), F.sum(F.when(full, ceiling).otherwise(0.0)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not row.open or row.n == capped:
            break
        capped, level = row.n, (total - row.held) / row.open
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), ceiling))


def thresholds(sized: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``source, threshold``: words at or below it come nearest to ``wanted(source, rest)``.

    ``sized`` has ``source, size, position``. Documents of equal position go together. A
    source without a row in the result takes all.
    """
    # Buckets are found from the leading bits on; `before` words lie below the open bucket.
    state = wanted.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    open_rows, depth = sized.filter("size > 0"), 0
    while depth < HASH_BITS:
        depth += BITS
        shift = HASH_BITS - depth
        n = state.count()
        keyed = open_rows.join(_shipped(state.withColumnRenamed("source", "__source"), n), F.col("source").eqNullSafe(F.col("__source")))
        if depth > BITS:
            keyed = keyed.filter(F.shiftright("position", shift + BITS) == F.col("prefix"))
        counted = keyed.groupBy("source", "rest", "before", F.shiftright("position", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        crossing = counted.withColumn("upto", F.col("before") + F.sum("words").over(upto)).filter("upto > rest")
        first = crossing.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "rest")).alias("x"))
        state = scratch.save(
            first.select("source", "x.rest", F.col("x.bucket").alias("prefix"), (F.col("x.upto") - F.col("x.words")).alias("before"), "x.words"), f"level-{depth}"
        )
    # The bucket is now one position: take it if that comes nearer than leaving it.
    nearer = F.col("before") + F.col("words") / 2 <= F.col("rest")
    return state.select("source", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def plan(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (3, 1, 2), percent: int = 150, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, size, position`` of all rows, one row of decisions per source).

    The decisions: ``source, source_size, target``, ``whole`` (times that every document is
    taken) and ``threshold`` (positions up to it are taken once more; null: all).
    """
    sized = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            size_of(F.col("text")).alias("size"), position_of(F.col("doc_id"), F.col("text"), seed).alias("position"),
        ),
        "sized",
    )
    sizes = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    wanted = targets(sizes, weights, percent, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = wanted.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    wanted = scratch.save(wanted, "wanted")
    found = thresholds(sized, wanted, scratch).withColumnRenamed("source", "__source")
    decided = wanted.join(found, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    return sized, scratch.save(decided, "decided")


def _copies(position: Column) -> Column:
    more = (position <= F.col("threshold")) | F.col("threshold").isNull() & (F.col("rest") > 0)
    return F.col("whole") + F.when(more, 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), percent: int = 150, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source)``.

    A null text has size 0, a null source is a source of its own, a document without id is
    placed by its text, and repeated rows go together. Other columns are ignored; an empty table gives an empty one.
    The taken words of a source differ from its target by at most half of its largest document.
    """
    scratch = Scratch(docs.sparkSession)
    sized, decided = plan(docs, scratch, weights, percent, most, seed)
    decided = decided.withColumnRenamed("source", "__source")
    out = sized.join(_shipped(decided, decided.count()), F.col("source").eqNullSafe(F.col("__source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("position"))).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), percent: int = 150, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed rows of ``docs``, all columns, each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession)
    _, decided = plan(docs, scratch, weights, percent, most, seed)
    decided = decided.select(F.col("source").alias("__source"), "whole", "threshold", "rest")
    joined = docs.join(_shipped(decided, decided.count()), docs["source"].cast("string").eqNullSafe(F.col("__source")))
    copies = _copies(position_of(docs["doc_id"], docs["text"], seed)).cast("int")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).drop("__copy")


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS position
  FROM documents),
sources AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
-- Water under ceilings: the level is right for the set of sources that it fills up.
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM sources),
sums AS (
  SELECT full_at, sum(2.0::DOUBLE * source_size) OVER w AS held, sum(weight) OVER () - sum(weight) OVER w AS open,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM ordered WINDOW w AS (ORDER BY full_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (
  SELECT 0.0::DOUBLE AS full_at, (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM sources) AS level
  UNION ALL SELECT full_at, (total - held) / open FROM sums WHERE open > 0),
level AS (
  -- the level that fills up those sources and no further one
  SELECT min(level) AS level FROM levels l WHERE l.level >= l.full_at AND NOT EXISTS (
    SELECT 1 FROM ordered o WHERE o.full_at > l.full_at AND l.level * o.weight >= 2.0::DOUBLE * o.source_size)),
wanted AS (
  SELECT source, source_size, least(coalesce(level, 0) * weight, 2.0::DOUBLE * source_size) AS target FROM sources, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM wanted),
places AS (
  SELECT source, position, words, sum(words) OVER (PARTITION BY source ORDER BY position) - words AS before
  FROM (SELECT source, position, sum(size) AS words FROM sized GROUP BY source, position))
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.whole + CASE WHEN c.before + c.words / 2 <= p.target - p.whole * p.source_size AND p.target > p.whole * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
JOIN places c ON s.source IS NOT DISTINCT FROM c.source AND s.position = c.position
"""
