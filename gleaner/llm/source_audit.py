"""How far the sources of a language differ in their words, from count-level bitmaps.

Terms are counted per (language, source); those in enough documents of the language are kept and
numbered by falling frequency, so that neighbours are alike in frequency. For each group and count the
numbers of its terms with that count are stored as bitsets of 64 (one row per group, chunk and count).
For two groups AND and popcount of their bitsets give the number of terms in each joint cell
(count here, count there), which is multiplied by the cell's difference; what a level shares with
no level of the other group has count 0 there, and the rest of the chunk has 0 in both. So no
term is compared by itself: rare terms, which are most of them, have few levels.

All shares are whole numbers: ``p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))`` with the group's sum ``N`` over
the ``V`` kept terms of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.ordering import row_number
from gleaner.llm.scratch import Scratch
from gleaner.llm.text import Words, pieces

#: Documents of a language that a kept term stands in, and ranks of terms that are listed (both part of the feature).
LEAST_DOCUMENTS, TOP_TERMS = 30, 50
PRIOR, SCALE = 5, 1_000_000_000
#: Terms of a bitset, bitsets of a task, and sources of a block; two blocks of sources meet in a task.
CHUNK, LOT, BLOCK = 64, 16, 64
#: Cells of joint counts that a task holds at once.
CELLS = 1 << 20
#: Rows of counts that a counting task holds before it passes them on, rows of a batch of them, and bytes of text counted at once.
HELD, ROWS, PIECE_BYTES = 150_000, 16_384, 2 << 20
#: Rows of groups that are shipped.
SHIPPED = 100_000

_NOT_TERM = np.ones(256, bool)
_NOT_TERM[0x80:] = _NOT_TERM[ord("A") : ord("Z") + 1] = _NOT_TERM[ord("a") : ord("z") + 1] = False

_COUNTS = "lang string, source string, term string, n long, docs long"
_NAMES = ["lang", "source", "term", "n", "docs"]


def _piece_counts(lang: pa.Array, source: pa.Array, groups: np.ndarray, piece: tuple[int, np.ndarray, np.ndarray]) -> pa.Table:
    """Occurrences and rows of each (group, term) in one piece of a batch."""
    first, data, offsets = piece
    words = Words(data, offsets, other=_NOT_TERM)
    lengths = words.ends - words.starts
    bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    # Terms are told apart by all their bytes, not by a hash.
    flat = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(words.data[words.inside])])
    coded = flat.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    in_row, n = np.unique(words.rows * size + coded.indices.to_numpy(), return_counts=True)
    key, place = np.unique(groups[first + in_row // size] * size + in_row % size, return_inverse=True)
    row_of = np.zeros(int(groups.max()) + 1, np.int64)
    row_of[groups] = np.arange(len(groups))  # any row of the group, for its names
    at = pa.array(row_of[key // size])
    return pa.table([
        lang.take(at), source.take(at), coded.dictionary.take(pa.array(key % size)).cast(pa.string()),
        pa.array(np.bincount(place, n, len(key)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(key)).astype(np.int64)),
    ], names=_NAMES)


def _merged(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(_NAMES[:3]).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*_NAMES[:3], "n_sum", "docs_sum"]).rename_columns(_NAMES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, term), combined over the task as far as ``HELD`` rows allow."""
    held: list[pa.Table] = []
    rows = merged = 0
    for batch in batches:
        lang, source = batch.column(0), batch.column(1)
        codes = [c.dictionary_encode() for c in (lang, source)]
        groups = codes[0].indices.to_numpy().astype(np.int64) * max(len(codes[1].dictionary), 1) + codes[1].indices.to_numpy()
        groups = np.unique(groups, return_inverse=True)[1]
        for piece in pieces(batch.column(2), PIECE_BYTES):
            held.append(_piece_counts(lang, source, groups, piece))
            rows += held[-1].num_rows
            if rows > 2 * max(merged, HELD // 2):
                held = [_merged(held)]
                rows = merged = held[0].num_rows
                if merged > HELD:
                    yield from held[0].combine_chunks().to_batches(ROWS)
                    held, rows, merged = [], 0, 0
    if held:
        yield from _merged(held).combine_chunks().to_batches(ROWS)


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 * (count + 5) / (total + 5 * terms))`` in whole numbers; null where there are no terms."""
    above = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif((total + terms * PRIOR).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", above, below) + 1


def _levels_product(a: tuple, b: tuple, zero_a: np.ndarray, zero_b: np.ndarray, terms: int) -> np.ndarray:
    """Sum of differences over one chunk's terms, for each source of ``a`` with each of ``b``.

    ``a`` and ``b`` are (source, p, bits) by source; ``zero_*`` is each source's p at count 0.
    """
    (ia, pa_, ba), (ib, pb, bb) = a, b
    starts_b = np.flatnonzero(np.diff(ib, prepend=-1))
    has_b = ib[starts_b]
    both = np.zeros((len(ia), len(zero_b)), np.int64)  # terms of a level of a that each source of b has
    value = np.zeros_like(both)
    one_b = np.zeros((len(ib), len(zero_a)), np.int64)  # terms of a level of b that each source of a has
    if len(ia) and len(ib):
        step = max(CELLS // len(ib), 1)
        for at in range(0, len(ia), step):
            part = slice(at, at + step)
            cells = np.bitwise_count(ba[part, None] & bb[None, :]).astype(np.int64)
            both[part, has_b] = np.add.reduceat(cells, starts_b, axis=1)
            starts_a = np.flatnonzero(np.diff(ia[part], prepend=-1))
            one_b[:, ia[part][starts_a]] += np.add.reduceat(cells, starts_a, axis=0).T
            value[part, has_b] = np.add.reduceat(cells * np.abs(pa_[part, None] - pb[None, :]), starts_b, axis=1)
    count_a, count_b = (np.bitwise_count(x).astype(np.int64) for x in (ba, bb))
    value += (count_a[:, None] - both) * np.abs(pa_[:, None] - zero_b[None, :])
    other = (count_b[:, None] - one_b) * np.abs(pb[:, None] - zero_a[None, :])
    out = np.zeros((len(zero_a), len(zero_b)), np.int64)
    joint, in_a, in_b = np.zeros_like(out), np.zeros(len(zero_a), np.int64), np.zeros(len(zero_b), np.int64)
    np.add.at(out, ia, value)
    np.add.at(out.T, ib, other)
    np.add.at(joint, ia, both)
    np.add.at(in_a, ia, count_a)
    np.add.at(in_b, ib, count_b)
    return out + (terms - in_a[:, None] - in_b[None, :] + joint) * np.abs(zero_a[:, None] - zero_b[None, :])


def _compare(table: pa.Table) -> pa.Table:
    """All pairs of sources of two blocks over one lot of chunks.

    Rows without bits tell each source's p at count 0 and the language's number of terms.
    """
    lang, lot, low, high, source, chunk, p, bits, terms = (table.column(i) for i in range(9))
    lang, lot, low, high, terms = (c[0].as_py() for c in (lang, lot, low, high, terms))
    source, chunk, p, bits = (c.to_numpy() for c in (source, chunk, p, bits))
    order = np.lexsort((source, chunk))
    source, chunk, p, bits = source[order], chunk[order], p[order], bits[order].view(np.uint64)
    zero = [np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)]
    present = [np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)]
    for side, block in enumerate((low, high)):
        mine = (chunk < 0) & (source // BLOCK == block)
        zero[side][source[mine] % BLOCK] = p[mine]
        present[side][source[mine] % BLOCK] = True
    total = np.zeros((BLOCK, BLOCK), np.int64)
    for c in range(lot * LOT, (lot + 1) * LOT):
        inside = min(CHUNK, terms - c * CHUNK)
        if inside <= 0:
            break
        sides = []
        for block in (low, high):
            a, b = np.searchsorted(chunk, [c, c + 1])
            mine = np.arange(a, b)[source[a:b] // BLOCK == block]
            sides.append((source[mine] % BLOCK, p[mine], bits[mine]))
        total += _levels_product(*sides, *zero, inside)
    at, to = np.nonzero(present[0][:, None] & present[1][None, :])
    if low == high:
        at, to = at[at < to], to[at < to]
    return pa.table({
        "lang": pa.array([lang] * len(at), pa.string()), "a": pa.array(low * BLOCK + at, pa.int64()),
        "b": pa.array(high * BLOCK + to, pa.int64()), "value": pa.array(total[at, to], pa.int64()),
    })


def _shipped(df: DataFrame) -> DataFrame:
    """``df`` to be shipped to every task where its number of rows is known to be small."""
    return F.broadcast(df) if df.limit(SHIPPED + 1).count() <= SHIPPED else df


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS
) -> DataFrame:
    """Distances between the sources of each language, and each source's most typical terms.

    Returns ``lang, source, part, item, value, rank``. Part ``pair`` has every other source of the language with the sum
    of differences over all kept terms (0 where none is kept), part ``term`` up to ``top`` terms that are more frequent
    in the source than in its language. Ranks fall by value, ties by the item's bytes.

    Nulls in any of the three columns count as empty strings; a text without terms still makes its group known. Repeated
    rows count each. Whole texts are read, however long. An empty table gives an empty one. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = scratch.save(
        read.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts"
    )
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = scratch.save(row_number(kept.drop("docs"), [F.desc("n_lang"), F.asc("term")], ["lang"], "id"), "kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    cells = scratch.save(
        counts.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang", (F.col("id") - 1).alias("id")), "cells"
    )
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = row_number(read.select("lang", "source").distinct(), [F.asc("source")], ["lang"], "i")
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = scratch.save(
        groups.select("lang", "source", (F.col("i") - 1).alias("i"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "total_lang")]), "groups"
    )
    small = _shipped(groups)

    n_blocks = groups.groupBy("lang").agg((F.max("i") / BLOCK).cast("long").alias("last_block"))
    named = cells.join(small, ["lang", "source"])
    levels = named.groupBy("lang", "i", F.expr(f"id div {CHUNK}").alias("chunk"), "n", "total", "terms").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % CHUNK).cast("int"))).alias("bits")
    )
    levels = scratch.save(
        levels.select("lang", "i", "chunk", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "bits", "terms"), "levels"
    )
    per_lot = CHUNK * LOT
    zeros = groups.select(
        "lang", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(terms - 1) div {per_lot}"), F.lit(0).cast("long")))).alias("lot"),
        F.lit(-1).cast("long").alias("chunk"), F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0)).cast("long").alias("p"),
        F.lit(0).cast("long").alias("bits"), "terms",
    )
    rows = levels.select("lang", "i", F.expr(f"chunk div {LOT}").alias("lot"), "chunk", "p", "bits", "terms").unionByName(zeros)
    rows = rows.join(_shipped(n_blocks), "lang").withColumn("own", F.expr(f"i div {BLOCK}"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_block"))))
    rows = rows.select("lang", "lot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "i", "chunk", "p", "bits", "terms")
    found = rows.groupBy("lang", "lot", "low", "high").applyInArrow(_compare, "lang string, a long, b long, value long")
    pairs = scratch.save(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("x"), "value")
    names = _shipped(groups.select("lang", "i", "source"))
    others = _shipped(groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item")))
    pairs = pairs.select("lang", "x.i", "x.j", "value").join(names, ["lang", "i"]).join(others, ["lang", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    typical = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        typical.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    )


#: The same, comparing term by term.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
z AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM l GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN l USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, l.term, coalesce(c.n, 0) AS n,
    (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (s.total + {PRIOR} * z.v))::BIGINT AS p,
    (1 + ({SCALE}::HUGEINT * (l.n + {PRIOR})) // (z.total + {PRIOR} * z.v))::BIGINT AS q
  FROM s JOIN l USING (lang) JOIN z USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = l.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
