"""Language-model scores: Katz backoff over words, with Good-Turing discounts.

A text is ``<start> word .. word <end>``. The model has two orders:

* unigrams: ``P(w) = d(c) c / N`` for seen words; what the discounts free is the probability of the
  one class of unseen words;
* bigrams seen at least ``LEAST`` times: ``P(w | v) = d(c) c / c(v)``; every other word gets
  ``a(v) P(w)``, with ``a(v) = (1 - sum P(w | v)) / (1 - sum P(w))`` over the kept bigrams of v,
  so that each context's probabilities sum to exactly 1. Bigrams seen once are left to backing off, as Katz (1987) does.

Counts of up to ``DISCOUNTED`` are discounted by Good-Turing's ``(r + 1) n(r + 1) / (r n(r))``.

The recursion over a text's tokens is a sum of table values: ``log P(w)`` and ``log a(v)`` of each
word, and for each kept bigram what its own probability differs from backing off. The table
is keyed by 64-bit hashes and cut into buckets by key range. Every piece of text asks each
bucket once for its distinct keys; the most frequent keys, at most ``SHIPPED`` of them, are shipped to the
tasks instead, so no key of a bucket has more than a ``1 / SHIPPED`` share of the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.text import Words, mix, pieces

DISCOUNTED, LEAST = 5, 2
#: Keys shipped to every task (20 bytes each).
SHIPPED = 400_000
#: Size of the filter that spares questions to the table (16 MB).
FILTER_BITS = 27
#: Tokens that one bucket of the table answers for, and bigrams merged in one task.
BUCKET_TOKENS = 4_000_000
#: Words with more than this share of the tokens are split by what follows them (at most 1 / HOT words).
HOT = 1e-3
FOLDS, HELD_OUT = 7, 2
PIECE = 6 << 20
#: Tokens that are looked up at once.
SLICE = 1 << 17

_START, _END = np.uint64(0x5351_A7E1_0000_0001), np.uint64(0xE4D0_0F7E_0000_0003)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _PAIR + second)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, row) hashes of all texts of a piece, ends included."""
    words = Words(data, offsets)
    rows = len(offsets) - 1
    n = np.diff(words.bounds)
    total = len(words) + rows
    last = np.cumsum(n + 1) - 1
    is_end = np.zeros(total, bool)
    is_end[last] = True
    token = np.full(total, _END, np.uint64)
    token[~is_end] = words.hashes()
    context = np.full(total, _START, np.uint64)
    context[1:] = token[:-1]
    context[last - n] = _START
    return context, token, np.repeat(np.arange(rows), n + 1)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, summed over the task as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        keys, counts = (np.concatenate(x) for x in zip(*held))
        unique, inverse = np.unique(keys, return_inverse=True)
        return unique, np.bincount(inverse, counts).astype(np.int64)

    def batch_of(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for _, data, offsets in pieces(batch.column(0), PIECE):
            _, token, _ = _tokens(data, offsets)
            held.append(_tally(token))
            if sum(len(k) for k, _ in held) > 3_000_000:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield batch_of(*held.pop())
    if held:
        yield batch_of(*merged())


def _count_pairs(hot: np.ndarray, parts: np.ndarray):
    """Rows context, part, nexts, counts: the words that follow each context in a piece."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0), PIECE):
                context, token, _ = _tokens(data, offsets)
                firsts, first = np.unique(context, return_inverse=True)
                seconds, second = np.unique(token, return_inverse=True)
                codes, counts = _tally(first.astype(np.int64) * len(seconds) + second)
                first, second = codes // len(seconds), codes % len(seconds)
                a, b = firsts[first], seconds[second]
                part = np.zeros(len(a), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
                    part = np.where(hot[at] == a, (mix(b) % parts[at].astype(np.uint64)).astype(np.int64), 0)
                    order = np.lexsort((part, first))
                    first, a, b, counts, part = first[order], a[order], b[order], counts[order], part[order]
                begin = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (part[1:] != part[:-1]))))
                ends = pa.array(np.append(begin, len(first)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a[begin].astype(np.int64)), pa.array(part[begin].astype(np.int32)),
                        pa.ListArray.from_arrays(ends, pa.array(b.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
                    ],
                    names=["context", "part", "nexts", "counts"],
                )

    return run


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some contexts -> kept bigrams, and the counts of counts (context null)."""
    found = [(np.repeat(b.column(0).to_numpy(), np.diff(b.column(2).offsets.to_numpy())), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy())
             for b in batches if b.num_rows]
    if not found:
        return
    a, b, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    a, b, n = a[begin], b[begin], np.add.reduceat(n, begin).astype(np.int64)
    names = ["context", "next", "n"]
    sizes, counts = np.unique(n[n <= DISCOUNTED + 1], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(sizes), pa.int64()), pa.array(sizes), pa.array(counts.astype(np.int64))], names=names)
    keep = n >= LEAST
    a, b, n = a[keep], b[keep], n[keep]
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (a, b, n)], names=names)


def good_turing(count_of: dict[int, int], least: int = 1) -> list[float]:
    """Discount of each count 0..DISCOUNTED; 1 where Good-Turing's is undefined or not below 1, at least 0.1."""
    out = [0.0] * least
    for r in range(least, DISCOUNTED + 1):
        here, above = count_of.get(r, 0), count_of.get(r + 1, 0)
        ratio = (r + 1) * above / (r * here) if here and above else 1.0
        out.append(min(max(ratio, 0.1), 1.0))
    return out


def _discount(n: F.Column, discounts: list[float]) -> F.Column:
    table = F.array(*[F.lit(d) for d in discounts])
    return n * F.when(n <= DISCOUNTED, F.element_at(table, F.least(n, F.lit(DISCOUNTED)).cast("int") + 1)).otherwise(1.0)


def fit(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, float]]:
    """(table ``key, n, score, base, known``, constants) of the training ``texts(text, ..)``.

    The values of a key are what it adds to a text that has it, against a text of unseen words.
    """
    corpus = texts.select("text")
    words = scratch.save(corpus.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    of_count = {r.n: r["count"] for r in words.filter(F.col("n") <= DISCOUNTED + 1).groupBy("n").count().collect()}
    total, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        empty = scratch.spark.createDataFrame([], "key long, n long, score double, base double, known int")
        return empty, {"total": 0, "unseen": 0.0, "unseen_base": 0.0, "fixed": 0.0}
    discounts = good_turing(of_count)
    # Without discounted counts, the unseen words get half a count.
    freed = sum((1 - discounts[r]) * r * of_count.get(r, 0) for r in range(1, DISCOUNTED + 1))
    unseen = max(freed, 0.5) / (total + (0.5 if freed < 0.5 else 0))
    scale = (1 - unseen) * total / (total - freed)
    words = words.withColumn("p", _discount(F.col("n"), discounts) / total * scale)

    hot = sorted((int(np.uint64(np.int64(r.word))), int(np.ceil(r.n / total / HOT))) for r in words.filter(F.col("n") > HOT * total).collect())
    n_texts = int(words.filter(F.col("word") == int(_END.astype(np.int64))).first().n)
    hot = sorted([*hot, (int(_START), int(np.ceil(n_texts / total / HOT)))])
    hot_keys, parts = np.array([h for h, _ in hot], np.uint64), np.array([p for _, p in hot], np.int64)
    tasks = max(int(np.ceil(total / BUCKET_TOKENS)) * 2, 1)
    merged = corpus.mapInArrow(_count_pairs(hot_keys, parts), "context long, part int, nexts array<long>, counts array<int>").repartition(
        tasks, "context", "part"
    ).mapInArrow(_merge_pairs, "context long, next long, n long")
    merged = scratch.save(merged, "pairs")
    scratch.settle()
    pair_counts = {r.next: r.n for r in merged.filter("context IS NULL").groupBy("next").agg(F.sum("n").alias("n")).collect()}
    pair_discounts = good_turing(pair_counts, LEAST)
    pairs = merged.filter("context IS NOT NULL")
    first = words.select(F.col("word").alias("context"), F.col("n").alias("n_context")).filter(F.col("context") != int(_END.astype(np.int64))).union(
        scratch.spark.createDataFrame([(int(_START.astype(np.int64)), n_texts)], "context long, n_context long")
    )
    known = pairs.join(words.select(F.col("word").alias("next"), "p"), "next")
    known = scratch.save(known.withColumn("kept", _discount(F.col("n"), pair_discounts)), "known")
    sums = known.groupBy("context").agg(F.sum("kept").alias("kept_all"), F.sum("p").alias("p_all"))
    # A context whose counts leave nothing free keeps one part in n + 1 for other words.
    room = 1 / (F.col("n_context") + 1)
    used = F.col("kept_all") / F.col("n_context")
    contexts = sums.join(first, "context").withColumn("shrink", F.when(1 - used < room, (1 - room) / used).otherwise(1.0))
    contexts = scratch.save(
        contexts.select("context", "n_context", "shrink", F.log10((1 - used * F.col("shrink")) / F.greatest(1 - F.col("p_all"), F.lit(1e-12))).alias("backoff")), "contexts"
    )
    nothing = (1 / (total + vocabulary + 1), unseen)
    own = words.join(contexts.select(F.col("context").alias("word"), "backoff"), "word", "left").select(
        F.col("word").alias("key"), "n", (F.log10("p") + F.coalesce("backoff", F.lit(0.0)) - float(np.log10(unseen))).alias("score"),
        F.log10(F.col("n") + 1).alias("base"), F.lit(1).alias("known"),
    )
    ratio = known.join(contexts, "context").select(
        "context", "next", "n", (F.log10(F.col("kept") * F.col("shrink") / F.col("n_context")) - F.log10("p") - F.col("backoff")).alias("score")
    )
    keyed = ratio.mapInArrow(_keyed, "key long, n long, score double").select("key", "n", "score", F.lit(0.0).alias("base"), F.lit(0).alias("known"))
    table = scratch.save(own.union(keyed), "table")
    scratch.settle()
    start = contexts.filter(F.col("context") == int(_START.astype(np.int64))).select("backoff").first()
    scratch.drop("pairs", "known")
    return table, {
        "total": total, "unseen": float(np.log10(nothing[1])), "unseen_base": float(np.log10(nothing[0])), "fixed": float(start.backoff) if start else 0.0,
    }


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pair_key(batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy().astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), batch.column(2), batch.column(3)], names=["key", "n", "score"])


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    return keys >> np.uint64(64 - FILTER_BITS), (keys * _PAIR) >> np.uint64(64 - FILTER_BITS)


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.unique(np.concatenate(_places(batch.column(0).to_numpy().astype(np.uint64))))
        word = (bits >> np.uint64(6)).astype(np.int64)
        values = np.left_shift(np.uint64(1), bits & np.uint64(63))
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(word), 1), bool), word[1:] != word[:-1])))
        values = np.bitwise_or.reduceat(values, begin) if len(begin) else values
        yield pa.RecordBatch.from_arrays([pa.array(word[begin]), pa.array(values.astype(np.int64))], names=["word", "bits"])


def key_filter(table: DataFrame) -> np.ndarray:
    """A Bloom filter of the table's keys, of 2 ** FILTER_BITS bits whatever their number.

    It only spares questions whose answer is nothing; when it fills up at great sizes more of
    them are asked.
    """
    words = table.select("key").mapInArrow(_set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint64)
    return out


def _not_shipped(keys: np.ndarray, rows: np.ndarray, hot: np.ndarray, values: np.ndarray, bits: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that the table has to be asked for, with their rows; the shipped ones are added to ``sums``."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        hit = hot[at] == keys
        for i in range(3):
            sums[i] += np.bincount(rows[hit], values[i][at[hit]], sums.shape[1])
        keys, rows = keys[~hit], rows[~hit]
    there = np.ones(len(keys), bool)
    for place in _places(keys):
        there &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return keys[there], rows[there]


_ASK = "bucket int, piece long, own boolean, keys binary, counts binary, rows binary"


def _ask(hot: np.ndarray, values: np.ndarray, bits: np.ndarray, buckets: int):
    """Each piece's questions to the buckets, and one row of its own with what it knows itself."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, data, offsets in pieces(batch.column(2), PIECE):
                number += 1
                context, token, rows = _tokens(data, offsets)
                n = len(offsets) - 1
                tokens = np.bincount(rows, minlength=n)
                sums = np.zeros((3, n))
                rows = rows.astype(np.uint32)
                left: list[tuple[np.ndarray, np.ndarray]] = []
                for at in range(0, len(token), SLICE):
                    part = slice(at, at + SLICE)
                    for keys in (token[part], pair_key(context[part], token[part])):
                        left.append(_not_shipped(keys, rows[part], hot, values, bits, sums))
                del context, token
                keys, rows = (np.concatenate(x) for x in zip(*left))
                mine = np.stack([tokens, sums[2]]).astype(np.int64)
                out: list[tuple] = [(number % buckets, number, True, batch.column(0).slice(row, n).cast(pa.int64()).fill_null(0).to_numpy().tobytes(),
                                     np.concatenate((mine.ravel().astype(np.float64), sums[0], sums[1])).tobytes(),
                                     batch.column(1).slice(row, n).to_numpy(zero_copy_only=False).astype(np.int8).tobytes())]
                order = np.argsort(keys, kind="stable")
                keys, rows = keys[order], rows[order]
                begin = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
                unique, counts = keys[begin], np.diff(np.append(begin, len(keys))).astype(np.uint32)
                bucket = ((unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                ends = np.append(begin, len(keys))
                small = np.uint16 if n < 1 << 16 else np.uint32
                for b in np.flatnonzero(np.diff(cuts)):
                    x, y = cuts[b], cuts[b + 1]
                    asked = counts[x:y].astype(np.uint8) if counts[x:y].max() < 256 else counts[x:y]
                    out.append((int(b), number, False, unique[x:y].tobytes(), asked.tobytes(), rows[ends[x] : ends[y]].astype(small).tobytes()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in _ASK.split(", ")])

    return run


_ANSWER = "piece long, rows binary, score binary, base binary, known binary, doc_ids binary, held binary, tokens binary"
_ANSWER_TYPES = [pa.int64(), *[pa.binary()] * 7]
_TOTAL = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _answer(key, asked, table):
    """One bucket's sums for the rows of each piece, packed into a row a piece, and the pieces' own rows."""
    order = np.argsort(table.column("key").to_numpy().astype(np.uint64)) if table.num_rows else np.zeros(0, int)
    keys = table.column("key").to_numpy().astype(np.uint64)[order] if len(order) else np.zeros(0, np.uint64)
    values = [table.column(c).to_numpy()[order] for c in ("score", "base", "known")] if len(order) else []
    out = []

    def give(piece, rows, score, base, known, *others):
        packed = (rows.astype(np.int32), score.astype(np.float64), base.astype(np.float64), known.astype(np.int64), *others)
        out.append((piece, *[x.tobytes() for x in packed], *[None] * (3 - len(others))))

    for i in range(asked.num_rows):
        piece, own, first, second, third = (asked.column(c)[i].as_py() for c in ("piece", "own", "keys", "counts", "rows"))
        if own:
            doc_id, held = np.frombuffer(first, np.int64), np.frombuffer(third, np.int8)
            tokens, known, score, base = np.frombuffer(second, np.float64).reshape(4, len(doc_id))
            give(piece, np.arange(len(doc_id)), score, base, known, doc_id, held, tokens.astype(np.int64))
            continue
        wanted = np.frombuffer(first, np.uint64)
        counts = np.frombuffer(second, np.uint8 if len(second) == len(wanted) else np.uint32)
        rows = np.frombuffer(third, np.uint16 if len(third) == 2 * int(counts.sum(dtype=np.int64)) else np.uint32)
        if not len(keys):
            continue
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        rows = rows[np.repeat(hit, counts)].astype(np.int64)
        places = np.repeat(at[hit], counts[hit])
        present = np.unique(rows)
        give(piece, present, *[np.bincount(rows, value[places])[present] for value in values])
    names = [c.split(" ")[0] for c in _ANSWER.split(", ")]
    columns = list(zip(*out)) if out else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _ANSWER_TYPES)], names=names)


def _total(table):
    """All answers to one piece, and its own row -> its texts."""
    own = next(i for i in range(table.num_rows) if table.column("doc_ids")[i].is_valid)
    doc_id, held, tokens = (np.frombuffer(table.column(c)[own].as_py(), t) for c, t in (("doc_ids", np.int64), ("held", np.int8), ("tokens", np.int64)))
    sums = {"score": np.zeros(len(doc_id)), "base": np.zeros(len(doc_id)), "known": np.zeros(len(doc_id), np.int64)}
    # In a fixed order, so that the sums are the same in every run.
    packed = sorted((table.column("rows")[i].as_py(), i) for i in range(table.num_rows))
    for rows, i in packed:
        at = np.frombuffer(rows, np.int32)
        for name, total in sums.items():
            total[at] += np.frombuffer(table.column(name)[i].as_py(), total.dtype)
    return pa.table({
        "doc_id": pa.array(doc_id, mask=held == 2), "held_out": pa.array(held > 0), "n_tokens": pa.array(tokens),
        "n_known": pa.array(sums["known"]), "base": pa.array(sums["base"]), "score": pa.array(sums["score"]),
    })


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    Learns from the rows whose ``crc32(doc_id as text) mod 7`` is not 2; a row without id is held
    out. A null or empty text is its end alone. Repeated rows count each time. Other columns are ignored; an empty table gives an
    empty one; without training rows all scores are 0.
    """
    scratch = Scratch(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), 2).when(held, 1).otherwise(0).cast("int").alias("held"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    table, constants = fit(texts.filter("held = 0"), scratch)
    top = table.orderBy(F.col("n").desc(), "key").limit(SHIPPED).toArrow()
    keys = top.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    values = np.stack([top.column(c).to_numpy()[order].astype(np.float64) for c in ("score", "base", "known")])
    buckets = max(int(np.ceil(constants["total"] / BUCKET_TOKENS)), 1)
    asked = texts.mapInArrow(_ask(keys[order], values, key_filter(table), buckets), _ASK)
    # Unsigned keys by range, as the questions are cut.
    high = F.shiftrightunsigned("key", 32)
    stored = table.select(F.shiftrightunsigned(high * buckets, 32).cast("int").alias("bucket"), "key", "score", "base", "known")
    parts = asked.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(_answer, _ANSWER)
    sums = parts.groupBy("piece").applyInArrow(_total, _TOTAL)
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(constants["total"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("n_tokens") * constants["unseen_base"]).alias("base_score"),
        (F.col("score") + F.col("n_tokens") * constants["unseen"] + constants["fixed"]).alias("score"),
    )
