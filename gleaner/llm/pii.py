"""Personal data: fixed patterns, and information-theoretic sanitisation of the words that go with them.

The entities to protect are the e-mail addresses, IP addresses, card and phone numbers that the
patterns find. A word in a document that names an entity discloses it as far as it tells which entity is meant:
with the corpus as the source of probabilities, the pointwise mutual information
``log2(N * n(entity, word) / (n(entity) * n(word)))`` is set against the information of the entity,
``-log2(n(entity) / N)``. Words whose share reaches ``GENERALISE`` are replaced by a general term,
from ``REMOVE`` on they are removed, in every text that holds them. Counts are of documents, whole texts all of them.
A word must stand with the entity in two different contexts: a single context,
however often it is copied, says nothing about what belongs together. A document is one context, and its
copies are the same: texts that ``near_dedup`` links by half of their pairs of neighbouring words, so that edits scattered over
a copy leave it a copy. Only words and entities that stand in two contexts each are paired; a document's pairs are made
block by block, so that a directory page with thousands of entities is no single task's work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.katz import _places as _filter_places
from gleaner.llm.katz import key_filter
from gleaner.llm.near_dedup import near_duplicates
from gleaner.llm.scratch import Scratch
from gleaner.llm.text import Words, pieces

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE, REMOVE = 0.5, 0.8
#: Copies of a document share so many percent of their different runs of so many words: edits that are scattered over a copy
#: leave it one, while long texts of one subject share words but not what follows what.
COPY_WORDS, COPY_PERCENT = 2, 50
#: Entities and words of a document that are paired in one row's work; a document with more of both is dealt to several tasks.
ENTITY_BLOCK, TERM_BLOCK = 64, 1024
#: Words shipped to every task (8 bytes each), for counting and for finding them again; beyond it they are joined. Also the most
#: entities, and the most places of words, that are broadcast.
SHIPPED = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starts inside a run of digits can't do better than its start: this keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign; the pattern's first part can't hold one."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """``(start, kind, end)`` of the four patterns in code points, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.strip("0") == "" else p.lstrip("0")) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def span_string(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(kind: int, value: str) -> int:
    value = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGITS.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


_FOUND = (
    "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:int,kind:int,end:int>>, entities array<long>, text string"
)
_FOUND_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64()), pa.string(),
]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern spans of every text, with the different entities; texts that have some are kept."""
    names = [f.split(" ")[0] for f in _FOUND.split(", ")[:7]] + ["base", "entities", "text"]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            counts, hashes, bases, entities, kept = [], [], [], [], []
            for text in part.column(2):
                text = text.as_py() or ""
                spans = base_spans(text)
                counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                hashes.append(hashlib.sha256(span_string(spans).encode()).hexdigest())
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                entities.append(sorted({_entity(k, text[a:b]) for a, k, b in spans}))
                kept.append(text if spans else None)
            columns = [part.column(0), part.column(1), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], hashes, bases, entities, kept]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, _FOUND_TYPES)], names=names)


def _outside(words: Words, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, clear) of each word, in code points of its text; it is clear when no span of ``rows`` touches it."""
    chars = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    first = chars[offsets[:-1]]
    start, end = chars[words.starts], chars[words.ends]
    edge = np.zeros(int(chars[-1]) + 1, np.int64)
    if len(rows):
        np.add.at(edge, first[rows] + spans[:, 0], 1)
        np.add.at(edge, first[rows] + spans[:, 1], -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    return start - first[words.rows], end - first[words.rows], covered[start] == covered[end]


def _span_rows(bases: list[list[Span]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(bases)), [len(spans) for spans in bases])
    return rows, np.array([(a, b) for spans in bases for a, _, b in spans], np.int64).reshape(-1, 2)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text, base, *others`` -> ``terms, *others``: the different words of each whole text outside its spans."""
    for batch in batches:
        for row, data, offsets in pieces(batch.column(0).cast(pa.large_binary())):
            n = len(offsets) - 1
            bases = [[(x["start"], x["kind"], x["end"]) for x in base] for base in batch.column(1).slice(row, n).to_pylist()]
            words = Words(data, offsets)
            clear = _outside(words, data, offsets, *_span_rows(bases))[2]
            keys, rows = words.hashes().astype(np.int64)[clear], words.rows[clear]
            order = np.lexsort((keys, rows))
            keys, rows = keys[order], rows[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
            bounds = np.searchsorted(rows[new], np.arange(n + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[new]))
            yield pa.RecordBatch.from_arrays([terms, *[c.slice(row, n) for c in batch.columns[2:]]], names=["terms", *batch.schema.names[2:]])


_PLACES = "key long, term long, start int, end int, removed boolean"


def _places(wanted: np.ndarray, removed: np.ndarray | None, bits: np.ndarray | None = None):
    """``key, text`` -> the places of the wanted words, or of those that the filter may hold and that are not wanted."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets)
                terms = words.hashes().astype(np.int64)
                at, hit = np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
                if len(wanted):
                    at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
                    hit = wanted[at] == terms
                if bits is not None:
                    hit = ~hit
                    for place in _filter_places(terms.astype(np.uint64)):
                        hit &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                if not hit.any():
                    continue
                bases = [[]] * (len(offsets) - 1)
                for r in np.unique(words.rows[hit]).tolist():
                    bases[r] = base_spans(data[offsets[r] : offsets[r + 1]].tobytes().decode())
                start, end, clear = _outside(words, data, offsets, *_span_rows(bases))
                hit &= clear
                gone = removed[at[hit]] if bits is None else np.zeros(int(hit.sum()), bool)
                keys = batch.column(0).slice(row, len(offsets) - 1).take(pa.array(words.rows[hit]))
                columns = [keys, pa.array(terms[hit]), pa.array(start[hit], pa.int32()), pa.array(end[hit], pa.int32()), pa.array(gone)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "term", "start", "end", "removed"])

    return run


def _document_counts(wanted: np.ndarray | None):
    """Texts -> ``term, documents`` for the wanted terms or all, summed over the task as far as memory allows."""

    def run(batches):
        terms, documents = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                words = Words(data, offsets)
                keys, rows = words.hashes().astype(np.int64), words.rows
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    keep = wanted[at] == keys
                    keys, rows = keys[keep], rows[keep]
                order = np.lexsort((rows, keys))
                keys, rows = keys[order], rows[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                keys = np.concatenate((terms, keys[new]))
                counts = np.concatenate((documents, np.ones(int(new.sum()), np.int64)))
                terms, inverse = np.unique(keys, return_inverse=True)
                documents = np.bincount(inverse, counts, len(terms)).astype(np.int64)
                if len(terms) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(documents)], names=["term", "documents"])
                    terms, documents = terms[:0], documents[:0]
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(documents)], names=["term", "documents"])

    return run


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def _blocks(column: str, size: int) -> Column:
    """The array in slices of ``size``; an empty one has none."""
    starts = F.when(F.size(column) > 0, F.sequence(F.lit(1), F.size(column), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(column, i, F.lit(size)))


def _contexts(held: DataFrame) -> DataFrame:
    """``key, context``: a context is a document with all its copies, exact and near."""
    copies = near_duplicates(held.select(F.col("key").alias("doc_id"), "text"), COPY_WORDS, COPY_PERCENT)
    return copies.select(F.col("doc_id").alias("key"), F.col("component_id").alias("context"))


def find(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(base findings of each row, ``key, extra`` of texts that hold words which disclose an entity).

    ``extra`` holds ``start, kind, end, removed``; ``key`` is a hash of id and text, so that repeated rows share it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    found = scratch.save(texts.mapInArrow(_find, _FOUND), "found")
    telling = _telling(texts, found, scratch)
    none = scratch.spark.createDataFrame([], "key long, extra array<struct<start:int,kind:int,end:int,removed:boolean>>")
    n_telling = telling.count() if telling is not None else 0
    if not n_telling:
        return found, none
    # The most frequent telling words are shipped, so that the others are rare where they are joined.
    bytes_of = texts.select("key", F.col("text").cast("binary").alias("text"))
    first = telling.orderBy(F.desc("n_term"), "term").limit(SHIPPED).toArrow() if SHIPPED else None
    wanted, removed = np.zeros(0, np.int64), np.zeros(0, bool)
    if first is not None:
        order = np.argsort(first.column("term").to_numpy())
        wanted, removed = first.column("term").to_numpy()[order], first.column("removed").to_numpy(zero_copy_only=False)[order]
    places = bytes_of.mapInArrow(_places(wanted, removed), _PLACES) if len(wanted) else None
    if n_telling > len(wanted):
        bits = key_filter(telling.select(F.col("term").alias("key")))
        others = bytes_of.mapInArrow(_places(wanted, None, bits), _PLACES).drop("removed").join(telling.select("term", "removed"), "term")
        others = others.select("key", "term", "start", "end", "removed")
        places = others if places is None else places.unionByName(others)
    # Rows of the same id and text give the same places.
    extra = places.groupBy("key").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end", "removed")).alias("extra"))
    extra = scratch.save(extra, "extra")
    scratch.drop("telling")
    return found, extra


def _telling(texts: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The written words ``term, removed, n_term`` that disclose an entity; None when no entity is in two different texts."""
    carriers = found.filter(F.size("entities") > 0)
    named = carriers.select("key", F.xxhash64("text").alias("digest"), F.explode("entities").alias("entity"))
    seen = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    shared = scratch.save(seen.filter("low < high").select("entity", "n_entity"), "shared")
    n_shared = shared.count()
    if not n_shared:
        return None
    few = F.broadcast(shared) if n_shared <= SHIPPED else shared
    owners = named.join(few, "entity").groupBy("key").agg(F.collect_set("entity").alias("entities"), F.count(F.lit(1)).alias("n"))
    # Rows of the same id and text are one here, as often as they are repeated.
    owners = scratch.save(owners.select("key", "entities", (F.col("n") / F.size("entities")).cast("long").alias("repeated")), "owners")
    held = carriers.select("key", "text", "base").join(F.broadcast(owners) if owners.count() <= SHIPPED // 10 else owners, "key").dropDuplicates(["key"])
    held = scratch.save(held, "held")
    contexts = scratch.save(_contexts(held), "contexts")
    named = held.join(contexts, "key").select("text", "base", "entities", "repeated", "context")
    named = scratch.save(named.mapInArrow(_terms, "terms array<long>, entities array<long>, repeated long, context long"), "named")

    def in_two_contexts(column: str) -> DataFrame:
        """What stands in two contexts at all; nothing else can do so with an entity."""
        each = named.select(F.explode(column).alias("x"), "context").groupBy("x").agg(F.min("context").alias("low"), F.max("context").alias("high"))
        kept = scratch.save(each.filter("low < high").select("x"), f"two-{column}")
        return F.broadcast(kept) if kept.count() <= SHIPPED else kept

    blocks = named.select(F.explode(_blocks("entities", ENTITY_BLOCK)).alias("entities"), "terms", "repeated", "context")
    blocks = blocks.select("entities", F.explode(_blocks("terms", TERM_BLOCK)).alias("terms"), "repeated", "context")
    blocks = blocks.repartition("context", F.get("entities", F.lit(0)), F.get("terms", F.lit(0)))
    pairs = blocks.select("entities", F.explode("terms").alias("x"), "repeated", "context").join(in_two_contexts("terms"), "x", "left_semi")
    pairs = pairs.select(F.col("x").alias("term"), F.explode("entities").alias("x"), "repeated", "context").join(in_two_contexts("entities"), "x", "left_semi")
    joint = pairs.groupBy(F.col("x").alias("entity"), "term").agg(F.sum("repeated").alias("n_joint"), F.min("context").alias("low"), F.max("context").alias("high"))
    pairs = scratch.save(joint.filter("low < high").select("entity", "term", "n_joint"), "pairs")
    scratch.drop("owners", "held", "contexts", "named", "two-terms", "two-entities")
    terms = scratch.save(pairs.select("term").distinct(), "terms")
    n_terms = terms.count()
    if not n_terms:
        return None
    corpus = texts.select(F.col("text").cast("binary"))
    if n_terms <= SHIPPED:
        counted = corpus.mapInArrow(_document_counts(np.sort(terms.toArrow().column("term").to_numpy())), "term long, documents long")
    else:
        counted = corpus.mapInArrow(_document_counts(None), "term long, documents long").join(terms, "term", "left_semi")
    frequency = scratch.save(counted.groupBy("term").agg(F.sum("documents").alias("n_term")), "frequency")
    total = float(found.count())
    known = pairs.join(F.broadcast(frequency) if n_terms <= SHIPPED else frequency, "term").join(few, "entity")
    information = -F.log2(F.col("n_entity") / total)
    mutual = F.log2(total * F.col("n_joint") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, mutual / information).otherwise(0.0)
    known = known.select("term", "n_term", share.alias("share")).filter(F.col("share") >= GENERALISE)
    telling = known.groupBy("term").agg((F.max("share") >= REMOVE).alias("removed"), F.max("n_term").alias("n_term"))
    telling = scratch.save(telling, "telling")
    scratch.drop("shared", "pairs", "terms", "frequency")
    return telling


def _small(extra: DataFrame) -> bool:
    return (extra.agg(F.sum(F.size("extra"))).first()[0] or 0) <= SHIPPED // 10


def detect(docs: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans and all spans of every row of ``docs(doc_id, text)``.

    A null or empty text has no spans. Repeated rows and rows without id are treated like any
    other. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    found, extra = find(docs, scratch)
    small = _small(extra)
    joined = found.join(F.broadcast(extra) if small else extra, "key", "left")
    more = F.transform(F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")),
                       lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    spans = F.transform(
        F.sort_array(F.concat("base", more)),
        lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"], x["end"]),
    )
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(spans, ",").alias("spans"))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, extra in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if text is None:
                out.append(None)
                continue
            spans = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in base_spans(text)]
            for x in extra.as_py() or []:
                general = "[NUMBER]" if _DIGIT.search(text[x["start"] : x["end"]]) else "[WORD]"
                spans.append((x["start"], x["end"], "" if x["removed"] else general))
            parts, done = [], 0
            for a, b, name in sorted(spans):
                if a >= done:
                    parts += [text[done:a], name]
                done = max(done, b)
            out.append("".join([*parts, text[done:]]) if parts else text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["__clean", *batch.schema.names[2:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind, or removed; other columns stay as they are.

    Of overlapping spans the first gives the replacement. Null texts stay null.
    """
    scratch = Scratch(docs.sparkSession)
    found, extra = find(docs, scratch)
    small = _small(extra)
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = renamed.withColumn("__key", _key(F.col(names["doc_id"]), F.col(names["text"])))
    extra = extra.withColumnRenamed("key", "__key")
    joined = keyed.join(F.broadcast(extra) if small else extra, "__key", "left")
    others = [names[c] for c in docs.columns if c != "text"]
    ready = joined.select(F.col(names["text"]).cast("string").alias("__text"), "extra", *others)
    kinds = dict(renamed.dtypes)
    cleaned = ready.mapInArrow(_clean, ", ".join(["__clean string", *[f"{c} {kinds[c]}" for c in others]]))
    return cleaned.select(*[F.col("__clean" if c == "text" else names[c]).alias(c) for c in docs.columns])
