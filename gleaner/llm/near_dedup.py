"""Near-duplicate documents by SetSketch registers, bands, a joint estimate and exact checks.

A document's set holds its distinct 5-word shingles (the whole sequence as one shingle when it
has fewer words). Two documents are linked when their sets' Jaccard similarity is at least 0.75.

1. One pass makes each set's registers: exponential minima on a scale of powers of ``BASE``
   (Ertl, "SetSketch", 2021). An element's arrival times form a Poisson process whose points are
   dealt to the registers, so that only points below the set's own bound are ever made.
2. Documents with equal sets form one class, found by a digest of the whole set.
3. Classes that share a band of registers meet in a bucket. Each is first compared with one other,
   the smallest of the buckets that they share most; likelihood of the registers' order relations and the exact
   set sizes gives the joint estimate, and pairs it can't rule out are checked on the full sets.
4. Buckets that still hold several components are searched whole, in blocks. Pairs of different
   components that the estimate can't rule out are checked on the full sets in the same task, so
   that only links leave it. Buckets whose members are all in one component cost nothing here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.scratch import Scratch
from gleaner.llm.text import Words, mix, pieces, shingles

REGISTERS = 256
BASE = 1.1
#: A register's value is 1 at this arrival time and grows by 1 for each factor 1/BASE.
LATEST = 20.0
#: 51 bands of 5 registers: a pair of similarity 0.75 shares none with probability 1e-6.
BANDS, BAND_SIZE = 51, 5
#: Pairs are ruled out when their likelihood at the wanted similarity is e^-12 of the best.
SLACK = 12.0
#: Ids shipped to every task for fetching texts (8 bytes each); beyond it the ids are joined.
SHIPPED_IDS = 1_000_000
#: Rows of a bucket, and their shingles, in one block; one task compares two blocks.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def registers(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) register values of sets given one after another; empty sets have zeros."""
    sizes = np.diff(bounds)
    first = np.full(len(sizes) * REGISTERS, np.inf)
    todo, extra = np.flatnonzero(sizes), 6.0
    while len(todo):
        owner = np.repeat(todo, sizes[todo])
        state = elements if len(todo) == len(sizes) else elements[np.isin(np.repeat(np.arange(len(sizes)), sizes), todo)]
        limit = ((np.log(REGISTERS) + extra) / np.maximum(sizes, 1))[owner]
        owner, time = owner * REGISTERS, np.zeros(len(owner))
        while len(owner):
            state = state + _STEP
            draw = mix(state)
            time = time - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / REGISTERS
            keep = time <= limit
            state, time, limit, owner, draw = state[keep], time[keep], limit[keep], owner[keep], draw[keep]
            np.minimum.at(first, owner + (draw & np.uint64(REGISTERS - 1)).astype(np.int64), time)
        todo = np.flatnonzero((sizes > 0) & np.isinf(first.reshape(-1, REGISTERS)).any(axis=1))
        extra += 10
    first[np.isinf(first)] = LATEST * BASE * 2  # empty sets
    value = np.floor(1 - np.log(first / LATEST) / np.log(BASE))
    return np.clip(value, 0, 255).astype(np.uint8).reshape(-1, REGISTERS)


def likely_similarity(more: np.ndarray, fewer: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """(most likely Jaccard similarity, log-likelihood ratio of ``at`` or more against it).

    ``more`` and ``fewer`` count the registers in which the first set is larger or smaller;
    with known set sizes the order of two registers depends on the similarity alone.
    """
    grid = np.linspace(0, 1, 101)
    n_a, n_b = n_a.astype(float)[:, None], n_b.astype(float)[:, None]
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    j = np.minimum(grid, np.minimum(u / v, v / u))
    up, down = np.maximum(chance(u - v * j), 1e-9), np.maximum(chance(v - u * j), 1e-9)
    equal = np.maximum(1 - up - down, 1e-9)
    more, fewer = more[:, None], fewer[:, None]
    fit = more * np.log(up) + fewer * np.log(down) + (REGISTERS - more - fewer) * np.log(equal)
    best = fit.argmax(axis=1)
    return grid[best], fit[:, grid >= at - 1e-9].max(axis=1) - fit.max(axis=1)


def _sizes_fit(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in pieces(batch.column(1)):
                sets, bounds = shingles(Words(data, offsets), size)
                values = registers(sets, bounds)
                digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(offsets) - 1),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([v.tobytes() for v in values], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "registers"],
                )

    return run


def sketch(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, digest, registers`` of every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        _sketch(size), "doc_id long, n_shingles long, digest binary, registers binary"
    )


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS)
        values = values[:, : BANDS * BAND_SIZE].reshape(len(values), BANDS, BAND_SIZE).astype(np.uint64)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(values), 0)
        for j in range(BAND_SIZE):
            keys = keys * np.uint64(256) + values[:, :, j]
        node, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS) for i in (0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(node), pa.array(n)], names=["bucket", "node", "n_shingles"])


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _screen(percent: int):
    """Rows a, b, n_a, n_b, r_a, r_b -> pairs whose registers allow the wanted similarity."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            r_a, r_b = _bytes(batch.column(4)), _bytes(batch.column(5))
            _, ratio = likely_similarity((r_a > r_b).sum(1), (r_a < r_b).sum(1), n_a, n_b, percent / 100)
            keep = _sizes_fit(n_a, n_b, percent) & (ratio >= -SLACK)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _verify(size: int, percent: int):
    """Rows a, b, text_a, text_b -> a, b and whether the full sets are similar enough."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, data, offsets in pieces(column):
            values, bounds = shingles(Words(data, offsets), size)
            out += [values[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        return out

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                linked = []
                # a text met by many others comes in consecutive rows: cut it once
                column = part.column(2).dictionary_encode()
                left = sets(column.dictionary)
                for i, y in zip(column.indices.to_pylist(), sets(part.column(3))):
                    x = left[i]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _search(size: int, percent: int):
    """A bucket's pair of blocks -> links between different roots, checked on the full sets.

    Rows of the left block meet those of the right one; a block against itself meets each pair
    once. A pair counts in the first band that it shares, and once two roots are linked they are one.
    """

    def run(key, table):
        bucket, left, right = (k.as_py() for k in key)
        band = (bucket >> (8 * BAND_SIZE)) - 1
        node, root, n, block = (table.column(c).to_numpy() for c in ("node", "root", "n_shingles", "block"))
        order = np.argsort(node, kind="stable")
        values = _bytes(table.column("registers").combine_chunks())[order]
        bands = values[:, : BANDS * BAND_SIZE].reshape(-1, BANDS, BAND_SIZE)
        texts = table.column("text")
        node, n, block = node[order], n[order], block[order]
        root = np.unique(root[order], return_inverse=True)[1]
        sets: dict[int, np.ndarray] = {}

        def whole(i: int) -> np.ndarray:
            if i not in sets:
                text = np.frombuffer(texts[int(order[i])].as_buffer(), np.uint8)
                sets[i] = shingles(Words(text, np.array([0, len(text)])), size)[0]
            return sets[i]

        found = []
        targets = np.flatnonzero(block == right)
        for i in np.flatnonzero(block == left).tolist():
            js = targets[targets > i] if left == right else targets
            js = js[(root[js] != root[i]) & _sizes_fit(n[js], n[i : i + 1], percent)]
            if len(js) and band:
                js = js[~(bands[js, :band] == bands[i, :band]).all(axis=2).any(axis=1)]
            if not len(js):
                continue
            more, fewer = (values[i] > values[js]).sum(1), (values[i] < values[js]).sum(1)
            best, ratio = likely_similarity(more, fewer, np.repeat(n[i], len(js)), n[js], percent / 100)
            js = js[ratio >= -SLACK][np.argsort(-best[ratio >= -SLACK], kind="stable")]
            for j in js.tolist():
                if root[i] != root[j]:
                    x, y = sorted((whole(i), whole(j)), key=len)
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((int(node[i]), int(node[j])))
                        root[root == root[j]] = root[i]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _texts(ids: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The written rows of ``docs`` with one of the ids."""
    ids = scratch.save(ids, f"{name}-ids")
    small = ids.count() <= SHIPPED_IDS
    texts = scratch.save(docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi"), f"{name}-texts")
    scratch.drop(f"{name}-ids")
    return texts


def _confirm(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, size: int, percent: int) -> DataFrame:
    """The written pairs ``(a, b, linked)``: sets of whole texts are compared."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, scratch, name)
    with_a = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    checked = scratch.save(
        with_b.select("a", "b", "text_b", "text_a").mapInArrow(_verify(size, percent), "a long, b long, linked boolean"), f"{name}-checked"
    )
    scratch.drop(f"{name}-texts")
    return checked


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that links reach from the document, itself
    included. Null and empty texts have no shingles and no links. Rows that share an id are one
    document; equal texts are linked whatever their number. A row without id has null as its component and is
    kept. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = scratch.save(sketch(docs, size), "rows")
    known = rows.filter("doc_id IS NOT NULL")
    classes = scratch.save(
        known.filter("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
        ),
        "classes",
    )
    keys = classes.select("node", "registers", "n_shingles").mapInArrow(_bands, "bucket long, node long, n_shingles long")
    buckets = scratch.save(
        keys.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), "buckets"
    )
    members = scratch.save(keys.join(buckets.select("bucket", "low"), "bucket"), "members")

    # Each class against the smallest of its buckets that it shares most bands with: one pair a
    # class, which mostly settles it.
    shared = members.filter("node <> low").groupBy(F.col("node").alias("a"), F.col("low").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    star = shared.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    described = star.join(
        classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a")), "a"
    ).join(classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b")), "b")
    first = scratch.save(described.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_screen(percent), "a long, b long"), "first")
    checked = _confirm(first, docs, scratch, "first-check", size, percent)

    # Ids in several rows with different texts tie these texts' classes.
    of_class = known.filter("n_shingles > 0").select("doc_id", "digest").join(classes.select("digest", "node"), "digest")
    of_class = scratch.save(of_class.select("doc_id", "node"), "of-class")
    several = of_class.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    ties = scratch.save(
        of_class.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "ties"
    )
    links = checked.filter("linked").select("a", "b").union(ties)
    roots = scratch.save(components(links, scratch, "tree-1"), "roots-1")

    # What buckets still hold of different components.
    label = F.coalesce("root", "node")
    labelled = members.join(roots, "node", "left").select("bucket", "node", "n_shingles", label.alias("root"))
    labelled = scratch.save(labelled, "labelled")
    scratch.drop("members")
    mixed = scratch.save(
        labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("total"))
        .filter("low < high"),
        "mixed",
    )
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rest = labelled.join(mixed.select("bucket", blocks.alias("blocks")), "bucket").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    rest = scratch.save(rest.select("bucket", "node", "root", "n_shingles", "block", "blocks"), "rest")
    texts = _texts(rest.select(F.col("node").alias("doc_id")).distinct(), docs, scratch, "rest")
    described = texts.select(F.col("doc_id").alias("node"), "text").join(classes.select("node", "registers"), "node")
    # Block x is the left one against those after it and the right one against those before it.
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "node", "root", "n_shingles", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    )
    found = rest.join(described, "node").groupBy("bucket", "left", "right").applyInArrow(_search(size, percent), "a long, b long")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(scratch.save(found, "found"))
    roots = scratch.save(components(links, scratch, "tree-2"), "roots-2")

    tops = scratch.save(
        of_class.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id")), "tops"
    )
    scratch.drop("classes", "buckets", "first", "first-check-checked", "of-class", "ties", "roots-1", "labelled", "mixed", "rest", "rest-texts", "found", "roots-2")
    out = rows.select("doc_id", "n_shingles").join(tops, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the near copies: of each component the smallest id stays, once.

    Rows without id and documents without words all stay. Of rows that share the kept id the first in the order of
    their texts stays.
    """
    copies = near_duplicates(docs, size, percent).filter("n_shingles > 0").filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    scratch = Scratch(docs.sparkSession)
    copies = scratch.save(copies, "copies")
    small = copies.count() <= SHIPPED_IDS
    left = docs.join(F.broadcast(copies) if small else copies, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    repeated = scratch.save(left.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")), "repeated")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, F.col("doc_id") == F.col("__again"), "left_semi")
    best = again.groupBy("doc_id").agg(F.min(F.struct(*[c for c in ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]])).alias("__row"))
    once = best.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    return left.join(repeated, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(once)
