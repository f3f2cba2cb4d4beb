"""License scans by diagonal voting.

Words are lower-cased runs of ASCII letters, digits and all other non-ASCII characters. The
rolling k-gram hashes of every text are joined with the places of the same hashes in the license
templates. Each meeting votes for its offset, the diagonal; votes are summed by diagonal,
neighbouring diagonals (words added or left out) are merged, and the span that a merged diagonal
points at is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.text import Words, pieces, window_hashes

GRAM = 3
#: Diagonals this near to each other are one; words kept around a meeting for verification.
NEIGHBOURS, MARGIN = 4, 40
#: Share of the template's words that must stand in the span, in order.
LEAST_COVER = 0.8

# Phrases with their labels, and texts of license notices.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)

_OTHER = np.ones(256, bool)
_OTHER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), other=_OTHER).hashes()


def _templates(templates=TEMPLATES) -> list[np.ndarray]:
    return [_word_hashes(t) for _, t in templates]


def template_grams(spark: SparkSession, templates=TEMPLATES, size: int = GRAM) -> DataFrame:
    """``gram, template, at``: every k-gram hash of every template (a fixed small table)."""
    rows = [
        (int(g), number, at)
        for number, words in enumerate(_templates(templates)) for at, g in enumerate(window_hashes(words, size).astype(np.int64))
    ]
    return spark.createDataFrame(rows, "gram long, template int, at int")


_SCANNED = (
    "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, phrases array<int>, "
    "places array<int>, grams array<long>, run_starts array<int>, runs array<array<long>>"
)


def _scan(phrases: list[np.ndarray], wanted: np.ndarray, size: int):
    """One row a text: base phrases, the k-grams that some template has, and the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in pieces(batch.column(2)):
                words = Words(data, offsets, other=_OTHER)
                hashes = words.hashes()
                n = len(hashes)
                room = words.bounds[1:][words.rows] - np.arange(n) if n else np.zeros(0, int)  # words left in the text
                base = []
                for number, phrase in enumerate(phrases):
                    fits = np.flatnonzero((hashes == phrase[0]) & (room >= len(phrase)))
                    for j in range(1, len(phrase)):
                        fits = fits[hashes[fits + j] == phrase[j]]
                    base += [(int(words.rows[i]), int(i - words.bounds[words.rows[i]]), number) for i in fits]
                by_row: dict[int, list[tuple[int, int]]] = {}
                for r, at, number in base:
                    by_row.setdefault(r, []).append((at, number))
                grams = window_hashes(hashes, size)
                hit = np.flatnonzero(np.isin(grams, wanted) & (room[: len(grams)] >= size)) if len(grams) else np.zeros(0, int)
                cut = np.searchsorted(hit, words.bounds)
                places, found, starts, runs = [], [], [], []
                for r in range(len(offsets) - 1):
                    own = hit[cut[r] : cut[r + 1]]
                    places.append((own - words.bounds[r]).tolist())
                    found.append(grams[own].astype(np.int64).tolist())
                    spans: list[list[int]] = []
                    for i in own.tolist():
                        a, b = max(words.bounds[r], i - MARGIN), min(words.bounds[r + 1], i + size + MARGIN)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = b
                        else:
                            spans.append([a, b])
                    starts.append([int(a - words.bounds[r]) for a, _ in spans])
                    runs.append([hashes[a:b].astype(np.int64).tolist() for a, b in spans])
                seen = [sorted(by_row.get(r, [])) for r in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(seen)),
                        batch.column(1).slice(row, len(seen)),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array([len(x) for x in seen], pa.int64()),
                        pa.array([x[0][0] if x else None for x in seen], pa.int64()),
                        pa.array([x[-1][0] if x else None for x in seen], pa.int64()),
                        pa.array([sorted({k for _, k in x}) for x in seen], pa.list_(pa.int32())),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array(found, pa.list_(pa.int64())),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=[c.split(" ")[0] for c in _SCANNED.split(", ")],
                )

    return run


def _cover(template: np.ndarray, span: np.ndarray) -> tuple[int, int, int]:
    """(words of the template found in order, first and last of them in the span)."""
    length = np.zeros((len(template) + 1, len(span) + 1), np.int32)
    for i in range(1, len(template) + 1):
        same = np.where(span == template[i - 1], length[i - 1, :-1] + 1, 0)
        length[i, 1:] = np.maximum.accumulate(np.maximum(length[i - 1, 1:], same))
    i, j, used = len(template), len(span), []
    while i and j:
        if span[j - 1] == template[i - 1] and length[i, j] == length[i - 1, j - 1] + 1:
            used.append(j - 1)
            i, j = i - 1, j - 1
        elif length[i - 1, j] >= length[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return len(used), (used[-1] if used else 0), (used[0] if used else 0)


def _verify(templates: list[np.ndarray], least: float):
    """row, template, low, high, run_start, run -> the spans whose words are the template's."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                template = templates[row["template"]]
                words = np.array(row["run"], np.int64).astype(np.uint64)
                a = max(row["low"] - row["run_start"], 0)
                b = min(row["high"] - row["run_start"] + len(template), len(words))
                n, first, last = _cover(template, words[a:b])
                if n >= least * len(template):
                    at = row["run_start"] + a
                    out.append((row["row"], row["template"], at + first, at + last + 1, n / len(template)))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["row", "template", "start", "end", "cover"])

    return run


def scan(docs: DataFrame, scratch: Scratch, phrases=PHRASES, templates=TEMPLATES, size: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(one row a text, the verified spans ``row, template, start, end, cover``)."""
    spark = docs.sparkSession
    words = _templates(templates)
    grams = template_grams(spark, templates, size)
    wanted = np.unique(np.concatenate([window_hashes(w, size) for w in words]))
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    rows = scratch.save(texts.mapInArrow(_scan([_word_hashes(p) for p, _ in phrases], wanted, size), _SCANNED), "scanned")
    hits = rows.filter(F.size("places") > 0).select("row", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("row", "x.places", F.col("x.grams").alias("gram"))
    votes = hits.join(F.broadcast(grams), "gram").groupBy("row", "template", (F.col("places") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS).cast("int"), F.lit(1))
    group = F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    merged = votes.withColumn("new", new).withColumn("group", group).groupBy("row", "template", "group").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")
    )
    # A template of n words with one word in five wrong keeps at least this many of its k-grams.
    lengths = F.element_at(F.array(*[F.lit(len(w)) for w in words]), F.col("template") + 1)
    merged = merged.filter(F.col("votes") >= F.greatest(F.lit(1), F.floor((lengths - size + 1) - size * (1 - LEAST_COVER) * lengths)))
    runs = rows.select("row", F.explode(F.arrays_zip("run_starts", "runs")).alias("x")).select("row", F.col("x.run_starts").alias("run_start"), F.col("x.runs").alias("run"))
    within = (F.col("low") + lengths > F.col("run_start")) & (F.col("high") < F.col("run_start") + F.size("run"))
    spans = merged.join(runs, "row").filter(within).select("row", "template", "low", "high", "run_start", "run")
    verified = spans.mapInArrow(_verify(words, LEAST_COVER), "row long, template int, start int, end int, cover double")
    return rows, scratch.save(verified, "verified")


def licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Base counts, ``base_labels``, ``labels`` and ``score`` for every row of ``docs(doc_id, text)``.

    ``score`` is the largest share of a template that a verified span covers, 0 without one. A
    null or empty text has no words and no labels. Repeated rows and rows without id are scanned
    like any other; other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    rows, verified = scan(docs, scratch, phrases, templates)
    names = F.array(*[F.lit(label) for label, _ in templates])
    best = verified.groupBy("row").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("own"), F.max("cover").alias("cover"))
    base = F.transform("phrases", lambda k: F.element_at(F.array(*[F.lit(label) for _, label in phrases]), k + 1))
    own = F.coalesce("own", F.array().cast("array<string>"))
    return rows.join(scratch.save(best, "best"), "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce("cover", F.lit(0.0)).alias("score"),
    )
