"""License notices by diagonal voting over word k-grams.

Every k-gram of a text is joined to the places where it stands in a template.  A copied
notice gives matches of one offset (text place less template place), so matches are
counted by offset; words put in or left out move the offset a little, so the votes of
neighbouring offsets are added; and what is left is compared word by word.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written
from raceframe.llm.textblocks import LOWER, pieces, shingle_hashes, span_hashes, text_bytes, word_spans

# Bytes that separate words: ASCII but letters and digits (A-Z are lower-cased before).
GAPS = np.zeros(256, dtype=bool)
GAPS[0x00:0x30] = GAPS[0x3A:0x61] = GAPS[0x7B:0x80] = True
# Bytes of text that are hashed at a time.
PIECE = 2 << 20
# Words of a k-gram.
K = 3
# Offsets that differ by up to this many words may belong to one notice.
DRIFT = 4
# Share of a template's words, in order, that a notice holds.
COVER = 0.8
# Texts with candidates up to this number (16 bytes and the places each) are broadcast.
BROADCAST_TEXTS = 1 << 18
# Template places up to this number are broadcast.
BROADCAST_PLACES = 1 << 16


@dataclass(frozen=True)
class Template:
    """A notice and its label; ``exact`` ones count only word for word, and as base."""

    label: str
    text: str
    exact: bool = False


# The phrases that count word for word, and the opening words of public notices.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("cc-by-sa-4", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of a column, and start, end and row of its words."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    return data, *word_spans(data, offsets, GAPS)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased."""
    data, starts, ends, _ = _spans(pa.array([text], pa.string()))
    return [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def grams(column: pa.Array, k: int) -> pa.Array:
    """A list per text: the hash of every k consecutive words."""
    data, starts, ends, rows = _spans(column)
    values, at = shingle_hashes(span_hashes(data, starts, ends), rows, k)
    counts = np.bincount(rows[at], minlength=len(column))
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def aligned(found: Sequence[bytes], template: Sequence[bytes]) -> tuple[int, int, int]:
    """(words of ``template`` that ``found`` holds in order, first of them in ``found``, one past the last).

    Of equally many, the shortest stretch, then the first: a cell holds (words, -length,
    start) of the best common subsequence that ends there.
    """
    row: list[tuple[int, int]] = [(0, 0)] * (len(template) + 1)
    best = (0, 0, 0, 0)
    for i, word in enumerate(found):
        new = [(0, 0)]
        for j, wanted in enumerate(template):
            cell = max(row[j + 1], new[j])
            if word == wanted:
                n, start = row[j]
                cell = max(cell, (n + 1, start if n else i))
                n, start = cell
                best = max(best, (n, start - i, -i, start))
            new.append(cell)
        row = new
    n, _, last, start = best
    return n, start, 1 - last if n else start


def template_places(templates: Sequence[Template], k: int) -> list[tuple[int, int, int]]:
    """(gram, template, place) of every k-gram of every template; a template has k words or more."""
    out = []
    for t, values in enumerate(grams(pa.array([x.text for x in templates], pa.string()), k).to_pylist()):
        if not values:
            raise ValueError(f"template {t} has fewer than {k} words")
        out += [(value, t, place) for place, value in enumerate(values)]
    return out


def needed_votes(n: int, k: int, cover: float, exact: bool) -> int:
    """k-grams left of a template of n words, each missing word having spoilt k of them; at least one."""
    missing = 0 if exact else n - math.ceil(cover * n - 1e-9)
    return max(1, n - k + 1 - k * missing)


def candidates(docs: DataFrame, templates: Sequence[Template], *, k: int = K, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """(key, template, offset, votes): offsets on or around which a template has votes enough.

    ``docs`` holds (key, text); rows with one key count once.  A template that counts word
    for word needs all its k-grams on one offset.  For the others the votes of offsets at
    most ``drift`` away are added, and ``needed_votes`` must come together.
    """
    places = template_places(templates, k)
    table = docs.sparkSession.createDataFrame(places, "gram long, template int, at int")
    table = F.broadcast(table) if len(places) <= BROADCAST_PLACES else table

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([piece.column("key"), grams(piece.column("text"), k)], ["key", "grams"])

    found = docs.select("key", "text").mapInArrow(compute, "key binary, grams array<long>")
    hits = found.select("key", F.posexplode("grams").alias("place", "gram")).join(table, "gram")
    hits = hits.select("key", "template", (F.col("place") - F.col("at")).alias("offset"), "place").distinct()
    votes = hits.groupBy("key", "template", "offset").agg(F.count(F.lit(1)).alias("own"))
    around = Window.partitionBy("key", "template").orderBy("offset").rangeBetween(-drift, drift)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)
    need = of([needed_votes(len(words(t.text)), k, cover, t.exact) for t in templates])
    total = F.when(of([t.exact for t in templates]), F.col("own")).otherwise(F.sum("own").over(around))
    return votes.withColumn("votes", total).filter(F.col("votes") >= need).select("key", "template", "offset", "votes")


def verified(held: Sequence[bytes], template: Sequence[bytes], exact: bool, offset: int, drift: int, cover: float) -> tuple[int, int, float] | None:
    """(start, stop, cover) of a template around an offset, or None."""
    n = len(template)
    if offset >= 0 and held[offset : offset + n] == template:
        return offset, offset + n, 1.0
    if exact:
        return None
    first = max(0, offset - drift)
    count, start, stop = aligned(held[first : max(0, offset + n + drift)], template)
    return (first + start, first + stop, count / n) if count >= cover * n - 1e-9 else None


SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64()), ("base", pa.bool_()), ("held", pa.int64())])
SPANS = "array<struct<label string, start long, stop long, cover double, base boolean, held long>>"


def best_spans(spans: set[tuple[str, int, int, float, bool, int]]) -> list[dict]:
    """All base spans, and of other spans that overlap the one with most cover, then most words held, then the first; by start."""
    kept = sorted(s for s in spans if s[4])
    taken: list[tuple[int, int]] = []
    for s in sorted((s for s in spans if not s[4]), key=lambda s: (-s[3], -s[5], s[1], s[2], s[0])):
        k = bisect.bisect_left(taken, (s[2], 0))
        if k == 0 or taken[k - 1][1] <= s[1]:
            taken.insert(k, (s[1], s[2]))
            kept.append(s)
    return [dict(zip(SPAN.names, s, strict=True)) for s in sorted(kept, key=lambda s: (s[1], s[2], s[0], s[4]))]


def scan(
    docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, *, id: str = "doc_id", text: str = "text",
    k: int = K, drift: int = DRIFT, cover: float = COVER,
) -> DataFrame:
    """``id``, ``n_words`` and ``spans`` (label, start, stop, cover, base, words held) of every row, in words from 0.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
    A template marked exact is a base span at every place where it stands word for word.
    The others count where at least ``cover`` of their words stand in order, within their
    own length and ``drift`` words on either side, and ``needed_votes`` k-grams agree; of
    those that overlap the one with most cover is kept, then the one that holds most words.
    Null and empty texts have no words and no spans.  Every row gets a row, repeated and
    null ids too; other columns are not read.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id]
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    found = candidates(rows, templates, k=k, drift=drift, cover=cover)
    by_text = written(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("template", "offset"))).alias("places")), "places", few=True)
    rows = rows.join(F.broadcast(by_text) if by_text.count() <= BROADCAST_TEXTS else by_text, "key", "left")
    known = [(t.label, words(t.text), t.exact) for t in templates]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                data, starts, ends, row = _spans(piece.column("text"))
                edges = np.searchsorted(row, np.arange(piece.num_rows + 1)).tolist()
                out = []
                for r, places in enumerate(piece.column("places").to_pylist()):
                    spans = set()
                    if places:
                        own = slice(edges[r], edges[r + 1])
                        held = [data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                        for place in places:
                            label, wanted, exact = known[place["template"]]
                            hit = verified(held, wanted, exact, place["offset"], drift, cover)
                            if hit:
                                spans.add((label, *hit, exact, round(hit[2] * len(wanted))))
                    out.append(best_spans(spans))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(np.diff(edges), pa.int64()), pa.array(out, pa.list_(SPAN))], ["id", "n_words", "spans"])

    return rows.select("id", "text", "places").mapInArrow(check, f"id {kind}, n_words long, spans {SPANS}").withColumnRenamed("id", id)
