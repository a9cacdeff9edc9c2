"""Benchmark items inside documents: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written
from raceframe.llm.textblocks import LOWER, pieces, shingle_hashes, span_hashes, text_bytes, word_spans

# Bytes of text that are hashed at a time.
PIECE = 2 << 20
# Sketches of at most this many hashes (8 bytes each) are sent to the tasks as a filter.
FILTER_HASHES = 1 << 21


def _shingles(column: pa.Array, widths: list[int]):
    """Per width: hashes, rows and byte spans of the shingles of a column, and the bytes."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    out = []
    for width in widths:
        values, at = shingle_hashes(hashes, rows, width)
        out.append((values, rows[at], starts[at], ends[at + width - 1]))
    return data, out


def _spelled(data: np.ndarray, start: int, end: int) -> str:
    return b" ".join(data[start:end].tobytes().split()).decode("utf-8", "replace")


def item_shingles(items: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(item, size, width, shingle, hash): the distinct shingles of every item.

    An item with fewer words than ``width`` is one shingle of all its words.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            data, offsets = text_bytes(batch.column(1))
            np.add.at(counts, word_spans(data, offsets)[2], 1)
            widths = sorted({int(min(width, c)) for c in counts if c})
            data, parts = _shingles(batch.column(1), widths)
            for w, (values, where, starts, ends) in zip(widths, parts, strict=True):
                for h, r, a, b in zip(values.view(np.int64).tolist(), where.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    if min(width, counts[r]) == w:
                        rows.append((ids[r], w, _spelled(data, a, b), h))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                ["item", "width", "shingle", "hash"],
            )

    kind = dict(items.dtypes)[id]
    rows = items.select(F.col(id).alias("item"), F.col(text).cast("string").alias("text")).filter("item is not null").mapInArrow(
        compute, f"item {kind}, width int, shingle string, hash long").distinct()
    sizes = rows.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, "item")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(part, width, hash): each item's smallest hashes, as many as its own size needs.

    A document that holds ``threshold`` of an item misses at most (1 - threshold) * size
    of its shingles, so of any more than that it has at least one: with that many, the
    item's bottom-k MinHash sketch cannot miss a document.  ``part`` is the power of two
    of the size; probing does not use it.  Equal hashes of different shingles only add
    candidates.
    """
    part = F.floor(F.log2("size")).cast("int")
    most = F.floor(F.pow(F.lit(2.0), part + 1) - 1)
    need = F.floor(F.lit(1 - threshold) * F.least(most, F.col("size")) + F.lit(1e-9)) + 1
    kept = shingles.groupBy("item", "size", "width").agg(F.array_sort(F.collect_set("hash")).alias("all"))
    return kept.select(part.alias("part"), "width", F.explode(F.slice("all", F.lit(1), need.cast("int"))).alias("hash")).distinct()


def probe(docs: DataFrame, id: str, text: str, sketch: dict[int, np.ndarray], known: dict[int, np.ndarray]) -> DataFrame:
    """(doc, width, shingle): of documents with a sketch hash, all distinct shingles with an item's hash.

    Whole texts are hashed; ``sketch`` and ``known`` are sorted hashes per width.
    """
    widths = sorted(known)

    def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        # Equal 16-bit prefixes are looked up in a small table first.
        near = np.zeros(1 << 16, dtype=bool)
        near[(table >> np.uint64(48)).astype(np.int64)] = True
        hit = np.flatnonzero(near[(values >> np.uint64(48)).astype(np.int64)])
        spot = np.searchsorted(table, values[hit])
        spot[spot == len(table)] = 0
        return hit[table[spot] == values[hit]]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                data, parts = _shingles(piece.column(1), widths)
                out: set[tuple[int, int, str]] = set()
                for w, (values, rows, starts, ends) in zip(widths, parts, strict=True):
                    if not len(values):
                        continue
                    hit = np.zeros(piece.num_rows, dtype=bool)
                    hit[rows[among(values, sketch[w])]] = True
                    of_hit = np.flatnonzero(hit[rows])
                    for i in of_hit[among(values[of_hit], known[w])].tolist():
                        out.add((int(rows[i]), w, _spelled(data, int(starts[i]), int(ends[i]))))
                found = sorted(out)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.string())],
                    ["doc", "width", "shingle"],
                )

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(compute, f"doc {kind}, width int, shingle string")


def contained_items(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """(id, item_id, shared, size, containment): items of which a document holds ``threshold`` or more.

    Containment is the share of an item's distinct shingles (``width`` words, A-Z
    lower-cased; all words of a shorter item) that occur anywhere in the whole document,
    counted on the spelled shingles.  The items' size-partitioned sketches give the
    candidates and lose none.  Items without words or id match nothing, documents without
    text have no items; rows that repeat an id count together.  The items' hashes go to
    the tasks in blocks of a bounded number; each block is a pass over the documents.
    """
    spark = prepare(docs.sparkSession)
    shingles = written(item_shingles(items, item_id, item_text, width), "items", few=True)
    marks = written(sketches(shingles, threshold), "sketches", few=True)
    blocks = max(1, math.ceil(shingles.count() / FILTER_HASHES))
    # An item belongs to one block, so that its shingles are known wherever its sketch is.
    found = None
    for k in range(blocks):
        own = shingles.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        known = _by_width(own)
        if not known:
            continue
        sketch = _by_width(own.join(marks.select("width", "hash"), ["width", "hash"], "left_semi") if blocks > 1 else marks)
        part = probe(docs, id, text, sketch, known).join(own.select("item", "size", "width", "shingle"), ["width", "shingle"])
        shared = part.groupBy("doc", "item", "size").agg(F.count_distinct("shingle").alias("shared"))
        kept = shared.filter(F.col("shared") >= F.col("size") * threshold - 1e-9)
        found = kept if found is None else found.unionByName(kept)
    if found is None:
        kinds = dict(docs.dtypes)[id], dict(items.dtypes)[item_id]
        found = spark.createDataFrame([], f"doc {kinds[0]}, item {kinds[1]}, size long, shared long")
    return found.select(F.col("doc").alias(id), F.col("item").alias(item_id), "shared", "size", (F.col("shared") / F.col("size")).alias("containment"))


def _by_width(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sorted hashes per width; the caller has checked that there are at most FILTER_HASHES rows."""
    table: dict[int, list[int]] = {}
    for r in rows.select("width", "hash").distinct().toLocalIterator():
        table.setdefault(r.width, []).append(r.hash)
    return {w: np.sort(np.array(h, dtype=np.int64).view(np.uint64)) for w, h in table.items()}


def remove_contaminated(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item, all columns kept; rows with a null id stay."""
    gone = contained_items(docs, items, id=id, **options).select(F.col(id).alias("__gone")).distinct()
    return docs.join(gone, F.col(id) == F.col("__gone"), "left_anti")
