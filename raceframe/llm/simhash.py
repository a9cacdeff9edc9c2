"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.llm.common import connected_components, prepare, written

BITS = 64
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Shingles whose bits are counted at a time.
BLOCK = 1 << 14


def shingle_values(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; fewer words: of all of them."""
    found = (text or "").encode().translate(ASCII_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[min(width, len(found)) - 1 :]
    value = xxhash.xxh64_intdigest
    return np.array([value(joined[a:b], seed) for a, b in zip(starts, ends)], dtype=np.uint64)


def fingerprint(values: np.ndarray) -> int:
    """Bit i is 1 if more than half of the values have it; 0 for no values."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), BLOCK):
        bits = np.unpackbits(values[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the SimHash of every whole text as a signed long; no words: zero."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(shingle_values(t.as_py(), width, seed)) for t in batch.column(1)]
            signed = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["id", "fp"])

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(compute, f"id {kind}, fp long")


def segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of every segment.

    Of a pair within ``distance``, some segment is within its radius: the radii plus one
    add up to more than ``distance``.  Fewer segments are wider and have larger balls, more
    of them match more fingerprints by chance; the number is the one with the fewest probes
    and expected matches per fingerprint.
    """

    def cuts(parts: int) -> list[tuple[int, int, int]]:
        edges = [BITS * k // parts for k in range(parts + 1)]
        radius, rest = divmod(distance, parts)
        return [(a, b - a, radius if k <= rest else radius - 1) for k, (a, b) in enumerate(zip(edges, edges[1:])) if k <= rest or radius > 0]

    def cost(found: list[tuple[int, int, int]]) -> float:
        probes = [(bits, sum(math.comb(bits, r) for r in range(radius + 1))) for _, bits, radius in found]
        return sum(n + n * count / 2**bits for bits, n in probes) + len(found)

    return min((cuts(parts) for parts in range(2, max(2, distance + 1) + 1)), key=cost)


def ball(bits: int, radius: int) -> list[int]:
    """Every mask of ``bits`` bits with at most ``radius`` ones."""
    masks = [0]
    grown = [0]
    for _ in range(radius):
        grown = sorted({m | 1 << i for m in grown for i in range(bits) if not m >> i & 1})
        masks += grown
    return masks


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _ball_of(k: int, first: int, bits: int, radius: int) -> Column:
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius)])
    return F.transform(masks, lambda m: F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), first, bits).bitwiseXOR(m).alias("v")))


def links(table: DataFrame, distance: int, count: int) -> DataFrame:
    """(a, b): all pairs of different fingerprints in ``table.fp`` within ``distance`` bits.

    Every fingerprint is indexed by each segment's value and probes, per segment, the
    values in the Hamming ball around its own; matches are verified over all bits.
    """
    cuts = segments(count, distance)
    index = F.array(*[F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), first, bits).alias("v")) for k, (first, bits, _) in enumerate(cuts)])
    probes = F.concat(*[_ball_of(k, first, bits, radius) for k, (first, bits, radius) in enumerate(cuts)])
    held = table.select(F.col("fp").alias("a"), F.explode(index).alias("s")).select("a", "s.k", "s.v")
    asked = table.select(F.col("fp").alias("b"), F.explode(probes).alias("s")).select("b", "s.k", "s.v")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # Never broadcast: Spark's size of what an explode gives is that of its input.
    return held.join(asked.hint("merge"), ["k", "v"]).filter(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): the SimHash class of every document.

    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased.  Documents link
    if their fingerprints differ in at most ``distance`` bits; ``component_id`` is the
    smallest id reachable, null if all of them are null.  Null, empty and blank texts have
    fingerprint zero, linked like any other.  Every row gets a row, repeated ids too;
    columns beyond ``id`` and ``text`` are not read.  Equal fingerprints are collapsed
    before the search, so copies cost one entry.
    """
    spark = prepare(docs.sparkSession)
    found = written(fingerprints(docs, id=id, text=text, width=width, seed=seed), "fingerprints")
    table = written(found.groupBy("fp").agg(F.min("id").alias("least")), "table", few=True)
    pairs = links(table, distance, table.count())
    member = connected_components(pairs)
    own = table.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    own = written(own, "members", few=True)
    classes = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    # Most fingerprints are alone: only the others need the class's smallest id.
    linked = classes.filter("fps > 1").select("component", "component_id")
    label = own.join(linked, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return found.join(label, "fp").select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """The documents whose id is the smallest of their class, all columns kept; null ids come last.

    Rows that repeat an id are judged one by one, by id and fingerprint.  Rows of a class
    that share its smallest id are all kept, as are classes of null ids alone.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(shingle_values(t, width, seed)):016x}" for t in texts])

    classes = near_duplicates(docs, id=id, text=text, width=width, seed=seed, distance=distance)
    gone = classes.filter(~F.col(id).eqNullSafe(F.col("component_id"))).select(F.col(id).alias("__id"), F.col("fingerprint").alias("__fp")).distinct()
    rows = docs.withColumn("__shown", shown(F.col(text).cast("string")))
    return rows.join(gone, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__shown") == F.col("__fp")), "left_anti").drop("__shown")
