"""Near copies by SimHash with multi-index hashing and by banded MinHash, verified by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceframe.llm.common import connected_components, prepare, written
from raceframe.llm.simhash import fingerprint, shingle_values
from raceframe.llm.simhash import links as near_prints

# A pair of similarity s shares none of the bands with probability (1 - s**ROWS) ** BANDS:
# 0.00003 at 0.8.
BANDS, ROWS = 20, 4
# Bits in which the fingerprints of a pair differ at most; pairs at 0.8 differ in about ten, so
# the bands have to find most of those.
DISTANCE = 4
# Shingles that are permuted at a time.
BLOCK = 1 << 13
# Text hashes up to this number (8 bytes each) are broadcast.
BROADCAST_KEYS = 1 << 21


def permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One flip and one odd factor per row of every band."""
    rng = np.random.default_rng(seed)
    flips, factors = rng.integers(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
    return flips, factors | np.uint64(1)


def band_values(values: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> list[int]:
    """A hash of every band's smallest permuted values; none for no values."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), BLOCK):
        least = np.minimum(least, ((values[at : at + BLOCK] ^ flips) * factors).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def nodes(docs: DataFrame, id: str, text: str, width: int, seed: int) -> DataFrame:
    """(id, t, node, n, fp, bands): the text's hash; the hash, size, SimHash and bands of its set of shingles."""
    flips, factors = permutations(seed)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_values(x.as_py(), width, seed)) for x in batch.column(2)]
            node = pa.array(_signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]))
            bands = pa.array([_signed(band_values(s, flips, factors)) for s in sets], pa.list_(pa.int64()))
            fp = pa.array(_signed([fingerprint(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array([len(s) for s in sets], pa.int32()), fp, bands], ["id", "t", "node", "n", "fp", "bands"])

    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(compute, f"id {dict(docs.dtypes)[id]}, t long, node long, n int, fp long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(node, values): the distinct shingle hashes of every (t, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                values = np.unique(shingle_values(x.as_py(), width, seed))
                node = pa.array(_signed([xxhash.xxh64_intdigest(values.tobytes())]))
                yield pa.RecordBatch.from_arrays([node, pa.array([_signed(values)], pa.list_(pa.int64()))], ["node", "values"])

    return texts.select("t", "text").mapInArrow(compute, "node long, values array<long>")


def set_table(nodes: DataFrame, table: DataFrame, docs: DataFrame, text: str, width: int, seed: int) -> DataFrame:
    """(node, values): the shingle sets of ``nodes``, each from one of its texts."""
    needed = written(table.join(nodes, "node").select("t").distinct(), "needed", few=True)
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed
    texts = docs.select(F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text")).join(needed, "t", "left_semi")
    # Copies of one text count once, before its set is made.
    return written(shingle_sets(texts.groupBy("t").agg(F.first("text").alias("text")), width, seed), "sets")


def verified(pairs: DataFrame, table: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of at least ``threshold``."""
    size = lambda c: table.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    sized = written(sized, "pairs", few=True)
    of = lambda c: sets.select(F.col("node").alias(c), F.col("values").alias(f"v{c}"))
    both = sized.join(of("b"), "b").join(of("a"), "a").withColumn("shared", F.size(F.array_intersect("va", "vb")))
    return both.filter(F.col("shared") >= (F.col("na") + F.col("nb") - F.col("shared")) * threshold - 1e-9).select("a", "b")


def print_pairs(table: DataFrame) -> DataFrame:
    """(a, b): every node with the smallest of its fingerprint, and that one with the smallest of a fingerprint near it.

    Fingerprints within ``DISTANCE`` bits are found by multi-index hashing.  Each is compared
    with the least one near it: what else is near is compared with its own least one.
    """
    prints = written(table.groupBy("fp").agg(F.min("node").alias("least")), "prints", few=True)
    near = near_prints(prints, DISTANCE, prints.count()).groupBy("b").agg(F.min("a").alias("a"))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}"))
    across = near.join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("x"), F.col("node_b").alias("y"))
    within = table.join(prints, "fp").filter("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y"))
    return written(across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "prints-near", few=True)


def prefix_links(sets: DataFrame, member: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all similar nodes of different classes, found by the rarest of their shingles.

    ``member`` holds (node, c).  Shingles are ordered by the number of classes that hold
    them.  Two sets of a Jaccard similarity of ``threshold`` share one of the first
    ``n - ceil(threshold * n) + 1`` of each, whatever the order; with the rarest first, a
    passage that many documents share is left out as long as a document has that many
    shingles of its own.  Shingles of one class alone lead no pair and only take places; and
    as their owners can't share them, one of a similar pair has few: only such nodes ask.

    Nodes with the same shingles in common with others differ in their own ones alone, which
    nobody shares: of such a group the one with fewest is the most similar to any node.  So
    these stand for their groups, and the others are compared with their own one and with
    those that it is similar to.
    """
    each = sets.join(member, "node").select("node", "c", F.size("values").alias("n"), F.explode("values").alias("s"))
    held = written(each.select("s", "c").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"), "held", few=True)
    common = each.join(held, "s")
    content = [F.bit_xor(F.xxhash64(F.lit(seed), "s")).alias(f"g{seed}") for seed in (1, 2)]
    left = common.groupBy("node", "c", "n").agg(F.count(F.lit(1)).alias("common"), *content)
    # Places left after the shingles that no other class has.
    places = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.col("common"))
    left = written(left.withColumn("places", places).filter("places > 0"), "left", few=True)
    group = ["g1", "g2", "common"]
    best = left.groupBy(*group).agg(F.min(F.struct("n", "node", "c")).alias("x")).select(*group, F.col("x.node").alias("rep"), F.col("x.c").alias("rc"))
    grouped = written(left.join(best, group).select("node", "c", "n", "common", "places", "rep", "rc"), "grouped", few=True)
    inside = grouped.filter("node <> rep and c <> rc").select(F.col("rep").alias("a"), F.col("node").alias("b"))

    order = Window.partitionBy("node").orderBy("classes", "s")
    reps = grouped.filter("node = rep").select(F.col("node").alias("of"), "common", "places")
    first = common.join(reps, F.col("node") == F.col("of")).withColumn("rank", F.row_number().over(order)).filter("rank <= places")
    first = written(first.select("node", "c", "n", "common", "s"), "prefixes", few=True)
    side = lambda x: first.select("s", F.col("node").alias(x), *[F.col(y).alias(f"{y}{x}") for y in ("c", "n", "common")])
    # What neither can share is at most 1 - threshold of the union, which is at most
    # n / threshold: of a similar pair, one has at most half of that of its own.
    most = (1 - threshold) / 2 / threshold
    light = lambda x: F.col(f"n{x}") - F.col(f"common{x}") <= F.col(f"n{x}") * most + 1e-9
    shared = F.least("commona", "commonb")
    fits = shared >= (F.col("na") + F.col("nb") - shared) * threshold - 1e-9
    once = ~light("b") | (F.col("a") < F.col("b"))
    across = side("a").filter(light("a")).join(side("b"), "s").filter((F.col("ca") != F.col("cb")) & once & fits).select("a", "b").distinct()
    links = written(verified(inside.union(across), table, sets, threshold), "links", few=True)

    if links.isEmpty():
        return links
    # A member of one group can be similar to one of another only if it is to that one's best.
    both = links.union(links.select("b", "a"))
    of_rep = grouped.filter("node <> rep").select("rep", "node")
    more = both.join(of_rep, F.col("a") == F.col("rep")).select(F.col("node").alias("a"), "b").join(reps.select(F.col("of").alias("b")), "b", "left_semi")
    return written(links.union(verified(more.filter("a <> b").distinct(), table, sets, threshold)), "rest", few=True)


def centrality(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, score): how many of ``nodes`` hold a shingle of the node, on average."""
    each = sets.join(nodes.select("node").distinct(), "node").select("node", F.explode("values").alias("s"))
    held = written(each.groupBy("s").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "held", few=True)
    shared = each.join(held, "s").groupBy("node").agg(F.sum("held").alias("total"))
    return sets.join(shared, "node").select("node", (F.col("total") / F.size("values")).alias("score"))


def _mixed(placed: DataFrame, member: DataFrame) -> DataFrame:
    """(k, v, node, c): the nodes of bands that still hold several classes ``c``."""
    held = written(placed.join(member, "node", "left").select("k", "v", "node", F.coalesce("component", "node").alias("c")), "held", few=True)
    mixed = held.groupBy("k", "v").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("k", "v")
    return written(held.join(mixed, ["k", "v"]), "mixed", few=True)


def _members(docs: DataFrame, id: str, text: str, width: int, seed: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, t, node) of every row, and (node, component) of every node."""
    found = written(nodes(docs, id, text, width, seed), "nodes")
    table = written(found.groupBy("node").agg(F.min("t").alias("t"), F.min("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "table", few=True)
    alike = print_pairs(table)
    placed = table.select("node", F.posexplode("bands").alias("k", "v"))
    crowded = placed.groupBy("k", "v").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a < top").drop("top")
    placed = written(placed.join(crowded.hint("merge"), ["k", "v"]), "placed", few=True)
    keys = table.select("node", "n", "t")
    asked = placed.select("node").union(alike.select(F.explode(F.array("a", "b"))))
    sets = set_table(asked.distinct(), keys, docs, text, width, seed)
    star = alike.union(placed.filter("a < node").select("a", F.col("node").alias("b"))).distinct()
    near = written(verified(star, keys, sets, threshold), "near", few=True)
    # Copies of one text, each changed elsewhere, may all be far from the smallest but not
    # from the text they come from, whose shingles are the most frequent.  Nodes with the same
    # smallest neighbour are of one class; others that are cost a pair, not a link.
    mixed = _mixed(placed, near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")))
    score = written(centrality(sets, mixed), "score", few=True)
    scored = mixed.join(score, "node")
    middle = scored.groupBy("k", "v").agg(F.max(F.struct("score", F.col("node").alias("m"), F.col("c").alias("mc"))).alias("x")).select("k", "v", "x.m", "x.mc")
    star = scored.join(middle, ["k", "v"]).filter("c <> mc").select(F.least("m", "node").alias("a"), F.greatest("m", "node").alias("b")).distinct()
    near = written(near.union(verified(star, keys, sets, threshold)), "near", few=True)
    member = written(connected_components(near), "classes", few=True)
    left = _mixed(placed, member).select("node", "c").distinct()
    rest = prefix_links(sets, written(left, "open", few=True), keys, threshold)
    # Classes change only by links that the prefixes find.
    if not rest.isEmpty():
        member = connected_components(member.select(F.col("component").alias("a"), F.col("node").alias("b")).union(rest))
    own = table.join(member, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return found.select("id", "t", "node"), written(own, "members", few=True)


def classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42, threshold: float = 0.8) -> DataFrame:
    """(id, component_id): the near-copy class of every row, by its smallest id.

    Documents link if the sets of their shingles (``width`` words, A-Z lower-cased; all
    words of a shorter text) have a Jaccard similarity of at least ``threshold``.  Equal
    sets are one node, also the empty one of null, empty and blank texts.  Nodes whose SimHash
    differs in few bits are found by multi-index hashing (``print_pairs``).  Nodes that share
    a band are compared with the band's smallest node, then with its most central one.  Nodes
    whose bands still hold several classes are joined on the rarest of their shingles (``prefix_links``), so
    neither a large class nor a passage that many documents share costs a pair per pair of
    documents.  Repeated ids keep a row each; a class of null ids alone has a null class.
    """
    prepare(docs.sparkSession)
    found, own = _members(docs, id, text, width, seed, threshold)
    rows = found.join(own, "node").select("id", "component")
    smallest = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(smallest, "component").select(F.col("id").alias(id), "component_id")


def keep_first(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42, threshold: float = 0.8,
) -> DataFrame:
    """The first document of every class, all columns kept: smallest id, then smallest text hash; null ids come last.

    Rows that repeat an id are judged one by one.  Rows equal in id and text are one
    document and stay or go together.
    """
    prepare(docs.sparkSession)
    found, own = _members(docs, id, text, width, seed, threshold)
    row = F.struct(F.col("id").isNull().alias("unknown"), "id", "t")
    first = found.join(own, "node").groupBy("component").agg(F.min(row).alias("first"), F.max(row).alias("last")).filter("not (first <=> last)")
    first = first.select(F.col("component").alias("of"), "first")
    gone = found.join(own, "node").join(first, F.col("component") == F.col("of")).filter(~row.eqNullSafe(F.col("first")))
    gone = written(gone.select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct(), "gone", few=True)
    return docs.join(gone, F.col(id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__t")), "left_anti")
