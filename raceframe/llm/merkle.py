"""Merkle manifest of a table, its nodes stored in van Emde Boas order.

Every source is one tree, and the roots of the sources are the leaves of a last one.  A
tree is cut into aligned subtrees of ``HEIGHT`` levels.  Each is one row that holds its
digests in one array, laid out by halving the height again and again, so that the nodes
of a path lie close together at every scale.  The roots of these subtrees are the leaves
of the subtrees above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written

ARITY = 3
# Levels of hashing in one stored subtree: 3**6 = 729 leaves.
HEIGHT = 6
# Rows of a range while leaves are numbered, and most ranges.
RANGE_ROWS, MOST_RANGES = 25_000, 20_000
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values in a row: each ``-`` if null, else byte count, ``:``, value."""
    spelled = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*spelled).cast("binary"), 256)


# Layout of one subtree


def _below(levels: int, arity: int) -> int:
    """Nodes of a whole tree with so many levels of nodes."""
    return (arity**levels - 1) // (arity - 1) if arity > 1 else levels


def address(levels: int, depth: int, place: np.ndarray, arity: int = ARITY) -> np.ndarray:
    """Where node ``place`` of ``depth`` (root 0) lies in a tree of so many levels of nodes.

    The upper half of the levels comes first, then the lower trees one after the other,
    each laid out in the same way.
    """
    if levels == 1:
        return np.zeros_like(place)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, place, arity)
    width = arity ** (depth - upper)
    return _below(upper, arity) + place // width * _below(levels - upper, arity) + address(levels - upper, depth - upper, place % width, arity)


def layout(height: int, arity: int = ARITY) -> list[np.ndarray]:
    """Addresses of all nodes by depth, for so many levels of hashing."""
    return [address(height + 1, d, np.arange(arity**d), arity) for d in range(height + 1)]


def height_of(leaves: int, arity: int = ARITY) -> int:
    """Levels of hashing that leave one node."""
    height, width = 0, 1
    while width < leaves:
        height, width = height + 1, width * arity
    return height


def block_nodes(leaves: Sequence[str], height: int, arity: int = ARITY) -> list[str | None]:
    """Digests of a subtree in van Emde Boas order; places beyond its right edge hold None."""
    where = layout(height, arity)
    nodes: list[str | None] = [None] * _below(height + 1, arity)
    row = list(leaves)
    for depth in range(height, -1, -1):
        for at, digest in zip(where[depth].tolist(), row):
            nodes[at] = digest
        row = [hashlib.sha256("".join(row[k : k + arity]).encode()).hexdigest() for k in range(0, len(row), arity)]
    return nodes


def block_path(nodes: Sequence[str | None], where: Sequence[np.ndarray], leaf: int, arity: int = ARITY) -> list[dict[str, str]]:
    """Siblings of a leaf and its ancestors inside one subtree, from the bottom up."""
    path = []
    for depth in range(len(where) - 1, 0, -1):
        first = leaf // arity * arity
        run = [nodes[at] or "" for at in where[depth][first : first + arity].tolist()]
        path.append({"before": "".join(run[: leaf - first]), "after": "".join(run[leaf - first + 1 :])})
        leaf //= arity
    return path


STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
PATH = "array<struct<before string, after string>>"


# Numbering


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` written in ranges of ``order`` (null first), with the range as ``range``; equal rows may part."""
    n = rows.count()
    parts = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    ranged = rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    return written(ranged.withColumn("range", F.spark_partition_id()), "ranged")


def counts_before(ranged: DataFrame, group: Sequence[str]) -> DataFrame:
    """(range, group, count, start): rows per range and group, and those in the ranges before."""
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range", *group).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))


# Trees


@dataclass(frozen=True)
class Forest:
    """Stored subtrees of many trees.

    ``levels[k]`` holds (tree, block, size, nodes): the subtrees whose leaves are the
    roots of the subtrees in ``levels[k - 1]``; ``roots`` holds (tree, root).
    """

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    height: int


def _blocks(rows: DataFrame, arity: int, height: int) -> DataFrame:
    """(tree, block, size, nodes): the subtrees of leaves (tree, pos, digest, size), ``size`` leaves being the whole tree's."""
    per = arity**height

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        digests = table.column("digest").take(pa.array(order)).to_pylist()
        size = table.column("size")[0].as_py()
        nodes = block_nodes(digests, min(height, height_of(size, arity)), arity)
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "block": pa.array([table.column("pos")[0].as_py() // per], pa.int64()),
            "size": pa.array([size], pa.int64()), "nodes": pa.array([nodes], pa.list_(pa.string())),
        })

    rows = rows.select("tree", "pos", "digest", "size", F.floor(F.col("pos") / per).cast("long").alias("block"))
    return rows.groupBy("tree", "block").applyInArrow(build, "tree long, block long, size long, nodes array<string>")


def build(leaves: DataFrame, longest: int, *, arity: int = ARITY, height: int = HEIGHT) -> Forest:
    """The subtrees over leaves (tree, pos, digest, size); ``longest`` is the largest size of a tree.

    A group holds at most ``arity ** height`` digests, and every pass leaves that many
    times fewer; a tree of one leaf is its own root.
    """
    per = arity**height
    levels = []
    roots = None
    row = leaves
    while True:
        block = written(_blocks(row, arity, height), "subtrees", few=True)
        levels.append(block)
        whole = block.filter(F.col("size") <= per).select("tree", F.element_at("nodes", 1).alias("root"))
        roots = whole if roots is None else roots.unionByName(whole)
        if longest <= per:
            return Forest(levels, roots, arity, height)
        longest = -(-longest // per)
        row = block.filter(F.col("size") > per).select(
            "tree", F.col("block").alias("pos"), F.element_at("nodes", 1).alias("digest"), F.ceil(F.col("size") / per).cast("long").alias("size"),
        )


def paths(forest: Forest, leaves: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``leaves`` (tree, pos, more) with ``subroot`` and ``path``: the siblings from the bottom up, then those in ``above`` (tree, path).

    Subtrees hand what lies above them to the roots below, level by level; every row meets
    the one subtree that holds it.
    """
    per, arity, height = forest.arity**forest.height, forest.arity, forest.height

    def attach(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        size, up = block.column("size")[0].as_py(), block.column("up")[0].as_py()
        where, nodes = layout(min(height, height_of(size, arity)), arity), block.column("nodes")[0].as_py()
        found = [block_path(nodes, where, pos % per, arity) + up for pos in rows.column("pos").to_pylist()]
        top = pa.array(block.column("subroot").to_pylist() * len(rows), pa.string())
        return rows.drop_columns(["block"]).append_column("subroot", top).append_column("path", pa.array(found, pa.list_(STEP)))

    handed = None
    for k in range(len(forest.levels) - 1, -1, -1):
        block = forest.levels[k]
        held = block.filter(F.col("size") <= per).withColumn("subroot", F.element_at("nodes", 1))
        if above is None:
            held = held.withColumn("up", F.array().cast(PATH))
        else:
            held = held.join(above.select("tree", F.col("path").alias("up")), "tree")
        if handed is not None:
            up = handed.select("tree", F.col("pos").alias("block"), "subroot", F.col("path").alias("up"))
            held = held.unionByName(block.filter(F.col("size") > per).join(up, ["tree", "block"]))
        rows = leaves if k == 0 else forest.levels[k - 1].filter(F.col("size") > per).select("tree", F.col("block").alias("pos"))
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", subroot string, path {PATH}"
        rows = rows.withColumn("block", F.floor(F.col("pos") / per).cast("long"))
        found = rows.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInArrow(attach, schema)
        handed = written(found, "paths", few=True) if k else found
    return handed


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step.before, node, step.after).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of all siblings of a path, left to right, from the bottom up."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step.before, step.after)), "").cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, pos, id, leaf, carried columns), ``trees`` (tree, source, size), both forests, the root."""

    leaves: DataFrame
    trees: DataFrame
    inner: Forest
    outer: Forest
    root: str | None


def manifest(
    docs: DataFrame, *, id: str = "doc_id", source: str = "source", columns: Sequence[str] = LEAF_COLUMNS,
    carry: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT,
) -> Manifest:
    """Hash every row, every source and the whole table.

    Leaves hash ``columns`` as text (null: ``-``).  Per source they ascend by id, rows that
    repeat an id by their leaf; a null id comes first.  Every ``arity`` consecutive nodes
    become one until one is left; the sources' roots, null first and in byte order, likewise
    give the root.  A lone leaf is the subroot, a lone subroot the root.  An empty table has
    no trees and no root.  ``carry`` names further values to keep beside a leaf.

    Leaves are numbered without a window over a source: they are cut into ranges of
    (source, id), numbered inside a range, and only counts per (range, source) meet.
    """
    prepare(docs.sparkSession)
    kept = {n: c.alias(n) for n, c in (carry or {}).items()}
    rows = docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), *kept.values())
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    ranged = in_ranges(rows, ["source", "id", "leaf", "row"])
    starts = written(counts_before(ranged, ["source"]), "starts", few=True)

    sources = in_ranges(starts.groupBy("source").agg(F.sum("count").alias("size")), ["source"])
    numbered = sources.withColumn("inside", F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_first())) - 1)
    numbered = numbered.join(counts_before(sources, []).select("range", "start"), "range")
    trees = written(numbered.select((F.col("start") + F.col("inside")).cast("long").alias("tree"), "source", "size"), "trees", few=True)
    count, longest = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()

    names = trees.withColumnRenamed("source", "of")
    starts = starts.join(names, F.col("source").eqNullSafe(F.col("of"))).select(F.col("range").alias("at"), "of", "start", "tree", "size")
    inside = Window.partitionBy("range", "source").orderBy(F.col("id").asc_nulls_first(), "leaf", "row")
    placed = ranged.withColumn("inside", F.row_number().over(inside) - 1)
    placed = placed.join(starts, (F.col("range") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    leaves = placed.select("tree", (F.col("start") + F.col("inside")).cast("long").alias("pos"), "size", "id", "leaf", *kept)
    leaves = written(leaves, "numbered", few=True)

    inner = build(leaves.select("tree", "pos", F.col("leaf").alias("digest"), "size"), longest, arity=arity, height=height)
    zero = F.lit(0).cast("long")
    tops = inner.roots.select(zero.alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"), F.lit(count).cast("long").alias("size"))
    outer = build(tops, count, arity=arity, height=height)
    root = outer.roots.first()
    return Manifest(leaves, trees, inner, outer, root.root if root else None)


def proofs(made: Manifest) -> DataFrame:
    """Every leaf with its siblings up to the root: the leaves' columns, ``subroot``, ``root`` and ``path``."""
    tops = made.trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"))
    upper = paths(made.outer, tops).select(F.col("pos").alias("tree"), "path")
    found = paths(made.inner, made.leaves, written(upper, "upper", few=True))
    return found.withColumn("root", F.lit(made.root))


def verify(docs: DataFrame, tampered: Sequence[Column], *, id: str = "doc_id", columns: Sequence[str] = LEAF_COLUMNS, **options) -> DataFrame:
    """Fold every row's ``tampered`` values (as ``columns``) with the original siblings.

    Returns ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and
    ``verified``, one row per row, repeated and null ids too.
    """
    told = proofs(manifest(docs, id=id, columns=columns, carry={"shown": leaf_digest(tampered)}, **options))
    told = told.withColumn("folded_root", fold(F.col("shown"), F.col("path")))
    return told.select(
        F.col("id").alias(id), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
