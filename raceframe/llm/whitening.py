"""Embedding whitening on MLlib's distributed block matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix, Matrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written
from raceframe.llm.topk import usable

# Values of a block, and blocks of rows that one task multiplies and adds up.
VALUES, BLOCKS = 1 << 16, 16
# Rows of a range while rows are numbered, and most ranges.
RANGE_ROWS, MOST_RANGES = 25_000, 20_000
# Eigenvalues below this share of the trace count as zero.
NOTHING = 1e-12


def whole(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * c) of every component c as a long; never -0."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``index`` from 0 without gaps: ranges of ``order``, each numbered inside, started by the counts before."""
    parts = min(MOST_RANGES, max(1, -(-rows.count() // RANGE_ROWS)))
    ranged = written(rows.repartitionByRange(parts, order).withColumn("range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("count"))
    starts = counts.select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    out = ranged.withColumn("inside", inside).join(starts, "range")
    return out.withColumn("index", (F.col("start") + F.col("inside")).cast("long")).drop("range", "start", "inside")


def block_rows(dim: int) -> int:
    """Rows of a block: so many that it holds about ``VALUES`` values."""
    return max(1, VALUES // dim)


def block_matrix(rows: DataFrame, vector: Column, count: int, dim: int) -> BlockMatrix:
    """Rows (index, ``vector``) as blocks of consecutive rows over all columns, kept while they are used.

    Rows meet in their block as one array of doubles: ``IndexedRowMatrix.toBlockMatrix``
    would send every value as an object of its own.
    """
    per = block_rows(dim)
    place = F.struct((F.col("index") % per).alias("at"), vector.alias("v"))
    blocks = rows.groupBy(F.floor(F.col("index") / per).cast("long").alias("block")).agg(F.sort_array(F.collect_list(place)).alias("rows"))
    blocks = blocks.select("block", F.flatten("rows.v").alias("values"))

    def dense(row) -> tuple[tuple[int, int], DenseMatrix]:
        values = np.array(row["values"], dtype=np.float64).reshape(-1, dim)
        return (row["block"], 0), DenseMatrix(len(values), dim, values.ravel(order="F"))

    return BlockMatrix(blocks.rdd.map(dense), per, dim, count, dim).persist(StorageLevel.MEMORY_AND_DISK)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """matrix' * matrix, small and dense.

    The middle dimension is split, so that the products of a bounded number of blocks are
    added per task before their sums meet; the plain call would bring all blocks to one.
    """
    dim = matrix.numCols()
    splits = max(1, -(-matrix.numRows() // (block_rows(dim) * BLOCKS)))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, dim, dim).toLocalMatrix().toArray()


@dataclass(frozen=True)
class Whitening:
    """Mean, eigenvalues (falling), unit eigenvectors (columns) and trace of the covariance; ``n`` vectors, their sums."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def matrix(self, components: int) -> np.ndarray:
        """Columns that project a centred vector on a component in units of its deviation; zero where there is none."""
        values = self.values[:components]
        fine = values > NOTHING * max(self.trace, 0.0)
        return self.vectors[:, :components] * np.where(fine, 1.0 / np.sqrt(np.where(fine, values, 1.0)), 0.0)


def centred(x: str, model_sums: list[int], n: int) -> Column:
    """x - S / n as doubles."""
    mean = F.array(*[F.lit(s / n) for s in model_sums])
    return F.zip_with(x, mean, lambda v, m: v.cast("double") - m)


def deviation(x: str, model: Whitening, rows: DataFrame) -> Column:
    """Sum of (n * x - S)^2 in whole numbers: in longs where that is safe, else in decimals, null beyond a long."""
    largest = rows.agg(F.max(F.array_max(F.transform(x, F.abs)))).first()[0] or 0
    kind = "long" if len(model.sums) * (2 * model.n * largest) ** 2 < 1 << 63 else "decimal(38,0)"
    total = F.array(*[F.lit(s).cast(kind) for s in model.sums])
    gap = F.zip_with(x, total, lambda v, s: F.lit(model.n).cast(kind) * v.cast(kind) - s)
    squares = F.aggregate(gap, F.lit(0).cast(kind), lambda a, g: (a + g * g).cast(kind))
    return squares if kind == "long" else squares.try_cast("long")


def fit(vectors: DataFrame, n: int, dim: int) -> Whitening:
    """Components of rows (index, x), every x once: covariance by blocks, eigenvectors on the driver (``dim`` squared)."""
    totals = vectors.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("sum")).collect()
    sums = [0] * dim
    for row in totals:
        sums[row["at"]] = row["sum"]
    matrix = block_matrix(vectors, centred("x", sums, n), n, dim)
    covariance = scatter(matrix) / n
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    values, columns = values[::-1], columns[:, ::-1]
    # Either sign would do: the largest entry is positive, so that reruns agree.
    peak = np.abs(columns).argmax(axis=0)
    columns = columns * np.where(columns[peak, np.arange(dim)] < 0, -1.0, 1.0)
    return Whitening(n, sums, np.maximum(values, 0.0), columns, float(np.trace(covariance)))


def project(rows: DataFrame, x: Column, count: int, model: Whitening, components: int) -> DataFrame:
    """(index, whitened): each row's block of centred vectors multiplied by the whitening matrix."""
    spark, dim = rows.sparkSession, len(model.sums)
    block = DenseMatrix(dim, components, model.matrix(components).ravel(order="F"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), dim, components, dim, components)
    product = block_matrix(rows, x, count, dim).multiply(right)
    per = block_rows(dim)

    def rows_of(block: tuple[tuple[int, int], Matrix]):
        (at, _), matrix = block
        return [(at * per + k, values) for k, values in enumerate(matrix.toArray().tolist())]

    return spark.createDataFrame(product.blocks.flatMap(rows_of), "index long, whitened array<double>")


def whiten(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and leading component.

    Components c count as x = floor(256 * c).  Every distinct x is in the fit list once: n
    vectors with sums S.  ``deviation`` is the exact sum over dimensions of (n * x - S)^2,
    ``whitened`` the centred vector on the component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, and ``identity_error`` the largest
    difference between the covariance of ``whitened`` over the fit list and the identity.

    Vectors that are null, empty or hold a null or non-finite entry have no rows.  Of vectors
    of different lengths, those of the most frequent length (the greater of equals) take
    part.  Repeated and null ids keep a row each.  Without variance along a component
    (fewer distinct vectors than components, equal vectors) ``whitened`` is null there,
    ``explained`` is 0 (null where the trace is 0) and the component is left out of
    ``identity_error``, which is null if none is left.
    """
    spark = prepare(vectors.sparkSession)
    kind = dict(vectors.dtypes)[id]
    schema = f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("c")).filter(usable(F.col("c")) & (F.size("c") > 0))
    rows = rows.select("id", whole(F.col("c")).alias("x"), F.size("c").alias("dim"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "whole", few=True)
    widths = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), F.col("dim").desc()).first()
    if widths is None:
        return spark.createDataFrame([], schema)
    dim, count = widths
    rows = written(numbered(rows.filter(F.col("dim") == dim), "row"), "indexed", few=True)
    first = rows.groupBy("x").agg(F.min("index").alias("of"))
    distinct = written(numbered(first, "of"), "distinct", few=True)
    n = distinct.count()
    model = fit(distinct, n, dim)

    most = min(components, dim)
    found = written(project(rows, centred("x", model.sums, n), count, model, most), "projected", few=True)
    listed = found.join(distinct.select(F.col("of").alias("index")), "index", "left_semi")
    entry = lambda k: F.element_at("whitened", k + 1)
    means = listed.agg(*[F.avg(entry(k)) for k in range(most)]).first()
    pairs = [(i, j) for i in range(most) for j in range(i, most) if (model.matrix(most)[:, [i, j]] != 0).any(axis=0).all()]
    moved = [entry(k) - F.lit(means[k]) for k in range(most)]
    error = None
    if pairs:
        sums = listed.agg(*[(F.sum(moved[i] * moved[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(value - (i == j)) for value, (i, j) in zip(sums, pairs, strict=True))

    rows = rows.select("id", "index", deviation("x", model, rows).alias("deviation")).join(found, "index")
    alive = [bool((model.matrix(most)[:, k] != 0).any()) for k in range(most)]
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.values[:most]]
    told = F.array(*[
        F.struct(F.lit(k + 1).alias("component"), F.when(F.lit(alive[k]), entry(k)).alias("whitened"), F.lit(share[k] if alive[k] or share[k] is None else 0.0).cast("double").alias("explained"))
        for k in range(most)
    ])
    rows = rows.select("id", "deviation", F.explode(told).alias("told"))
    return rows.select(
        F.col("id").alias(id), "told.component", F.lit(n).cast("long").alias("n"), "deviation", "told.whitened", "told.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
