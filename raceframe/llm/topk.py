"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written

# Rows of a candidate block and of a query block, and values either may hold.
CANDIDATES, QUERIES, VALUES = 2048, 512, 1 << 19
BINS = 1024
# Scores beyond this stop there: twice the range of scores and a bin of each pass fit a long.
LIMIT = (1 << 62) - (1 << 53)
EXACT = float(1 << 53)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.floor(np.vstack(rows.to_numpy()).astype(np.float64) * 256.0)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point while that is exact, else by long integers."""
    size = np.abs(queries).max(initial=0.0) * np.abs(candidates).max(initial=0.0) * queries.shape[1]
    if size < EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(whole(queries) @ whole(candidates).T, -LIMIT, LIMIT).astype(np.int64)


def _scored(queries: pd.DataFrame, candidates: pd.DataFrame):
    """Per length of vector and run of queries: the queries' rows, candidates, scores, and where both are one row."""
    own = queries["embedding"].map(len).to_numpy()
    other = candidates["embedding"].map(len).to_numpy()
    for dim in np.unique(own):
        at = np.flatnonzero(other == dim)
        if not len(at):
            continue
        table, other_rows = _matrix(candidates["embedding"].iloc[at]), candidates["row"].to_numpy()[at]
        places = np.flatnonzero(own == dim)
        for k in range(0, len(places), 128):
            part = queries.iloc[places[k : k + 128]]
            yield part, candidates["vec_id"].to_numpy()[at], scores(_matrix(part["embedding"]), table), part["row"].to_numpy()[:, None] == other_rows[None, :]


def histogram(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Counts of scores per bin of each query's range, from the top.

    A block's bins below its own ``need``-th score can't hold the overall one, as the
    bins above already count enough; they are left out.
    """
    out = []
    for part, _, score, same in _scored(queries, candidates):
        low, width, span, need = (part[c].to_numpy()[:, None] for c in ("low", "width", "span", "need"))
        bins = (score - low) // width
        bins[same | (score < low) | (score - low >= span)] = -1
        row, column = np.nonzero(bins >= 0)
        count = np.bincount(row * BINS + bins[row, column], minlength=len(part) * BINS).reshape(len(part), BINS)
        above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
        row, column = np.nonzero((count > 0) & (above < need))
        out.append(pd.DataFrame({"asked": part["row"].to_numpy()[row], "bin": column, "count": count[row, column]}))
    return pd.concat(out) if out else pd.DataFrame({"asked": [], "bin": [], "count": []}).astype("int64")


def reached(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Scores above each query's located value, and the smallest ids that tie with it."""
    out = []
    for part, ids, score, same in _scored(queries, candidates):
        low, need = part["low"].to_numpy()[:, None], part["need"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, score, same = ids[order], score[:, order], same[:, order]
        ties = (score == low) & ~same
        keep = ((score > low) & ~same) | (ties & (np.cumsum(ties, axis=1) <= need[:, None]))
        row, column = np.nonzero(keep)
        out.append(pd.DataFrame({"asked": part["row"].to_numpy()[row], "query_id": part["vec_id"].to_numpy()[row], "vec_id": ids[column], "score": score[row, column]}))
    return pd.concat(out) if out else pd.DataFrame({"asked": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def top_k(vectors: DataFrame, queries: Column, *, id: str = "vec_id", embedding: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Queries are the rows for which ``queries`` holds, candidates all rows but the query's
    own; components count as floor(256 * x).  Everything is scored, in blocks of a bounded
    size.  The first pass fills a histogram per query over the range that the norms allow;
    each further pass refines the bin with the k-th score, until the bin is one value.  The
    last pass filters by it; ties go to smaller ids.  With fewer than ``k`` candidates all
    are returned.  Unusable vectors (null, or with a null or non-finite component) and null
    ids take no part, rows that repeat an id count once (its smallest vector), vectors are
    compared with those of the same length, and an empty one scores 0.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # At least the norm of the whole components: floor moves each by less than one.
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * 256.0) + 1.0, 2)))
    # The number of a row is fixed by writing it down.
    rows = written(rows.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id()), "vectors", few=True)
    count, asked, longest, dim = rows.agg(F.count(F.lit(1)), F.count_if("asked"), F.max("norm"), F.max(F.size("embedding"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per = max(1, VALUES // max(dim, 1))
    query_blocks = -(-asked // min(QUERIES, per))
    blocks = -(-count // min(CANDIDATES, per))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # New names: both sides of the search come from one table.
    candidates = rows.select("row", "vec_id", "embedding", block(blocks).alias("c"), every(query_blocks).alias("q"))
    candidates = candidates.select(*[F.col(c).alias(f"_{c}") for c in candidates.columns]).toDF(*candidates.columns)
    bound = F.ceil(F.least(F.col("norm") * longest * 1.000001 + 1, F.lit(float(LIMIT)))).cast("long")
    asking = rows.filter("asked").select("row", "vec_id", "embedding", bound.alias("bound"), block(query_blocks).alias("q"))
    state = asking.select("row", (-F.col("bound")).alias("low"), F.floor(F.col("bound") / (BINS // 2) + 1).alias("width"), F.lit(k).cast("long").alias("need")).withColumn("span", F.col("width") * BINS)

    def joined(state: DataFrame):
        full = asking.join(state, "row").withColumn("c", every(blocks))
        return full.groupBy("q", "c").cogroup(candidates.groupBy("q", "c"))

    while True:
        state = written(state, "state", few=True)
        if (state.agg(F.max("width")).first()[0] or 0) <= 0:
            break
        counts = joined(state.filter("width > 0")).applyInPandas(histogram, "asked long, bin long, count long").groupBy("asked", "bin").agg(F.sum("count").alias("count"))
        down = Window.partitionBy("asked").orderBy(F.col("bin").desc())
        placed = counts.withColumn("upto", F.sum("count").over(down)).join(state, F.col("asked") == F.col("row"))
        hit = placed.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need")))
        low = F.col("low") + F.col("bin") * F.col("width")
        # A bin of one value ends the search: width 0 marks it.
        found = hit.select("row", low.alias("low"), F.when(F.col("width") == 1, 0).otherwise(F.ceil(F.col("width") / BINS)).alias("width"), (F.col("need") - F.col("upto") + F.col("count")).alias("need"), F.col("width").alias("span"))
        # Too few candidates for k: everything from the bottom of the range on is returned.
        short = state.filter("width > 0").join(hit.select("row"), "row", "left_anti").select("row", (F.col("low") - 1).alias("low"), F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("need"), "span")
        state = state.filter("width <= 0").unionByName(found).unionByName(short)
    best = joined(state).applyInPandas(reached, "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
