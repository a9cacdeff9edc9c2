"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written

# Two neighbours of the Fibonacci sequence: i * LOWER / UPPER modulo 1 is the golden-ratio
# sequence in exact integers.
FIB_LOWER, FIB_UPPER = 1_134_903_170, 1_836_311_903
CELLS = 4096
# A source has at least this many blocks, unless they would be shorter than the least block.
LEAST_BLOCKS = 256
LEAST_TOKENS = 16
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``place``, ``target``.

    Sources in code-point order, null last, take the weights in turn.  They share
    ``share`` times all sizes; a target stops at ``most`` times its source's size and the
    excess is shared by weight among the others.  The level at which nobody is above is
    found directly: sorted by cap per weight, the capped sources come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1))
    rows = rows.select("*", (F.col("source_size") * most).alias("cap"), (F.sum("source_size").over(everything) * share).alias("total"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped_before"), F.sum("weight").over(after).alias("weight_after"),
    )
    rows = rows.withColumn("capped", F.col("ratio") * F.col("weight_after") <= F.col("total") - F.col("capped_before"))
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - spent) / free * F.col("weight"))
    return rows.select("source", "source_size", "place", F.least(target, "cap").alias("target"))


def block_tokens(total: float) -> int:
    """Tokens per block: about a million blocks, between 16 and 4096 tokens each."""
    return min(4096, max(LEAST_TOKENS, int(total) >> 20))


def own_block(size: Column, block: int) -> Column:
    """Tokens per block of one source: ``block``, or less where that is too much of its size."""
    return F.least(F.lit(block), F.greatest(F.lit(LEAST_TOKENS), F.floor(size / LEAST_BLOCKS))).cast("long")


def slot_counts(targets: DataFrame, block: int) -> DataFrame:
    """Add ``own``, ``blocks``, ``passes``, ``rest`` and ``slots`` to the sources.

    ``own`` is the source's block size, ``blocks`` how many it has.  The target, to the
    nearest word, is ``passes`` times the whole source and the first ``rest`` words of it;
    ``slots`` is the number of blocks that takes, the last one cut short where it must be.
    """
    rows = targets.withColumn("own", own_block(F.col("source_size"), block)).filter("source_size > 0")
    want = F.floor(F.col("target") + 0.5)
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.col("own"))).withColumn("passes", F.floor(want / F.col("source_size")))
    rows = rows.withColumn("rest", want - F.col("passes") * F.col("source_size"))
    return rows.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / F.col("own")))


def schedule(counted: DataFrame) -> DataFrame:
    """One row per slot: ``slot``, ``place`` of its source, ``rank`` among its slots, ``block`` and ``part``.

    Slot i is the point i * golden ratio modulo 1, mapped through the cumulative ``slots``
    of the sources.  A source is drawn about as often as it has slots; what is drawn beyond
    is left out, what is missing follows at the end, so that every source has exactly its
    slots, however small its share is.  ``part`` is the number of words of a last, shorter
    block, else null.  Ranks come from counts per (source, run of slots) and a row number
    inside a run, so a source with most slots stays spread out.
    """
    spark = counted.sparkSession
    slots = counted.agg(F.sum("slots")).first()[0] or 0
    run, step = max(64, slots >> 10), max(1, -(-slots // CELLS))
    by_place = Window.orderBy("place")
    bounds = counted.filter("slots > 0").select("place", "slots", F.sum("slots").over(by_place).alias("high")).withColumn("low", F.col("high") - F.col("slots"))
    cell = lambda c: F.floor(c / step)
    bounds = bounds.select("place", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    point = F.floor((F.col("slot") % FIB_UPPER * FIB_LOWER % FIB_UPPER).cast("double") / FIB_UPPER * slots)
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", cell(F.col("point")))
    drawn = drawn.join(bounds, "cell").filter("point >= low and point < high").select("slot", "place", F.floor(F.col("slot") / run).alias("run"))
    drawn = written(drawn, "drawn")
    inside = Window.partitionBy("place", "run").orderBy("slot")
    earlier = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("place", "run").count()
    starts = counts.select("place", "run", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    ranked = drawn.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["place", "run"])
    ranked = ranked.select("slot", "place", (F.col("start") + F.col("inside")).alias("rank"))
    have = counts.groupBy("place").agg(F.sum("count").alias("have"))
    short = counted.join(have, "place", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < slots")
    short = short.select("place", F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"))
    ranked = ranked.unionByName(short.select((F.lit(slots) + F.col("rank")).alias("slot"), "place", "rank"))
    cut = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return ranked.join(counted.select("place", "slots", "blocks", "own", "rest"), "place").filter("rank < slots").select(
        "slot", "place", "rank", (F.col("rank") % F.col("blocks")).alias("block"),
        F.when(cut, F.col("rest") - (F.ceil(F.col("rest") / F.col("own")) - 1) * F.col("own")).alias("part"),
    )


def token_stream(sizes: DataFrame, n: int) -> DataFrame:
    """Add ``begin``: tokens of the source before this document in its shuffled order.

    The order is that of an MD5 of the id; a source is cut by the first digits of it, with
    more digits for more documents, and each cut starts at the tokens of the cuts before.
    """
    digits = max(2, math.ceil(math.log(max(n, 1) / 100_000 + 1, 16)))
    rows = sizes.filter("size > 0").withColumn("cut", F.substring("shuffle", 1, digits))
    earlier = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "cut").orderBy("shuffle", "row").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "cut").agg(F.sum("size").alias("sum")).select(
        F.col("source").alias("of"), F.col("cut").alias("at"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start")
    )
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("at"))).select(
        *sizes.columns, (F.col("start") + F.col("inside")).alias("begin")
    )


def mix(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """How many words the mix takes of every document.

    Returns ``id``, ``size``, ``source_size``, ``target`` and ``taken``.  Each source's
    documents, shuffled by a hash of the id, are one stream of words cut into equal blocks, shorter ones for small sources.
    Slots of the schedule are ranked per source; rank r takes block r modulo the number of
    blocks, so a source starts again once it is used up, at most ``most`` times, and the
    last block is cut so that the source's words are its target to the nearest word.
    Empty and null texts have size 0 and are never taken; a null source is a source of its own.
    Rows that repeat an id count as documents of their own, told apart by their text's
    hash; rows equal in all of these share what they take evenly, which rounds down.
    """
    spark = prepare(docs.sparkSession)
    sizes = docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
        F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("row"),
    )
    sizes = written(sizes, "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets", few=True)
    n, total = sizes.count(), targets.agg(F.sum("target")).first()[0] or 0.0
    if total > 0:
        counted = written(slot_counts(targets, block_tokens(total)), "slots", few=True)
        times = schedule(counted).groupBy("place", "block").agg(
            F.count_if(F.col("part").isNull()).alias("times"), F.coalesce(F.max("part"), F.lit(0)).alias("part"))
        stream = token_stream(sizes, n)
        of = counted.select(F.col("source").alias("of"), "place", "own")
        cut = stream.join(of, F.col("source").eqNullSafe(F.col("of"))).select("id", "row", "place", "size", "begin", "own", F.explode(
            F.sequence(F.floor(F.col("begin") / F.col("own")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("own")))).alias("block"))
        first = F.greatest(F.col("begin"), F.col("block") * F.col("own"))
        upto = lambda words: F.greatest(F.least(F.col("begin") + F.col("size"), F.col("block") * F.col("own") + words) - first, F.lit(0))
        taken = cut.join(times, ["place", "block"]).groupBy("id", "row", "place", "begin").agg(
            F.sum(upto(F.col("own")) * F.col("times") + upto(F.col("part"))).alias("taken"))
        # A document is found again by its id, text hash and place; equal rows share evenly.
        taken = taken.groupBy("id", "row", "place").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    else:
        taken = spark.createDataFrame([], "id long, row long, place int, taken long, rows long")
    rows = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).alias("s")
    t = taken.alias("t")
    rows = rows.join(t, F.col("s.id").eqNullSafe(F.col("t.id")) & (F.col("s.row") == F.col("t.row")) & (F.col("s.place") == F.col("t.place")), "left")
    return rows.select(
        F.col("s.id").alias(id), F.col("s.size").alias("size"), "source_size", "target",
        F.coalesce(F.floor(F.col("taken") / F.col("rows")), F.lit(0)).cast("long").alias("taken"),
    )
