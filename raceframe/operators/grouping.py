"""Work inside groups that stays spread out when one group is very large.

A plain window puts a whole group into one task.  The functions here either
aggregate first (partial aggregation bounds what a group sends) or cut a group
into ordered chunks, so that no task needs more than one chunk of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups above this many rows are ranked chunk by chunk.
HOT_ROWS = 1_000_000
# Keys are counted in buckets of their hash to find those with more rows than a task should hold
# in all its windows at once.
BUCKETS = 16384
CROWDED = 100_000

_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}

Measures = Mapping[str, tuple[str, Column]]


def join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the other side's key columns go."""
    renamed = other.withColumnsRenamed({k: f"__other_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__other_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"__other_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add group aggregates to every row: aggregate, then join back on the keys; NULL is a key as well."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return join_null_safe(df, totals, keys)


def by_size(df: DataFrame, size: str | None, plan: Callable[[DataFrame, bool], DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Run ``plan(rows, hot)`` on the rows of ordinary and of very large groups apart.

    Ordinary groups fit a task, so they may use windows that share one shuffle.  The
    large ones take the spread-out way.  Without a size column all rows do.
    """
    if size is None:
        return plan(df, True)
    n = F.col(size)
    ordinary = df.filter((n <= hot_rows) | n.isNull())
    return plan(ordinary, False).unionByName(plan(df.filter(n > hot_rows), True))


def group_stats(df: DataFrame, keys: Sequence[str], hot: bool, **stats: Column) -> DataFrame:
    """Group aggregates on every row: by join for large groups, by window for the others."""
    if hot:
        return with_group_stats(df, keys, **stats)
    group = Window.partitionBy(*keys)
    return df.select("*", *[c.over(group).alias(n) for n, c in stats.items()])


def value_chunk(value: Column) -> Column:
    """Monotone bucket of a number: 256 buckets per power of two, either sign.

    In ascending order NULL comes first and NaN last, with the infinities beside the
    finite values, as in a sort.
    """
    v = value.cast("double")
    size = (F.floor(F.log2(F.abs(v)) * 256) + 300_000).cast("long")
    infinite = F.abs(v) == float("inf")
    chunk = (
        F.when(v.isNull(), -1_000_000).when(F.isnan(v), 900_000).when(infinite & (v < 0), -800_000).when(infinite, 800_000)
        .when(v == 0, 0).when(v < 0, -size).otherwise(size)
    )
    return chunk.cast("long")


def ordered_pieces(df: DataFrame, column: str, name: str, rows: int) -> DataFrame:
    """Add ``name``: the number of the piece, in rising order of a known double, a row lies in.

    Borders follow the data: values are counted per ``value_chunk``, chunks with more than
    ``rows`` rows are cut into even steps, and the steps are numbered by the rows before
    them, so that a piece has about ``rows`` rows.  Only equal values, and values closer than
    a step of a crowded chunk, stay together beyond that.
    """
    v = F.col(column)
    marked = df.withColumn("__chunk", value_chunk(v))
    chunks = marked.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"), F.min(column).alias("__low"), F.max(column).alias("__high"))
    chunks = chunks.select("__chunk", "__low", "__high", F.least(F.ceil(F.col("__n") * 4 / rows), F.lit(65536)).alias("__steps"))
    step = F.floor((v - F.col("__low")) / (F.col("__high") - F.col("__low")) * F.col("__steps"))
    marked = marked.join(chunks, "__chunk").withColumn("__step", F.when((F.col("__steps") > 4) & (F.col("__high") > F.col("__low")), step).otherwise(0).cast("long"))
    steps = marked.groupBy("__chunk", "__step").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__chunk", "__step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("__chunk", "__step", F.floor(F.coalesce(F.sum("__n").over(earlier), F.lit(0)) / rows).alias(name))
    return marked.join(steps, ["__chunk", "__step"]).select(*df.columns, name)


def prior(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    measures: Measures,
    source: DataFrame | None = None,
    hot_rows: int = CROWDED,
) -> DataFrame:
    """Aggregate, for every row, over the earlier rows of its group.

    ``measures`` maps a result name to (``sum|count|min|max``, column).  Rows are
    ordered by (``chunk``, ``order``).  A window over the group serves ordinary ones.  In
    groups whose bucket has more than ``hot_rows`` rows, and without keys, earlier chunks come
    from one total per chunk, rows of the same chunk from a window over that chunk only.  Rows
    of both are sent once, as the totals come to where the windows are.  ``source`` is an
    earlier form of the same rows to take counts and totals from.
    """
    keys = list(keys)
    source = df if source is None else source
    if keys:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
        crowded = source.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select("__bucket")
        source = source.join(F.broadcast(crowded), bucket == F.col("__bucket"), "left_semi")
    totals = source.groupBy(*keys, chunk).agg(*[_AGG[fn](c).alias(n) for n, (fn, c) in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, chunk, *[_MERGE[fn](n).over(earlier).alias(f"__c_{n}") for n, (fn, _) in measures.items()]
    )
    # Structs are equal where their fields are, also where those are NULL.
    place = lambda at: F.struct(*keys, at.alias("__at"))
    if keys:
        marked = df.join(F.broadcast(crowded), bucket == F.col("__bucket"), "left")
        rows = marked.select(*df.columns, place(F.when(F.col("__bucket").isNotNull(), F.struct(chunk))).alias("__place"))
    else:
        rows = df.select("*", place(F.struct(chunk)).alias("__place"))
    carried = carried.select(place(F.struct(chunk)).alias("__place"), *[f"__c_{n}" for n in measures])
    inside = Window.partitionBy("__place").orderBy(chunk, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[_AGG[fn](c).over(inside).alias(f"__i_{n}") for n, (fn, c) in measures.items()])
    joined = rows.join(carried, "__place", "left")
    out = []
    for name, (fn, _) in measures.items():
        c, i = F.col(f"__c_{name}"), F.col(f"__i_{name}")
        if fn in ("sum", "count"):
            value = F.when(c.isNull(), i).when(i.isNull(), c).otherwise(c + i)
            out.append((F.coalesce(value, F.lit(0)) if fn == "count" else value).alias(name))
        else:
            out.append((F.least if fn == "min" else F.greatest)(c, i).alias(name))
    return joined.select(*df.columns, *out)


@dataclass(frozen=True)
class Rank:
    """A position by one column: ``row_number`` (ties by ``ties``), ``rank`` or ``average``."""

    by: str
    name: str
    descending: bool = False
    ties: Sequence[str] = ()
    kind: str = "row_number"


def _position(rank: Rank, part: Sequence[str]) -> Column:
    lead = F.col(rank.by).desc() if rank.descending else F.col(rank.by).asc()
    order = [lead, *[F.col(t).asc() for t in rank.ties]] if rank.kind == "row_number" else [lead]
    position = (F.row_number() if rank.kind == "row_number" else F.rank()).over(Window.partitionBy(*part).orderBy(*order))
    if rank.kind == "average":
        position = position + (F.count(F.lit(1)).over(Window.partitionBy(*part, rank.by)) - 1) / 2
    return position if rank.kind == "average" else position.cast("long")


def group_ranks(df: DataFrame, keys: Sequence[str], ranks: Sequence[Rank], hot: bool) -> DataFrame:
    """Exact positions of every row in its group.

    A large group is cut by ``value_chunk``; equal values share a chunk, and each
    chunk starts at the row count of the chunks before it.  The other groups need one
    shuffle for all ranks.
    """
    keys = list(keys)
    if not hot:
        return df.select("*", *[_position(r, keys).alias(r.name) for r in ranks])
    out = df
    for r in ranks:
        step = value_chunk(F.col(r.by))
        chunk = (-step if r.descending else step).alias("__chunk")
        earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            df.select(*keys, chunk).groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
            .select(*keys, "__chunk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
        )
        columns = out.columns
        placed = join_null_safe(out.select("*", chunk).withColumn("__pos", _position(r, [*keys, "__chunk"])), starts, [*keys, "__chunk"])
        out = placed.select(*columns, (F.col("__pos") + F.col("__start")).alias(r.name))
    return out


def rank_in_group(
    df: DataFrame, keys: Sequence[str], by: str, name: str, *, descending: bool = False, ties: Sequence[str] = (),
    size: str | None = None, kind: str = "row_number", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One exact position per row; ``size`` names a column with the group size, if there is one."""
    rank = Rank(by, name, descending, tuple(ties), kind)
    return by_size(df, size, lambda rows, hot: group_ranks(rows, keys, [rank], hot), hot_rows)


def _holding(steps: DataFrame, group: Sequence[str], step: str, count: str, out: str) -> DataFrame:
    """The steps of a group, in order, that hold one of its wanted positions ``__ranks``; ``out`` rows precede them."""
    earlier = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    placed = steps.withColumn(out, F.col("__base") + F.coalesce(F.sum(count).over(earlier), F.lit(0)))
    within = F.filter("__ranks", lambda r: (r >= F.col(out)) & (r < F.col(out) + F.col(count)))
    return placed.withColumn("__ranks", within).filter(F.size("__ranks") > 0)


def quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], name: str) -> DataFrame:
    """(keys, ``name``): exact interpolated quantiles per group, an array in the order of ``shares``.

    Counts narrow down where the wanted positions lie: first by ``value_chunk``, then by
    65,537 even steps inside the chunks that hold one, then value by value inside the steps
    that hold one.  Every pass reads the rows again.  The wanted chunks, at most two for each
    share and group, are a small table that Spark broadcasts by its size or joins with split
    partitions; no task holds the values of a group.  NULL is left out, NaN is the largest value, a NULL key is a
    group, and a group without values has no row.  Without keys there is always one row, of
    NULLs if there are no values.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(column).cast("double").alias("__v")).filter(F.col("__v").isNotNull()).withColumn("__chunk", value_chunk(F.col("__v")))
    chunks = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    last = F.sum("__n").over(Window.partitionBy(*keys)) - 1
    places = F.array(*[end(last * F.lit(float(s))).cast("long") for s in shares for end in (F.floor, F.ceil)])
    chunks = _holding(chunks.withColumns({"__last": last, "__ranks": F.array_distinct(places), "__base": F.lit(0)}), keys, "__chunk", "__n", "__before")

    chunks = chunks.select(*keys, "__chunk", "__low", "__high", "__last", "__ranks", F.col("__before").alias("__base"))
    place = F.floor((F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low")) * 65536)
    found = join_null_safe(rows, chunks.select(*keys, "__chunk", "__low", "__high"), [*keys, "__chunk"], "inner")
    found = found.withColumn("__step", F.when(F.col("__high") > F.col("__low"), place).otherwise(0).cast("long"))
    steps = join_null_safe(found.groupBy(*keys, "__chunk", "__step").agg(F.count(F.lit(1)).alias("__n")), chunks, [*keys, "__chunk"], "inner")
    steps = _holding(steps, [*keys, "__chunk"], "__step", "__n", "__before")

    steps = steps.select(*keys, "__chunk", "__step", "__last", "__ranks", F.col("__before").alias("__base"))
    values = found.groupBy(*keys, "__chunk", "__step", "__v").agg(F.count(F.lit(1)).alias("__n"))
    values = join_null_safe(values, steps, [*keys, "__chunk", "__step"], "inner")
    values = _holding(values, [*keys, "__chunk", "__step"], "__v", "__n", "__before")

    # At most two positions for each share are left.
    picked = values.select(*keys, "__last", "__v", F.explode("__ranks").alias("__rank"))
    at = picked.groupBy(*keys).agg(F.first("__last").alias("__last"), F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def between(share: float) -> Column:
        spot = F.col("__last") * F.lit(float(share))
        low, high = F.floor(spot).cast("long"), F.ceil(spot).cast("long")
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when(a == b, a).otherwise((high - spot) * a + (spot - low) * b)

    return at.select(*keys, F.array(*[between(s) for s in shares]).alias(name))


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], name: str) -> DataFrame:
    """Add the quantiles of ``df``'s column to one row per group; NULL where a group has no values."""
    found = quantiles(df, keys, column, shares, name)
    return join_null_safe(stats, found, keys) if keys else stats.withColumn(name, found.scalar())


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, name: str | None = None
) -> DataFrame:
    """First ``k`` rows of every group; each map task already keeps at most ``k``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name or "__rank", F.row_number().over(w)).filter(F.col(name or "__rank") <= k)
    return ranked if name else ranked.drop("__rank")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in the given order."""
    return top_per_group(df, keys, order, 1)


def dense_ids(df: DataFrame, column: str, name: str, buckets: int = 4096) -> DataFrame:
    """(column, ``name``): the distinct known values numbered from 0 without gaps, the same on every run.

    Values are numbered inside buckets of their hash, and each bucket starts at the number
    of values in the buckets before: only one count per bucket meets in one task.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("__b", F.pmod(F.xxhash64(column), F.lit(buckets)))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = values.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(column)) - 1
    return values.withColumn("__i", inside).join(starts, "__b").select(column, (F.col("__start") + F.col("__i")).cast("long").alias(name))
