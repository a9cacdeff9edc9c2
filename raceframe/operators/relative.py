"""Values relative to the other entries of the same event."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceframe.operators.grouping import Rank, by_size, group_ranks, group_stats, rank_in_group, top_per_group

EVENT = ["event"]
KEY = ("event", "entity")


def _ranked(df: DataFrame, columns: Sequence[str], hot: bool, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Average rank of the known values of each column, and their number.

    ``store`` writes the ranks of one column of large groups after the other and reads them
    back, so that the shuffle files of one are gone before the next.
    """
    known = {f"__n_{c}": F.count(c) for c in columns}
    if not hot:
        # NULLs sort last and are masked, so they move no rank of a known value
        ranks = []
        for c in columns:
            w = Window.partitionBy(*EVENT).orderBy(F.col(c).asc_nulls_last())
            ties = F.count(F.lit(1)).over(Window.partitionBy(*EVENT, c))
            ranks.append(F.when(F.col(c).isNotNull(), F.rank().over(w) + (ties - 1) / 2).alias(f"__r_{c}"))
        return group_stats(df, EVENT, False, **known).select("*", *ranks)
    out = group_stats(df, EVENT, True, **known)
    for c in columns:
        r = group_ranks(df.filter(F.col(c).isNotNull()).select(*KEY, c), EVENT, [Rank(c, f"__r_{c}", kind="average")], True)
        r = store(r.drop(c), f"rank-{c}") if store else r.drop(c)
        out = out.join(r, list(KEY), "left")
    return out


def rank_pct(df: DataFrame, columns: Sequence[str], prefix: str, inverted: Collection[str] = (), size: str | None = None) -> DataFrame:
    """Average rank / count among the known values of the event; NULL stays NULL."""
    def plan(rows: DataFrame, hot: bool) -> DataFrame:
        out = []
        for c in columns:
            pct = F.col(f"__r_{c}") / F.col(f"__n_{c}")
            out.append((1 - pct if c in inverted else pct).alias(f"{prefix}{c}"))
        return _ranked(rows, columns, hot).select(*rows.columns, *out)

    return by_size(df, size, plan)


def _zscores(df: DataFrame, columns: Sequence[str], prefix: str, suffix: str, inverted: Collection[str], min_std: float, hot: bool) -> DataFrame:
    stats = {f"__m_{c}": F.avg(c) for c in columns} | {f"__s_{c}": F.stddev_samp(c) for c in columns}
    joined = group_stats(df, EVENT, hot, **stats)
    out = []
    for c in columns:
        z = (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")
        z = F.coalesce(F.when(F.col(f"__s_{c}") > min_std, z), F.lit(0.0))
        out.append((-z if c in inverted else z).alias(f"{prefix}{c}{suffix}"))
    return joined.select(*df.columns, *out)


def zscores(
    df: DataFrame, columns: Sequence[str], prefix: str = "", suffix: str = "_z",
    inverted: Collection[str] = (), min_std: float = 0.0, size: str | None = None,
) -> DataFrame:
    """(x - mean) / sample std per event; 0 where the spread is at most ``min_std`` or x is NULL."""
    return by_size(df, size, lambda rows, hot: _zscores(rows, columns, prefix, suffix, inverted, min_std, hot))


def relative_features(df: DataFrame, columns: Sequence[str], smaller_is_better: Collection[str], size: str | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Rank percentage and z-score per event for many columns, larger always better."""
    def plan(rows: DataFrame, hot: bool) -> DataFrame:
        z = _zscores(rows, columns, "rr_zscore_", "", smaller_is_better, 0.0, hot)
        out = []
        for c in columns:
            pct = F.col(f"__r_{c}") / F.col(f"__n_{c}")
            out.append((1 - pct if c in smaller_is_better else pct).alias(f"rr_rank_pct_{c}"))
        return _ranked(z, columns, hot, store).select(*z.columns, *out)

    return by_size(df, size, plan)


def softmax(df: DataFrame, logit: str, name: str, size: str | None = None) -> DataFrame:
    """Softmax of a column within the event."""
    def plan(rows: DataFrame, hot: bool) -> DataFrame:
        peak = group_stats(rows, EVENT, hot, __max=F.max(logit)).withColumn("__e", F.exp(F.col(logit) - F.col("__max")))
        total = group_stats(peak, EVENT, hot, __sum=F.sum("__e"))
        return total.select(*rows.columns, (F.col("__e") / F.col("__sum")).alias(name))

    return by_size(df, size, plan)


def normalize(df: DataFrame, win: str, in3: str | None = None, cap: float = 3.0, size: str | None = None) -> DataFrame:
    """Scale ``win`` to sum 1 per event, and ``in3`` to sum ``cap`` only where it is above."""
    stats = {"__w": F.sum(win)} | ({"__i": F.sum(in3)} if in3 else {})
    new = {win: F.when(F.col("__w") > 0, F.col(win) / F.col("__w")).otherwise(F.col(win))}
    if in3:
        new[in3] = F.when(F.col("__i") > cap, F.col(in3) * (cap / F.col("__i"))).otherwise(F.col(in3))
    return by_size(df, size, lambda rows, hot: group_stats(rows, EVENT, hot, **stats).withColumns(new).select(*rows.columns))


def prediction_rank(df: DataFrame, p: str, name: str = "pred_rank", size: str | None = None) -> DataFrame:
    """Rank by falling prediction; equal predictions by entity."""
    return rank_in_group(df, EVENT, p, name, descending=True, ties=["entity"], size=size)


def top_two(df: DataFrame, p: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per event: the best entry with its prediction, the second prediction and the gap."""
    best = top_per_group(
        df.select("event", "entity", p, *keep), EVENT, [F.col(p).desc(), F.col("entity").asc()], 2, "__k"
    )
    first = F.col("__k") == 1
    out = best.groupBy("event").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("entity", *keep)],
        F.max(F.when(first, F.col(p))).alias("top1_p"),
        F.max(F.when(F.col("__k") == 2, F.col(p))).alias("top2_p"),
    )
    return out.withColumn("gap", F.col("top1_p") - F.col("top2_p"))
