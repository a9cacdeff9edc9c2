"""Comparison of feature versions by importance and safety.

A catalogue has one row per (version, feature, gain).  It holds feature names, so
its size does not grow with the data; windows are per version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.functions import constants as K
from raceframe.functions.columns import feature_group, feature_safety, prefix_group
from raceframe.operators.history import ratio



def _best_first() -> list[Column]:
    return [F.col("gain").desc(), F.col("feature").asc()]


def with_rank(df: DataFrame) -> DataFrame:
    """Rank, share of the best gain and running share per version; equal gains share the running value."""
    version = Window.partitionBy("version")
    ordered = version.orderBy(*_best_first())
    equal = Window.partitionBy("version", "gain")
    upto = version.orderBy(F.col("gain").desc()).rangeBetween(Window.unboundedPreceding, 0)
    top, total = F.max("gain").over(version), F.sum("gain").over(version)
    running = F.sum("gain").over(upto) - (F.count(F.lit(1)).over(equal) - 1) * F.col("gain")
    return df.withColumns(
        {
            "rank": F.row_number().over(ordered).cast("long"),
            "gain_norm": F.when(top > 0, F.col("gain") / top).otherwise(0.0),
            "cumulative": F.when(total > 0, running / total).otherwise(0.0),
        }
    )


def with_safety(df: DataFrame) -> DataFrame:
    label, notes = feature_safety("feature")
    return df.withColumns({"safety_label": label, "safety_notes": notes})


def compare_versions(df: DataFrame, versions: Sequence[str]) -> DataFrame:
    """One row per feature with rank, gain, shares and presence in every version."""
    ranked = with_rank(df)

    def of(v: str, c: str) -> Column:
        return F.max(F.when(F.col("version") == v, F.col(c)))

    cols = []
    for v in versions:
        cols += [of(v, c).alias(f"{v}_{c}") for c in ("rank", "gain", "gain_norm", "cumulative")]
        cols.append((F.count(F.when(F.col("version") == v, 1)) > 0).alias(f"{v}_present"))
    wide = with_safety(ranked.groupBy("feature").agg(*cols))
    return wide.withColumn("group", prefix_group("feature"))


def top_features(df: DataFrame, n: int) -> DataFrame:
    """Best ``n`` features of every version."""
    return with_rank(df).filter(F.col("rank") <= n).select("version", "feature", "rank", "gain")


def common_top(df: DataFrame, n: int, min_versions: int = 2) -> DataFrame:
    """Features among the best ``n`` of at least two versions."""
    return top_features(df, n).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_versions"), F.avg("rank").alias("avg_rank"), F.sum("gain").alias("total_gain")
    ).filter(F.col("n_versions") >= min_versions)


def version_diff(df: DataFrame, new: str, old: str, min_gain: float = 0.01, min_rank: int = 5) -> DataFrame:
    """New, removed and changed features; small changes of gain and rank are left out."""
    ranked = with_rank(df)

    def side(v: str, p: str) -> DataFrame:
        return ranked.filter(F.col("version") == v).select("feature", F.col("gain").alias(f"{p}_gain"), F.col("rank").alias(f"{p}_rank"))

    both = side(new, "new").join(side(old, "old"), "feature", "full_outer")
    kind = F.when(F.col("old_rank").isNull(), "new").when(F.col("new_rank").isNull(), "removed").otherwise("changed")
    out = both.withColumns(
        {
            "change_type": kind,
            "gain_diff": F.coalesce("new_gain", F.lit(0)) - F.coalesce("old_gain", F.lit(0)),
            "rank_diff": F.col("old_rank") - F.col("new_rank"),
        }
    )
    big = (F.abs("gain_diff") >= min_gain) | (F.abs("rank_diff") >= min_rank)
    return with_safety(out.filter((F.col("change_type") != "changed") | F.coalesce(big, F.lit(False))))


def safety_summary(df: DataFrame, top_n: int) -> DataFrame:
    """Counts and shares by safety per version, and the first names of each kind within the top."""
    rows = with_safety(with_rank(df))

    def count(label: str, within: bool = False) -> Column:
        test = F.col("safety_label") == label
        return F.count(F.when(test & (F.col("rank") <= top_n) if within else test, 1))

    def names(label: str) -> Column:
        hit = (F.col("safety_label") == label) & (F.col("rank") <= top_n)
        text = F.concat(F.col("feature"), F.lit(" (rank="), F.col("rank").cast("string"), F.lit(")"))
        listed = F.slice(F.sort_array(F.collect_list(F.when(hit, F.struct("rank", text.alias("t"))))), 1, 5)
        return F.array_join(F.transform(listed, lambda x: x["t"]), "; ")

    n = F.count(F.lit(1))
    return rows.groupBy("version").agg(
        n.alias("n_features"), count("unsafe").alias("n_unsafe"), count("warn").alias("n_warn"), count("safe").alias("n_safe"),
        (count("unsafe") / n * 100).alias("unsafe_pct"), (count("warn") / n * 100).alias("warn_pct"),
        count("unsafe", True).alias("unsafe_in_top_n"), count("warn", True).alias("warn_in_top_n"),
        names("unsafe").alias("unsafe_features_in_top"), names("warn").alias("warn_features_in_top"),
    )


def migration_candidates(df: DataFrame, source: str, target: str, top_k: int) -> DataFrame:
    """Best features of one version that the other lacks, with the action their safety allows."""
    ranked = with_rank(df)
    best = ranked.filter((F.col("version") == source) & (F.col("rank") <= top_k)).select("feature", "gain", "rank")
    absent = best.join(ranked.filter(F.col("version") == target).select("feature"), "feature", "left_anti")
    out = with_safety(absent).withColumn("reason_tag", prefix_group("feature"))
    label = F.col("safety_label")
    return out.withColumns(
        {
            "suggested_action": F.when(label == "unsafe", "skip").when(label == "warn", "needs_review").otherwise("port"),
            "blocked_reason": F.when(label == "safe", "").otherwise(F.concat(label, F.lit(": "), F.col("safety_notes"))),
        }
    )


def bridge_features(candidates: DataFrame, max_features: int, include_warn: bool = True) -> DataFrame:
    """Candidates that pass the safety gate, best first, up to the cap; unsafe ones never pass."""
    allowed = ["safe", "warn"] if include_warn else ["safe"]
    passed = candidates.filter(F.col("safety_label").isin(allowed) & (F.col("suggested_action") != "skip"))
    return passed.orderBy("rank", "feature").limit(max_features)


def explain_features(df: DataFrame, descriptions: DataFrame | None = None, exclude_warn: bool = False) -> DataFrame:
    """Display name, origin, safety and description of every feature in the order of its gain."""
    bridged = F.col("feature").startswith(K.BRIDGE_PREFIX)
    shown = F.when(bridged, F.expr(f"substring(feature, {len(K.BRIDGE_PREFIX) + 1})")).otherwise(F.col("feature"))
    out = with_safety(df).withColumns(
        {"display_name": shown, "origin": F.when(bridged, "v3_bridged").otherwise("v4_native")}
    )
    if exclude_warn:
        out = out.filter(F.col("safety_label") != "warn")
    if descriptions is not None:
        out = out.join(descriptions, "display_name", "left")
    return out.withColumn("position", F.row_number().over(Window.partitionBy("version").orderBy(*_best_first())).cast("long"))


def group_importance(df: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Gain per feature group: total, mean, largest, the names of the best three, mean permutation change."""
    rows = df.withColumn("group_name", feature_group("feature"))
    if deltas is not None:
        rows = rows.join(deltas.select("feature", "delta"), "feature", "left")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("g"), F.col("feature").alias("f")))), 1, 3)
    aggs = [
        F.count(F.lit(1)).alias("n_features"), F.sum("gain").alias("total_gain"), F.avg("gain").alias("mean_gain"),
        F.max("gain").alias("max_gain"), F.sum("split").alias("total_split"),
        F.array_join(F.transform(best, lambda x: x["f"]), ",").alias("top_features"),
    ]
    if deltas is not None:
        aggs.append(F.avg("delta").alias("perm_delta"))
    return rows.groupBy("version", "group_name").agg(*aggs)


def prefix_importance(df: DataFrame) -> DataFrame:
    """Gain and number of features per version and name prefix, with the share of the version's gain."""
    total = Window.partitionBy("version")
    out = df.groupBy("version", prefix_group("feature").alias("group")).agg(F.count(F.lit(1)).alias("n"), F.sum("gain").alias("gain"))
    return out.withColumn("share", ratio(F.col("gain"), F.sum("gain").over(total)))
