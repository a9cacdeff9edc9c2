"""Features of an event from its entries, and tables of rates and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.functions import constants as K
from raceframe.functions.columns import clip, distance_band, style_score
from raceframe.operators.grouping import with_quantiles
from raceframe.operators.history import arr_sum, asof_totals, ratio, recent_values


def _is(style: str, *values: str) -> Column:
    return F.col(style).isin(list(values))


def event_style_features(df: DataFrame, style: str = "style") -> DataFrame:
    """Style counts, leader speed, pressure, partner aggressiveness and the risk of a leader duel."""
    lead = _is(style, K.STYLES[0])
    early = F.when(lead, F.col("early_speed_index"))
    zero = F.lit(0.0)
    names = {"num_nige": K.STYLES[0], "num_senkou": K.STYLES[1], "num_sashi": K.STYLES[2], "num_oikomi": K.STYLES[3]}
    out = df.groupBy("event").agg(
        F.count(F.lit(1)).alias("field_size"),
        *[F.count(F.when(_is(style, s), 1)).alias(n) for n, s in names.items()],
        F.coalesce(F.max(early), zero).alias("nige_speed_max"),
        F.coalesce(F.avg(early), zero).alias("nige_speed_mean"),
        F.coalesce(F.stddev_pop(early), zero).alias("nige_speed_std"),
        F.min(early).alias("__low"),
        F.coalesce(F.avg(F.when(_is(style, K.STYLES[1]), F.col("early_speed_index"))), zero).alias("senkou_pressure"),
        F.coalesce(F.avg(F.when(_is(style, K.STYLES[2]), F.col("late_speed_index"))), zero).alias("sashi_late_speed_mean"),
        F.coalesce(F.avg(F.when(_is(style, K.STYLES[3]), F.col("late_speed_index"))), zero).alias("oikomi_late_speed_mean"),
        F.avg("aggressiveness").alias("mean_jockey_aggressiveness"),
        F.count(F.when(F.col("aggressiveness") >= 0.6, 1)).alias("aggressive_jockey_count"),
    )
    return out.withColumn(
        "escape_competition_risk", duel_risk(F.col("num_nige"), F.col("nige_speed_max") - F.col("__low"))
    ).drop("__low")


def duel_risk(leaders: Column, difference: Column) -> Column:
    """0 for one leader, 1 from three, and for two 0.9 falling to 0.5 as their speeds differ."""
    two = F.when(difference <= 0.15, 0.9).when(difference >= 0.3, 0.5).otherwise(0.9 - (difference - 0.15) / 0.15 * 0.4)
    return F.when(leaders >= 3, 1.0).when(leaders == 2, two).otherwise(0.0)


def event_pace_inputs(df: DataFrame, style: str = "style") -> DataFrame:
    """Numbers and means of leaders and forward entries; a mean without entries is NULL and flagged."""
    lead, forward = _is(style, K.STYLES[0]), _is(style, K.STYLES[0], K.STYLES[1])
    out = df.groupBy("event").agg(
        F.count(F.lit(1)).alias("n_horses"),
        F.count(F.when(lead, 1)).alias("n_escape"),
        F.count(F.when(forward, 1)).alias("n_leading"),
        F.avg(F.when(lead, F.col("corner1"))).alias("escape_avg_corner1"),
        F.avg(F.when(lead, F.col("last3f"))).alias("escape_best_3f"),
        F.avg(F.when(forward, F.col("corner1"))).alias("leading_avg_corner1"),
        F.avg(F.when(forward, F.col("last3f"))).alias("leading_best_3f"),
        F.avg("post").alias("avg_gate_number"),
    )
    return out.withColumns(
        {
            "escape_ratio": F.col("n_escape") / F.col("n_horses"),
            "has_escape_horse": F.when(F.col("n_escape") > 0, 1).otherwise(0),
            "has_leading_horse": F.when(F.col("n_leading") > 0, 1).otherwise(0),
        }
    )


def style_profile(df: DataFrame, style: str, n: int = 10) -> DataFrame:
    """Most frequent style, style shares and recency-weighted position over the last ``n`` runs.

    Equal counts go to the style that is first in the fixed order.
    """
    rel = df.withColumn("__rel", F.col("corner1") / F.col("field_size"))
    known = F.filter(F.transform("recent", lambda x: x[style]), lambda s: s != K.STYLE_UNKNOWN)
    weighted = F.transform("recent", lambda x, i: F.struct(
        x["__rel"].alias("v"),
        F.coalesce(F.try_element_at(F.array(*[F.lit(w) for w in K.RECENCY_WEIGHTS]), i + 1), F.lit(0.2)).alias("w")))
    parts = {"__styles": known, "__w": F.filter(weighted, lambda x: x["v"].isNotNull())}

    def count_of(name: str) -> Column:
        return F.size(F.filter("__styles", lambda v: v == name))

    counts = [count_of(s) for s in K.STYLES]
    best = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, (c, s) in enumerate(zip(counts, K.STYLES))]))
    total = F.size("__styles")
    weight = arr_sum(F.transform("__w", lambda x: x["w"]))
    values = {
        "main_style": F.when(total > 0, best["s"]),
        **{f"share_{name}": ratio(c, total) for c, name in zip(counts, ("nige", "senkou", "sashi", "oikomi"))},
        "avg_pos_rel": F.when(weight > 0, arr_sum(F.transform("__w", lambda x: x["v"] * x["w"])) / weight),
        "race_count": F.size("recent").cast("long"),
    }
    r = recent_values(rel, n, [style, "__rel"], parts, values)
    return r.select(*df.columns, F.coalesce("main_style", F.lit(K.STYLE_UNKNOWN)).alias("main_style"), *[c for c in values if c != "main_style"])


def aggressiveness(df: DataFrame, style: str, key: str = "actor", min_runs: int = 20, weight: float = 0.5) -> DataFrame:
    """Mean style score per actor; few runs are averaged with the mean over actors.

    Scores are summed as whole tenths and means over actors as decimals, so the result
    does not depend on the order of the rows.
    """
    tenths = F.round(style_score(style) * 10).cast("long")
    per = (
        df.withColumn("__s", tenths).filter(F.col("__s").isNotNull())
        .groupBy(key).agg((F.sum("__s") / (10.0 * F.count(F.lit(1)))).alias("__m"), F.count(F.lit(1)).alias("n"))
    )
    overall = per.agg(F.avg(F.col("__m").cast("decimal(28,12)")).cast("double")).scalar()
    score = F.when(F.col("n") < min_runs, (1 - weight) * F.col("__m") + weight * overall).otherwise(F.col("__m"))
    # Halves of the last kept place are settled before anyone rounds to fewer.
    return per.select(key, "n", clip(F.round(score, 9), 0.0, 1.0).alias("aggressiveness"))


def smoothed_rate(hits: Column, n: Column, alpha: float, p0: float) -> Column:
    """(hits + alpha * p0) / (n + alpha)."""
    return (hits + alpha * p0) / (n + alpha)


def smoothed_rates_asof(df: DataFrame, late: Column, front: Column, min_runs: int = 5) -> DataFrame:
    """Late-start rate of the entity and front-running rate of the actor before the event."""
    e = asof_totals(df, ["entity"], {"__en": ("count", F.lit(1)), "__ek": ("count", F.when(late, 1))})
    a = asof_totals(df, ["actor"], {"__an": ("count", F.lit(1)), "__ak": ("count", F.when(front, 1))})
    joined = df.join(e, ["entity", "day"], "left").join(a, ["actor", "day"], "left")
    front_rate = F.when(F.col("__an") < min_runs, 0.18).otherwise(smoothed_rate(F.col("__ak"), F.col("__an"), 40.0, 0.18))
    return joined.select(
        *df.columns,
        smoothed_rate(F.col("__ek"), F.col("__en"), 20.0, 0.10).alias("late_start_rate"),
        F.coalesce(ratio("__ek", "__en"), F.lit(0.0)).alias("late_start_rate_raw"),
        front_rate.alias("front_runner_rate"),
    )


def going_split(df: DataFrame, index: str, prior: float, limit: float = 1.5) -> DataFrame:
    """Win rate and runs on fast (index below -limit) and slow (above limit) going before the event."""
    win = F.col("outcome") == 1
    fast, slow = F.col(index) < -limit, F.col(index) > limit
    t = asof_totals(
        df, ["entity"],
        {
            "fast_n": ("count", F.when(fast, 1)), "__fw": ("count", F.when(fast & win, 1)),
            "slow_n": ("count", F.when(slow, 1)), "__sw": ("count", F.when(slow & win, 1)),
        },
    )
    return df.join(t, ["entity", "day"], "left").select(
        *df.columns, F.coalesce(ratio("__fw", "fast_n"), F.lit(prior)).alias("high_speed_win_rate"),
        F.coalesce(ratio("__sw", "slow_n"), F.lit(prior)).alias("slow_win_rate"),
        F.col("fast_n").alias("high_speed_count"), F.col("slow_n").alias("slow_count"),
    )


def normalize_by(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, mean: str, std: str, name: str) -> DataFrame:
    """(value - mean) / std of the key, 0 where the spread is 0 or unknown."""
    joined = df.join(stats.select(*keys, F.col(mean).alias("__m"), F.col(std).alias("__s")), list(keys), "left")
    z = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))
    return joined.select(*df.columns, F.coalesce(z, F.lit(0.0)).alias(name))


def nearest_baseline(probes: DataFrame, baseline: DataFrame, keys: Sequence[str], near: str, value: str, default: float) -> DataFrame:
    """Baseline of the same key at the nearest ``near`` value, the smaller one on a tie, else the default.

    A baseline holds one row per key and distance, so an array per key is small.
    """
    table = baseline.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(near).alias("at"), F.col(value).alias("v")))).alias("__b")
    )
    best = F.array_min(
        F.transform("__b", lambda b: F.struct(F.abs(b["at"] - F.col(near)).alias("d"), b["at"].alias("at"), b["v"].alias("v")))
    )
    joined = probes.join(table, list(keys), "left")
    return joined.select(*probes.columns, F.coalesce(best["v"], F.lit(default)).alias("baseline"))


def pace_class(value: Column, baseline: Column, width: float = 0.5) -> Column:
    """High, standard or slow pace around the baseline."""
    return F.when(value < baseline - width, "ハイペース").when(value > baseline + width, "スローペース").otherwise("標準ペース")


def clip_ranges(df: DataFrame, columns: Sequence[str], percentile: float = 99.5, min_rows: int = 10) -> DataFrame:
    """Low and high quantile per (surface, distance band) with enough rows."""
    low = (100 - percentile) / 2 / 100
    keys = ["surface", "band"]
    banded = df.withColumn("band", distance_band("distance"))
    out = banded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    for c in columns:
        out = with_quantiles(out, banded, keys, c, [low, 1 - low], "__q")
        out = out.withColumns({f"{c}_low": F.col("__q")[0], f"{c}_high": F.col("__q")[1]}).drop("__q")
    return out


def apply_clip(df: DataFrame, ranges: DataFrame, column: str, name: str) -> DataFrame:
    """Hold a column within the learned range of its surface and band."""
    banded = df.withColumn("band", distance_band("distance"))
    joined = banded.join(ranges.select("surface", "band", f"{column}_low", f"{column}_high"), ["surface", "band"], "left")
    held = clip(column, F.coalesce(F.col(f"{column}_low"), F.col(column)), F.coalesce(F.col(f"{column}_high"), F.col(column)))
    return joined.select(*df.columns, held.alias(name))


def backfill(events: DataFrame, rows: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fill missing event attributes from the first row of the event, in a fixed order, that knows them."""
    first = rows.groupBy("event").agg(
        *[
            F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f"__b_{f}")
            for f in fields
        ]
    )
    joined = events.join(first, "event", "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.col(f"__b_{f}")) for f in fields}).select(*events.columns)
