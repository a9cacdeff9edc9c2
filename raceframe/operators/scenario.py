"""Re-weighting of predicted probabilities by scenarios.

A scenario is a row per (event, scenario), so any number of scenarios of any
number of events is one join and one normalisation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.functions import constants as K
from raceframe.functions.columns import clip, logit
from raceframe.operators.grouping import Rank, by_size, group_ranks, group_stats, top_per_group

KEYS = ["event", "scenario"]


def _factor(table: Mapping[tuple, tuple], which: int, *keys: Column) -> Column:
    """Coefficient of a small table by its keys, 1 if it is not listed."""
    pairs = []
    for k, v in table.items():
        pairs += [F.lit("|".join(k)), F.lit(float(v[which]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("|", *keys)), F.lit(1.0))


def with_roles(entries: DataFrame, scenarios: DataFrame, roles: DataFrame, names: Sequence[str]) -> DataFrame:
    """Entries times the scenarios of their event, with a flag ``is_<role>`` per name.

    ``roles`` has a row per (event, scenario, entity, role): rows rather than lists per event,
    so that an event of any size joins by entity.  An entry gets the scenarios of each of its
    roles before it is multiplied, so that the many rows of all scenarios are never shuffled:
    they are made where the event's entries and scenarios meet.
    """
    told = roles.groupBy("event", "entity").agg(*[F.collect_set(F.when(F.col("role") == n, F.col("scenario"))).alias(f"__{n}") for n in names])
    df = entries.join(told, ["event", "entity"], "left").join(scenarios, "event")
    flags = {f"is_{n}": F.coalesce(F.array_contains(f"__{n}", F.col("scenario")), F.lit(False)) for n in names}
    return df.withColumns(flags).drop(*[f"__{n}" for n in names])


def _by_table(c: Column, table: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def scale_by_total(df: DataFrame, keys: Sequence[str], win: str, in3: str, size: str | None = None) -> DataFrame:
    """``win`` to sum 1 per group, ``in3`` to sum 3 only where it is above."""
    new = {
        win: F.when(F.col("__w") > 0, F.col(win) / F.col("__w")).otherwise(F.col(win)),
        in3: F.when(F.col("__i") > 3.0, F.col(in3) * (3.0 / F.col("__i"))).otherwise(F.col(in3)),
    }
    return by_size(df, size, lambda rows, hot: group_stats(rows, keys, hot, __w=F.sum(win), __i=F.sum(in3)).withColumns(new).drop("__w", "__i"))


def scenario_adjust(entries: DataFrame, scenarios: DataFrame, roles: DataFrame, normalize: bool = True) -> DataFrame:
    """Style by pace, leader, lane by bias and weak factors, with reason codes.

    ``entries``: event, entity, field_size, frame_no, run_style, base_win, base_in3.
    ``scenarios``: event, scenario, pace (S/M/H), bias (内/外/フラット).
    ``roles``: event, scenario, entity, role (front, stalker, closer, weak).
    """
    df = with_roles(entries, scenarios, roles, ["front", "stalker", "closer", "weak"])
    raw = F.trim(F.col("run_style"))
    known = F.coalesce(F.when(raw.isin(K.STYLES), raw), _by_table(F.upper(raw), K.STYLE_ALIASES))
    front = F.col("is_front")
    style = (
        F.when(front, K.STYLES[0]).when(known.isNotNull(), known)
        .when(F.col("is_stalker"), K.STYLES[1]).when(F.col("is_closer"), K.STYLES[2]).otherwise("その他")
    )
    named = front | (known.isNull() & (F.col("is_stalker") | F.col("is_closer")))
    df = df.withColumns({"run_style_label": style, "__named": named, "__front": front})
    label = F.col("run_style_label")
    df = df.withColumn("__cat", F.coalesce(_by_table(label, K.STYLE_CATEGORY), F.lit("other")))
    df = df.withColumns({"__pw": _factor(K.PACE_FACTORS, 0, F.col("pace"), F.col("__cat")), "__pi": _factor(K.PACE_FACTORS, 1, F.col("pace"), F.col("__cat"))})
    df = df.withColumn("lane", _lane())
    size = F.least(F.greatest(F.col("field_size"), F.lit(8)), F.lit(18))
    scale = 0.4 + 0.6 * (size - 8) / 10
    side = F.when(F.col("bias") == "内", "inside").when(F.col("bias") == "外", "outside")
    other = F.when(F.col("bias") == "内", "outside").when(F.col("bias") == "外", "inside")
    gain, loss = F.coalesce(F.col("lane") == side, F.lit(False)), F.coalesce(F.col("lane") == other, F.lit(False))
    weak = F.col("is_weak")
    lead = {k: (a, b) for k, (a, b) in K.LEADER_FACTORS.items()}
    out = {}
    for i, p in enumerate(("win", "in3")):
        pace = F.col("__pw" if p == "win" else "__pi")
        leader = F.when(F.col("__front"), _factor({(k,): v for k, v in lead.items()}, i, F.col("pace"))).otherwise(1.0)
        bias = F.when(gain, (K.BIAS_GAIN[i] - 1.0) * scale + 1.0).when(loss, (K.BIAS_LOSS[i] - 1.0) * scale + 1.0).otherwise(1.0)
        out[f"adj_{p}"] = F.col(f"base_{p}") * pace * leader * bias * F.when(weak, K.WEAK_FACTORS[i]).otherwise(1.0)
    up = (F.col("__pw") > 1) | (F.col("__pi") > 1)
    down = (F.col("__pw") < 1) | (F.col("__pi") < 1)
    nige, senko, sashi, oikomi = K.STYLES
    back = label.isin(sashi, oikomi)
    reasons = F.array_compact(
        F.array(
            F.when(label == nige, "FRONT_RUNNER").when(label == senko, "STALKER").when(back, "CLOSER"),
            F.when(F.col("__named"), F.when(label == nige, "SCENARIO_FRONT_RUNNER").when(label == senko, "SCENARIO_STALKER").when(back, "SCENARIO_CLOSER")),
            F.when(up, "PACE_ADVANTAGE").when(down, "PACE_DISADVANTAGE"),
            F.when(gain, "BIAS_ADVANTAGE").when(loss, "BIAS_DISADVANTAGE"),
            F.when(weak, "MARKED_WEAK"),
        )
    )
    adjusted = df.withColumns({**out, "reasons": reasons})
    adjusted = adjusted.select(
        "event", "scenario", "entity", "field_size", "base_win", "base_in3", "run_style_label", "lane", "adj_win", "adj_in3", "reasons"
    )
    if normalize:
        adjusted = scale_by_total(adjusted, KEYS, "adj_win", "adj_in3", "field_size")
    return adjusted.drop("field_size")


def _lane() -> Column:
    """Lane on the straight from frame, style category and field size; NULL without a valid frame."""
    frame, n, cat = F.col("frame_no"), F.col("field_size"), F.col("__cat")
    size = F.least(F.greatest(n, F.lit(8)), F.lit(18))
    width = F.greatest(F.lit(2), F.bround(size * 0.3).cast("int"))
    inside, outside = frame <= width, frame >= size - width + 1
    base = F.when(inside, "inside").when(outside, "outside").otherwise("middle")
    keeper = F.when(inside, "inside").when(outside, "middle").when(n >= 14, "middle").otherwise("inside")
    lane = (
        F.when(cat == "front_runner", "inside").when(cat == "pace_keeper", keeper)
        .when(cat == "mid_chaser", F.when(outside & ~inside, "outside").otherwise("middle"))
        .when(cat == "deep_closer", F.when(inside, "middle").otherwise("outside")).otherwise(base)
    )
    return F.when(frame.between(1, 8), lane)


def bias_adjust(entries: DataFrame, scenarios: DataFrame, roles: DataFrame) -> DataFrame:
    """Second coefficient set: pace, going, lane and style bias, with ranks before and after.

    ``entries``: event, entity, field_size, umaban, run_style, p_win, p_in3, rank_win, rank_in3.
    ``scenarios``: event, scenario, pace, track_condition, lane_bias, style_bias.
    ``roles``: event, scenario, entity, role (front).
    """
    df = with_roles(entries, scenarios, roles, ["front"])
    no, n = F.col("umaban"), F.col("field_size")
    guess = F.when(F.col("is_front"), K.STYLES[0]).when(no <= 4, K.STYLES[1]).when(no <= 10, K.STYLES[2]).otherwise(K.STYLES[3])
    df = df.withColumn("run_style", F.when(F.col("run_style").isin(K.STYLES), F.col("run_style")).otherwise(guess))
    quarter = F.when(n <= 8, 2).otherwise(F.greatest(F.lit(2), F.floor(n * 0.25)))
    outer = F.when(n <= 8, 7).otherwise(n - quarter + 1)
    style = F.col("run_style")
    lane = (
        F.when(no <= quarter, F.when(style.isin(K.STYLES[2], K.STYLES[3]), "middle_lane").otherwise("inner_lane"))
        .when(no >= outer, F.when(style.isin(K.STYLES[0], K.STYLES[1]), "middle_lane").otherwise("outer_lane")).otherwise("middle_lane")
    )
    df = df.withColumn("lane", lane)
    going = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in K.GOING_FACTOR.items() for x in kv]), F.col("track_condition")), F.lit(1.0))
    for i, p in enumerate(("win", "in3")):
        f = (
            F.coalesce(f"p_{p}", F.lit(0.0)) * _factor(K.PACE_STYLE, i, F.col("pace"), style) * going
            * _factor(K.LANE_BIAS, i, F.col("lane_bias"), F.col("lane")) * _factor(K.STYLE_BIAS, i, F.col("style_bias"), style)
        )
        df = df.withColumn(f"adj_{p}", F.round(f, 6))
    share = {
        "adj_win": F.when(F.col("__w") > 0, F.round(F.col("adj_win") / F.col("__w"), 4)).otherwise(F.col("adj_win")),
        "adj_in3": F.when(F.col("__i") > 3.0, F.round(F.col("adj_in3") * (3.0 / F.col("__i")), 4)).otherwise(F.col("adj_in3")),
    }
    ranks = [Rank(f"adj_{p}", f"adj_rank_{p}", True, ("umaban",)) for p in ("win", "in3")]

    def plan(rows: DataFrame, hot: bool) -> DataFrame:
        scaled = group_stats(rows, KEYS, hot, __w=F.sum("adj_win"), __i=F.sum("adj_in3")).withColumns(share)
        return group_ranks(scaled, KEYS, ranks, hot)

    df = by_size(df, "field_size", plan)
    df = df.withColumns({f"rank_change_{p}": F.col(f"rank_{p}") - F.col(f"adj_rank_{p}") for p in ("win", "in3")})
    return df.select(
        "event", "scenario", "entity", "run_style", "lane", "adj_win", "adj_in3", "adj_rank_win", "adj_rank_in3", "rank_change_win", "rank_change_in3"
    )


def bias_reasons(pace: Column, style: Column, lane: Column, lane_bias: Column, style_bias: Column, going: Column) -> Column:
    """Which parts of the second set raised or lowered an entry."""
    def sign(name: str, f: Column) -> Column:
        return F.when(f > 1, f"{name}_up").when(f < 1, f"{name}_down")

    track = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in K.GOING_FACTOR.items() for x in kv]), going), F.lit(1.0))
    return F.array_compact(
        F.array(
            sign("pace", _factor(K.PACE_STYLE, 0, pace, style)), sign("style_bias", _factor(K.STYLE_BIAS, 0, style_bias, style)),
            sign("lane_bias", _factor(K.LANE_BIAS, 0, lane_bias, lane)), F.when(track < 1, "track_condition_down"),
        )
    )


def pace_shift(df: DataFrame, p: str, style: str, balance: str, name: str, size: str | None = None) -> DataFrame:
    """Shift log-odds by style and pace balance, then let the odds of the event sum to one."""
    pairs = [F.lit(x) for kv in K.PACE_SHIFT.items() for x in kv]
    coef = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(style)), F.lit(0.0))
    delta = clip(K.PACE_SHIFT_ALPHA * coef * F.tanh(F.col(balance) / K.PACE_SHIFT_SCALE), -K.PACE_SHIFT_MAX, K.PACE_SHIFT_MAX)
    odds = df.withColumn("__o", F.exp(logit(p) + delta))
    share = F.when(F.col("__t") > 0, F.col("__o") / F.col("__t")).otherwise(F.col(p)).alias(name)
    return by_size(odds, size, lambda rows, hot: group_stats(rows, ["event"], hot, __t=F.sum("__o")).select(*df.columns, share))


def integrate(df: DataFrame, p: str, going_delta: str, pace_delta: str, size: str | None = None) -> DataFrame:
    """Base log-odds plus both deltas, as probability and as softmax within the event."""
    from raceframe.operators.relative import softmax

    x = df.withColumn("logit_final", logit(p, 0.001) + F.col(going_delta) + F.col(pace_delta))
    return softmax(x, "logit_final", "normalized_prob", size)


def validate(df: DataFrame, p: str, tolerance: float = 1e-5) -> DataFrame:
    """Whether all values are probabilities and sum to one per event."""
    per = df.groupBy("event").agg(F.sum(p).alias("s"), F.min(p).alias("lo"), F.max(p).alias("hi"))
    off = F.abs(F.col("s") - 1) > tolerance
    return per.agg(
        (F.min("lo") >= 0).alias("all_positive"), (F.max("hi") <= 1).alias("all_below_one"),
        (F.count(F.when(off, 1)) == 0).alias("sums_to_one"), F.count(F.when(off, 1)).alias("n_off"),
    )


def compare(adjusted: DataFrame, base: str, a: str, b: str) -> DataFrame:
    """Differences of two scenarios against the base and each other, for entities in all three."""
    def of(s: str, c: str) -> Column:
        return F.max(F.when(F.col("scenario") == s, F.col(c)))

    wide = adjusted.filter(F.col("scenario").isin(base, a, b)).groupBy("event", "entity").agg(
        F.count_distinct("scenario").alias("__n"), of(base, "base_win").alias("base_win"), of(base, "base_in3").alias("base_in3"),
        *[of(s, f"adj_{p}").alias(f"{k}_{p}") for k, s in (("a", a), ("b", b)) for p in ("win", "in3")],
    ).filter("__n = 3").drop("__n")
    base_win = F.col("base_win")

    def pct(d: str) -> Column:
        return F.when(base_win > 0, F.col(d) / base_win * 100).otherwise(0.0)

    wide = wide.withColumns(
        {
            "delta_a": F.col("a_win") - base_win, "delta_b": F.col("b_win") - base_win, "delta_ab": F.col("a_win") - F.col("b_win"),
            "delta_in3_a": F.col("a_in3") - F.col("base_in3"), "delta_in3_b": F.col("b_in3") - F.col("base_in3"),
        }
    )
    return wide.withColumns({"delta_a_pct": pct("delta_a"), "delta_b_pct": pct("delta_b")})


def top_movers(compared: DataFrame, delta: str, k: int, absolute: bool = False) -> DataFrame:
    """Entries per event that change most: risers only, or either way.

    Differences count to nine decimals, so that noise does not order equal ones.
    """
    d = F.round(F.abs(delta) if absolute else F.col(delta), 9)
    rows = compared if absolute else compared.filter(d > 0)
    return top_per_group(rows, ["event"], [d.desc(), F.col("entity").asc()], k, "position")


def summaries(adjusted: DataFrame, k: int = 5, placers: int = 3) -> DataFrame:
    """Top entries, boosted, dropped and solid placers per (event, scenario), as ranked rows by kind.

    Differences count to nine decimals, so that noise does not order equal ones.
    """
    win, in3 = F.round(F.col("adj_win") - F.col("base_win"), 9), F.round(F.col("adj_in3") - F.col("base_in3"), 9)
    top, third = F.round("adj_win", 9), F.round("adj_in3", 9)
    kinds = {
        "top": (F.lit(True), -top, k),
        "boosted": ((win > 0.001) | (in3 > 0.001), -win, k),
        "dropped": ((win < -0.001) | (in3 < -0.001), win, k),
        "solid_placer": ((F.col("adj_in3") > 0.3) & (F.col("adj_win") < 0.1), -third, placers),
    }
    tags = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(n).alias("n")))
                for kind, (test, key, n) in kinds.items()
            ]
        )
    )
    rows = adjusted.withColumn("win_delta", win).withColumn("__t", F.explode(tags))
    rows = rows.select("event", "scenario", "entity", "adj_win", "adj_in3", "win_delta", "__t.*")
    best = top_per_group(rows, [*KEYS, "kind"], [F.col("key").asc(), F.col("entity").asc()], max(k, placers), "position")
    return best.filter(F.col("position") <= F.col("n")).drop("key", "n")
