"""Bets, their settlement and returns by strategy and threshold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.functions.columns import paid_places
from raceframe.operators.grouping import prior, top_per_group
from raceframe.operators.history import ratio
from raceframe.operators.relative import top_two


def pick(df: DataFrame, order: Sequence[Column], k: int, strategy: str) -> DataFrame:
    """First ``k`` entries of every event, tagged with the strategy."""
    return top_per_group(df, ["event"], [*order, F.col("entity").asc()], k).withColumn("strategy", F.lit(strategy))


def random_order(seed: int) -> Column:
    """Repeatable random order of the entries of an event."""
    return F.sha2(F.concat_ws("|", F.col("event").cast("string"), F.col("entity").cast("string"), F.lit(str(seed))), 256).asc()


def strategy_bets(df: DataFrame, p: str, popularity: str, seed: int = 42) -> DataFrame:
    """Bets of the four base strategies: best, best three, favourite, one at random."""
    best = F.col(p).desc()
    parts = [
        pick(df, [best], 1, "model_top1"),
        pick(df, [best], 3, "model_top3"),
        pick(df, [F.col(popularity).asc()], 1, "popularity_top1"),
        pick(df, [random_order(seed)], 1, "random_top1"),
    ]
    return reduce(DataFrame.unionByName, parts)


def settle(bets: DataFrame, payouts: DataFrame, number: str, bet_types: Mapping[str, int]) -> DataFrame:
    """Payout of every bet under every bet type; a hit needs a payout and an outcome in the paid range."""
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("bet_type"), F.lit(k).alias("last")) for t, k in bet_types.items()]))
    open_bets = bets.withColumn("__t", kinds).select(*bets.columns, "__t.bet_type", F.col("__t.last").alias("__last"))
    paid = payouts.filter(F.col("bet_type").isin(list(bet_types))).select(
        "event", "bet_type", F.col("combination").alias("__no"), "payout"
    )
    joined = open_bets.withColumn("__no", F.col(number).cast("string")).join(paid, ["event", "bet_type", "__no"], "left")
    hit = F.coalesce((F.col("outcome") <= F.col("__last")) & F.col("payout").isNotNull(), F.lit(False))
    return joined.withColumn("is_hit", hit).drop("__last", "__no")


def roi(settled: DataFrame, by: Sequence[str], stake: float = 100.0) -> DataFrame:
    """Stake, return and gross ratio of settled bets."""
    hit = F.col("is_hit")
    return settled.groupBy(*by, "event").agg(
        F.count(F.lit(1)).alias("b"), F.count(F.when(hit, 1)).alias("h"), F.sum(F.when(hit, F.col("payout"))).alias("r")
    ).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_races"), F.sum("b").alias("n_bets"), F.sum("h").alias("n_hits"),
        (F.sum("b") * stake).alias("stake_total"),
        F.coalesce(F.sum("r") / 100 * stake, F.lit(0.0)).alias("return_total"),
        F.coalesce(ratio(F.sum("r"), F.sum("b") * 100), F.lit(0.0)).alias("roi_gross"),
        F.coalesce(ratio(F.sum("h"), F.sum("b")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(ratio(F.sum("r"), F.sum("h")), F.lit(0.0)).alias("avg_payout"),
    )


def threshold_sweep(
    df: DataFrame, dimensions: Mapping[str, Sequence[float]], sums: Mapping[str, Column]
) -> DataFrame:
    """Sums over the rows that reach every threshold, for every combination of thresholds.

    ``df`` has one row per event.  Each row falls into one cell: the number of
    thresholds it reaches in each dimension.  Rows are summed per cell first, and
    only the few cells are spread to the combinations they satisfy.
    """
    spark = df.sparkSession
    grids = {d: sorted(ts) for d, ts in dimensions.items()}
    cells = {f"__{d}": _reached(d, ts) for d, ts in grids.items()}
    per_cell = df.groupBy(*[c.alias(n) for n, c in cells.items()]).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    out = per_cell
    grid = spark.range(1).drop("id")
    for d, ts in grids.items():
        steps = F.array(*[F.lit(float(t)) for t in ts])
        out = out.withColumn(f"{d}_th", F.explode(F.slice(steps, F.lit(1), F.col(f"__{d}"))))
        grid = grid.withColumn(f"{d}_th", F.explode(steps))
    keys = [f"{d}_th" for d in grids]
    total = out.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
    return grid.join(total, keys, "left").fillna(0, subset=list(sums))


def _reached(name: str, thresholds: Sequence[float]) -> Column:
    """Number of sorted thresholds at or below the value; 0 for NULL."""
    reached = F.lit(0)
    for i, t in enumerate(thresholds, 1):
        reached = F.when(F.col(name) >= float(t), i).otherwise(reached)
    return reached


def selective_bets(
    df: DataFrame, payouts: DataFrame, p: str, popularity: str, number: str, bet_types: Mapping[str, int]
) -> DataFrame:
    """One row per (event, bet type): the best entry, its gap, and its result beside the favourite's."""
    best = top_two(df, p, [number, "outcome"])
    model = settle(best, payouts, number, bet_types)
    fav = settle(pick(df.select("event", "entity", popularity, number, "outcome"), [F.col(popularity).asc()], 1, "f"), payouts, number, bet_types)
    fav = fav.select("event", "bet_type", F.col("is_hit").alias("pop_hit"), F.when(F.col("is_hit"), F.col("payout")).alias("pop_return"))
    model = model.select(
        "event", "bet_type", "top1_p", "gap", F.col("is_hit").alias("model_hit"),
        F.when(F.col("is_hit"), F.col("payout")).alias("model_return"),
    )
    return model.join(fav, ["event", "bet_type"])


def selective_sweep(per_event: DataFrame, dimension: str, thresholds: Sequence[float], bet_type: str) -> DataFrame:
    """Coverage, return and hit rate per threshold, with the favourite on the same events."""
    rows = per_event.filter(F.col("bet_type") == bet_type)
    total = rows.agg(F.count(F.lit(1))).scalar()
    one = F.lit(1)
    sums = {
        "n_races_bet": one,
        "model_n_hits": F.when(F.col("model_hit"), 1).otherwise(0), "model_return": F.coalesce("model_return", F.lit(0)),
        "pop_n_hits": F.when(F.col("pop_hit"), 1).otherwise(0), "pop_return": F.coalesce("pop_return", F.lit(0)),
    }
    s = threshold_sweep(rows, {dimension: thresholds}, sums)

    def per(num: str, scale: float = 1.0) -> Column:
        return F.coalesce(ratio(F.col(num), F.col("n_races_bet") * scale), F.lit(0.0))

    out = s.withColumn("bet_type", F.lit(bet_type)).withColumnRenamed(f"{dimension}_th", "threshold").select(
        F.lit(dimension).alias("threshold_type"), "threshold", "bet_type", total.alias("n_total_races"), "n_races_bet",
        F.coalesce(ratio(F.col("n_races_bet"), total), F.lit(0.0)).alias("coverage"), "model_n_hits", "pop_n_hits",
        per("model_return", 100).alias("model_roi"), per("pop_return", 100).alias("pop_roi"),
        per("model_n_hits").alias("model_hit_rate"), per("pop_n_hits").alias("pop_hit_rate"),
    )
    return out.withColumns(
        {"roi_diff": F.col("model_roi") - F.col("pop_roi"), "hit_diff": F.col("model_hit_rate") - F.col("pop_hit_rate")}
    )


def place_frame(df: DataFrame, p: str, payout: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per event for place bets: best entry, gap, payout; events whose due payout is missing are left out."""
    best = top_two(df.withColumn("in3", F.when(F.col("outcome") <= 3, 1).otherwise(0)), p, [payout, "outcome", "in3", "field_size", *extra])
    places = paid_places("field_size")
    bad = (F.col("outcome") <= places) & (places > 0) & F.col(payout).isNull()
    return best.filter(~F.coalesce(bad, F.lit(False)))


def place_sweep(frame: DataFrame, payout: str, dimensions: Mapping[str, Sequence[float]], stake: float = 100.0) -> DataFrame:
    """Return in percent for every combination of thresholds on the place frame."""
    sums = {
        "n_bet_races": F.lit(1),
        "n_hits": F.when(F.col(payout).isNotNull() & (F.col("in3") == 1), 1).otherwise(0),
        "total_return": F.coalesce(payout, F.lit(0)),
    }
    sums |= {f"sum_{d}": F.col(d) for d in dimensions}
    s = threshold_sweep(frame, dimensions, sums)
    n = F.col("n_bet_races")
    return s.select(
        *[f"{d}_th" for d in dimensions], "n_bet_races", "n_hits", F.coalesce(ratio("n_hits", "n_bet_races"), F.lit(0.0)).alias("hit_rate"),
        (n * stake).alias("total_bet"), "total_return",
        F.coalesce(ratio(F.col("total_return"), n * stake) * 100, F.lit(0.0)).alias("roi"),
        *[F.coalesce(ratio(f"sum_{d}", "n_bet_races"), F.lit(0.0)).alias(f"avg_{d}") for d in dimensions],
    )


def best_by_roi(sweep: DataFrame, min_bets: int, k: int, keys: Sequence[str]) -> DataFrame:
    """Best threshold combinations with enough bets."""
    return sweep.filter(F.col("n_bet_races") >= min_bets).orderBy(F.col("roi").desc(), *keys).limit(k)


def net_roi(df: DataFrame, p: str, odds: str, stake: float = 100.0) -> DataFrame:
    """Net return of backing the best entry of every event at its odds."""
    best = pick(df, [F.col(p).desc()], 1, "top1")
    back = F.when(F.col("outcome") == 1, F.col(odds)).otherwise(0.0)
    return best.agg(
        F.count(F.lit(1)).alias("n_bets"), F.count(F.when(F.col("outcome") == 1, 1)).alias("n_hits"),
        (F.sum(back) * stake).alias("return_total"), ((F.sum(back) - F.count(F.lit(1))) / F.count(F.lit(1))).alias("roi_net"),
    )


def backtest_bets(df: DataFrame, p: str, odds: str) -> DataFrame:
    """Bets of the strategies all, ev>1.0, ev>1.2, top1 and top3 with their expected value."""
    ev = df.withColumn("ev", F.col(p) * F.col(odds))
    tags = F.array_compact(
        F.array(F.lit("all"), F.when(F.col("ev") > 1.0, "ev>1.0"), F.when(F.col("ev") > 1.2, "ev>1.2"))
    )
    by_value = ev.withColumn("strategy", F.explode(tags))
    best = F.col(p).desc()
    return by_value.unionByName(pick(ev, [best], 1, "top1")).unionByName(pick(ev, [best], 3, "top3"))


def event_profits(bets: DataFrame, odds: str, stake: float = 100.0) -> DataFrame:
    """Per strategy and event: mean odds, wins, stake, return and profit."""
    win = F.when(F.col("outcome") == 1, 1).otherwise(0)
    return bets.groupBy("strategy", "event", "day").agg(
        F.count(F.lit(1)).alias("n_bets"), F.avg(odds).alias("avg_odds"), F.sum(win).alias("wins"),
        (F.count(F.lit(1)) * stake).alias("bet"), (F.sum(win * F.col(odds)) * stake).alias("return"),
        F.sum(odds).alias("sum_odds"), F.sum("ev").alias("sum_ev"),
    ).withColumn("profit", F.col("return") - F.col("bet"))


def profit_curve(per_event: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Running profit, its peak so far and the drawdown, in (day, event) order.

    Profits are summed per day and carried over days, so that the scan of one
    strategy is spread over its days.
    """
    by = list(by)
    run = prior(per_event, by, "day", [F.col("event")], {"__before": ("sum", F.col("profit"))})
    run = run.withColumn("cumulative", F.coalesce("__before", F.lit(0.0)) + F.col("profit"))
    peaks = prior(run, by, "day", [F.col("event")], {"__peak": ("max", F.col("cumulative"))})
    peak = F.greatest(F.col("__peak"), F.col("cumulative"))
    return peaks.withColumn("peak", peak).withColumn("drawdown", F.col("peak") - F.col("cumulative")).drop("__before", "__peak")


def backtest_summary(per_event: DataFrame) -> DataFrame:
    """Return, hit rate, odds, expected value and largest drawdown per strategy."""
    curve = profit_curve(per_event)
    bet, back, n = F.sum("bet"), F.sum("return"), F.sum("n_bets")
    return curve.groupBy("strategy").agg(
        n.alias("n_bets"), bet.alias("total_bet"), back.alias("total_return"), (back - bet).alias("net_profit"),
        ((back - bet) / bet).alias("roi"), (F.sum("wins") / n).alias("hit_rate"), F.max("drawdown").alias("max_drawdown"),
        (F.sum("sum_odds") / n).alias("avg_odds"), (F.sum("sum_ev") / n).alias("avg_ev"),
    )


def ev_recovery(df: DataFrame, p: str, odds: str, threshold: float, stake: float = 100.0) -> DataFrame:
    """Return ratio when each event's stake is split over its entries with ev > 1 and p above the threshold."""
    buy = (F.col(p) * F.col(odds) > 1.0) & (F.col(p) > threshold)
    per = df.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(buy, 1)).alias("k"),
        F.sum(F.when(buy & (F.col("outcome") == 1), F.col(odds))).alias("won"),
    ).filter((F.col("n") > 1) & (F.col("k") > 0))
    back = F.sum(F.coalesce(stake / F.col("k") * F.col("won"), F.lit(0.0)))
    return per.agg(
        F.count(F.lit(1)).alias("n_events"), F.coalesce(back, F.lit(0.0)).alias("total_return"),
        F.coalesce(back / (F.count(F.lit(1)) * stake), F.lit(0.0)).alias("recovery"),
    )
