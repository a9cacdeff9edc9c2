"""What an entity, actor or owner had done before an event.

Two orders of time are offered.  *Date-strict*: only events on earlier days count.
*Row-strict*: all earlier rows in the order (day, event) count, so an earlier
event of the same day does too.

Both go through totals per (key, day).  A key with very many rows has at most one
total per calendar day, and the join back to the rows is on (key, day), so a hot
key is spread over its days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.operators.grouping import _AGG, _MERGE, Measures, prior

ROW = ("event", "entity")


def asof_totals(df: DataFrame, keys: Sequence[str], measures: Measures, days: int | None = None) -> DataFrame:
    """Per (keys, day): each measure over the days before, or the last ``days`` days."""
    keys = list(keys)
    daily = df.groupBy(*keys, "day").agg(*[_AGG[fn](c).alias(n) for n, (fn, c) in measures.items()])
    start = Window.unboundedPreceding if days is None else -days
    before = Window.partitionBy(*keys).orderBy("day").rangeBetween(start, -1)
    out = []
    for name, (fn, _) in measures.items():
        merged = _MERGE[fn](name).over(before)
        out.append((F.coalesce(merged, F.lit(0).cast("long")) if fn == "count" else merged).alias(name))
    return daily.select(*keys, "day", *out)


def result_measures(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, tuple[str, Column]]:
    """Additive measures of past results; rows without an outcome do not count."""
    ran = F.col("outcome").isNotNull()
    o = F.col("outcome").cast("long")
    every = {
        "n": ("count", F.when(ran, 1)),
        "wins": ("count", F.when(o == 1, 1)),
        "in3": ("count", F.when(o <= 3, 1)),
        "o_sum": ("sum", o),
        "o_sq": ("sum", o * o),
        "best": ("min", o),
        "worst": ("max", o),
    }
    if "last3f" in df.columns:
        v = F.when(ran, F.col("last3f"))
        every |= {"l_n": ("count", v), "l_sum": ("sum", v), "l_best": ("min", v)}
    if "prize" in df.columns:
        v = F.when(ran, F.col("prize"))
        every |= {"p_n": ("count", v), "p_sum": ("sum", v), "p_max": ("max", v)}
    if "weight" in df.columns:
        v = F.when(ran, F.col("weight").cast("long"))
        every |= {"w_n": ("count", v), "w_sum": ("sum", v), "w_sq": ("sum", v * v)}
    return {k: every[k] for k in names} if names else every


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, NULL when the denominator is 0 or NULL."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.when(den > 0, num.cast("double") / den)


def spread(n: str | Column, total: str | Column, squares: str | Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares."""
    n_, s, q = (F.col(c) if isinstance(c, str) else c for c in (n, total, squares))
    s, q = s.cast("double"), q.cast("double")
    return F.when(n_ > 1, F.sqrt(F.greatest((q - s * s / n_) / (n_ - 1), F.lit(0.0))))


def _attach(df: DataFrame, block: DataFrame, keys: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    joined = df.join(block, [*keys, "day"], "left")
    return joined.fillna(0, subset=list(counts)) if counts else joined


def career(df: DataFrame, keys: Sequence[str] = ("entity",), prefix: str = "h_") -> DataFrame:
    """Date-strict record: starts, wins, in3, rates, outcome mean, spread, best, worst, first-run flag."""
    t = asof_totals(df, keys, result_measures(df, ["n", "wins", "in3", "o_sum", "o_sq", "best", "worst"]))
    block = t.select(
        *keys, "day",
        F.col("n").alias(f"{prefix}n_starts"),
        F.col("wins").alias(f"{prefix}n_wins"),
        F.col("in3").alias(f"{prefix}n_in3"),
        ratio("wins", "n").alias(f"{prefix}win_rate"),
        ratio("in3", "n").alias(f"{prefix}in3_rate"),
        ratio("o_sum", "n").alias(f"{prefix}avg_finish"),
        spread("n", "o_sum", "o_sq").alias(f"{prefix}std_finish"),
        F.col("best").alias(f"{prefix}best_finish"),
        F.col("worst").alias(f"{prefix}worst_finish"),
        F.when(F.col("n") == 0, 1).otherwise(0).alias(f"{prefix}is_first_run"),
    )
    return _attach(df, block, keys)


def conditional(
    df: DataFrame,
    condition: str | None,
    keys: Sequence[str] = ("entity",),
    prefix: str = "h_",
    suffix: str = "",
    stats: Sequence[str] = ("win_rate", "in3_rate"),
    days: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Date-strict starts and rates under the same condition value.

    An unknown condition gives 0 starts and NULL rates.  ``source`` is an earlier form
    of the same rows to read the history from, so that stacked calls do not nest.
    """
    base = df if source is None else source
    by = [*keys, condition] if condition else list(keys)
    need = {"win_rate": "wins", "in3_rate": "in3", "avg_finish": "o_sum", "avg_last3f": "l_sum", "n_wins": "wins"}
    names = ["n", *dict.fromkeys(need[s] for s in stats)] + (["l_n"] if "avg_last3f" in stats else [])
    known = base.filter(F.col(condition).isNotNull()) if condition else base
    t = asof_totals(known, by, result_measures(base, names), days)
    value = {
        "win_rate": ratio("wins", "n"), "in3_rate": ratio("in3", "n"), "avg_finish": ratio("o_sum", "n"),
        "avg_last3f": ratio("l_sum", "l_n") if "avg_last3f" in stats else None,
        "n_wins": F.col("wins") if "n_wins" in stats else None,
    }
    starts = f"{prefix}n_starts{suffix}"
    counts = [starts] + ([f"{prefix}n_wins{suffix}"] if "n_wins" in stats else [])
    block = t.select(
        *by, "day", F.col("n").alias(starts), *[value[s].alias(f"{prefix}{s}{suffix}") for s in stats]
    )
    return _attach(df, block, by, counts)


def measure_history(df: DataFrame, prefix: str = "h_") -> DataFrame:
    """Date-strict means and bests of the last section time and of the prize."""
    t = asof_totals(df, ["entity"], result_measures(df, ["n", "l_n", "l_sum", "l_best", "p_n", "p_sum", "p_max"]))
    has = F.col("n") > 0
    block = t.select(
        "entity", "day",
        ratio("l_sum", "l_n").alias(f"{prefix}avg_last3f"),
        F.col("l_best").alias(f"{prefix}best_last3f"),
        F.when(has, F.coalesce("p_sum", F.lit(0))).alias(f"{prefix}total_prize"),
        ratio("p_sum", "p_n").alias(f"{prefix}avg_prize"),
        F.col("p_max").alias(f"{prefix}max_prize"),
    )
    return _attach(df, block, ["entity"])


def recent_days(
    df: DataFrame,
    keys: Sequence[str],
    n: int,
    fields: Sequence[str],
    valid: Column | None = None,
    through: bool = False,
) -> DataFrame:
    """Per (keys, day): the latest ``n`` runs on earlier days, newest first.

    Every day keeps at most its ``n`` last runs, so a day row is bounded.  The
    latest ``n`` runs then lie in the latest ``n`` days that have any run.
    ``through`` includes the runs of the day itself.
    """
    keys = list(keys)
    valid = F.lit(True) if valid is None else valid
    names = list(dict.fromkeys(["event", *fields]))
    # the last runs of a day, valid ones first; the first of them stands for the day
    last = Window.partitionBy(*keys, "day").orderBy(F.col("__valid").desc(), *[F.col(f).desc() for f in names])
    kept = (
        df.select(*dict.fromkeys([*keys, "day", *names]), valid.alias("__valid"))
        .withColumn("__k", F.row_number().over(last))
        .filter(F.col("__k") <= n)
    )
    run = F.struct(F.col("day"), *[F.col(f) for f in names if f != "day"])
    by_valid = (
        Window.partitionBy(*keys, "__valid").orderBy("day", *names).rowsBetween(-(n - 1), 0)
    )
    upto = F.when(F.col("__valid"), F.reverse(F.collect_list(run).over(by_valid)))
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow if through else -1)
    return (
        kept.repartition(*keys)
        .withColumn("__upto", upto)
        .filter(F.col("__k") == 1)
        .select(*keys, "day", F.coalesce(F.last("__upto", ignorenulls=True).over(before), F.slice(F.array(run), 1, 0)).alias("recent"))
    )


def recent_lists(df: DataFrame, keys: Sequence[str], lists: Mapping[str, tuple[int, Sequence[str], Column]]) -> DataFrame:
    """Per (keys, day): for each name the latest ``n`` runs before the day that pass a test, newest first.

    ``lists`` maps a name to (n, fields, test).  Every day keeps at most ``n`` runs per list,
    and all lists share one shuffle by day and one by key.  NULL keys have no rows.
    """
    keys = list(keys)
    fields = list(dict.fromkeys(["event", *[f for _, names, _ in lists.values() for f in names]]))
    rows = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(
        *dict.fromkeys([*keys, "day", *fields]), *[test.alias(f"__t_{name}") for name, (_, _, test) in lists.items()])
    late = [F.col(f).desc() for f in fields]
    place = {name: F.row_number().over(Window.partitionBy(*keys, "day").orderBy(F.col(f"__t_{name}").desc_nulls_last(), *late)) for name in lists}
    kept = rows.select("*", *[c.alias(f"__k_{name}") for name, c in place.items()])
    held = {name: F.col(f"__t_{name}") & (F.col(f"__k_{name}") <= n) for name, (n, _, _) in lists.items()}
    first = f"__k_{next(iter(lists))}"
    kept = kept.withColumns({f"__t_{name}": F.coalesce(c, F.lit(False)) for name, c in held.items()})
    kept = kept.filter(" OR ".join([f"{first} = 1", *[f"__t_{name}" for name in lists]])).repartition(*keys)
    upto, before = {}, {}
    for name, (n, names, _) in lists.items():
        run = F.struct("day", *[F.col(f) for f in names if f != "day"])
        same = Window.partitionBy(*keys, f"__t_{name}").orderBy("day", *fields).rowsBetween(-(n - 1), 0)
        upto[f"__u_{name}"] = F.when(F.col(f"__t_{name}"), F.reverse(F.collect_list(run).over(same)))
        past = Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
        order = F.when(F.col(f"__t_{name}"), F.struct("day", *fields))
        before[name] = F.coalesce(F.max_by(f"__u_{name}", order).over(past), F.slice(F.array(run), 1, 0))
    days = kept.select("*", *[c.alias(n) for n, c in upto.items()]).select(*keys, "day", first, *[c.alias(n) for n, c in before.items()])
    return days.filter(F.col(first) == 1).drop(first)


def recent_date_strict(
    df: DataFrame, n: int, fields: Sequence[str], keys: Sequence[str] = ("entity",), valid: Column | None = None
) -> DataFrame:
    """Add ``recent``: the latest ``n`` runs before the day of the event, newest first."""
    if valid is None:
        valid = F.col("outcome").isNotNull()
    return df.join(recent_days(df, keys, n, fields, valid), [*keys, "day"], "left")


def recent_values(
    df: DataFrame, n: int, fields: Sequence[str], parts: Mapping[str, Column], values: Mapping[str, Column],
    keys: Sequence[str] = ("entity",), valid: Column | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """Add ``values``, made from ``recent``, ``day`` and ``parts`` of them; NULL where a key or the day is.

    They are worked out once per (keys, day), so that numbers travel back to the rows in
    place of the runs that they come from.  ``source`` is an earlier form of the same rows
    to read the runs from.
    """
    if valid is None:
        valid = F.col("outcome").isNotNull()
    days = recent_days(df if source is None else source, keys, n, fields, valid).withColumns(dict(parts))
    days = days.select(*keys, "day", *[c.alias(name) for name, c in values.items()])
    return df.join(days, [*keys, "day"], "left")


def last_runs(
    df: DataFrame, n: int, fields: Sequence[str], keys: Sequence[str] = ("entity",), left_out: Column | None = None
) -> DataFrame:
    """Add ``recent``: the latest ``n`` runs before the day, without those for which ``left_out`` holds.

    A run that is left out, like a late start, gives its place to an earlier one; rows with
    a NULL key have no runs.
    """
    valid = F.lit(True) if left_out is None else ~F.coalesce(left_out, F.lit(False))
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    days = recent_days(df.filter(known), keys, n, fields, valid)
    none = F.array().cast(days.schema["recent"].dataType)
    return df.join(days, [*keys, "day"], "left").select(*df.columns, F.coalesce("recent", none).alias("recent"))


def recent_row_strict(
    df: DataFrame, n: int, fields: Sequence[str], keys: Sequence[str] = ("entity",), source: DataFrame | None = None
) -> DataFrame:
    """Add ``recent``: the latest ``n`` earlier rows in (day, event) order, newest first.

    ``source`` is an earlier form of the same rows to read the days before from.
    """
    keys = list(keys)
    run = F.struct(F.col("day"), F.col("event"), *[F.col(f) for f in fields if f not in ("day", "event")])
    inside = Window.partitionBy(*keys, "day").orderBy("event").rowsBetween(-n, -1)
    rows = df.withColumn("__today", F.reverse(F.collect_list(run).over(inside)))
    joined = rows.join(recent_days(df if source is None else source, keys, n, fields), [*keys, "day"], "left")
    return joined.select(*df.columns, F.slice(F.concat("__today", "recent"), 1, n).alias("recent"))


def prior_rows(
    df: DataFrame, measures: Measures, keys: Sequence[str] = ("entity",), source: DataFrame | None = None
) -> DataFrame:
    """Row-strict totals over all earlier rows of the key."""
    return prior(df, keys, "day", [F.col("event"), F.col("entity")], measures, source)


# --- expressions over the newest-first array of runs -------------------------------


def take(field: str, n: int, array: str = "recent") -> Column:
    """The field of the newest ``n`` runs, NULLs left out."""
    return F.filter(F.transform(F.slice(array, 1, n), lambda r: r[field]), lambda v: v.isNotNull())


def arr_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def _moments(a: Column, finish) -> Column:
    """Count, sum and sum of squares in one walk, so the array is evaluated once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(m: Column, v: Column) -> Column:
        x = v.cast("double")
        return F.struct((m["n"] + 1).alias("n"), (m["s"] + x).alias("s"), (m["q"] + x * x).alias("q"))

    return F.aggregate(a, zero, add, finish)


def arr_mean(a: Column) -> Column:
    """Mean; NULL for an empty array."""
    return _moments(a, lambda m: F.when(m["n"] > 0, m["s"] / m["n"]))


def arr_std(a: Column) -> Column:
    """Sample standard deviation; NULL below two values."""
    def finish(m: Column) -> Column:
        return F.when(m["n"] > 1, F.sqrt(F.greatest((m["q"] - m["s"] * m["s"] / m["n"]) / (m["n"] - 1), F.lit(0.0))))

    return _moments(a, finish)


def arr_slope(a: Column) -> Column:
    """(newest - oldest) / (n - 1); NULL below two values."""
    return F.when(F.size(a) > 1, (F.element_at(a, 1) - F.element_at(a, -1)) / (F.size(a) - 1))


def arr_count(a: Column, test) -> Column:
    return F.size(F.filter(a, test)).cast("long")


def first_of(field: str, array: str = "recent") -> Column:
    """The field of the newest run, NULL if there is none."""
    return F.try_element_at(F.col(array), F.lit(1))[field]


# --- feature blocks, date-strict -----------------------------------------------------


def recent_form(df: DataFrame, prefix: str = "h_") -> DataFrame:
    """Days since the last run and the means and bests of the last three and five runs."""
    o3, l3, o5 = F.col("__o3"), F.col("__l3"), F.col("__o5")
    values = {
        "days_since_last": F.col("day") - first_of("day"), "recent3_avg_finish": arr_mean(o3), "recent3_best_finish": F.array_min(o3),
        "recent3_avg_last3f": arr_mean(l3), "recent5_avg_finish": arr_mean(o5),
        "recent5_win_rate": ratio(arr_count(o5, lambda v: v == 1), F.size(o5)),
        "recent5_in3_rate": ratio(arr_count(o5, lambda v: v <= 3), F.size(o5)),
    }
    values = {f"{prefix}{name}": c for name, c in values.items()}
    parts = {"__o3": take("outcome", 3), "__l3": take("last3f", 3), "__o5": take("outcome", 5)}
    return recent_values(df, 5, ["outcome", "last3f"], parts, values).select(*df.columns, *values)


def prize_form(df: DataFrame, prefix: str = "h_") -> DataFrame:
    """Prize of the last three runs and its momentum against the mean of all runs."""
    t = asof_totals(df, ["entity"], result_measures(df, ["n", "p_n", "p_sum"]))
    r = recent_values(df, 3, ["prize"], {}, {"__last3": arr_sum(take("prize", 3))}).join(t, ["entity", "day"], "left")
    last3 = F.col("__last3")
    mean = ratio("p_sum", "p_n")
    return r.select(
        *df.columns,
        F.when(F.col("n") > 0, last3).alias(f"{prefix}recent3_total_prize"),
        F.when(mean > 0, last3 / (3 * mean)).alias(f"{prefix}prize_momentum"),
    )


def weight_form(df: DataFrame, change: str, prefix: str = "h_") -> DataFrame:
    """Body weight before the event: mean, last, last change, last-three mean, spread, trend, z-score."""
    weighed = F.col("outcome").isNotNull() & F.col("weight").isNotNull()
    t = asof_totals(df, ["entity"], result_measures(df, ["w_n", "w_sum", "w_sq"]))
    w = F.col("__w")
    values = {
        "last_body_weight": first_of("weight"), "last_body_weight_diff": first_of(change), "recent3_avg_body_weight": arr_mean(w),
        "recent3_std_body_weight": arr_std(w), "recent3_body_weight_trend": arr_slope(w),
    }
    values = {f"{prefix}{name}": c for name, c in values.items()}
    r = recent_values(df, 3, ["weight", change], {"__w": take("weight", 3)}, values, valid=weighed).join(t, ["entity", "day"], "left")
    mean, std = ratio("w_sum", "w_n"), spread("w_n", "w_sum", "w_sq")
    return r.select(
        *df.columns, mean.alias(f"{prefix}avg_body_weight"), *values,
        F.when(std > 0, (F.col(f"{prefix}last_body_weight") - mean) / std).alias(f"{prefix}body_weight_z"),
    )


def base_recent_form(df: DataFrame, n: int = 3) -> DataFrame:
    """Mean and spread of the last outcomes with defaults for an entity without history."""
    parts = {"__o": take("outcome", n)}
    values = {"__mean": arr_mean(F.col("__o")), "__std": arr_std(F.col("__o")), "__last3f": arr_mean(take("last3f", n)), "perf_recent_runs": F.size("recent").cast("long")}
    return recent_values(df, n, ["outcome", "last3f"], parts, values).select(
        *df.columns,
        F.coalesce("__mean", F.lit(10.0)).alias("perf_finish_mean"),
        F.coalesce("__std", F.lit(0.0)).alias("perf_finish_std"),
        F.coalesce("__last3f", F.lit(37.0)).alias("perf_last3f_mean"),
        "perf_recent_runs",
    )


def speed_form(df: DataFrame, n: int) -> DataFrame:
    """Early speed from first-corner positions and late speed from section times, 0.5 without history."""
    runs = F.filter("recent", lambda x: x["corner1"].isNotNull() & (x["field_size"] > 1))
    early = F.transform(
        runs,
        lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (x["corner1"] - 1).cast("double") / (x["field_size"] - 1))),
    )
    t = F.col("__t")
    low, high = F.array_min(t), F.array_max(t)
    values = {"__early": arr_mean(early), "__late": F.when(high > low, 1 - (arr_mean(t) - low) / (high - low))}
    return recent_values(df, n, ["corner1", "field_size", "last3f"], {"__t": take("last3f", n)}, values).select(
        *df.columns,
        F.coalesce("__early", F.lit(0.5)).alias("early_speed_index"),
        F.coalesce("__late", F.lit(0.5)).alias("late_speed_index"),
    )


# --- feature blocks, row-strict --------------------------------------------------------


def row_career(df: DataFrame, prefix: str = "hr_career_") -> DataFrame:
    """Record over all earlier rows."""
    o = F.col("outcome").cast("long")
    p = prior_rows(
        df,
        {
            "__n": ("count", F.lit(1)), "__w": ("count", F.when(o == 1, 1)),
            "__i": ("count", F.when(o.between(1, 3), 1)), "__on": ("count", o), "__os": ("sum", o),
            "__oq": ("sum", o * o), "__ln": ("count", F.col("last3f")), "__ls": ("sum", F.col("last3f")),
            "__un": ("count", F.col("popularity")), "__us": ("sum", F.col("popularity")),
            "__pn": ("count", F.col("prize")), "__ps": ("sum", F.col("prize")),
        },
    )
    return p.select(
        *df.columns,
        F.col("__n").alias(f"{prefix}starts"), F.col("__w").alias(f"{prefix}wins"), F.col("__i").alias(f"{prefix}in3"),
        ratio("__w", "__n").alias(f"{prefix}win_rate"), ratio("__i", "__n").alias(f"{prefix}in3_rate"),
        ratio("__os", "__on").alias(f"{prefix}avg_finish"), spread("__on", "__os", "__oq").alias(f"{prefix}std_finish"),
        ratio("__ls", "__ln").alias(f"{prefix}avg_last3f"), ratio("__us", "__un").alias(f"{prefix}avg_popularity"),
        F.coalesce("__ps", F.lit(0)).alias(f"{prefix}total_prize"), ratio("__ps", "__pn").alias(f"{prefix}avg_prize"),
    )


def row_recent(df: DataFrame, starts: str, source: DataFrame | None = None) -> DataFrame:
    """Means, bests and big losses of the last three and five rows, and two trends.

    ``starts`` names the number of earlier rows.
    """
    r = recent_row_strict(df, 5, ["outcome", "last3f", "odds", "popularity"], source=source)
    r = r.withColumns({"__o3": take("outcome", 3), "__o5": take("outcome", 5)})
    out = {}
    for n in (3, 5):
        o, p = F.col(f"__o{n}"), f"hr_recent{n}_"
        out[f"{p}starts"] = F.least(F.col(starts), F.lit(n)).cast("long")
        out[f"{p}avg_finish"] = arr_mean(o)
        out[f"{p}best_finish"] = F.array_min(o)
        out[f"{p}avg_last3f"] = arr_mean(take("last3f", n))
        out[f"{p}avg_popularity"] = arr_mean(take("popularity", n))
        out[f"{p}big_loss_count"] = F.when(F.size("recent") > 0, arr_count(o, lambda v: v >= 10))
    out["hr_recent3_avg_win_odds"] = arr_mean(take("odds", 3))
    out["hr_days_since_prev"] = F.col("day") - first_of("day")
    last = first_of("outcome")
    earlier = F.filter(F.transform(F.slice("recent", 2, 2), lambda x: x["outcome"]), lambda v: v.isNotNull())
    out["hr_recent3_finish_trend"] = F.when(F.col(starts) == 0, 0.0).otherwise(last - arr_mean(earlier))
    out["hr_recent3_last_vs_best_diff"] = last - F.array_min("__o3")
    return r.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def recent_axis(df: DataFrame) -> DataFrame:
    """Last outcome and section time against the last three; zeroed when the last outcome is unknown."""
    r = recent_row_strict(df, 5, ["outcome", "last3f"])
    r = r.withColumns({"__o3": take("outcome", 3), "__l3": take("last3f", 3)})
    last, last_l = first_of("outcome"), first_of("last3f")
    o3, l3 = F.col("__o3"), F.col("__l3")
    none = last.isNull()

    def masked(c: Column) -> Column:
        return F.when(none, 0.0).otherwise(c.cast("double"))

    return r.select(
        *df.columns,
        masked(last).alias("ax1_last_finish"), masked(last_l).alias("ax1_last_last3f"),
        arr_mean(o3).alias("ax1_recent3_avg_finish"), arr_mean(l3).alias("ax1_recent3_avg_last3f"),
        masked(arr_slope(o3)).alias("ax1_recent3_finish_slope"), masked(arr_slope(l3)).alias("ax1_recent3_last3f_slope"),
        F.array_min(take("outcome", 5)).alias("ax1_best_finish_recent5"),
        masked(last - arr_mean(o3)).alias("ax1_last_vs_avg3_finish"),
        masked(last_l - arr_mean(l3)).alias("ax1_last_vs_avg3_last3f"),
    )


def condition_axis(
    df: DataFrame, name: str, condition: str, last3f: bool = False, source: DataFrame | None = None
) -> DataFrame:
    """Row-strict record under the same condition; an unknown outcome adds 0 to the outcome sum."""
    o = F.col("outcome").cast("long")
    measures = {
        "__n": ("count", F.lit(1)), "__i": ("count", F.when(o.between(1, 3), 1)), "__s": ("sum", F.coalesce(o, F.lit(0)))
    }
    if last3f:
        measures |= {"__ln": ("count", F.col("last3f")), "__ls": ("sum", F.col("last3f"))}
    p = prior_rows(df, measures, ["entity", condition], source)
    known = F.col(condition).isNotNull()
    extra = [F.when(known, ratio("__ls", "__ln")).alias(f"{name}_avg_last3f")] if last3f else []
    return p.select(
        *df.columns, F.when(known, F.col("__n")).otherwise(0).alias(f"{name}_starts"),
        F.when(known, ratio("__i", "__n")).alias(f"{name}_in3_rate"),
        F.when(known, ratio("__s", "__n")).alias(f"{name}_avg_finish"), *extra,
    )


def change_axis(df: DataFrame, rank: str) -> DataFrame:
    """Change of distance, surface, place and class against the previous row, and the rest since it."""
    r = recent_row_strict(df, 1, ["distance", "surface", "place", rank])
    prev = {f: first_of(f) for f in ("day", "distance", "surface", "place", rank)}
    first = F.size("recent") == 0
    dist = F.when(prev["distance"].isNull(), 0).otherwise(F.col("distance") - prev["distance"])
    rest = F.when(first, 0).otherwise(F.col("day") - prev["day"])
    cls = F.when(first, 0).otherwise(F.col(rank) - F.coalesce(prev[rank], F.col(rank)))

    def flag(test: Column) -> Column:
        return F.when(~first & F.coalesce(test, F.lit(False)), 1).otherwise(0)

    return r.select(
        *df.columns,
        dist.alias("ax2_dist_change_prev"), flag(dist > 0).alias("ax2_is_dist_up"), flag(dist < 0).alias("ax2_is_dist_down"),
        flag(~F.col("surface").eqNullSafe(prev["surface"])).alias("ax2_is_surface_change"),
        flag(~F.col("place").eqNullSafe(prev["place"])).alias("ax2_is_course_change"),
        rest.alias("ax4_rest_days"), (rest / 7.0).alias("ax4_rest_weeks"),
        flag(rest <= 7).alias("ax4_is_short_turnaround"), flag(rest >= 84).alias("ax4_is_long_break_12w"),
        cls.alias("ax4_class_diff"), flag(cls > 0).alias("ax4_is_class_up"), flag(cls < 0).alias("ax4_is_class_down"),
    )


def class_axis(df: DataFrame, rank: str) -> DataFrame:
    """Class strength and prize over the last five rows; all 0 on the first row."""
    r = recent_row_strict(df.withColumn("__prize", F.coalesce("prize", F.lit(0))), 5, [rank, "__prize"])
    r = r.withColumns({"__c5": take(rank, 5), "__p5": take("__prize", 5)})
    c5, p5, p3 = F.col("__c5"), F.col("__p5"), F.slice("__p5", 1, 3)
    trend = F.when(F.size(p5) >= 3, arr_mean(F.slice(p5, 1, 2)) - arr_mean(F.slice(p5, 3, 3)))
    first = F.size("recent") == 0

    def masked(c: Column) -> Column:
        return F.when(first, 0.0).otherwise(c.cast("double"))

    return r.select(
        *df.columns,
        masked(F.array_max(c5)).alias("ax3_best_class_recent5"), masked(arr_mean(c5)).alias("ax3_avg_class_recent5"),
        masked(arr_sum(p5)).alias("ax3_total_prize_recent5"), masked(arr_mean(p3)).alias("ax3_avg_prize_recent3"),
        masked(trend).alias("ax3_prize_trend_recent5"),
        masked(F.col(rank) - F.coalesce(F.array_max(c5), F.lit(0))).alias("ax3_curr_vs_best_class"),
    )


def position_axis(df: DataFrame) -> DataFrame:
    """Relative corner positions of the last rows and the front runners each event can expect."""
    n = F.col("field_size")
    rel = df.withColumns(
        {
            "__c1": F.col("corner1") / n,
            "__c4": F.col("corner4") / n,
            "__gain": (F.col("corner1") - F.col("corner4")) / n,
        }
    )
    r = recent_row_strict(rel, 5, ["__c1", "__c4", "__gain"])
    cols = {}
    for k in (3, 5):
        cols[f"ax6_recent{k}_c1_pos_pct_mean"] = arr_mean(take("__c1", k))
        cols[f"ax6_recent{k}_c4_pos_pct_mean"] = arr_mean(take("__c4", k))
        cols[f"ax6_recent{k}_pos_gain_mean"] = arr_mean(take("__gain", k))
    rows = r.select(*df.columns, *[c.alias(n) for n, c in cols.items()])
    # nine decimals, so that the noise of the mean does not decide a tie with the bound
    style = F.round("ax6_recent5_c1_pos_pct_mean", 9)
    event = rows.groupBy("event").agg(
        F.count(style).alias("__known"),
        F.count(F.when(style <= 0.30, 1)).alias("ax6_race_front_runner_count"),
        F.count(F.when(style <= 0.20, 1)).alias("ax6_race_leader_count"),
    )
    share = F.coalesce(ratio("ax6_race_front_runner_count", "__known"), F.lit(0.0))
    return rows.join(event.withColumn("ax6_race_front_runner_share", share).drop("__known"), "event", "left")


def stability_axis(df: DataFrame) -> DataFrame:
    """Spread of the last five outcomes, section times, popularities and gains; 0 below two values."""
    gain = (F.col("corner1") - F.col("corner4")) / F.col("field_size")
    r = recent_row_strict(df.withColumn("__gain", gain), 5, ["outcome", "last3f", "popularity", "__gain"])
    names = {"finish": "outcome", "last3f": "last3f", "popularity": "popularity", "pos_gain": "__gain"}
    return r.select(
        *df.columns,
        *[F.coalesce(arr_std(take(f, 5)), F.lit(0.0)).alias(f"ax7_{n}_std_recent5") for n, f in names.items()],
    )


def partner_axis(df: DataFrame, key: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """Row-strict in-three rate of an actor or owner, 0 without earlier rows."""
    i = F.when(F.col("outcome").between(1, 3), 1)
    p = prior_rows(df, {"__n": ("count", F.lit(1)), "__i": ("count", i)}, [key], source)
    return p.select(*df.columns, F.coalesce(ratio("__i", "__n"), F.lit(0.0)).alias(name))


def market_axis(df: DataFrame) -> DataFrame:
    """Past odds and past outcome against popularity over five rows; NULL becomes 0."""
    r = recent_row_strict(df.withColumn("__diff", F.col("outcome") - F.col("popularity")), 5, ["odds", "__diff"])
    r = r.withColumns({"__o": take("odds", 5), "__d": take("__diff", 5)})
    o, d = F.col("__o"), F.col("__d")
    cols = {
        "ax9_avg_win_odds_recent5": arr_mean(o),
        "ax9_std_win_odds_recent5": arr_std(o),
        "ax9_finish_minus_popularity_mean_recent5": arr_mean(d),
        "ax9_finish_minus_popularity_slope_recent5": arr_slope(d),
    }
    return r.select(*df.columns, *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in cols.items()])


def start_index(df: DataFrame) -> DataFrame:
    """1 for the first row of an entity, 2 for the next, and so on."""
    p = prior_rows(df, {"__n": ("count", F.lit(1))})
    return p.select(*df.columns, (F.col("__n") + 1).alias("start_index"))


def entity_block(df: DataFrame, change: str, prefix: str = "h_") -> DataFrame:
    """All date-strict history of the entity: one pass for totals, one for the last runs, one for weights.

    The same columns as ``career``, ``recent_form``, ``measure_history``, ``prize_form``
    and ``weight_form`` give one by one.
    """
    t = asof_totals(df, ["entity"], result_measures(df))
    runs = recent_days(df, ["entity"], 5, ["outcome", "last3f", "prize"], F.col("outcome").isNotNull())
    weighed = F.col("outcome").isNotNull() & F.col("weight").isNotNull()
    weights = recent_days(df, ["entity"], 3, ["weight", change], weighed).withColumnRenamed("recent", "weights")
    # the three blocks share the partitioning by (entity, day) of the totals
    day = t.join(runs, ["entity", "day"], "left").join(weights, ["entity", "day"], "left")
    o3, l3, o5, w3 = take("outcome", 3), take("last3f", 3), take("outcome", 5), take("weight", 3, "weights")
    day = day.withColumns({"o3": o3, "l3": l3, "o5": o5, "w3": w3, "last3p": arr_sum(take("prize", 3))})
    o3, l3, o5, w3, p3 = F.col("o3"), F.col("l3"), F.col("o5"), F.col("w3"), F.col("last3p")
    wmean, wstd, pmean = ratio("w_sum", "w_n"), spread("w_n", "w_sum", "w_sq"), ratio("p_sum", "p_n")
    ran = F.col("n") > 0
    last_w = first_of("weight", "weights")
    cols = {
        "n_starts": F.col("n"), "n_wins": F.col("wins"), "n_in3": F.col("in3"), "win_rate": ratio("wins", "n"),
        "in3_rate": ratio("in3", "n"), "avg_finish": ratio("o_sum", "n"), "std_finish": spread("n", "o_sum", "o_sq"),
        "best_finish": F.col("best"), "worst_finish": F.col("worst"), "is_first_run": F.when(F.col("n") == 0, 1).otherwise(0),
        "days_since_last": F.col("day") - first_of("day"), "recent3_avg_finish": arr_mean(o3), "recent3_best_finish": F.array_min(o3),
        "recent3_avg_last3f": arr_mean(l3), "recent5_avg_finish": arr_mean(o5),
        "recent5_win_rate": ratio(arr_count(o5, lambda v: v == 1), F.size(o5)),
        "recent5_in3_rate": ratio(arr_count(o5, lambda v: v <= 3), F.size(o5)),
        "avg_last3f": ratio("l_sum", "l_n"), "best_last3f": F.col("l_best"),
        "total_prize": F.when(ran, F.coalesce("p_sum", F.lit(0))), "avg_prize": pmean, "max_prize": F.col("p_max"),
        "recent3_total_prize": F.when(ran, p3), "prize_momentum": F.when(pmean > 0, p3 / (3 * pmean)),
        "avg_body_weight": wmean, "last_body_weight": last_w, "last_body_weight_diff": first_of(change, "weights"),
        "recent3_avg_body_weight": arr_mean(w3), "recent3_std_body_weight": arr_std(w3), "recent3_body_weight_trend": arr_slope(w3),
        "body_weight_z": F.when(wstd > 0, (last_w - wmean) / wstd),
    }
    block = day.select("entity", "day", *[c.alias(f"{prefix}{n}") for n, c in cols.items()])
    return _attach(df, block, ["entity"])
