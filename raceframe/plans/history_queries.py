"""History features: date-strict (W1-W8, W30) and row-strict (W9-W20)."""

from __future__ import annotations


from pyspark.sql import functions as F

from raceframe.functions import columns as C
from raceframe.operators import history as H
from raceframe.operators import records
from raceframe.plans.base import ENTRIES, entries, r6
from raceframe.plans.registry import query

_PAST = """, past AS (
  SELECT a.event, a.entity, b.outcome AS o, b.event AS b_event, b.day AS b_day, a.day AS a_day,
    b.last3f, b.prize, b.weight, b.odds, b.popularity, b.distance AS b_distance,
    row_number() OVER (PARTITION BY a.event, a.entity ORDER BY b.day DESC, b.event DESC) AS k
  FROM entries a JOIN entries b ON a.entity = b.entity AND b.day < a.day
)
"""


@query("entries_loaded", "S1 S2 J1 A-base", ENTRIES + "SELECT event, entity, actor, owner, event_date, day, surface, place, going, race_class, distance, field_size, outcome, post, popularity, round(p,6) AS p, odds, prize, weight, last3f, passing FROM entries")
def entries_loaded(spark, sf_dir):
    return entries(spark, sf_dir).select(
        "event", "entity", "actor", "owner", "event_date", "day", "surface", "place", "going", "race_class",
        "distance", "field_size", "outcome", "post", "popularity", r6("p").alias("p"), "odds", "prize", "weight",
        "last3f", "passing",
    )


@query(
    "career_asof", "J5 W1",
    ENTRIES + """
SELECT a.event, a.entity, count(b.event) AS h_n_starts,
  count(*) FILTER (WHERE b.outcome = 1) AS h_n_wins, count(*) FILTER (WHERE b.outcome <= 3) AS h_n_in3,
  round(count(*) FILTER (WHERE b.outcome = 1) / nullif(count(b.event),0), 6) AS h_win_rate,
  round(count(*) FILTER (WHERE b.outcome <= 3) / nullif(count(b.event),0), 6) AS h_in3_rate,
  round(avg(b.outcome), 6) AS h_avg_finish, round(stddev_samp(b.outcome), 6) AS h_std_finish,
  min(b.outcome) AS h_best_finish, max(b.outcome) AS h_worst_finish,
  CAST(CASE WHEN count(b.event) = 0 THEN 1 ELSE 0 END AS INTEGER) AS h_is_first_run
FROM entries a LEFT JOIN entries b ON a.entity = b.entity AND b.day < a.day
GROUP BY a.event, a.entity""",
)
def career_asof(spark, sf_dir):
    out = H.career(entries(spark, sf_dir))
    return out.select(
        "event", "entity", "h_n_starts", "h_n_wins", "h_n_in3", r6("h_win_rate").alias("h_win_rate"),
        r6("h_in3_rate").alias("h_in3_rate"), r6("h_avg_finish").alias("h_avg_finish"),
        r6("h_std_finish").alias("h_std_finish"), "h_best_finish", "h_worst_finish", "h_is_first_run",
    )


def _round(df, keep, names):
    """Keep some columns and round the others to six decimals."""
    return df.select(*keep, *[r6(n).alias(n) for n in names])


KEY = ["event", "entity"]

_DIST = """CASE WHEN {d} < 1100 THEN 1000 WHEN {d} < 1300 THEN 1200 WHEN {d} < 1500 THEN 1400 WHEN {d} < 1700 THEN 1600
 WHEN {d} < 1900 THEN 1800 WHEN {d} < 2100 THEN 2000 WHEN {d} < 2300 THEN 2200 WHEN {d} < 2500 THEN 2400 WHEN {d} < 2700 THEN 2500 ELSE 3000 END"""


def with_dist(df):
    return df.withColumn("dist_cat", C.distance_step("distance"))


def _rate_sql(alias, test, cond, name, kind):
    if kind == "n":
        return f"count(*) FILTER (WHERE b.event IS NOT NULL AND {cond}) AS {name}"
    return (f"round(count(*) FILTER (WHERE {test} AND {cond}) / nullif(count(*) FILTER (WHERE b.event IS NOT NULL AND {cond}),0),6) AS {name}")


_CONDS = {"dist": "b.dc = a.dc", "surface": "b.surface = a.surface", "track": "b.going = a.going", "course": "b.place = a.place"}
_cond_cols = []
for _s, _t in _CONDS.items():
    _cond_cols += [
        f"count(b.event) FILTER (WHERE {_t}) AS h_n_starts_{_s}",
        f"round(count(*) FILTER (WHERE b.outcome = 1 AND {_t}) / nullif(count(b.event) FILTER (WHERE {_t}),0),6) AS h_win_rate_{_s}",
        f"round(count(*) FILTER (WHERE b.outcome <= 3 AND {_t}) / nullif(count(b.event) FILTER (WHERE {_t}),0),6) AS h_in3_rate_{_s}",
    ]
_cond_cols += [
    "round(avg(b.outcome) FILTER (WHERE b.dc = a.dc),6) AS h_avg_finish_dist",
    "round(avg(b.last3f) FILTER (WHERE b.dc = a.dc),6) AS h_avg_last3f_dist",
]


@query(
    "conditional_asof", "J5 W2 P6",
    ENTRIES + ", e AS (SELECT *, " + _DIST.format(d="distance") + " AS dc FROM entries) SELECT a.event, a.entity, "
    + ", ".join(_cond_cols) + " FROM e a LEFT JOIN e b ON a.entity = b.entity AND b.day < a.day GROUP BY a.event, a.entity",
)
def conditional_asof(spark, sf_dir):
    df = with_dist(entries(spark, sf_dir)).select(*KEY, "day", "outcome", "last3f", "dist_cat", "surface", "going", "place")
    names = {"_dist": "dist_cat", "_surface": "surface", "_track": "going", "_course": "place"}
    out = records.records(df, [records.Record("h_", ["entity"], names, detailed=["_dist"])])
    counts = [f"h_n_starts{s}" for s in names]
    rates = [f"h_{k}{s}" for s in names for k in ("win_rate", "in3_rate")]
    return _round(out, KEY + counts, [*rates, "h_avg_finish_dist", "h_avg_last3f_dist"])


@query("last_runs_clean", "T5 P14", ENTRIES + """, runs AS (SELECT a.event, a.entity, b.event AS run, b.day AS run_day, b.tax AS run_tax, row_number() OVER (PARTITION BY a.event, a.entity ORDER BY b.day DESC, b.event DESC) AS k,
  row_number() OVER (PARTITION BY a.event, a.entity, b.tax = 8 ORDER BY b.day DESC, b.event DESC) AS kc FROM entries a JOIN entries b ON a.entity = b.entity AND b.day < a.day)
SELECT event, entity, coalesce(string_agg(CAST(run AS VARCHAR), ',' ORDER BY run_day DESC, run DESC) FILTER (k <= 3), '') AS runs,
  coalesce(string_agg(CAST(run AS VARCHAR), ',' ORDER BY run_day DESC, run DESC) FILTER (kc <= 3 AND run_tax <> 8), '') AS clean_runs FROM entries LEFT JOIN runs USING (event, entity) GROUP BY event, entity""")
def last_runs_clean(spark, sf_dir):
    """The last three runs of every entry, all of them and those without a late start."""
    df = entries(spark, sf_dir).select(*KEY, "day", F.when(F.col("tax") == 8, "出遅れ").alias("remarks"))
    df = df.filter("entity IS NOT NULL")
    clean = ~F.coalesce(C.late_start("remarks"), F.lit(False))
    listed = F.array_join(F.transform("recent", lambda r: r.event.cast("string")), ",")
    told = df.filter("event IS NOT NULL").select(*KEY, "day")
    told = H.recent_values(told, 3, [], {}, {"runs": listed}, valid=F.lit(True), source=df)
    told = H.recent_values(told, 3, [], {}, {"clean_runs": listed}, valid=clean, source=df)
    told = told.select(*KEY, *[F.coalesce(c, F.lit("")).alias(c) for c in ("runs", "clean_runs")])
    # Entries that repeat their key have a row for each pair of them.
    pairs = told.groupBy(*KEY).agg(F.collect_list("runs").alias("every"), F.collect_list("clean_runs").alias("clean"))
    return pairs.select(*KEY, F.explode("every").alias("runs"), "clean").select(*KEY, "runs", F.explode("clean").alias("clean_runs"))


@query(
    "recent_form_asof", "W3",
    ENTRIES + _PAST + """
SELECT a.event, a.entity, min(a_day - b_day) FILTER (WHERE k = 1) AS h_days_since_last,
  round(avg(o) FILTER (WHERE k <= 3),6) AS h_recent3_avg_finish, min(o) FILTER (WHERE k <= 3) AS h_recent3_best_finish,
  round(avg(p.last3f) FILTER (WHERE k <= 3),6) AS h_recent3_avg_last3f,
  round(avg(o) FILTER (WHERE k <= 5),6) AS h_recent5_avg_finish,
  round(count(*) FILTER (WHERE k <= 5 AND o = 1) / nullif(count(*) FILTER (WHERE k <= 5),0),6) AS h_recent5_win_rate,
  round(count(*) FILTER (WHERE k <= 5 AND o <= 3) / nullif(count(*) FILTER (WHERE k <= 5),0),6) AS h_recent5_in3_rate
FROM entries a LEFT JOIN past p ON a.event = p.event AND a.entity = p.entity GROUP BY a.event, a.entity""",
)
def recent_form_asof(spark, sf_dir):
    out = H.recent_form(entries(spark, sf_dir))
    return _round(
        out, [*KEY, "h_days_since_last", "h_recent3_best_finish"],
        ["h_recent3_avg_finish", "h_recent3_avg_last3f", "h_recent5_avg_finish", "h_recent5_win_rate", "h_recent5_in3_rate"],
    )


@query(
    "weight_asof", "W4",
    ENTRIES + """, past AS (
  SELECT a.event, a.entity, b.weight AS w, b.tax AS t,
    row_number() OVER (PARTITION BY a.event, a.entity ORDER BY b.day DESC, b.event DESC) AS k
  FROM entries a JOIN entries b ON a.entity = b.entity AND b.day < a.day AND b.weight IS NOT NULL
), g AS (
  SELECT event, entity, avg(w) AS m, stddev_samp(w) AS s, max(w) FILTER (WHERE k=1) AS lw, max(t) FILTER (WHERE k=1) AS lt,
    avg(w) FILTER (WHERE k<=3) AS m3, stddev_samp(w) FILTER (WHERE k<=3) AS s3, count(*) FILTER (WHERE k<=3) AS n3,
    max(w) FILTER (WHERE k=2) AS w2, max(w) FILTER (WHERE k=3) AS w3
  FROM past GROUP BY 1,2)
SELECT event, entity, round(m,6) AS h_avg_body_weight, lw AS h_last_body_weight, lt AS h_last_body_weight_diff,
  round(m3,6) AS h_recent3_avg_body_weight, round(s3,6) AS h_recent3_std_body_weight,
  round(CASE WHEN n3 >= 2 THEN (lw - coalesce(w3, w2)) / (n3 - 1) END,6) AS h_recent3_body_weight_trend,
  round(CASE WHEN s > 0 THEN (lw - m) / s END,6) AS h_body_weight_z
FROM entries LEFT JOIN g USING (event, entity)""",
)
def weight_asof(spark, sf_dir):
    out = H.weight_form(entries(spark, sf_dir), change="tax")
    return _round(
        out, [*KEY, "h_last_body_weight", "h_last_body_weight_diff"],
        ["h_avg_body_weight", "h_recent3_avg_body_weight", "h_recent3_std_body_weight", "h_recent3_body_weight_trend", "h_body_weight_z"],
    )


@query(
    "prize_last3f_asof", "W5 W6",
    ENTRIES + _PAST + """
SELECT a.event, a.entity, round(avg(p.last3f),6) AS h_avg_last3f, min(p.last3f) AS h_best_last3f,
  CAST(sum(p.prize) AS BIGINT) AS h_total_prize, round(avg(p.prize),6) AS h_avg_prize, max(p.prize) AS h_max_prize,
  CAST(sum(p.prize) FILTER (WHERE k <= 3) AS DOUBLE) AS h_recent3_total_prize,
  round(sum(p.prize) FILTER (WHERE k <= 3) / (3 * nullif(avg(p.prize),0)),6) AS h_prize_momentum
FROM entries a LEFT JOIN past p ON a.event = p.event AND a.entity = p.entity GROUP BY a.event, a.entity""",
)
def prize_last3f_asof(spark, sf_dir):
    out = H.entity_block(entries(spark, sf_dir), "tax")
    return _round(
        out, [*KEY, "h_best_last3f", "h_total_prize", "h_max_prize", "h_recent3_total_prize"],
        ["h_avg_last3f", "h_avg_prize", "h_prize_momentum"],
    )


def _actor_sql(key, prefix, pair, pair_prefix):
    conds = {"": "TRUE", "_dist": "b.dc = a.dc", "_surface": "b.surface = a.surface", "_course": "b.place = a.place"}
    cols = [f"count(*) FILTER (WHERE b.outcome = 1) AS {prefix}n_wins"]
    for suffix, test in conds.items():
        cols.append(f"count(b.event) FILTER (WHERE {test}) AS {prefix}n_starts{suffix}")
    recent, both = "b.day >= a.day - 30", f"b.{pair} = a.{pair}"
    cols.append(f"count(b.event) FILTER (WHERE {recent}) AS {prefix}recent30d_n_starts")
    cols.append(f"count(b.event) FILTER (WHERE {both}) AS {pair_prefix}n_starts")
    named = {f"{prefix}{{}}{s}": t for s, t in conds.items()} | {f"{prefix}recent30d_{{}}": recent, f"{pair_prefix}{{}}": both}
    for name, test in named.items():
        for rate, hit in (("win_rate", "b.outcome = 1"), ("in3_rate", "b.outcome <= 3")):
            cols.append(
                f"round(count(*) FILTER (WHERE {hit} AND {test}) / nullif(count(b.event) FILTER (WHERE {test}),0),6) AS {name.format(rate)}"
            )
    return (
        ENTRIES + ", e AS (SELECT *, " + _DIST.format(d="distance") + " AS dc FROM entries) SELECT a.event, a.entity, "
        + ", ".join(cols) + f" FROM e a LEFT JOIN e b ON a.{key} = b.{key} AND b.day < a.day GROUP BY a.event, a.entity"
    )


def _actor(spark, sf_dir, key, prefix, pair, pair_prefix):
    df = with_dist(entries(spark, sf_dir)).select(*KEY, "actor", "owner", "day", "outcome", "dist_cat", "surface", "place")
    names = {"_dist": "dist_cat", "_surface": "surface", "_course": "place"}
    wanted = [records.Record(prefix, [key], names, days=30), records.Record(pair_prefix, [key, pair])]
    out = records.records(df, wanted).drop(f"{pair_prefix}n_wins")
    new = [c for c in out.columns if c not in KEY]
    counts = [c for c in new if "n_starts" in c or "n_wins" in c]
    return _round(out, KEY + counts, [c for c in new if c not in counts])


@query("actor_asof", "J5 J8 W7", _actor_sql("actor", "j_", "entity", "jh_"))
def actor_asof(spark, sf_dir):
    return _actor(spark, sf_dir, "actor", "j_", "entity", "jh_")


@query("owner_asof", "J5 J8 W8", _actor_sql("owner", "t_", "actor", "tj_"))
def owner_asof(spark, sf_dir):
    return _actor(spark, sf_dir, "owner", "t_", "actor", "tj_")


@query(
    "base_recent_form", "W30",
    ENTRIES + _PAST + """
SELECT a.event, a.entity, round(coalesce(avg(o) FILTER (WHERE k<=3),10.0),6) AS perf_finish_mean,
  round(coalesce(stddev_samp(o) FILTER (WHERE k<=3),0.0),6) AS perf_finish_std,
  round(coalesce(avg(p.last3f) FILTER (WHERE k<=3),37.0),6) AS perf_last3f_mean,
  count(k) FILTER (WHERE k<=3) AS perf_recent_runs
FROM entries a LEFT JOIN past p ON a.event = p.event AND a.entity = p.entity GROUP BY a.event, a.entity""",
)
def base_recent_form(spark, sf_dir):
    out = H.base_recent_form(entries(spark, sf_dir))
    return _round(out, [*KEY, "perf_recent_runs"], ["perf_finish_mean", "perf_finish_std", "perf_last3f_mean"])


@query(
    "speed_form", "W29 T5",
    ENTRIES + """, past AS (
  SELECT a.event, a.entity, b.last3f,
    CASE WHEN b.field_size > 1 THEN greatest(0.0, least(1.0, 1 - (b.corner1 - 1) / (b.field_size - 1))) END AS early,
    row_number() OVER (PARTITION BY a.event, a.entity ORDER BY b.day DESC, b.event DESC) AS k
  FROM entries a JOIN entries b ON a.entity = b.entity AND b.day < a.day)
SELECT a.event, a.entity, round(coalesce(avg(early) FILTER (WHERE k <= 5),0.5),6) AS early_speed_index,
  round(CASE WHEN max(last3f) FILTER (WHERE k<=5) > min(last3f) FILTER (WHERE k<=5)
    THEN 1 - (avg(last3f) FILTER (WHERE k<=5) - min(last3f) FILTER (WHERE k<=5)) / (max(last3f) FILTER (WHERE k<=5) - min(last3f) FILTER (WHERE k<=5))
    ELSE 0.5 END,6) AS late_speed_index
FROM (SELECT event, entity FROM entries) a LEFT JOIN past p USING (event, entity) GROUP BY a.event, a.entity""",
)
def speed_form(spark, sf_dir):
    return _round(H.speed_form(entries(spark, sf_dir), 5), KEY, ["early_speed_index", "late_speed_index"])


_W = " WINDOW w AS (PARTITION BY entity ORDER BY day, event), wa AS (PARTITION BY entity ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY entity ORDER BY day, event ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY entity ORDER BY day, event ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w32 AS (PARTITION BY entity ORDER BY day, event ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), w21 AS (PARTITION BY entity ORDER BY day, event ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), w53 AS (PARTITION BY entity ORDER BY day, event ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING)"


@query(
    "career_rows", "W9 W21",
    ENTRIES + """
SELECT event, entity, row_number() OVER w - 1 AS hr_career_starts,
  coalesce(count(*) FILTER (WHERE outcome = 1) OVER wa, 0) AS hr_career_wins,
  coalesce(count(*) FILTER (WHERE outcome <= 3) OVER wa, 0) AS hr_career_in3,
  round(count(*) FILTER (WHERE outcome = 1) OVER wa / nullif(row_number() OVER w - 1,0),6) AS hr_career_win_rate,
  round(count(*) FILTER (WHERE outcome <= 3) OVER wa / nullif(row_number() OVER w - 1,0),6) AS hr_career_in3_rate,
  round(avg(outcome) OVER wa,6) AS hr_career_avg_finish, round(stddev_samp(outcome) OVER wa,6) AS hr_career_std_finish,
  round(avg(last3f) OVER wa,6) AS hr_career_avg_last3f, round(avg(popularity) OVER wa,6) AS hr_career_avg_popularity,
  CAST(coalesce(sum(prize) OVER wa,0) AS BIGINT) AS hr_career_total_prize, round(avg(prize) OVER wa,6) AS hr_career_avg_prize,
  row_number() OVER w AS start_index
FROM entries""" + _W,
)
def career_rows(spark, sf_dir):
    out = H.row_career(entries(spark, sf_dir)).withColumn("start_index", F.col("hr_career_starts") + 1)
    p = "hr_career_"
    return _round(
        out, [*KEY, p + "starts", p + "wins", p + "in3", p + "total_prize", "start_index"],
        [p + x for x in ("win_rate", "in3_rate", "avg_finish", "std_finish", "avg_last3f", "avg_popularity", "avg_prize")],
    )


@query(
    "recent_rows", "W10 W11 W12",
    ENTRIES + """
SELECT event, entity, least(row_number() OVER w - 1, 3) AS hr_recent3_starts, least(row_number() OVER w - 1, 5) AS hr_recent5_starts,
  round(avg(outcome) OVER w3,6) AS hr_recent3_avg_finish, round(avg(outcome) OVER w5,6) AS hr_recent5_avg_finish,
  min(outcome) OVER w3 AS hr_recent3_best_finish, min(outcome) OVER w5 AS hr_recent5_best_finish,
  round(avg(last3f) OVER w3,6) AS hr_recent3_avg_last3f, round(avg(last3f) OVER w5,6) AS hr_recent5_avg_last3f,
  round(avg(popularity) OVER w3,6) AS hr_recent3_avg_popularity, round(avg(popularity) OVER w5,6) AS hr_recent5_avg_popularity,
  CAST(sum(CASE WHEN outcome >= 10 THEN 1 ELSE 0 END) OVER w3 AS BIGINT) AS hr_recent3_big_loss_count,
  CAST(sum(CASE WHEN outcome >= 10 THEN 1 ELSE 0 END) OVER w5 AS BIGINT) AS hr_recent5_big_loss_count,
  round(avg(odds) OVER w3,6) AS hr_recent3_avg_win_odds, day - lag(day) OVER w AS hr_days_since_prev,
  round(CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE lag(outcome) OVER w - avg(outcome) OVER w32 END,6) AS hr_recent3_finish_trend,
  lag(outcome) OVER w - min(outcome) OVER w3 AS hr_recent3_last_vs_best_diff
FROM entries""" + _W,
)
def recent_rows(spark, sf_dir):
    df = entries(spark, sf_dir)
    out = H.row_recent(H.row_career(df), "hr_career_starts", source=df)
    rounded = [f"hr_recent{n}_{x}" for n in (3, 5) for x in ("avg_finish", "avg_last3f", "avg_popularity")]
    rounded += ["hr_recent3_avg_win_odds", "hr_recent3_finish_trend"]
    kept = [f"hr_recent{n}_{x}" for n in (3, 5) for x in ("starts", "best_finish", "big_loss_count")]
    return _round(out, [*KEY, *kept, "hr_days_since_prev", "hr_recent3_last_vs_best_diff"], rounded)


@query(
    "recent_axis_rows", "W13",
    ENTRIES + """, t AS (
SELECT event, entity, lag(outcome) OVER w AS o1, lag(outcome,2) OVER w AS o2, lag(outcome,3) OVER w AS o3,
  lag(last3f) OVER w AS l1, lag(last3f,2) OVER w AS l2, lag(last3f,3) OVER w AS l3, avg(outcome) OVER w3 AS ao, avg(last3f) OVER w3 AS al,
  min(outcome) OVER w5 AS best FROM entries""" + _W + """)
SELECT event, entity, CAST(coalesce(o1,0) AS DOUBLE) AS ax1_last_finish, CAST(CASE WHEN o1 IS NULL THEN 0 ELSE l1 END AS DOUBLE) AS ax1_last_last3f,
  round(ao,6) AS ax1_recent3_avg_finish, round(al,6) AS ax1_recent3_avg_last3f,
  round(CASE WHEN o1 IS NULL THEN 0.0 WHEN o3 IS NOT NULL THEN (o1-o3)/2 WHEN o2 IS NOT NULL THEN o1-o2 END,6) AS ax1_recent3_finish_slope,
  round(CASE WHEN o1 IS NULL THEN 0.0 WHEN l3 IS NOT NULL THEN (l1-l3)/2 WHEN l2 IS NOT NULL THEN l1-l2 END,6) AS ax1_recent3_last3f_slope,
  best AS ax1_best_finish_recent5, round(CASE WHEN o1 IS NULL THEN 0.0 ELSE o1-ao END,6) AS ax1_last_vs_avg3_finish,
  round(CASE WHEN o1 IS NULL THEN 0.0 ELSE l1-al END,6) AS ax1_last_vs_avg3_last3f FROM t""",
)
def recent_axis_rows(spark, sf_dir):
    out = H.recent_axis(entries(spark, sf_dir))
    names = [c for c in out.columns if c.startswith("ax1_") and c != "ax1_best_finish_recent5"]
    return _round(out, [*KEY, "ax1_best_finish_recent5"], names)


def _cond_axis_sql(cond, name, extra=False):
    w = f"(PARTITION BY entity, {cond} ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out = (
        f"count(*) OVER {w} AS {name}_starts, round(count(*) FILTER (WHERE outcome <= 3) OVER {w} / nullif(count(*) OVER {w},0),6) AS {name}_in3_rate, "
        f"round(sum(outcome) OVER {w} / nullif(count(*) OVER {w},0),6) AS {name}_avg_finish"
    )
    return out + (f", round(avg(last3f) OVER {w},6) AS {name}_avg_last3f" if extra else "")


_NAME = "CASE WHEN distance < 1400 THEN 'short' WHEN distance < 1800 THEN 'mile' WHEN distance < 2200 THEN 'middle' ELSE 'long' END"


@query(
    "condition_axis_rows", "W14 P6",
    ENTRIES + ", e AS (SELECT *, " + _NAME + " AS dn FROM entries) SELECT event, entity, "
    + _cond_axis_sql("surface", "ax2_same_surface", True) + ", " + _cond_axis_sql("place", "ax2_same_course") + ", "
    + _cond_axis_sql("dn", "ax2_same_distcat") + " FROM e",
)
def condition_axis_rows(spark, sf_dir):
    df = entries(spark, sf_dir).withColumn("dist_name", C.distance_name("distance"))
    out = H.condition_axis(df, "ax2_same_surface", "surface", last3f=True)
    out = H.condition_axis(out, "ax2_same_course", "place", source=df)
    out = H.condition_axis(out, "ax2_same_distcat", "dist_name", source=df)
    new = [c for c in out.columns if c.startswith("ax2_")]
    return _round(out, KEY + [c for c in new if c.endswith("starts")], [c for c in new if not c.endswith("starts")])


_RANK = "CASE WHEN race_class LIKE '%新馬%' THEN 1 WHEN race_class LIKE '%未勝利%' THEN 2 WHEN race_class LIKE '%1勝%' THEN 3 WHEN race_class LIKE '%2勝%' THEN 4 WHEN race_class LIKE '%3勝%' THEN 5 WHEN race_class LIKE '%オープン%' THEN 6 WHEN race_class = 'G3' THEN 8 WHEN race_class = 'G1' THEN 10 ELSE 0 END"


def with_rank(df):
    return df.withColumn("class_rank", C.class_rank("race_class"))


@query(
    "change_axis_rows", "W14 W16 P7",
    ENTRIES + ", e AS (SELECT *, " + _RANK + """ AS cr FROM entries), t AS (
SELECT event, entity, day - lag(day) OVER w AS rest, distance - lag(distance) OVER w AS dd, surface <> lag(surface) OVER w AS sc,
  place <> lag(place) OVER w AS pc, cr - lag(cr) OVER w AS dc FROM e""" + _W + """)
SELECT event, entity, coalesce(dd,0) AS ax2_dist_change_prev, CAST(coalesce(dd,0) > 0 AS INTEGER) AS ax2_is_dist_up,
  CAST(coalesce(dd,0) < 0 AS INTEGER) AS ax2_is_dist_down, CAST(coalesce(sc,FALSE) AS INTEGER) AS ax2_is_surface_change,
  CAST(coalesce(pc,FALSE) AS INTEGER) AS ax2_is_course_change, coalesce(rest,0) AS ax4_rest_days, round(coalesce(rest,0)/7.0,6) AS ax4_rest_weeks,
  CAST(coalesce(rest <= 7,FALSE) AS INTEGER) AS ax4_is_short_turnaround, CAST(coalesce(rest >= 84,FALSE) AS INTEGER) AS ax4_is_long_break_12w,
  coalesce(dc,0) AS ax4_class_diff, CAST(coalesce(dc,0) > 0 AS INTEGER) AS ax4_is_class_up, CAST(coalesce(dc,0) < 0 AS INTEGER) AS ax4_is_class_down
FROM t""",
)
def change_axis_rows(spark, sf_dir):
    out = H.change_axis(with_rank(entries(spark, sf_dir)), "class_rank")
    new = [c for c in out.columns if c.startswith(("ax2_", "ax4_")) and c != "ax4_rest_weeks"]
    return _round(out, KEY + new, ["ax4_rest_weeks"])


@query(
    "class_axis_rows", "W15 P7",
    ENTRIES + ", e AS (SELECT *, " + _RANK + """ AS cr FROM entries), t AS (
SELECT event, entity, cr, row_number() OVER w AS n, max(cr) OVER w5 AS b, avg(cr) OVER w5 AS a, sum(prize) OVER w5 AS p5, avg(prize) OVER w3 AS p3,
  avg(prize) OVER w21 - avg(prize) OVER w53 AS tr FROM e""" + _W + """)
SELECT event, entity, CAST(coalesce(b,0) AS DOUBLE) AS ax3_best_class_recent5, round(coalesce(a,0.0),6) AS ax3_avg_class_recent5,
  CAST(coalesce(p5,0) AS DOUBLE) AS ax3_total_prize_recent5, round(coalesce(p3,0.0),6) AS ax3_avg_prize_recent3,
  round(CASE WHEN n = 1 THEN 0.0 ELSE tr END,6) AS ax3_prize_trend_recent5, CAST(CASE WHEN n = 1 THEN 0 ELSE cr - b END AS DOUBLE) AS ax3_curr_vs_best_class
FROM t""",
)
def class_axis_rows(spark, sf_dir):
    out = H.class_axis(with_rank(entries(spark, sf_dir)), "class_rank")
    return _round(out, KEY, [c for c in out.columns if c.startswith("ax3_")])


@query(
    "position_axis_rows", "W17",
    ENTRIES + """, e AS (SELECT *, corner1/field_size AS c1, corner4/field_size AS c4, (corner1-corner4)/field_size AS g FROM entries), t AS (
SELECT event, entity, avg(c1) OVER w3 AS a3, avg(c1) OVER w5 AS a5, avg(c4) OVER w3 AS b3, avg(c4) OVER w5 AS b5, avg(g) OVER w3 AS g3, avg(g) OVER w5 AS g5 FROM e""" + _W + """)
SELECT event, entity, round(a3,6) AS ax6_recent3_c1_pos_pct_mean, round(a5,6) AS ax6_recent5_c1_pos_pct_mean, round(b3,6) AS ax6_recent3_c4_pos_pct_mean,
  round(b5,6) AS ax6_recent5_c4_pos_pct_mean, round(g3,6) AS ax6_recent3_pos_gain_mean, round(g5,6) AS ax6_recent5_pos_gain_mean,
  count(*) FILTER (WHERE round(a5,9) <= 0.30) OVER ev AS ax6_race_front_runner_count,
  round(coalesce(count(*) FILTER (WHERE round(a5,9) <= 0.30) OVER ev / nullif(count(a5) OVER ev,0),0.0),6) AS ax6_race_front_runner_share,
  count(*) FILTER (WHERE round(a5,9) <= 0.20) OVER ev AS ax6_race_leader_count
FROM t WINDOW ev AS (PARTITION BY event)""",
)
def position_axis_rows(spark, sf_dir):
    out = H.position_axis(entries(spark, sf_dir))
    new = [c for c in out.columns if c.startswith("ax6_")]
    return _round(out, KEY + [c for c in new if c.endswith("count")], [c for c in new if not c.endswith("count")])


@query(
    "stability_axis_rows", "W18",
    ENTRIES + """, e AS (SELECT *, (corner1-corner4)/field_size AS g FROM entries)
SELECT event, entity, round(coalesce(stddev_samp(outcome) OVER w5,0.0),6) AS ax7_finish_std_recent5, round(coalesce(stddev_samp(last3f) OVER w5,0.0),6) AS ax7_last3f_std_recent5,
  round(coalesce(stddev_samp(popularity) OVER w5,0.0),6) AS ax7_popularity_std_recent5, round(coalesce(stddev_samp(g) OVER w5,0.0),6) AS ax7_pos_gain_std_recent5
FROM e""" + _W,
)
def stability_axis_rows(spark, sf_dir):
    out = H.stability_axis(entries(spark, sf_dir))
    return _round(out, KEY, [c for c in out.columns if c.startswith("ax7_")])


@query(
    "partner_axis_rows", "W19",
    ENTRIES + """
SELECT event, entity, round(coalesce(count(*) FILTER (WHERE outcome <= 3) OVER a / nullif(count(*) OVER a,0),0.0),6) AS ax8_jockey_in3_rate_total_asof,
  round(coalesce(count(*) FILTER (WHERE outcome <= 3) OVER o / nullif(count(*) OVER o,0),0.0),6) AS ax8_trainer_in3_rate_total_asof
FROM entries WINDOW a AS (PARTITION BY actor ORDER BY day, event, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  o AS (PARTITION BY owner ORDER BY day, event, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def partner_axis_rows(spark, sf_dir):
    df = entries(spark, sf_dir)
    out = H.partner_axis(df, "actor", "ax8_jockey_in3_rate_total_asof")
    out = H.partner_axis(out, "owner", "ax8_trainer_in3_rate_total_asof", source=df)
    return _round(out, KEY, [c for c in out.columns if c.startswith("ax8_")])


@query(
    "market_axis_rows", "W20",
    ENTRIES + """, e AS (SELECT *, outcome - popularity AS d FROM entries), t AS (
SELECT event, entity, avg(odds) OVER w5 AS ao, stddev_samp(odds) OVER w5 AS so, avg(d) OVER w5 AS ad, least(row_number() OVER w - 1, 5) AS n,
  lag(d) OVER w AS d1, first_value(d) OVER w5 AS df FROM e""" + _W + """)
SELECT event, entity, round(coalesce(ao,0.0),6) AS ax9_avg_win_odds_recent5, round(coalesce(so,0.0),6) AS ax9_std_win_odds_recent5,
  round(coalesce(ad,0.0),6) AS ax9_finish_minus_popularity_mean_recent5,
  round(CASE WHEN n >= 2 THEN (d1 - df) / (n - 1) ELSE 0.0 END,6) AS ax9_finish_minus_popularity_slope_recent5 FROM t""",
)
def market_axis_rows(spark, sf_dir):
    out = H.market_axis(entries(spark, sf_dir))
    return _round(out, KEY, [c for c in out.columns if c.startswith("ax9_")])
