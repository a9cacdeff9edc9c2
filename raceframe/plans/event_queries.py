"""Event-relative values, snapshots, event features, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from raceframe.functions import columns as C
from raceframe.functions import constants as K
from raceframe.operators import asof, event, relative
from raceframe.operators.grouping import rank_in_group
from raceframe.plans.base import ENTRIES, entries, kept, r6, table
from raceframe.plans.registry import ORACLES, query

KEY = ["event", "entity"]


def rounded(df, keep, names):
    return df.select(*keep, *[r6(n).alias(n) for n in names])


def _pct(col, inverted=False):
    base = (
        f"(rank() OVER (PARTITION BY event, {col} IS NULL ORDER BY {col}) + (count(*) OVER (PARTITION BY event, {col}) - 1) / 2.0)"
        f" / count({col}) OVER (PARTITION BY event)"
    )
    return f"CASE WHEN {col} IS NOT NULL THEN round({'1 - ' if inverted else ''}{base},6) END"


def _z(col, inverted=False, low="0"):
    std = f"stddev_samp({col}) OVER (PARTITION BY event)"
    z = f"coalesce(CASE WHEN {std} > {low} THEN ({col} - avg({col}) OVER (PARTITION BY event)) / {std} END, 0.0)"
    return f"round({'-' if inverted else ''}{z},6) + 0.0"


@query(
    "event_relative", "W22",
    ENTRIES + f"""SELECT event, entity, {_pct('weight')} AS rr_rank_pct_weight, {_pct('odds', True)} AS rr_rank_pct_odds,
  {_pct('qty')} AS rr_rank_pct_qty, {_z('weight')} AS rr_zscore_weight, {_z('odds', True)} AS rr_zscore_odds, {_z('qty')} AS rr_zscore_qty FROM entries""",
)
def event_relative(spark, sf_dir):
    cols = ["weight", "odds", "qty"]
    out = relative.relative_features(entries(spark, sf_dir).select(*KEY, "field_size", *cols), cols, {"odds"}, "field_size")
    z = [(r6(f"rr_zscore_{c}") + 0.0).alias(f"rr_zscore_{c}") for c in cols]
    return out.select(*KEY, *[r6(f"rr_rank_pct_{c}").alias(f"rr_rank_pct_{c}") for c in cols], *z)


@query(
    "event_zscores", "W23",
    ENTRIES + f"SELECT event, entity, {_z('last3f', low='1e-8')} AS last3f_z, {_z('prize', low='1e-8')} AS prize_z, {_z('popularity', low='1e-8')} AS popularity_z, {_z('post', low='1e-8')} AS post_z FROM entries",
)
def event_zscores(spark, sf_dir):
    cols = ["last3f", "prize", "popularity", "post"]
    out = relative.zscores(entries(spark, sf_dir).select(*KEY, "field_size", *cols), cols, min_std=1e-8, size="field_size")
    return out.select(*KEY, *[(r6(f"{c}_z") + 0.0).alias(f"{c}_z") for c in cols])


@query(
    "event_softmax_share", "W24 P18",
    ENTRIES + """, l AS (SELECT event, entity, p, 0.9 * ln(greatest(least(p,0.999),0.001)/(1-greatest(least(p,0.999),0.001))) AS x, least(0.95, p * 4) AS w0 FROM entries)
SELECT event, entity, round(exp(x - max(x) OVER v) / sum(exp(x)) OVER v * exp(max(x) OVER v), 6) AS soft,
  round(w0 / sum(w0) OVER v,6) AS win, round(CASE WHEN sum(w0) OVER v > 3 THEN w0 * 3 / sum(w0) OVER v ELSE w0 END,6) AS in3,
  round(1/(1+exp(-x-0.1)),6) AS back
FROM l WINDOW v AS (PARTITION BY event)""",
)
def event_softmax_share(spark, sf_dir):
    df = entries(spark, sf_dir).select(*KEY, "field_size", "p").withColumn("x", 0.9 * C.logit("p", 0.001))
    df = relative.softmax(df, "x", "soft", "field_size")
    df = df.withColumn("win", F.least(F.lit(0.95), F.col("p") * 4)).withColumn("in3", F.col("win"))
    df = relative.normalize(df, "win", "in3", size="field_size").withColumn("back", C.sigmoid(F.col("x") + 0.1))
    return rounded(df, KEY, ["soft", "win", "in3", "back"])


@query(
    "prediction_ranks", "W26",
    ENTRIES + """, r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY p DESC, entity) AS k FROM entries),
t AS (SELECT event, max(p) FILTER (WHERE k=1) AS a, max(p) FILTER (WHERE k=2) AS b FROM r GROUP BY event)
SELECT event, entity, k AS pred_rank, round(a,6) AS top1_p, round(b,6) AS top2_p, round(a-b,6) AS gap FROM r JOIN t USING (event)""",
)
def prediction_ranks(spark, sf_dir):
    df = entries(spark, sf_dir).select(*KEY, "p", "field_size")
    top = relative.top_two(df, "p").drop("entity")
    out = relative.prediction_rank(df, "p", size="field_size").join(top, "event")
    return rounded(out, [*KEY, "pred_rank"], ["top1_p", "top2_p", "gap"])


@query(
    "hot_group_rank", "W22 W26",
    ENTRIES + """SELECT actor, event, entity, row_number() OVER (PARTITION BY actor ORDER BY price DESC, event, entity) AS pos,
  rank() OVER (PARTITION BY actor ORDER BY qty) AS qty_rank FROM entries""",
)
def hot_group_rank(spark, sf_dir):
    """Large groups, ranked chunk by chunk: the limit is set low so that every group is cut."""
    df = entries(spark, sf_dir).select("actor", *KEY, "price", "qty")
    out = rank_in_group(df, ["actor"], "price", "pos", descending=True, ties=KEY, hot_rows=10)
    return rank_in_group(out, ["actor"], "qty", "qty_rank", kind="rank", hot_rows=10).select("actor", *KEY, "pos", "qty_rank")


@query("event_relative_spread_out", "W22", ORACLES["event_relative"])
def event_relative_spread_out(spark, sf_dir):
    """The way of very large events, taken for all events."""
    cols = ["weight", "odds", "qty"]
    out = relative.relative_features(entries(spark, sf_dir).select(*KEY, *cols), cols, {"odds"}, store=kept)
    z = [(r6(f"rr_zscore_{c}") + 0.0).alias(f"rr_zscore_{c}") for c in cols]
    return out.select(*KEY, *[r6(f"rr_rank_pct_{c}").alias(f"rr_rank_pct_{c}") for c in cols], *z)


# --- snapshots ----------------------------------------------------------------------


@query(
    "snapshot_latest", "J6 W25 R1",
    """SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS k
  FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:00:00') WHERE k = 1""",
)
def snapshot_latest(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return asof.latest(ev, ["user_id", "event_type"], "ts", ["value"], F.lit("2024-01-10 12:00:00").cast("timestamp"))


@query(
    "snapshot_asof_join", "J6",
    """SELECT p.user_id, p.event_id, p.ts AS asked_at, o.ts AS ts, o.value AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1,2) o
  ON p.user_id = o.user_id AND p.ts >= o.ts""",
)
def snapshot_asof_join(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    probes = ev.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("asked_at"))
    seen = ev.filter("event_type = 'view'").select("user_id", "ts", "value")
    return asof.asof_join(probes, seen, ["user_id"], "asked_at", "ts", ["value"], ["event_id"])


@query(
    "snapshot_override", "J7",
    """WITH l AS (SELECT user_id, max_by(value, (ts, value)) AS value FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1)
SELECT c_custkey AS user_id, c_name, round(coalesce(l.value, c_acctbal),6) AS value, CASE WHEN l.user_id IS NULL THEN 'base' ELSE 'snapshot' END AS source
FROM customer LEFT JOIN l ON l.user_id = c_custkey""",
)
def snapshot_override(spark, sf_dir):
    ev = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    snap = asof.latest(ev, ["user_id"], "ts", ["value"], F.lit("2024-01-10 00:00:00").cast("timestamp"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", F.col("c_acctbal").alias("value"))
    return asof.override(base, snap, ["user_id"], ["value"], ("snapshot", "base")).withColumn("value", r6("value"))


_LONG = """, l AS (SELECT event, entity, unnest(['h_n_starts','odds','weather','horse_weight','finish_time']) AS feature,
    unnest([qty, odds, last3f, coalesce(weight,0), outcome]) AS value,
    unnest([0,1,2,3,4]) AS i, event_date, tax FROM entries),
long AS (SELECT event, entity, feature, CAST(value AS DOUBLE) AS value,
   CAST(event_date AS TIMESTAMP) + to_minutes(CAST(-900 + 400 * i + 60 * tax AS INTEGER)) AS seen_at, CAST(event_date AS TIMESTAMP) + INTERVAL 15 HOUR AS start FROM l)
"""


def _long(df):
    fields = [("h_n_starts", "qty"), ("odds", "odds"), ("weather", "last3f"), ("horse_weight", "weight"), ("finish_time", "outcome")]
    parts = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value"), F.lit(i).alias("i"))
                for i, (n, c) in enumerate(fields)
            ]
        )
    ).alias("x")
    day = F.col("event_date").cast("timestamp")
    minutes = -900 + 400 * F.col("x.i") + 60 * F.col("tax")
    return df.select(*KEY, "tax", "event_date", parts).select(
        *KEY, "x.feature", "x.value", F.timestamp_add("MINUTE", minutes.cast("int"), day).alias("seen_at")
    )


@query(
    "safe_features_at_decision", "E14 P22",
    ENTRIES + _LONG + """SELECT event, entity, feature, level, seen_at, value FROM (
  SELECT *, CASE feature WHEN 'h_n_starts' THEN 'pre_race' WHEN 'odds' THEN 'just_before' WHEN 'weather' THEN 'morning' WHEN 'horse_weight' THEN 'paddock' ELSE 'result' END AS level,
    start - INTERVAL 30 MINUTE AS cut FROM long) WHERE level IN ('pre_race','morning','paddock') AND seen_at <= cut""",
)
def safe_features_at_decision(spark, sf_dir):
    df = entries(spark, sf_dir)
    starts = df.select("event", (F.col("event_date").cast("timestamp") + F.expr("INTERVAL 15 HOURS")).alias("start")).distinct()
    return asof.safe_features(_long(df), starts, "paddock")


# --- event features ---------------------------------------------------------------------

_STYLE = """, s AS (SELECT *, CASE WHEN r <= 0.20 THEN '逃げ' WHEN r <= 0.40 THEN '先行' WHEN r <= 0.70 THEN '差し' ELSE '追込' END AS style,
   CASE WHEN field_size > 1 THEN 1 - (corner1 - 1) / (field_size - 1) ELSE 0.5 END AS early, 1 - (last3f - 33) / 8 AS late
  FROM (SELECT *, list_avg(list_transform(string_split(passing,'-'), lambda x: CAST(x AS INTEGER))) / field_size AS r FROM entries)),
s2 AS (SELECT *, CASE style WHEN '逃げ' THEN 1.0::DOUBLE WHEN '先行' THEN 0.7::DOUBLE WHEN '差し' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS aggr FROM s)
"""


def styled(df):
    n = F.col("field_size")
    return df.withColumns(
        {
            "style": C.style_by_ratio("passing", "field_size"),
            "early_speed_index": F.when(n > 1, 1 - (F.col("corner1") - 1) / (n - 1)).otherwise(0.5),
            "late_speed_index": 1 - (F.col("last3f") - 33) / 8,
        }
    ).withColumn("aggressiveness", C.style_score("style"))


@query("running_style", "P9 P13",
       ENTRIES + _STYLE + """SELECT event, entity, style, CAST(split_part(passing,'-',1) AS INTEGER) AS c1, CAST(split_part(passing,'-',3) AS INTEGER) AS c3,
  CASE WHEN corner1 <= lead THEN '逃げ' WHEN corner1 <= fwd THEN '先行' WHEN corner1 / field_size > 0.7 THEN '追込' ELSE '差し' END AS style_by_rank
  FROM (SELECT *, CASE WHEN sf = 'ダート' AND distance <= 1400 THEN 3 ELSE 2 END AS lead, CASE WHEN sf = 'ダート' AND distance <= 1400 THEN 6 ELSE 5 END AS fwd
    FROM (SELECT *, CASE surface WHEN 'ダ' THEN 'ダート' ELSE surface END AS sf FROM s2))""")
def running_style(spark, sf_dir):
    df = styled(entries(spark, sf_dir))
    long_name = F.when(F.col("surface") == "ダ", "ダート").otherwise(F.col("surface"))
    four = C.four_positions("passing")
    return df.select(*KEY, "style", four["c1"].alias("c1"), four["c3"].alias("c3"),
                     C.style_by_rank("corner1", "field_size", long_name, "distance").alias("style_by_rank"))


@query("event_style_features", "A18",
       ENTRIES + _STYLE + """, g AS (SELECT event, count(*) AS field_size, count(*) FILTER (WHERE style='逃げ') AS num_nige, count(*) FILTER (WHERE style='先行') AS num_senkou,
  count(*) FILTER (WHERE style='差し') AS num_sashi, count(*) FILTER (WHERE style='追込') AS num_oikomi,
  coalesce(max(early) FILTER (WHERE style='逃げ'),0) AS nige_speed_max, coalesce(avg(early) FILTER (WHERE style='逃げ'),0) AS nige_speed_mean,
  coalesce(stddev_pop(early) FILTER (WHERE style='逃げ'),0) AS nige_speed_std, max(early) FILTER (WHERE style='逃げ') - min(early) FILTER (WHERE style='逃げ') AS d,
  coalesce(avg(early) FILTER (WHERE style='先行'),0) AS senkou_pressure, coalesce(avg(late) FILTER (WHERE style='差し'),0) AS sashi_late_speed_mean,
  coalesce(avg(late) FILTER (WHERE style='追込'),0) AS oikomi_late_speed_mean, avg(aggr) AS mean_jockey_aggressiveness,
  count(*) FILTER (WHERE aggr >= 0.6) AS aggressive_jockey_count FROM s2 GROUP BY event)
SELECT event, field_size, num_nige, num_senkou, num_sashi, num_oikomi, round(nige_speed_max,6) AS nige_speed_max, round(nige_speed_mean,6) AS nige_speed_mean,
  round(nige_speed_std,6) AS nige_speed_std, round(senkou_pressure,6) AS senkou_pressure, round(sashi_late_speed_mean,6) AS sashi_late_speed_mean,
  round(oikomi_late_speed_mean,6) AS oikomi_late_speed_mean, round(mean_jockey_aggressiveness,6) AS mean_jockey_aggressiveness, aggressive_jockey_count,
  round(CASE WHEN num_nige >= 3 THEN 1.0::DOUBLE WHEN num_nige = 2 THEN CASE WHEN d <= 0.15 THEN 0.9 WHEN d >= 0.3 THEN 0.5 ELSE 0.9 - (d - 0.15)/0.15*0.4 END ELSE 0.0 END,6) AS escape_competition_risk FROM g""")
def event_style_features(spark, sf_dir):
    out = event.event_style_features(styled(entries(spark, sf_dir)))
    counts = ["event", "field_size", "num_nige", "num_senkou", "num_sashi", "num_oikomi", "aggressive_jockey_count"]
    return rounded(out, counts, [c for c in out.columns if c not in counts])


@query("event_pace_inputs", "A19",
       ENTRIES + _STYLE + """SELECT event, count(*) AS n_horses, count(*) FILTER (WHERE style='逃げ') AS n_escape, count(*) FILTER (WHERE style IN ('逃げ','先行')) AS n_leading,
  round(avg(corner1) FILTER (WHERE style='逃げ'),6) AS escape_avg_corner1, round(avg(last3f) FILTER (WHERE style='逃げ'),6) AS escape_best_3f,
  round(avg(corner1) FILTER (WHERE style IN ('逃げ','先行')),6) AS leading_avg_corner1, round(avg(last3f) FILTER (WHERE style IN ('逃げ','先行')),6) AS leading_best_3f,
  round(avg(post),6) AS avg_gate_number, round(count(*) FILTER (WHERE style='逃げ') / count(*),6) AS escape_ratio,
  CAST(count(*) FILTER (WHERE style='逃げ') > 0 AS INTEGER) AS has_escape_horse, CAST(count(*) FILTER (WHERE style IN ('逃げ','先行')) > 0 AS INTEGER) AS has_leading_horse
 FROM s2 GROUP BY event""")
def event_pace_inputs(spark, sf_dir):
    out = event.event_pace_inputs(styled(entries(spark, sf_dir)))
    keep = ["event", "n_horses", "n_escape", "n_leading", "has_escape_horse", "has_leading_horse"]
    return rounded(out, keep, [c for c in out.columns if c not in keep])


@query("style_profile_asof", "A20 T5",
       ENTRIES + _STYLE + """, past AS (SELECT a.event, a.entity, b.style, b.corner1/b.field_size AS rel,
   row_number() OVER (PARTITION BY a.event, a.entity ORDER BY b.day DESC, b.event DESC) AS k
  FROM entries a JOIN s2 b ON a.entity=b.entity AND b.day<a.day),
g AS (SELECT event, entity, count(*) AS n, count(*) FILTER (WHERE style='逃げ') AS c1, count(*) FILTER (WHERE style='先行') AS c2, count(*) FILTER (WHERE style='差し') AS c3,
  count(*) FILTER (WHERE style='追込') AS c4, sum(rel * w)/sum(w) AS ap FROM (SELECT *, CASE WHEN k<=3 THEN 1.0::DOUBLE WHEN k<=6 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS w FROM past WHERE k <= 10) GROUP BY 1,2)
SELECT e.event, e.entity, CASE WHEN n IS NULL THEN '不明' WHEN c1 >= c2 AND c1 >= c3 AND c1 >= c4 THEN '逃げ' WHEN c2 >= c3 AND c2 >= c4 THEN '先行' WHEN c3 >= c4 THEN '差し' ELSE '追込' END AS main_style,
  round(c1/n,6) AS share_nige, round(c2/n,6) AS share_senkou, round(c3/n,6) AS share_sashi, round(c4/n,6) AS share_oikomi, round(ap,6) AS avg_pos_rel, coalesce(n,0) AS race_count
FROM entries e LEFT JOIN g ON e.event = g.event AND e.entity = g.entity""")
def style_profile_asof(spark, sf_dir):
    out = event.style_profile(styled(entries(spark, sf_dir)), "style")
    return rounded(out, [*KEY, "main_style", "race_count"], ["share_nige", "share_senkou", "share_sashi", "share_oikomi", "avg_pos_rel"])


@query("actor_aggressiveness", "A21",
       ENTRIES + _STYLE + """, m AS (SELECT actor, CAST(sum(CAST(round(aggr * 10) AS BIGINT)) AS DOUBLE) / (10.0::DOUBLE * count(*)) AS m, count(*) AS n FROM s2 GROUP BY actor)
SELECT actor, n, round(greatest(0.0, least(1.0, CASE WHEN n < 600 THEN 0.5::DOUBLE*m + 0.5::DOUBLE*(SELECT avg(m) FROM m) ELSE m END)),6) AS aggressiveness FROM m""")
def actor_aggressiveness(spark, sf_dir):
    out = event.aggressiveness(styled(entries(spark, sf_dir)), "style", min_runs=600)
    return rounded(out, ["actor", "n"], ["aggressiveness"])


@query("smoothed_rates_asof", "A22 P14",
       ENTRIES + _STYLE + """, e AS (SELECT a.event, a.entity, count(b.event) AS n, count(*) FILTER (WHERE b.tax = 8) AS k FROM entries a LEFT JOIN entries b ON a.entity=b.entity AND b.day<a.day GROUP BY 1,2),
ac AS (SELECT a.event, a.entity, count(b.event) AS n, count(*) FILTER (WHERE b.style IN ('逃げ','先行')) AS k FROM entries a LEFT JOIN s2 b ON a.actor=b.actor AND b.day<a.day GROUP BY 1,2)
SELECT e.event, e.entity, round((e.k + 20*0.10::DOUBLE)/(e.n+20),6) AS late_start_rate, round(coalesce(e.k/nullif(e.n,0),0),6) AS late_start_rate_raw,
  round(CASE WHEN ac.n < 5 THEN 0.18 ELSE (ac.k + 40*0.18::DOUBLE)/(ac.n+40) END,6) AS front_runner_rate FROM e JOIN ac USING (event, entity)""")
def smoothed_rates_asof(spark, sf_dir):
    df = styled(entries(spark, sf_dir)).withColumn("remarks", F.when(F.col("tax") == 8, "出遅れ"))
    out = event.smoothed_rates_asof(df, C.late_start("remarks"), F.col("style").isin(K.STYLES[0], K.STYLES[1]))
    return rounded(out, KEY, ["late_start_rate", "late_start_rate_raw", "front_runner_rate"])


@query("going_split_asof", "A23",
       ENTRIES + """, x AS (SELECT *, CAST(event % 9 - 4 AS DOUBLE) AS idx FROM entries),
t AS (SELECT place, avg(idx) AS m, stddev_samp(idx) AS s FROM x GROUP BY place)
SELECT a.event, a.entity, round(coalesce(count(*) FILTER (WHERE b.idx < -1.5 AND b.outcome=1)/nullif(count(*) FILTER (WHERE b.idx < -1.5),0),0.08),6) AS high_speed_win_rate,
  round(coalesce(count(*) FILTER (WHERE b.idx > 1.5 AND b.outcome=1)/nullif(count(*) FILTER (WHERE b.idx > 1.5),0),0.08),6) AS slow_win_rate,
  count(*) FILTER (WHERE b.idx < -1.5) AS high_speed_count, count(*) FILTER (WHERE b.idx > 1.5) AS slow_count,
  round(any_value((a.idx - t.m)/t.s),6) AS normalized_index
FROM x a JOIN t ON t.place = a.place LEFT JOIN x b ON a.entity=b.entity AND b.day<a.day GROUP BY 1,2""")
def going_split_asof(spark, sf_dir):
    df = entries(spark, sf_dir).withColumn("idx", (F.col("event") % 9 - 4).cast("double"))
    stats = df.groupBy("place").agg(F.avg("idx").alias("m"), F.stddev_samp("idx").alias("s"))
    out = event.normalize_by(event.going_split(df, "idx", 0.08), stats, ["place"], "idx", "m", "s", "normalized_index")
    return rounded(out, [*KEY, "high_speed_count", "slow_count"], ["high_speed_win_rate", "slow_win_rate", "normalized_index"])


@query("pace_baseline", "J13 C7",
       ENTRIES + """, b AS (SELECT place, surface, distance, avg(last3f) AS v FROM entries WHERE distance % 700 = 0 AND surface <> '障' GROUP BY 1,2,3),
q AS (SELECT place, surface, distance, avg(last3f) AS pace FROM entries GROUP BY 1,2,3),
j AS (SELECT q.*, b.v, row_number() OVER (PARTITION BY q.place, q.surface, q.distance ORDER BY abs(b.distance - q.distance), b.distance) AS k FROM q LEFT JOIN b ON q.place=b.place AND q.surface=b.surface)
SELECT place, surface, distance, round(coalesce(v,35.5),6) AS baseline, round(pace - coalesce(v,35.5),6) AS deviation,
  CASE WHEN pace < coalesce(v,35.5) - 0.5 THEN 'ハイペース' WHEN pace > coalesce(v,35.5) + 0.5 THEN 'スローペース' ELSE '標準ペース' END AS pace_class FROM j WHERE k = 1""")
def pace_baseline(spark, sf_dir):
    keys = ["place", "surface", "distance"]
    mean = entries(spark, sf_dir).groupBy(*keys).agg(F.avg("last3f").alias("pace"))
    base = mean.filter((F.col("distance") % 700 == 0) & (F.col("surface") != "障"))
    out = event.nearest_baseline(mean, base, ["place", "surface"], "distance", "pace", 35.5)
    out = out.withColumn("deviation", F.col("pace") - F.col("baseline"))
    out = out.withColumn("pace_class", event.pace_class(F.col("pace"), F.col("baseline")))
    return rounded(out, [*keys, "pace_class"], ["baseline", "deviation"])


@query("event_backfill", "J14",
       ENTRIES + """, ev AS (SELECT DISTINCT event, CASE WHEN event % 3 = 0 THEN NULL ELSE place END AS place, CASE WHEN event % 2 = 0 THEN NULL ELSE flag0 END AS flag FROM (SELECT *, 'E' AS flag0 FROM entries)),
f AS (SELECT event, min_by(place, (entity)) AS place, min_by(flag, entity) FILTER (WHERE flag <> 'N') AS flag FROM entries GROUP BY event)
SELECT ev.event, coalesce(ev.place, f.place) AS place, coalesce(ev.flag, f.flag) AS flag FROM ev LEFT JOIN f USING (event)""")
def event_backfill(spark, sf_dir):
    df = entries(spark, sf_dir)
    rows = df.select("event", "entity", "place", F.when(F.col("flag") != "N", F.col("flag")).alias("flag"))
    ev = df.select("event", F.when(F.col("event") % 3 != 0, F.col("place")).alias("place"), F.when(F.col("event") % 2 != 0, "E").alias("flag")).distinct()
    return event.backfill(ev, rows, ["place", "flag"], ["entity"])


@query("clip_ranges", "A25",
       ENTRIES + """, b AS (SELECT *, CASE WHEN distance <= 1400 THEN 'short' WHEN distance <= 2000 THEN 'medium' ELSE 'long' END AS band, price/1000 AS kp FROM entries)
SELECT surface, band, count(*) AS n, round(quantile_cont(last3f, 0.0025),6) AS last3f_low, round(quantile_cont(last3f, 0.9975),6) AS last3f_high,
 round(quantile_cont(odds, 0.0025),6) AS odds_low, round(quantile_cont(odds, 0.9975),6) AS odds_high FROM b GROUP BY 1,2 HAVING count(*) >= 10""")
def clip_ranges(spark, sf_dir):
    out = event.clip_ranges(entries(spark, sf_dir), ["last3f", "odds"])
    return rounded(out, ["surface", "band", "n"], ["last3f_low", "last3f_high", "odds_low", "odds_high"])


@query("clip_applied", "A25",
       ENTRIES + """, b AS (SELECT *, CASE WHEN distance <= 1400 THEN 'short' WHEN distance <= 2000 THEN 'medium' ELSE 'long' END AS band FROM entries),
r AS (SELECT surface, band, quantile_cont(odds, 0.05) AS lo, quantile_cont(odds, 0.95) AS hi FROM b GROUP BY 1,2)
SELECT event, entity, round(greatest(least(odds, hi), lo),6) AS odds_held FROM b JOIN r USING (surface, band)""")
def clip_applied(spark, sf_dir):
    df = entries(spark, sf_dir)
    return rounded(event.apply_clip(df, event.clip_ranges(df, ["odds"], percentile=90.0), "odds", "odds_held"), KEY, ["odds_held"])
