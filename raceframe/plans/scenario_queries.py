"""Scenarios, catalogue and memos."""

from __future__ import annotations

from pyspark.sql import functions as F

from raceframe.functions import columns as C
from raceframe.operators import catalogue, memo, quality, scenario
from raceframe.operators.grouping import rank_in_group
from raceframe.plans.base import ENTRIES, entries, r6, table
from raceframe.plans.registry import query

KEY = ["event", "entity"]


def round_doubles(df):
    return df.select(*[r6(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# --- scenarios -------------------------------------------------------------------------------

_SCN = ENTRIES + """, sc AS (SELECT DISTINCT e.event, v.scenario, CASE v.scenario WHEN 'base' THEN 'M' WHEN 'a' THEN 'S' ELSE 'H' END AS pace, CASE v.scenario WHEN 'base' THEN 'フラット' WHEN 'a' THEN '内' ELSE '外' END AS bias, e.event % 4 AS em FROM entries e, (VALUES ('base'),('a'),('b')) v(scenario)),
b AS (SELECT e.event, e.entity, e.field_size, CAST((post-1) % 8 + 1 AS INTEGER) AS frame_no, sc.scenario, pace, bias, pow(p,0.9) AS base_win, least(pow(p,0.7),0.95) AS base_in3,
  scenario <> 'base' AND e.entity % 40 = em AS front, CASE e.entity % 6 WHEN 0 THEN '逃げ' WHEN 1 THEN '先行' WHEN 2 THEN '差し' WHEN 3 THEN '追込' END AS known,
  scenario <> 'base' AND e.entity % 12 = 4 AS stalk, scenario <> 'base' AND e.entity % 12 = 5 AS closer, scenario <> 'base' AND e.entity % 17 = 3 AS weak FROM entries e JOIN sc USING (event)),
l AS (SELECT *, CASE WHEN front THEN '逃げ' WHEN known IS NOT NULL THEN known WHEN stalk THEN '先行' WHEN closer THEN '差し' ELSE 'その他' END AS style, greatest(8, least(field_size,18)) AS x FROM b),
m AS (SELECT *, greatest(2, CAST(CASE WHEN x = 15 THEN 4 ELSE round(x*0.3) END AS INTEGER)) AS w FROM l),
n AS (SELECT *, CASE style WHEN '逃げ' THEN 'inside' WHEN '先行' THEN CASE WHEN frame_no <= w THEN 'inside' WHEN frame_no >= x-w+1 THEN 'middle' WHEN field_size >= 14 THEN 'middle' ELSE 'inside' END WHEN '差し' THEN CASE WHEN frame_no <= w THEN 'middle' WHEN frame_no >= x-w+1 THEN 'outside' ELSE 'middle' END
  WHEN '追込' THEN CASE WHEN frame_no <= w THEN 'middle' ELSE 'outside' END ELSE CASE WHEN frame_no <= w THEN 'inside' WHEN frame_no >= x-w+1 THEN 'outside' ELSE 'middle' END END AS lane, 0.4::DOUBLE + 0.6::DOUBLE*(x-8)/10 AS sc,
  CASE pace WHEN 'S' THEN CASE style WHEN '逃げ' THEN 1.2 WHEN '先行' THEN 1.1 WHEN '差し' THEN 0.95 WHEN '追込' THEN 0.85 ELSE 1 END WHEN 'H' THEN CASE style WHEN '逃げ' THEN 0.8 WHEN '先行' THEN 0.9 WHEN '差し' THEN 1.1 WHEN '追込' THEN 1.2 ELSE 1 END ELSE 1 END::DOUBLE AS pw,
  CASE pace WHEN 'S' THEN CASE style WHEN '逃げ' THEN 1.1 WHEN '先行' THEN 1.05 WHEN '差し' THEN 0.98 WHEN '追込' THEN 0.92 ELSE 1 END WHEN 'H' THEN CASE style WHEN '逃げ' THEN 0.9 WHEN '先行' THEN 0.95 WHEN '差し' THEN 1.05 WHEN '追込' THEN 1.12 ELSE 1 END ELSE 1 END::DOUBLE AS pi FROM m),
o AS (SELECT *, (bias='内' AND lane='inside') OR (bias='外' AND lane='outside') AS g, (bias='内' AND lane='outside') OR (bias='外' AND lane='inside') AS d FROM n),
q AS (SELECT *, base_win * pw * CASE WHEN front THEN CASE pace WHEN 'S' THEN 1.05 WHEN 'M' THEN 1.03 ELSE 0.95 END ELSE 1 END * CASE WHEN g THEN 0.05*sc+1 WHEN d THEN -0.03*sc+1 ELSE 1 END * CASE WHEN weak THEN 0.85 ELSE 1 END AS aw,
  base_in3 * pi * CASE WHEN front THEN CASE pace WHEN 'S' THEN 1.03 WHEN 'M' THEN 1.02 ELSE 0.97 END ELSE 1 END * CASE WHEN g THEN 0.03*sc+1 WHEN d THEN -0.02*sc+1 ELSE 1 END * CASE WHEN weak THEN 0.90 ELSE 1 END AS ai FROM o),
adj AS (SELECT *, aw / sum(aw) OVER v AS adj_win, CASE WHEN sum(ai) OVER v > 3 THEN ai * 3 / sum(ai) OVER v ELSE ai END AS adj_in3,
 concat_ws('|', CASE style WHEN '逃げ' THEN 'FRONT_RUNNER' WHEN '先行' THEN 'STALKER' WHEN '差し' THEN 'CLOSER' WHEN '追込' THEN 'CLOSER' END,
  CASE WHEN front OR (known IS NULL AND (stalk OR closer)) THEN CASE style WHEN '逃げ' THEN 'SCENARIO_FRONT_RUNNER' WHEN '先行' THEN 'SCENARIO_STALKER' ELSE 'SCENARIO_CLOSER' END END,
  CASE WHEN pw > 1 OR pi > 1 THEN 'PACE_ADVANTAGE' WHEN pw < 1 OR pi < 1 THEN 'PACE_DISADVANTAGE' END, CASE WHEN g THEN 'BIAS_ADVANTAGE' WHEN d THEN 'BIAS_DISADVANTAGE' END, CASE WHEN weak THEN 'MARKED_WEAK' END) AS reasons FROM q WINDOW v AS (PARTITION BY event, scenario))
"""


def _scenarios(df):
    """Three scenarios per event."""
    s = F.col("scenario")
    rows = df.select("event").distinct().withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("a"), F.lit("b"))))
    return rows.select(
        "event", "scenario", F.when(s == "base", "M").when(s == "a", "S").otherwise("H").alias("pace"),
        F.when(s == "base", "フラット").when(s == "a", "内").otherwise("外").alias("bias"),
    )


def _roles(df, scenarios, tests):
    """Role rows of the entries that pass each test, in the given scenarios."""
    names = F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))).alias("role")
    return df.select(*KEY, names).withColumn("scenario", F.explode(F.array(*[F.lit(x) for x in scenarios])))


def _adjusted(spark, sf_dir):
    df = entries(spark, sf_dir)
    e = F.col("entity")
    tests = {"front": e % 40 == F.col("event") % 4, "stalker": e % 12 == 4, "closer": e % 12 == 5, "weak": e % 17 == 3}
    style = F.when(e % 6 == 0, "逃げ").when(e % 6 == 1, "SENKO").when(e % 6 == 2, " 差し").when(e % 6 == 3, "oikomi")
    base = df.select(
        *KEY, "field_size", ((F.col("post") - 1) % 8 + 1).cast("int").alias("frame_no"), style.alias("run_style"),
        F.pow("p", F.lit(0.9)).alias("base_win"), F.least(F.pow("p", F.lit(0.7)), F.lit(0.95)).alias("base_in3"),
    )
    return scenario.scenario_adjust(base, _scenarios(df), _roles(df, ["a", "b"], tests))


@query("scenario_adjust", "C1", _SCN + "SELECT event, scenario, entity, style AS run_style_label, lane, round(adj_win,6) AS adj_win, round(adj_in3,6) AS adj_in3, reasons FROM adj")
def scenario_adjust(spark, sf_dir):
    out = _adjusted(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "|"))
    return round_doubles(out.select("event", "scenario", "entity", "run_style_label", "lane", "adj_win", "adj_in3", "reasons"))


_CMP = _SCN + """, cmp AS (SELECT event, entity, max(base_win) FILTER (WHERE scenario='base') AS base_win, max(base_in3) FILTER (WHERE scenario='base') AS base_in3, max(adj_win) FILTER (WHERE scenario='a') AS a_win, max(adj_in3) FILTER (WHERE scenario='a') AS a_in3,
 max(adj_win) FILTER (WHERE scenario='b') AS b_win, max(adj_in3) FILTER (WHERE scenario='b') AS b_in3 FROM adj GROUP BY 1,2) """


@query("scenario_compare", "C5 J12 U3", _CMP + "SELECT event, entity, round(a_win-base_win,6) AS delta_a, round(b_win-base_win,6) AS delta_b, round(a_win-b_win,6) AS delta_ab, round(a_in3-base_in3,6) AS delta_in3_a, round(b_in3-base_in3,6) AS delta_in3_b, round((a_win-base_win)/base_win*100,6) AS delta_a_pct, round((b_win-base_win)/base_win*100,6) AS delta_b_pct FROM cmp")
def scenario_compare(spark, sf_dir):
    out = scenario.compare(_adjusted(spark, sf_dir), "base", "a", "b")
    return round_doubles(out.select(*KEY, "delta_a", "delta_b", "delta_ab", "delta_in3_a", "delta_in3_b", "delta_a_pct", "delta_b_pct"))


@query("scenario_movers", "C5 T4", _CMP + ", r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY round(a_win-base_win,9) DESC, entity) AS position FROM cmp WHERE round(a_win-base_win,9) > 0) SELECT event, entity, CAST(position AS INTEGER) AS position FROM r WHERE position <= 2")
def scenario_movers(spark, sf_dir):
    out = scenario.compare(_adjusted(spark, sf_dir), "base", "a", "b")
    return scenario.top_movers(out, "delta_a", 2).select(*KEY, "position")


@query("scenario_summaries", "C6",
       _SCN + """, z AS (SELECT event, scenario, entity, round(adj_win,9) AS adj_win, round(adj_in3,9) AS adj_in3, round(adj_win-base_win,9) AS wd, round(adj_in3-base_in3,9) AS id FROM adj),
k AS (SELECT event, scenario, 'top' AS kind, row_number() OVER (PARTITION BY event, scenario ORDER BY adj_win DESC, entity) AS position, entity, 5 AS n FROM z
 UNION ALL SELECT event, scenario, 'boosted', row_number() OVER (PARTITION BY event, scenario ORDER BY wd DESC, entity), entity, 5 FROM z WHERE wd > 0.001 OR id > 0.001
 UNION ALL SELECT event, scenario, 'dropped', row_number() OVER (PARTITION BY event, scenario ORDER BY wd, entity), entity, 5 FROM z WHERE wd < -0.001 OR id < -0.001
 UNION ALL SELECT event, scenario, 'solid_placer', row_number() OVER (PARTITION BY event, scenario ORDER BY adj_in3 DESC, entity), entity, 3 FROM z WHERE adj_in3 > 0.3 AND adj_win < 0.1)
SELECT event, scenario, kind, CAST(position AS INTEGER) AS position, entity FROM k WHERE position <= n""")
def scenario_summaries(spark, sf_dir):
    out = scenario.summaries(_adjusted(spark, sf_dir))
    return out.select("event", "scenario", "kind", "position", "entity")


_BIAS = ENTRIES + """, sc AS (SELECT e.event, v.scenario, CASE v.scenario WHEN 'slow' THEN 'S' ELSE 'H' END AS pace, CASE e.event % 4 WHEN 0 THEN '良' WHEN 1 THEN '稍重' WHEN 2 THEN '重' ELSE '不良' END AS track, CASE v.scenario WHEN 'slow' THEN 'inner' ELSE 'outer' END AS lb, CASE v.scenario WHEN 'slow' THEN 'front' ELSE 'closer' END AS sb FROM (SELECT DISTINCT event FROM entries) e, (VALUES ('slow'),('fast')) v(scenario)),
b AS (SELECT e.*, sc.*exclude(event), CAST(e.post AS INTEGER) AS no, row_number() OVER (PARTITION BY e.event, scenario ORDER BY p DESC, post) AS rk, CASE WHEN e.entity % 5 = 0 THEN '追込' WHEN e.entity % 30 = 7 THEN '逃げ' WHEN e.post <= 4 THEN '先行' WHEN e.post <= 10 THEN '差し' ELSE '追込' END AS style FROM entries e JOIN sc USING (event)),
l AS (SELECT *, CASE WHEN field_size <= 8 THEN 2 ELSE greatest(2, CAST(floor(field_size*0.25) AS INTEGER)) END AS q FROM b),
m AS (SELECT *, CASE WHEN no <= q THEN CASE WHEN style IN ('差し','追込') THEN 'middle_lane' ELSE 'inner_lane' END WHEN no >= CASE WHEN field_size <= 8 THEN 7 ELSE field_size - q + 1 END THEN CASE WHEN style IN ('逃げ','先行') THEN 'middle_lane' ELSE 'outer_lane' END ELSE 'middle_lane' END AS lane FROM l),
f AS (SELECT *, CASE pace WHEN 'S' THEN CASE style WHEN '逃げ' THEN 1.2 WHEN '先行' THEN 1.12 WHEN '差し' THEN 0.92 ELSE 0.82 END ELSE CASE style WHEN '逃げ' THEN 0.8 WHEN '先行' THEN 0.9 WHEN '差し' THEN 1.12 ELSE 1.22 END END::DOUBLE AS pw,
 CASE pace WHEN 'S' THEN CASE style WHEN '逃げ' THEN 1.12 WHEN '先行' THEN 1.08 WHEN '差し' THEN 0.95 ELSE 0.88 END ELSE CASE style WHEN '逃げ' THEN 0.88 WHEN '先行' THEN 0.94 WHEN '差し' THEN 1.08 ELSE 1.14 END END::DOUBLE AS pi,
 CASE track WHEN '良' THEN 1.0 WHEN '稍重' THEN 0.99 WHEN '重' THEN 0.97 ELSE 0.94 END::DOUBLE AS g,
 CASE lb||lane WHEN 'innerinner_lane' THEN 1.06 WHEN 'innerouter_lane' THEN 0.96 WHEN 'outerinner_lane' THEN 0.96 WHEN 'outerouter_lane' THEN 1.06 ELSE 1 END::DOUBLE AS lw, CASE lb||lane WHEN 'innerinner_lane' THEN 1.04 WHEN 'innerouter_lane' THEN 0.97 WHEN 'outerinner_lane' THEN 0.97 WHEN 'outerouter_lane' THEN 1.04 ELSE 1 END::DOUBLE AS li,
 CASE sb WHEN 'front' THEN CASE style WHEN '逃げ' THEN 1.1 WHEN '先行' THEN 1.06 WHEN '差し' THEN 0.95 ELSE 0.9 END ELSE CASE style WHEN '逃げ' THEN 0.9 WHEN '先行' THEN 0.95 WHEN '差し' THEN 1.06 ELSE 1.1 END END::DOUBLE AS sw,
 CASE sb WHEN 'front' THEN CASE style WHEN '逃げ' THEN 1.06 WHEN '先行' THEN 1.04 WHEN '差し' THEN 0.97 ELSE 0.94 END ELSE CASE style WHEN '逃げ' THEN 0.94 WHEN '先行' THEN 0.97 WHEN '差し' THEN 1.04 ELSE 1.06 END END::DOUBLE AS si FROM m),
a AS (SELECT *, round(pow(p,0.9)*pw*g*lw*sw,6) AS aw, round(least(pow(p,0.7),0.95)*pi*g*li*si,6) AS ai FROM f),
n AS (SELECT *, round(aw/sum(aw) OVER v,4) AS adj_win, CASE WHEN sum(ai) OVER v > 3 THEN round(ai*(3/sum(ai) OVER v),4) ELSE ai END AS adj_in3 FROM a WINDOW v AS (PARTITION BY event, scenario))
"""


def _bias(spark, sf_dir):
    df = entries(spark, sf_dir)
    e = F.col("entity")
    base = rank_in_group(df, ["event"], "p", "rank_win", descending=True, ties=["post"], size="field_size")
    base = base.select(
        *KEY, "field_size", F.col("post").cast("int").alias("umaban"), F.when(e % 5 == 0, "追込").alias("run_style"), F.pow("p", F.lit(0.9)).alias("p_win"),
        F.least(F.pow("p", F.lit(0.7)), F.lit(0.95)).alias("p_in3"), "rank_win", F.col("rank_win").alias("rank_in3"),
    )
    roles = _roles(df, ["slow", "fast"], {"front": (e % 30 == 7) & (e % 5 != 0)})
    rows = df.select("event").distinct().withColumn("scenario", F.explode(F.array(F.lit("slow"), F.lit("fast"))))
    m = F.col("event") % 4
    slow = F.col("scenario") == "slow"
    scn = rows.select(
        "event", "scenario", F.when(slow, "S").otherwise("H").alias("pace"),
        F.when(m == 0, "良").when(m == 1, "稍重").when(m == 2, "重").otherwise("不良").alias("track_condition"),
        F.when(slow, "inner").otherwise("outer").alias("lane_bias"), F.when(slow, "front").otherwise("closer").alias("style_bias"),
    )
    return scenario.bias_adjust(base, scn, roles)


@query("bias_adjust", "C2", _BIAS + "SELECT event, scenario, entity, style AS run_style, lane, adj_win, adj_in3, row_number() OVER (PARTITION BY event, scenario ORDER BY adj_win DESC, no) AS adj_rank_win, rk - row_number() OVER (PARTITION BY event, scenario ORDER BY adj_win DESC, no) AS rank_change_win FROM n")
def bias_adjust(spark, sf_dir):
    return _bias(spark, sf_dir).select("event", "scenario", "entity", "run_style", "lane", "adj_win", "adj_in3", "adj_rank_win", "rank_change_win")


@query("bias_reasons", "C2", _BIAS + """SELECT event, scenario, entity, concat_ws('|', CASE WHEN pw > 1 THEN 'pace_up' WHEN pw < 1 THEN 'pace_down' END, CASE WHEN sw > 1 THEN 'style_bias_up' WHEN sw < 1 THEN 'style_bias_down' END, CASE WHEN lw > 1 THEN 'lane_bias_up' WHEN lw < 1 THEN 'lane_bias_down' END, CASE WHEN g < 1 THEN 'track_condition_down' END) AS reasons FROM n""")
def bias_reasons(spark, sf_dir):
    out = _bias(spark, sf_dir)
    slow = F.col("scenario") == "slow"
    m = F.col("event") % 4
    going = F.when(m == 0, "良").when(m == 1, "稍重").when(m == 2, "重").otherwise("不良")
    reasons = scenario.bias_reasons(F.when(slow, "S").otherwise("H"), F.col("run_style"), F.col("lane"), F.when(slow, "inner").otherwise("outer"), F.when(slow, "front").otherwise("closer"), going)
    return out.select("event", "scenario", "entity", F.array_join(reasons, "|").alias("reasons"))


@query("pace_shift", "C3",
       ENTRIES + """, x AS (SELECT event, entity, greatest(least(p,1-1e-6),1e-6) AS q, CASE entity % 5 WHEN 0 THEN -1.0 WHEN 1 THEN -0.5 WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 ELSE 0 END::DOUBLE AS c, CAST(event % 13 - 6 AS DOUBLE) AS bal FROM entries),
o AS (SELECT event, entity, exp(ln(q/(1-q)) + greatest(-1.5, least(1.5, 0.7*c*tanh(bal/3)))) AS o FROM x) SELECT event, entity, round(o/sum(o) OVER (PARTITION BY event),6) AS p_pace FROM o""")
def pace_shift(spark, sf_dir):
    e = F.col("entity") % 5
    df = entries(spark, sf_dir).withColumns({"style": F.when(e == 0, "逃げ").when(e == 1, "先行").when(e == 2, "差し").when(e == 3, "追込"), "bal": (F.col("event") % 13 - 6).cast("double")})
    return round_doubles(scenario.pace_shift(df, "p", "style", "bal", "p_pace", "field_size").select(*KEY, "p_pace"))


_INT = ENTRIES + ", x AS (SELECT event, entity, ln(greatest(least(p,0.999),0.001)/(1-greatest(least(p,0.999),0.001))) + (tax-4)/10::DOUBLE + (qty-25)/100::DOUBLE AS z FROM entries), s AS (SELECT event, entity, z, exp(z)/sum(exp(z)) OVER (PARTITION BY event) AS np FROM x) "


def _integrated(spark, sf_dir):
    df = entries(spark, sf_dir).withColumns({"dg": (F.col("tax") - 4) / 10, "dp": (F.col("qty") - 25) / 100})
    return scenario.integrate(df.select(*KEY, "field_size", "p", "dg", "dp"), "p", "dg", "dp", "field_size")


@query("integrated_probability", "C4", _INT + "SELECT event, entity, round(np,6) AS normalized_prob FROM s")
def integrated_probability(spark, sf_dir):
    return round_doubles(_integrated(spark, sf_dir).select(*KEY, "normalized_prob"))


_CHECK = "SELECT '{name}' AS probability, bool_and({p} >= 0) AS all_positive, bool_and({p} <= 1) AS all_below_one, count(DISTINCT CASE WHEN abs(t - 1) > 1e-5 THEN event END) = 0 AS sums_to_one, count(DISTINCT CASE WHEN abs(t - 1) > 1e-5 THEN event END) AS n_off FROM (SELECT event, {p}, sum({p}) OVER (PARTITION BY event) AS t FROM s)"


@query("probability_check", "C4", _INT + _CHECK.format(name="integrated", p="np") + " UNION ALL " + _CHECK.format(name="odds", p="q").replace("FROM s)", "FROM (SELECT event, 1 / odds AS q FROM entries))"))
def probability_check(spark, sf_dir):
    """The integrated probabilities, which must hold, and the plain inverse odds, which do not sum to one."""
    right = scenario.validate(_integrated(spark, sf_dir), "normalized_prob").withColumn("probability", F.lit("integrated"))
    odds = entries(spark, sf_dir).select("event", (1 / F.col("odds")).alias("q"))
    return right.unionByName(scenario.validate(odds, "q").withColumn("probability", F.lit("odds"))).select("probability", "all_positive", "all_below_one", "sums_to_one", "n_off")


@query("weight_flags", "P24", ENTRIES + "SELECT event, entity, coalesce(weight/100.0 > 4.0,FALSE) AS is_weight_volatile, coalesce(tax-4 > 2,FALSE) AS is_gaining_weight, coalesce(tax-4 < -2,FALSE) AS is_losing_weight, round(coalesce((weight+CASE WHEN tax>2 THEN qty END)/2, weight, CASE WHEN tax>2 THEN qty END),6) AS mean FROM entries")
def weight_flags(spark, sf_dir):
    w = F.col("weight")
    flags = C.weight_flags(w / 100.0, F.col("tax") - 4)
    second = F.when(F.col("tax") > 2, F.col("qty"))
    return round_doubles(entries(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in flags.items()], C.mean_of_two(w.cast("double"), second).alias("mean")))


# --- catalogue ---------------------------------------------------------------------------------------

_PRE = ["h_", "j_", "t_", "market_", "odds_", "target_", "post_", "ax1_", "pace_", "ped_hash_", "track_condition_", "v4_bridge_market_"]
_SUF = ["_id", "_weight_diff", "", "", ""]
_CAT = """WITH raw AS (SELECT CASE WHEN p_partkey % 61 = 0 THEN 'win_odds' WHEN p_partkey % 67 = 0 THEN 'v4_bridge_body_weight' WHEN p_partkey % 71 = 0 THEN 'distance' ELSE ([""" + ",".join(f"'{p}'" for p in _PRE) + """])[p_partkey % 12 + 1] || lower(p_type) || '_' || CAST(p_size AS VARCHAR) || ([""" + ",".join(f"'{s}'" for s in _SUF) + """])[p_partkey % 5 + 1] END AS feature, p_retailprice AS price, p_size AS size, p_partkey AS k FROM part),
cat AS (SELECT 'v3' AS version, feature, CAST(sum(CAST(round(price*100) AS BIGINT)) AS DOUBLE) AS gain, CAST(sum(size) AS BIGINT) AS split FROM raw WHERE k % 3 <> 0 GROUP BY 2 UNION ALL SELECT 'v4', feature, CAST(sum(CAST(round(price*100) AS BIGINT) + size) AS DOUBLE), CAST(sum(size) AS BIGINT) FROM raw WHERE k % 3 <> 1 GROUP BY 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY gain DESC, feature) AS rank, gain / max(gain) OVER (PARTITION BY version) AS gain_norm, (sum(gain) OVER (PARTITION BY version ORDER BY gain DESC RANGE UNBOUNDED PRECEDING) - (count(*) OVER (PARTITION BY version, gain) - 1) * gain) / sum(gain) OVER (PARTITION BY version) AS cumulative FROM cat),
nm AS (SELECT DISTINCT feature, CASE WHEN starts_with(feature,'v4_bridge_') THEN substr(feature,11) ELSE feature END AS own, starts_with(feature,'v4_bridge_') AS br FROM cat),
sf AS (SELECT feature, own, br, CASE WHEN own IN ('win_odds','body_weight') THEN 'unsafe' WHEN regexp_matches(own,'^market_|^h_body_weight|^odds_|_weight_diff$|^paid_') THEN 'unsafe' WHEN regexp_matches(own,'result|finish|payout|after|post|outcome|target_|^y_|^track_condition|^baba_|_id$') THEN 'warn' ELSE 'safe' END AS label,
 CASE WHEN own = 'win_odds' THEN 'market information (odds/popularity)' WHEN own = 'body_weight' THEN 'race-day body weight information' WHEN starts_with(own,'market_') THEN 'market information (odds/popularity)' WHEN starts_with(own,'odds_') THEN 'odds information' WHEN regexp_matches(own,'_weight_diff$') THEN 'weight difference (race-day info)'
  WHEN contains(own,'post') THEN 'contains ''post''' WHEN contains(own,'target_') THEN 'contains ''target_'' (label column)' WHEN starts_with(own,'track_condition') THEN 'track condition (handled by scenario layer)' WHEN regexp_matches(own,'_id$') THEN 'ID column (should not be feature)' ELSE '' END AS why0 FROM nm),
safe AS (SELECT *, CASE WHEN br THEN trim('[bridged from v3] ' || why0) ELSE why0 END AS notes FROM sf)
"""


def features(spark, sf_dir):
    """Feature names and gains of two versions, derived from the part table."""
    k = F.col("p_partkey")
    name = F.concat(
        F.element_at(F.array(*[F.lit(p) for p in _PRE]), (k % 12 + 1).cast("int")), F.lower("p_type"), F.lit("_"), F.col("p_size").cast("string"),
        F.element_at(F.array(*[F.lit(s) for s in _SUF]), (k % 5 + 1).cast("int")),
    )
    name = F.when(k % 61 == 0, "win_odds").when(k % 67 == 0, "v4_bridge_body_weight").when(k % 71 == 0, "distance").otherwise(name)
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    both = F.array_compact(F.array(
        F.when(k % 3 != 0, F.struct(F.lit("v3").alias("version"), cents.alias("g"))), F.when(k % 3 != 1, F.struct(F.lit("v4").alias("version"), (cents + F.col("p_size")).alias("g")))))
    rows = table(spark, sf_dir, "part").select(name.alias("feature"), "p_size", F.explode(both).alias("v"))
    return rows.groupBy("v.version", "feature").agg(F.sum("v.g").cast("double").alias("gain"), F.sum("p_size").alias("split"))


@query("feature_safety", "P21 P23", _CAT + """SELECT feature, label AS safety_label, notes AS safety_notes, CASE WHEN starts_with(feature,'distance') THEN 'base_race' WHEN starts_with(feature,'h_') THEN 'horse_form' WHEN starts_with(feature,'pace_') THEN 'pace_position' WHEN starts_with(feature,'j_') OR starts_with(feature,'t_') THEN 'jockey_trainer' WHEN starts_with(feature,'ped_hash_') THEN 'pedigree' WHEN starts_with(feature,'market_') THEN 'market' ELSE 'other' END AS feature_group, CASE WHEN contains(feature,'_') THEN split_part(feature,'_',1) || '_' ELSE 'other' END AS "group" FROM safe""")
def feature_safety(spark, sf_dir):
    names = features(spark, sf_dir).select("feature").distinct()
    return catalogue.with_safety(names).withColumns({"feature_group": C.feature_group("feature"), "group": C.prefix_group("feature")})


@query("availability_levels", "P22 E13", "WITH x AS (SELECT DISTINCT ([ 'odds','weather_' ,'weather','horse_weight','finish_time','prize_money_','h_'])[p_partkey % 7 + 1] || CASE WHEN p_partkey % 7 IN (1,5,6) THEN lower(p_type) ELSE '' END AS name FROM part), l AS (SELECT name, CASE WHEN name = 'finish_time' OR name LIKE '%prize%money%' THEN 'result' WHEN name = 'odds' THEN 'just_before' WHEN name = 'horse_weight' THEN 'paddock' WHEN name LIKE '%weather' THEN 'morning' ELSE 'pre_race' END AS level FROM x) SELECT name, level, level = 'result' AS fatal FROM l WHERE level IN ('paddock','just_before','result')")
def availability_levels(spark, sf_dir):
    heads = F.array(*[F.lit(x) for x in ("odds", "weather_", "weather", "horse_weight", "finish_time", "prize_money_", "h_")])
    k = F.col("p_partkey") % 7
    name = F.concat(F.element_at(heads, (k + 1).cast("int")), F.when(k.isin(1, 5, 6), F.lower("p_type")).otherwise(""))
    names = table(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return quality.level_violations(names, "name", "morning")


@query("version_compare", "F1 W28", _CAT + """SELECT feature, label AS safety_label, notes AS safety_notes, CASE WHEN contains(feature,'_') THEN split_part(feature,'_',1) || '_' ELSE 'other' END AS "group", """ + ", ".join(
    f"max(rank) FILTER (WHERE version='{v}') AS {v}_rank, max(gain) FILTER (WHERE version='{v}') AS {v}_gain, round(max(gain_norm) FILTER (WHERE version='{v}'),6) AS {v}_gain_norm, round(max(cumulative) FILTER (WHERE version='{v}'),6) AS {v}_cumulative, count(*) FILTER (WHERE version='{v}') > 0 AS {v}_present" for v in ("v3", "v4")) + " FROM rk JOIN safe USING (feature) GROUP BY 1,2,3,4")
def version_compare(spark, sf_dir):
    return round_doubles(catalogue.compare_versions(features(spark, sf_dir), ["v3", "v4"]))


@query("top_features", "F2 T4", _CAT + "SELECT version, feature, rank, gain FROM rk WHERE rank <= 30")
def top_features(spark, sf_dir):
    return catalogue.top_features(features(spark, sf_dir), 30)


@query("common_top_features", "F2 U3", _CAT + "SELECT feature, count(*) AS n_versions, round(avg(rank),6) AS avg_rank, sum(gain) AS total_gain FROM rk WHERE rank <= 60 GROUP BY 1 HAVING count(*) >= 2")
def common_top_features(spark, sf_dir):
    return round_doubles(catalogue.common_top(features(spark, sf_dir), 60))


@query("feature_names", "U2", _CAT + "SELECT feature FROM cat WHERE version='v3' UNION SELECT feature FROM cat WHERE version='v4'")
def feature_names(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.filter("version = 'v3'").select("feature").union(f.filter("version = 'v4'").select("feature")).distinct()


@query("version_diff", "F3 U4", _CAT + """, d AS (SELECT coalesce(a.feature,b.feature) AS feature, a.gain AS new_gain, a.rank AS new_rank, b.gain AS old_gain, b.rank AS old_rank FROM (SELECT * FROM rk WHERE version='v4') a FULL JOIN (SELECT * FROM rk WHERE version='v3') b ON a.feature=b.feature)
SELECT d.*, CASE WHEN old_rank IS NULL THEN 'new' WHEN new_rank IS NULL THEN 'removed' ELSE 'changed' END AS change_type, coalesce(new_gain,0)-coalesce(old_gain,0) AS gain_diff, old_rank-new_rank AS rank_diff, label AS safety_label, notes AS safety_notes FROM d JOIN safe USING (feature)
WHERE old_rank IS NULL OR new_rank IS NULL OR abs(new_gain-old_gain) >= 20000 OR abs(old_rank-new_rank) >= 5""")
def version_diff(spark, sf_dir):
    return catalogue.version_diff(features(spark, sf_dir), "v4", "v3", min_gain=20000)


@query("safety_summary", "F4", _CAT + """, j AS (SELECT * FROM rk JOIN safe USING (feature)), w AS (SELECT version, label, feature || ' (rank=' || CAST(rank AS VARCHAR) || ')' AS t, rank, row_number() OVER (PARTITION BY version, label ORDER BY rank) AS i FROM j WHERE rank <= 50)
SELECT version, count(*) AS n_features, count(*) FILTER (WHERE label='unsafe') AS n_unsafe, count(*) FILTER (WHERE label='warn') AS n_warn, count(*) FILTER (WHERE label='safe') AS n_safe, round(count(*) FILTER (WHERE label='unsafe')/count(*)*100,6) AS unsafe_pct, round(count(*) FILTER (WHERE label='warn')/count(*)*100,6) AS warn_pct,
 count(*) FILTER (WHERE label='unsafe' AND rank<=50) AS unsafe_in_top_n, count(*) FILTER (WHERE label='warn' AND rank<=50) AS warn_in_top_n, (SELECT coalesce(string_agg(t,'; ' ORDER BY rank),'') FROM w WHERE w.version=j.version AND label='unsafe' AND i<=5) AS unsafe_features_in_top, (SELECT coalesce(string_agg(t,'; ' ORDER BY rank),'') FROM w WHERE w.version=j.version AND label='warn' AND i<=5) AS warn_features_in_top FROM j GROUP BY version""")
def safety_summary(spark, sf_dir):
    return round_doubles(catalogue.safety_summary(features(spark, sf_dir), 50))


_MIG = _CAT + """, mig AS (SELECT feature, gain, rank, label AS safety_label, notes AS safety_notes, CASE WHEN contains(feature,'_') THEN split_part(feature,'_',1) || '_' ELSE 'other' END AS reason_tag, CASE label WHEN 'unsafe' THEN 'skip' WHEN 'warn' THEN 'needs_review' ELSE 'port' END AS suggested_action, CASE label WHEN 'safe' THEN '' ELSE label || ': ' || notes END AS blocked_reason
 FROM rk JOIN safe USING (feature) WHERE version='v3' AND rank <= 200 AND feature NOT IN (SELECT feature FROM cat WHERE version='v4')) """


@query("migration_candidates", "F5", _MIG + "SELECT * FROM mig")
def migration_candidates(spark, sf_dir):
    return catalogue.migration_candidates(features(spark, sf_dir), "v3", "v4", 200)


@query("bridge_candidates", "F5", _MIG + "SELECT feature, rank, safety_label FROM mig WHERE safety_label <> 'unsafe' ORDER BY rank, feature LIMIT 20")
def bridge_candidates(spark, sf_dir):
    out = catalogue.bridge_features(catalogue.migration_candidates(features(spark, sf_dir), "v3", "v4", 200), 20)
    return out.select("feature", "rank", "safety_label")


@query("feature_explanations", "F6", _CAT + "SELECT version, feature, own AS display_name, CASE WHEN br THEN 'v3_bridged' ELSE 'v4_native' END AS origin, label AS safety_label, gain, row_number() OVER (PARTITION BY version ORDER BY gain DESC, feature) AS position, CASE own WHEN 'distance' THEN 'race distance' WHEN 'body_weight' THEN 'body weight' END AS description FROM cat JOIN safe USING (feature) WHERE label <> 'warn'")
def feature_explanations(spark, sf_dir):
    words = spark.createDataFrame([("distance", "race distance"), ("body_weight", "body weight")], "display_name string, description string")
    out = catalogue.explain_features(features(spark, sf_dir), words, exclude_warn=True)
    return out.select("version", "feature", "display_name", "origin", "safety_label", "gain", "position", "description")


_GRP = "CASE WHEN starts_with(feature,'distance') THEN 'base_race' WHEN starts_with(feature,'h_') THEN 'horse_form' WHEN starts_with(feature,'pace_') THEN 'pace_position' WHEN starts_with(feature,'j_') OR starts_with(feature,'t_') THEN 'jockey_trainer' WHEN starts_with(feature,'ped_hash_') THEN 'pedigree' WHEN starts_with(feature,'market_') THEN 'market' ELSE 'other' END"


@query("group_importance", "A17", _CAT + ", g AS (SELECT *, " + _GRP + " AS group_name FROM cat), h AS (SELECT *, row_number() OVER (PARTITION BY version, group_name ORDER BY gain DESC, feature) AS i FROM g) SELECT version, group_name, count(*) AS n_features, sum(gain) AS total_gain, round(avg(gain),6) AS mean_gain, max(gain) AS max_gain, CAST(sum(split) AS BIGINT) AS total_split, string_agg(feature, ',' ORDER BY i) FILTER (WHERE i <= 3) AS top_features FROM h GROUP BY 1,2")
def group_importance(spark, sf_dir):
    return round_doubles(catalogue.group_importance(features(spark, sf_dir)))


@query("prefix_importance", "A17 P23", _CAT + "SELECT version, CASE WHEN contains(feature,'_') THEN split_part(feature,'_',1) || '_' ELSE 'other' END AS \"group\", count(*) AS n, sum(gain) AS gain, round(sum(gain)/sum(sum(gain)) OVER (PARTITION BY version),6) AS share FROM cat GROUP BY 1,2")
def prefix_importance(spark, sf_dir):
    return round_doubles(catalogue.prefix_importance(features(spark, sf_dir)))


# --- memos ------------------------------------------------------------------------------------------

RULES = [
    memo.Rule("lane_bias", "inner", "the an", "inner lane"), memo.Rule("lane_bias", "outer", "thathe", "outer lane"), memo.Rule("lane_bias", "outer", "and th", "outer lane"),
    memo.Rule("pace", "S", "esth", "slow"), memo.Rule("pace", "H", "ention", "high"), memo.Rule("pace", "H", "ie la", "high"),
    memo.Rule("track_condition", "重", "wher", "heavy"), memo.Rule("tag", "quick", "ing th", "quick", False), memo.Rule("tag", "late", "ou ", "late", False),
    memo.Rule("pedigree", "ana", "ana", "pedigree ana", reason="seen", needs_feature=True), memo.Rule("frame_hint", "inner", "er th", "frame", False, is_warning=True, warning="only a hint"),
]
WORDS = memo.Wording(after=["ere", "on"], before=["ti", "no"], doubt=["qu"], intensity={1.5: ["en "], 0.5: ["s ", "e"]})
PAIRS = [("lane_bias.inner", "lane_bias.outer", "lane"), ("pace.S", "pace.H", "pace")]


def _q(s):
    return "'" + s.replace("'", "''") + "'"


_RULE_ROWS = ", ".join(f"({i},{_q(r.category)},{_q(r.value)},{_q(r.keyword)},{_q(r.label)},{'TRUE' if r.every else 'FALSE'})" for i, r in enumerate(RULES))
_MEMO = f"""WITH d AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(12288)) AS t FROM documents), r(rule,category,value,keyword,label,every) AS (VALUES {_RULE_ROWS}),
h AS (SELECT doc_id, t, r.*, string_split(t, keyword) AS parts FROM d, r WHERE contains(t, keyword)),
i AS (SELECT doc_id, t, rule, category, value, keyword, label, every, parts, unnest(range(1, CASE WHEN every THEN len(parts) ELSE 2 END)) AS k FROM h),
p AS (SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k-1)*length(keyword) AS INTEGER) AS position FROM i),
c AS (SELECT *, substring(t, greatest(position-5,0)+1, position-greatest(position-5,0)) AS before, substring(t, position+length(keyword)+1, 8) AS after FROM p),
m AS (SELECT doc_id, rule, category, value, keyword, label, position,
  starts_with(substring(after,1,6),'ere') OR contains(substring(after,1,5),'ere') OR starts_with(substring(after,1,6),'on') OR contains(substring(after,1,5),'on') OR suffix(before,'ti') OR suffix(before,'no') OR contains(after,'qu') AS is_negated,
  CASE WHEN NOT every THEN 1.0::DOUBLE WHEN suffix(before,'en ') THEN 1.5::DOUBLE WHEN suffix(before,'s ') OR suffix(before,'e') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS intensity FROM c)
"""


def _found(spark, sf_dir):
    return memo.matches(table(spark, sf_dir, "documents"), "doc_id", "text", RULES, WORDS)


@query("memo_matches", "X1 X2", _MEMO + "SELECT doc_id, category, value, keyword, position, is_negated, intensity FROM m")
def memo_matches(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "category", "value", "keyword", "position", "is_negated", "intensity")


_SCORE = _MEMO + ", s AS (SELECT doc_id, category, value, sum(CASE WHEN is_negated THEN -intensity ELSE intensity END) AS score, min(rule) AS fr FROM m GROUP BY 1,2,3) "


@query("memo_scores", "X3", _SCORE + "SELECT doc_id, category, value, score FROM s")
def memo_scores(spark, sf_dir):
    return memo.scores(_found(spark, sf_dir), "doc_id").drop("first_rule")


@query("memo_suggestions", "X3", _SCORE + "SELECT doc_id, category, value, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY score DESC, fr) AS k FROM s) WHERE k = 1 AND score > 0")
def memo_suggestions(spark, sf_dir):
    return memo.suggestions(_found(spark, sf_dir), "doc_id")


_CONF = _MEMO + """, g AS (SELECT doc_id, list(DISTINCT category || '.' || value) AS ks FROM m WHERE NOT is_negated GROUP BY 1), x AS (SELECT doc_id, v.* FROM g, (VALUES ('lane_bias.inner','lane_bias.outer','lane'),('pace.S','pace.H','pace')) v(a,b,message) WHERE list_contains(ks, a) AND list_contains(ks, b)) """


@query("memo_conflicts", "X4", _CONF + "SELECT doc_id, a AS first, b AS second, message FROM x")
def memo_conflicts(spark, sf_dir):
    return memo.conflicts(_found(spark, sf_dir), "doc_id", PAIRS)


@query("memo_chips", "X5", _CONF + """, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category, value ORDER BY rule, position) AS k FROM m)
SELECT doc_id, CASE WHEN is_negated THEN 'negated.' ELSE '' END || category || '.' || value AS chip, CASE WHEN is_negated THEN CASE category || '.' || value WHEN 'lane_bias.inner' THEN '内伸び' WHEN 'lane_bias.outer' THEN '外伸び' WHEN 'pace.S' THEN 'スロー' WHEN 'pace.H' THEN 'ハイペース' WHEN 'track_condition.重' THEN '重馬場' ELSE label END || '否定' ELSE label END AS label,
  CASE WHEN is_negated THEN 'negation' ELSE category END AS kind, CASE WHEN is_negated THEN intensity ELSE least(1.0, intensity) END AS confidence, is_negated OR category = 'frame_hint' AS is_warning,
  CASE WHEN is_negated THEN '「' || keyword || '」が否定されています' WHEN category = 'pedigree' THEN 'seen' ELSE '' END AS reason, NOT is_negated AND category = 'pedigree' AS needs_feature,
  CASE WHEN NOT is_negated AND category = 'frame_hint' THEN 'only a hint' END AS warning, CASE WHEN NOT is_negated AND category IN ('track_condition','lane_bias','style_bias','pace','tag') THEN category || '=' || value ELSE '' END AS payload FROM f WHERE k = 1
UNION ALL SELECT doc_id, 'conflict.' || a || '_' || b, '矛盾注意', 'conflict', 1.0, TRUE, message, FALSE, NULL, '' FROM x""")
def memo_chips(spark, sf_dir):
    out = memo.chips(_found(spark, sf_dir), "doc_id", RULES, PAIRS)
    return out.withColumn("payload", F.array_join(F.transform(F.map_entries("payload"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("conversation_matches", "X1 X2", _MEMO.replace("SELECT doc_id, trim(text,", "SELECT ROW(conv_id, turn) AS doc_id, trim(text,").replace("FROM documents)", "FROM conversations)") + "SELECT doc_id[1] AS conv_id, doc_id[2] AS turn, category, value, keyword, position, is_negated, intensity FROM m")
def conversation_matches(spark, sf_dir):
    found = memo.matches(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", RULES, WORDS)
    return found.select("conv_id", "turn", "category", "value", "keyword", "position", "is_negated", "intensity")
