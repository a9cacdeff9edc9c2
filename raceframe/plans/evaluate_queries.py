"""Metrics, splits, strategies and backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from raceframe.functions import columns as C
from raceframe.functions import constants as K
from raceframe.operators import backtest, evaluate, history, quality, splits
from raceframe.plans.base import ENTRIES, entries, r6, stored
from raceframe.plans.registry import query

KEY = ["event", "entity"]
_S = ENTRIES + ", s AS (SELECT *, CAST(outcome = 1 AS INTEGER) AS win, CAST(outcome <= 3 AS INTEGER) AS in3, row_number() OVER (PARTITION BY event ORDER BY p DESC, entity) AS k FROM entries)"


def scored(spark, sf_dir):
    return entries(spark, sf_dir).withColumns({"win": C.within("outcome", 1), "in3": C.within("outcome", 3)})


def rounded(df, keep, names):
    return df.select(*keep, *[r6(n).alias(n) for n in names])


def round_doubles(df):
    """Round every double column."""
    return df.select(*[r6(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


_AUC = """(SELECT sum(CASE WHEN y=1 THEN r END) - count(*) FILTER (WHERE y=1) * (count(*) FILTER (WHERE y=1) + 1) / 2.0)
 / (CAST(count(*) FILTER (WHERE y=1) AS DOUBLE) * count(*) FILTER (WHERE y=0))"""


@query("global_metrics", "A10",
       _S + """, r AS (SELECT win AS y, CAST(rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1)/2.0 AS DOUBLE) AS r FROM s)
SELECT count(*) AS n, count(*) FILTER (WHERE win=1) AS n_positive, round(avg(CAST((p>=0.3)=(win=1) AS INTEGER)),6) AS accuracy,
  round(count(*) FILTER (WHERE p>=0.3 AND win=1)/count(*) FILTER (WHERE p>=0.3),6) AS precision,
  round(count(*) FILTER (WHERE p>=0.3 AND win=1)/count(*) FILTER (WHERE win=1),6) AS recall,
  round(2*count(*) FILTER (WHERE p>=0.3 AND win=1)/(count(*) FILTER (WHERE p>=0.3) + count(*) FILTER (WHERE win=1)),6) AS f1,
  round(avg(-CASE WHEN win=1 THEN ln(greatest(least(p,1-1e-15),1e-15)) ELSE ln(1-greatest(least(p,1-1e-15),1e-15)) END),6) AS logloss,
  round(avg((p-win)*(p-win)),6) AS brier,
  (SELECT round((sum(CASE WHEN y=1 THEN r END) - count(*) FILTER (WHERE y=1) * (count(*) FILTER (WHERE y=1) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE y=1) AS DOUBLE) * count(*) FILTER (WHERE y=0)),6) FROM r) AS auc
FROM s""")
def global_metrics(spark, sf_dir):
    return round_doubles(evaluate.global_metrics(scored(spark, sf_dir), "p", "win", threshold=0.3))


@query("global_metrics_by_surface", "A10",
       _S + """, r AS (SELECT surface, in3 AS y, CAST(rank() OVER (PARTITION BY surface ORDER BY p) + (count(*) OVER (PARTITION BY surface, p) - 1)/2.0 AS DOUBLE) AS r FROM s)
SELECT surface, round((sum(CASE WHEN y=1 THEN r END) - count(*) FILTER (WHERE y=1) * (count(*) FILTER (WHERE y=1) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE y=1) AS DOUBLE) * count(*) FILTER (WHERE y=0)),6) AS auc
FROM r GROUP BY surface""")
def global_metrics_by_surface(spark, sf_dir):
    return round_doubles(evaluate.roc_auc(scored(spark, sf_dir), "p", "in3", ["surface"]))


@query("ranking_metrics", "A11",
       _S + """, e AS (SELECT event, count(*) AS n, min(k) FILTER (WHERE win=1) AS r FROM s GROUP BY event)
SELECT count(r) AS n_races, CAST(sum(n) AS BIGINT) AS n_entries, round(count(*) FILTER (WHERE r=1)/count(r),6) AS top1_hit_rate, round(count(*) FILTER (WHERE r<=3)/count(r),6) AS top3_hit_rate,
 round(count(*) FILTER (WHERE r<=5)/count(r),6) AS top5_hit_rate, round(avg(1/r),6) AS mrr, round(avg(n),6) AS avg_field_size FROM e""")
def ranking_metrics(spark, sf_dir):
    return round_doubles(evaluate.ranking_metrics(scored(spark, sf_dir), "p", "win"))


@query("winner_rank_histogram", "A11",
       _S + """SELECT CASE WHEN r >= 10 THEN '10+' ELSE CAST(r AS VARCHAR) END AS rank, count(*) AS n FROM (SELECT event, min(k) FILTER (WHERE win=1) AS r FROM s GROUP BY event) WHERE r IS NOT NULL GROUP BY 1""")
def winner_rank_histogram(spark, sf_dir):
    return evaluate.rank_histogram(scored(spark, sf_dir), "p", "win")


@query("cover_metrics", "A12",
       _S + """SELECT count(*) AS n_races, round(avg(CAST(r<=1 AS INTEGER)),6) AS hit_top1_rate, round(avg(CAST(r<=2 AS INTEGER)),6) AS hit_top2_rate, round(avg(CAST(r<=3 AS INTEGER)),6) AS hit_top3_rate,
 round(avg(r),6) AS avg_rank_best FROM (SELECT event, min(k) FILTER (WHERE in3=1) AS r FROM s GROUP BY event) WHERE r IS NOT NULL""")
def cover_metrics(spark, sf_dir):
    return round_doubles(evaluate.cover_metrics(scored(spark, sf_dir), "p", "in3"))


@query("ndcg", "A13",
       _S + """, t AS (SELECT event, entity, win, p, k, max(CASE WHEN win=1 THEN p END) OVER (PARTITION BY event) AS w, count(*) OVER (PARTITION BY event) AS n FROM s),
e AS (SELECT event, avg(1/log2(1+k)) FILTER (WHERE p = w) AS d, max(win) FILTER (WHERE k = 1) AS t1 FROM t WHERE n > 1 GROUP BY event)
SELECT count(*) AS n_events, round(avg(coalesce(d,0)),6) AS ndcg, round(avg(t1),6) AS top1_accuracy FROM e""")
def ndcg(spark, sf_dir):
    return round_doubles(evaluate.ndcg(scored(spark, sf_dir), "p", "win"))


@query("calibration_bins", "A14",
       _S + "SELECT CAST(least(floor(p*10),9) AS INTEGER) AS bin, count(*) AS n, round(avg(p),6) AS avg_pred, round(avg(in3),6) AS emp_rate, round(avg(p)-avg(in3),6) AS diff FROM s GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return round_doubles(evaluate.calibration_bins(scored(spark, sf_dir), "p", "in3"))


@query("calibration_error", "A14",
       _S + """, b AS (SELECT (SELECT count(*) FROM range(1,15) t(i) WHERE p >= i/15) AS bin, p, win FROM s), g AS (SELECT bin, count(*) AS n, abs(avg(p)-avg(win)) AS d FROM b GROUP BY 1)
SELECT round(coalesce(sum(n*d) FILTER (WHERE n >= 2000) / sum(n),0.0),6) AS ece, count(*) FILTER (WHERE n >= 2000) AS bins_used FROM g""")
def calibration_error(spark, sf_dir):
    return round_doubles(evaluate.expected_calibration_error(scored(spark, sf_dir), "p", "win", min_rows=2000))


@query("reliability_curve", "A14",
       _S + """, b AS (SELECT CAST((SELECT count(*) FROM range(1,10) t(i) WHERE p/2 >= i/10) AS INTEGER) AS bin, p/2 AS q, win FROM s), g AS (SELECT bin, avg(win) AS a, avg(q) AS c FROM b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round((i+0.5)/10,6) AS center, round(a,6) AS bin_acc, round(c,6) AS bin_conf FROM range(10) t(i) LEFT JOIN g ON g.bin = i""")
def reliability_curve(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("q", F.col("p") / 2)
    return round_doubles(evaluate.reliability_curve(df, "q", "win"))


_SEG = """, x AS (SELECT *, CASE WHEN field_size <= 4 THEN 'small' WHEN field_size <= 6 THEN 'medium' ELSE 'large' END AS band FROM s),
l AS (SELECT event, entity, p, win, k, 'surface' AS segment_key, surface AS segment_value FROM x UNION ALL SELECT event, entity, p, win, k, 'going', going FROM x WHERE going IS NOT NULL
 UNION ALL SELECT event, entity, p, win, k, 'field_size_cat', CASE WHEN field_size <= 10 THEN 'small' WHEN field_size <= 14 THEN 'medium' ELSE 'large' END FROM x),
e AS (SELECT segment_key, segment_value, event, count(*) AS n, min(k) FILTER (WHERE win=1) AS r FROM l GROUP BY 1,2,3),
a AS (SELECT segment_key, segment_value, count(*) AS n_races, round(avg(n),6) AS avg_field_size, round(avg(1/r),6) AS mrr, round(avg(CAST(r<=1 AS INTEGER)),6) AS top1_hit_rate,
   round(avg(CAST(r<=3 AS INTEGER)),6) AS top3_hit_rate, round(avg(CAST(r<=5 AS INTEGER)),6) AS top5_hit_rate FROM e WHERE r IS NOT NULL GROUP BY 1,2),
u AS (SELECT segment_key, segment_value, win AS y, p, CAST(rank() OVER (PARTITION BY segment_key, segment_value ORDER BY p) + (count(*) OVER (PARTITION BY segment_key, segment_value, p) - 1)/2.0 AS DOUBLE) AS r FROM l),
m AS (SELECT segment_key, segment_value, count(*) AS n_entries, round(avg(-CASE WHEN y=1 THEN ln(greatest(least(p,1-1e-15),1e-15)) ELSE ln(1-greatest(least(p,1-1e-15),1e-15)) END),6) AS logloss,
  round((sum(CASE WHEN y=1 THEN r END) - count(*) FILTER (WHERE y=1) * (count(*) FILTER (WHERE y=1) + 1) / 2.0) / nullif(CAST(count(*) FILTER (WHERE y=1) AS DOUBLE) * count(*) FILTER (WHERE y=0),0),6) AS auc FROM u GROUP BY 1,2)
SELECT * FROM a JOIN m USING (segment_key, segment_value)"""


@query("segment_metrics", "A15", _S + _SEG)
def segment_metrics(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("field_size_cat", evaluate.field_size_band("field_size"))
    return round_doubles(evaluate.segment_metrics(df, "p", "win", ["surface", "going", "field_size_cat"]))


# --- payouts ----------------------------------------------------------------------------

_PAY = """, paid AS (SELECT *, CASE WHEN field_size >= 8 THEN 3 WHEN field_size >= 5 THEN 2 ELSE 0 END AS places FROM s),
payouts AS (SELECT event, '単勝' AS bet_type, CAST(post AS VARCHAR) AS combination, CAST(odds*100 AS INTEGER) AS payout FROM paid WHERE outcome = 1 AND tax <> 5
  UNION ALL SELECT event, '複勝', CAST(post AS VARCHAR), CAST(100 + odds*32 AS INTEGER) FROM paid WHERE outcome <= places AND tax <> 5),
placed AS (SELECT p.*, y.payout AS place_payout FROM paid p LEFT JOIN payouts y ON y.event = p.event AND y.combination = CAST(p.post AS VARCHAR) AND y.bet_type = '複勝')
"""
BETS = {"単勝": 1, "複勝": 3}


def payouts(df):
    """Payout rows (event, bet type, number as text, payout) for winners and paid places."""
    places = C.paid_places("field_size")
    known = df.filter("tax <> 5").select("event", F.col("post").cast("string").alias("combination"), "odds", "outcome", places.alias("places"))
    win = known.filter("outcome = 1").select("event", F.lit("単勝").alias("bet_type"), "combination", (F.col("odds") * 100).cast("int").alias("payout"))
    place = known.filter("outcome <= places").select("event", F.lit("複勝").alias("bet_type"), "combination", (100 + F.col("odds") * 32).cast("int").alias("payout"))
    return win.unionByName(place)


def with_place_payout(df):
    """Join the place payout on event and number as text."""
    pay = payouts(df).filter("bet_type = '複勝'").select("event", F.col("combination").alias("__c"), F.col("payout").alias("place_payout"))
    return df.withColumn("__c", F.col("post").cast("string")).join(pay, ["event", "__c"], "left").drop("__c")


@query("payout_join", "J4", _S + _PAY + "SELECT event, entity, place_payout FROM placed")
def payout_join(spark, sf_dir):
    return with_place_payout(scored(spark, sf_dir)).select(*KEY, "place_payout")


@query("payout_sanity", "A16",
       _S + _PAY + """, e AS (SELECT event, max(field_size) AS n, count(place_payout) AS paid, count(*) AS rows_, count(*) FILTER (WHERE outcome <= places) AS due,
  count(*) FILTER (WHERE outcome <= places AND place_payout IS NULL) AS bad, count(*) FILTER (WHERE outcome<=3) AS i3, count(*) FILTER (WHERE outcome<=3 AND place_payout IS NULL) AS i3m, max(places) AS places FROM placed GROUP BY event)
SELECT CAST(sum(rows_) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n<=4) AS races_le4, count(*) FILTER (WHERE n BETWEEN 5 AND 7) AS races_5_7, count(*) FILTER (WHERE n>=8) AS races_ge8,
 count(*) FILTER (WHERE paid=0) AS payouts_0, count(*) FILTER (WHERE paid=1) AS payouts_1, count(*) FILTER (WHERE paid=2) AS payouts_2, count(*) FILTER (WHERE paid=3) AS payouts_3, count(*) FILTER (WHERE paid>=4) AS payouts_4_plus,
 CAST(sum(due) AS BIGINT) AS n_due, CAST(sum(bad) AS BIGINT) AS n_anomaly_rows, count(*) FILTER (WHERE bad>0) AS n_anomaly_races, round(sum(i3m)/sum(i3),6) AS in3_missing_rate,
 round(1-avg(places)/avg(n),6) AS expected_missing_rate, round(1-sum(paid)/sum(rows_),6) AS actual_missing_rate, count(*) FILTER (WHERE paid<3) AS races_with_few_payouts, round(avg(paid),6) AS avg_payout_per_race FROM e""")
def payout_sanity(spark, sf_dir):
    return round_doubles(evaluate.payout_sanity(with_place_payout(scored(spark, sf_dir)), "place_payout"))


@query("payout_anomalies", "A16",
       _S + _PAY + "SELECT event, entity, outcome, places AS paid_places, field_size FROM placed WHERE outcome <= places AND place_payout IS NULL")
def payout_anomalies(spark, sf_dir):
    out = evaluate.payout_sanity_rows(with_place_payout(scored(spark, sf_dir)), "place_payout")
    return out.select(*KEY, "outcome", "paid_places", "field_size")


_H = "sha256(CAST(event AS VARCHAR) || '|' || CAST(entity AS VARCHAR) || '|42')"
_BETS = """, b AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY popularity, entity) AS kf, row_number() OVER (PARTITION BY event ORDER BY """ + _H + """) AS kr FROM s),
bets AS (SELECT 'model_top1' AS strategy, * FROM b WHERE k=1 UNION ALL SELECT 'model_top3', * FROM b WHERE k<=3 UNION ALL SELECT 'popularity_top1', * FROM b WHERE kf=1 UNION ALL SELECT 'random_top1', * FROM b WHERE kr=1),
settled AS (SELECT x.*, t.bet_type, y.payout, y.payout IS NOT NULL AND x.outcome <= t.last AS hit FROM bets x, (VALUES ('単勝',1),('複勝',3)) t(bet_type,last)
  LEFT JOIN payouts y ON y.event=x.event AND y.bet_type=t.bet_type AND y.combination=CAST(x.post AS VARCHAR))
"""


@query("strategy_roi", "E4 E5 T1 T2 T3",
       _S + _PAY + _BETS + """SELECT strategy, bet_type, count(DISTINCT event) AS n_races, count(*) AS n_bets, count(*) FILTER (WHERE hit) AS n_hits, CAST(count(*)*100 AS DOUBLE) AS stake_total,
 CAST(coalesce(sum(payout) FILTER (WHERE hit),0) AS DOUBLE) AS return_total, round(coalesce(sum(payout) FILTER (WHERE hit),0)/(count(*)*100),6) AS roi_gross, round(count(*) FILTER (WHERE hit)/count(*),6) AS hit_rate,
 round(coalesce(avg(payout) FILTER (WHERE hit),0),6) AS avg_payout FROM settled GROUP BY 1,2""")
def strategy_roi(spark, sf_dir):
    df = scored(spark, sf_dir)
    bets = backtest.strategy_bets(df.select(*KEY, "p", "popularity", "post", "outcome"), "p", "popularity")
    return round_doubles(backtest.roi(backtest.settle(bets, payouts(df), "post", BETS), ["strategy", "bet_type"]))


def _sweep_sql(dim, ths, bet):
    last = BETS[bet]
    vals = ",".join(f"({t}::DOUBLE)" for t in ths)
    return _S + _PAY + f""", b AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY popularity, entity) AS kf FROM s),
t AS (SELECT event, max(p) FILTER (WHERE k=1) AS top1_p, max(p) FILTER (WHERE k=1) - max(p) FILTER (WHERE k=2) AS gap, max(post) FILTER (WHERE k=1) AS mno, max(outcome) FILTER (WHERE k=1) AS mo,
  max(post) FILTER (WHERE kf=1) AS fno, max(outcome) FILTER (WHERE kf=1) AS fo FROM b GROUP BY event),
j AS (SELECT t.*, CASE WHEN mo <= {last} THEN m.payout END AS mr, CASE WHEN fo <= {last} THEN f.payout END AS fr FROM t
  LEFT JOIN payouts m ON m.event=t.event AND m.bet_type='{bet}' AND m.combination=CAST(mno AS VARCHAR) LEFT JOIN payouts f ON f.event=t.event AND f.bet_type='{bet}' AND f.combination=CAST(fno AS VARCHAR)),
g AS (SELECT threshold, count(event) AS n, count(mr) AS mh, count(fr) AS fh, coalesce(sum(mr),0) AS ms, coalesce(sum(fr),0) AS fs FROM (VALUES {vals}) v(threshold) LEFT JOIN j ON j.{dim} >= threshold GROUP BY 1)
SELECT '{dim}' AS threshold_type, threshold, '{bet}' AS bet_type, (SELECT count(*) FROM j) AS n_total_races, n AS n_races_bet, round(n/(SELECT count(*) FROM j),6) AS coverage, mh AS model_n_hits, fh AS pop_n_hits,
 round(coalesce(ms/nullif(n*100,0),0),6) AS model_roi, round(coalesce(fs/nullif(n*100,0),0),6) AS pop_roi, round(coalesce(mh/nullif(n,0),0),6) AS model_hit_rate, round(coalesce(fh/nullif(n,0),0),6) AS pop_hit_rate,
 round(coalesce(ms/nullif(n*100,0),0) - coalesce(fs/nullif(n*100,0),0),6) AS roi_diff, round(coalesce(mh/nullif(n,0),0) - coalesce(fh/nullif(n,0),0),6) AS hit_diff FROM g"""


def _sweep(spark, sf_dir, dim, ths, bet):
    df = scored(spark, sf_dir).select(*KEY, "p", "popularity", "post", "outcome", "odds", "tax", "field_size")
    per = backtest.selective_bets(df, payouts(df), "p", "popularity", "post", BETS)
    return round_doubles(backtest.selective_sweep(per, dim, ths, bet))


_PT = [0.2, 0.3, 0.4, 0.5, 0.7, 0.95, 1.5]


@query("sweep_prob_win", "E7", _sweep_sql("top1_p", _PT, "単勝"))
def sweep_prob_win(spark, sf_dir):
    return _sweep(spark, sf_dir, "top1_p", _PT, "単勝")


@query("sweep_gap_place", "E7", _sweep_sql("gap", K.GAP_THRESHOLDS, "複勝"))
def sweep_gap_place(spark, sf_dir):
    return _sweep(spark, sf_dir, "gap", K.GAP_THRESHOLDS, "複勝")


_FRAME = """, f AS (SELECT event, max(p) FILTER (WHERE k=1) AS top1_p, max(p) FILTER (WHERE k=1) - max(p) FILTER (WHERE k=2) AS gap, max(place_payout) FILTER (WHERE k=1) AS pay, max(outcome) FILTER (WHERE k=1) AS o,
  max(in3) FILTER (WHERE k=1) AS in3, max(places) AS places, max(odds) FILTER (WHERE k=1) AS odds_proxy, max(outcome - popularity) FILTER (WHERE k=1) AS popdiff FROM placed GROUP BY event),
ok AS (SELECT * FROM f WHERE NOT (o <= places AND pay IS NULL))
"""


@query("place_top1", "E8",
       _S + _PAY + _FRAME + "SELECT count(*) AS n_races, count(*) FILTER (WHERE pay IS NOT NULL AND in3=1) AS n_hits, round(count(*) FILTER (WHERE pay IS NOT NULL AND in3=1)/count(*),6) AS hit_rate, CAST(sum(pay) AS BIGINT) AS total_return, round(sum(pay)/(count(*)*100)*100,6) AS roi, (SELECT count(*) FROM f) - count(*) AS n_excluded_races FROM ok")
def place_top1(spark, sf_dir):
    df = with_place_payout(scored(spark, sf_dir))
    frame = backtest.place_frame(df, "p", "place_payout")
    hit = F.col("place_payout").isNotNull() & (F.col("in3") == 1)
    events = df.select(F.count_distinct("event")).scalar()
    return round_doubles(
        frame.agg(
            F.count(F.lit(1)).alias("n_races"), F.count(F.when(hit, 1)).alias("n_hits"),
            (F.count(F.when(hit, 1)) / F.count(F.lit(1))).alias("hit_rate"), F.sum("place_payout").alias("total_return"),
            (F.sum("place_payout") / (F.count(F.lit(1)) * 100) * 100).alias("roi"),
        ).withColumn("n_excluded_races", events - F.col("n_races"))
    )


def _place_sql(dims):
    joins = " CROSS JOIN ".join("(VALUES " + ",".join(f"({t}::DOUBLE)" for t in ts) + f") v{i}({d}_th)" for i, (d, ts) in enumerate(dims.items()))
    tests = " AND ".join(f"ok.{d} >= {d}_th" for d in dims)
    keys = ", ".join(f"{d}_th" for d in dims)
    avgs = ", ".join(f"round(coalesce(avg(ok.{d}),0),6) AS avg_{d}" for d in dims)
    return _S + _PAY + _FRAME + f"""SELECT {keys}, count(event) AS n_bet_races, count(*) FILTER (WHERE pay IS NOT NULL AND in3=1) AS n_hits, round(coalesce(count(*) FILTER (WHERE pay IS NOT NULL AND in3=1)/nullif(count(event),0),0),6) AS hit_rate,
 CAST(count(event)*100 AS DOUBLE) AS total_bet, CAST(coalesce(sum(pay),0) AS BIGINT) AS total_return, round(coalesce(sum(pay)/nullif(count(event)*100,0)*100,0),6) AS roi, {avgs} FROM {joins} LEFT JOIN ok ON {tests} GROUP BY {keys}"""


def _place(spark, sf_dir, dims):
    df = with_place_payout(scored(spark, sf_dir))
    df = df.withColumns({"odds_proxy": F.col("odds"), "popdiff": (F.col("outcome") - F.col("popularity")).cast("double")})
    frame = backtest.place_frame(df, "p", "place_payout", ["odds_proxy", "popdiff"])
    return round_doubles(backtest.place_sweep(frame, "place_payout", dims))


_D1 = {"top1_p": K.PLACE_PROB_GRID}
_D2 = {"top1_p": K.PLACE_PROB_GRID, "gap": K.PLACE_GAP_GRID}
_D3 = {"top1_p": K.PLACE_PROB_GRID, "gap": [0.03, 0.05], "odds_proxy": [6, 8, 10, 12]}
_D4 = {"top1_p": K.PLACE_PROB_GRID, "gap": [0.03, 0.05], "odds_proxy": [6, 10], "popdiff": [-1, 0, 1, 2]}


@query("place_sweep_prob", "E8", _place_sql(_D1))
def place_sweep_prob(spark, sf_dir):
    return _place(spark, sf_dir, _D1)


@query("place_sweep_gap", "E8", _place_sql(_D2))
def place_sweep_gap(spark, sf_dir):
    return _place(spark, sf_dir, _D2)


@query("place_sweep_odds", "E8", _place_sql(_D3))
def place_sweep_odds(spark, sf_dir):
    return _place(spark, sf_dir, _D3)


@query("place_sweep_popdiff", "E8", _place_sql(_D4))
def place_sweep_popdiff(spark, sf_dir):
    return _place(spark, sf_dir, _D4)


@query("place_best", "E8 T4", "SELECT * FROM (" + _place_sql(_D2) + ") WHERE n_bet_races >= 50 ORDER BY roi DESC, top1_p_th, gap_th LIMIT 5")
def place_best(spark, sf_dir):
    return backtest.best_by_roi(_place(spark, sf_dir, _D2), 50, 5, ["top1_p_th", "gap_th"])


@query("net_roi", "E6", _S + "SELECT count(*) AS n_bets, count(*) FILTER (WHERE outcome=1) AS n_hits, round(sum(CASE WHEN outcome=1 THEN odds ELSE 0 END)*100,6) AS return_total, round((sum(CASE WHEN outcome=1 THEN odds ELSE 0 END)-count(*))/count(*),6) AS roi_net FROM s WHERE k=1")
def net_roi(spark, sf_dir):
    return round_doubles(backtest.net_roi(scored(spark, sf_dir), "p", "odds"))


_BT = """, ev AS (SELECT *, p*odds AS ev FROM s), b AS (SELECT 'all' AS strategy, * FROM ev UNION ALL SELECT 'ev>1.0', * FROM ev WHERE ev>1.0 UNION ALL SELECT 'ev>1.2', * FROM ev WHERE ev>1.2 UNION ALL SELECT 'top1', * FROM ev WHERE k=1 UNION ALL SELECT 'top3', * FROM ev WHERE k<=3),
pe AS (SELECT strategy, event, day, count(*) AS n_bets, avg(odds) AS avg_odds, sum(win) AS wins, CAST(count(*)*100 AS DOUBLE) AS bet, sum(win*odds)*100 AS ret, sum(odds) AS so, sum(ev) AS sev FROM b GROUP BY 1,2,3),
c AS (SELECT *, sum(ret-bet) OVER (PARTITION BY strategy ORDER BY day, event ROWS UNBOUNDED PRECEDING) AS cum FROM pe),
d AS (SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY day, event ROWS UNBOUNDED PRECEDING) AS peak FROM c)
"""


def _event_profits(spark, sf_dir):
    """One row per strategy and event, stored once: the running sums read it several times."""
    def build(s, d):
        df = scored(s, d).select(*KEY, "day", "p", "odds", "outcome")
        return backtest.event_profits(backtest.backtest_bets(df, "p", "odds"), "odds")

    return stored(spark, sf_dir, "event-profits", build)


@query("backtest_event_profits", "E9", _S + _BT + 'SELECT strategy, event, n_bets, round(avg_odds,6) AS avg_odds, CAST(wins AS BIGINT) AS wins, bet, ret AS "return", ret-bet AS profit FROM pe')
def backtest_event_profits(spark, sf_dir):
    return round_doubles(_event_profits(spark, sf_dir)).select("strategy", "event", "n_bets", "avg_odds", "wins", "bet", "return", "profit")


@query("backtest_summary", "E9 W27", _S + _BT + "SELECT strategy, CAST(sum(n_bets) AS BIGINT) AS n_bets, sum(bet) AS total_bet, sum(ret) AS total_return, sum(ret)-sum(bet) AS net_profit, round((sum(ret)-sum(bet))/sum(bet),6) AS roi, round(sum(wins)/sum(n_bets),6) AS hit_rate, max(peak-cum) AS max_drawdown, round(sum(so)/sum(n_bets),6) AS avg_odds, round(sum(sev)/sum(n_bets),6) AS avg_ev FROM d GROUP BY 1")
def backtest_summary(spark, sf_dir):
    return round_doubles(backtest.backtest_summary(_event_profits(spark, sf_dir)))


@query("profit_curve", "W27", _S + _BT + "SELECT strategy, event, cum AS cumulative, peak, peak-cum AS drawdown FROM d")
def profit_curve(spark, sf_dir):
    return backtest.profit_curve(_event_profits(spark, sf_dir)).select("strategy", "event", "cumulative", "peak", "drawdown")


@query("ev_recovery", "E10", _S + """, e AS (SELECT event, count(*) AS n, count(*) FILTER (WHERE p*odds>1 AND p>0.1) AS k, sum(odds) FILTER (WHERE p*odds>1 AND p>0.1 AND outcome=1) AS won FROM s GROUP BY event)
SELECT count(*) AS n_events, round(sum(coalesce(100/k*won,0)),4) AS total_return, round(sum(coalesce(100/k*won,0))/(count(*)*100),6) AS recovery FROM e WHERE n>1 AND k>0""")
def ev_recovery(spark, sf_dir):
    out = backtest.ev_recovery(scored(spark, sf_dir), "p", "odds", 0.1)
    return out.select("n_events", F.round("total_return", 4).alias("total_return"), r6("recovery").alias("recovery"))


@query("regression_metrics", "A24", ENTRIES + ", x AS (SELECT place, last3f AS a, 33 + field_size/4 AS b FROM entries) SELECT place, count(*) AS n, round(avg(abs(a-b)),6) AS mae, round(sqrt(avg((a-b)*(a-b))),6) AS rmse, round(avg(abs(a-b)/(abs(a)+1e-6))*100,6) AS mape, round(avg(CAST(abs(a-b)<0.5 AS INTEGER)),6) AS within_half, round(avg(CAST(abs(a-b)<1.0 AS INTEGER)),6) AS within_one FROM x GROUP BY place")
def regression_metrics(spark, sf_dir):
    df = entries(spark, sf_dir).withColumn("guess", 33 + F.col("field_size") / 4)
    return round_doubles(evaluate.regression_metrics(df, "last3f", "guess", ["place"]))


_SUM = "count({p}) AS n, round(avg({p}),6) AS mean, round(stddev_pop({p}),6) AS std, round(min({p}),6) AS min, round(max({p}),6) AS max, round(quantile_cont({p},0.25),6) AS q25, round(quantile_cont({p},0.5),6) AS median, round(quantile_cont({p},0.75),6) AS q75, round(avg(win),6) AS positive_rate"


@query("score_summary", "A26", _S + "SELECT surface, " + _SUM.format(p="p") + " FROM s GROUP BY surface")
def score_summary(spark, sf_dir):
    return round_doubles(evaluate.score_summary(scored(spark, sf_dir), "p", "win", ["surface"]))


@query("score_drift", "A26", _S + ", f AS (SELECT avg(p) AS m, stddev_pop(p) AS sd FROM s WHERE event_date < DATE '1998-01-01'), n AS (SELECT count(p) AS n, avg(p*p) AS m, avg(win) AS r FROM s WHERE event_date >= DATE '1998-01-01') SELECT n.n, round(n.m,6) AS mean, round(f.m,6) AS fit_mean, round(abs(n.m-f.m),6) AS shift, abs(n.m-f.m) > 2*f.sd AS drifted, (n.r < 0.01 OR n.r > 0.99) AS extreme_rate FROM n, f")
def score_drift(spark, sf_dir):
    df = scored(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("date")
    fit = evaluate.score_summary(df.filter(F.col("event_date") < cut), "p", "win")
    now = evaluate.score_summary(df.filter(F.col("event_date") >= cut).withColumn("p", F.col("p") * F.col("p")), "p", "win")
    return round_doubles(evaluate.drift_flags(now, fit))


# --- splits -----------------------------------------------------------------------------


@query("time_split", "E1 S4", ENTRIES + "SELECT CASE WHEN event_date < DATE '1997-01-01' THEN 'train' WHEN event_date < DATE '1999-01-01' THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT event) AS events, min(event_date) AS first, max(event_date) AS last FROM entries GROUP BY 1")
def time_split(spark, sf_dir):
    out = splits.require_disjoint(splits.time_split(entries(spark, sf_dir), "event_date", "1997-01-01", "1999-01-01"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event").alias("events"), F.min("event_date").alias("first"), F.max("event_date").alias("last"))


@query("tail_split", "E2", ENTRIES + ", g AS (SELECT event, day, count(*) AS n FROM entries GROUP BY 1,2), c AS (SELECT *, sum(n) OVER (ORDER BY day, event ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS tot FROM g) SELECT event, entity, CASE WHEN cum <= tot * 0.8 THEN 'train' ELSE 'test' END AS split FROM entries JOIN c USING (event)")
def tail_split(spark, sf_dir):
    return splits.tail_split(entries(spark, sf_dir), 0.2).select(*KEY, "split")


@query("group_split", "E2", ENTRIES + "SELECT event, entity, CASE WHEN CAST('0x' || substr(sha256(CAST(event AS VARCHAR) || '|42'),1,8) AS BIGINT) % 10000 < 2500 THEN 'test' ELSE 'train' END AS split FROM entries")
def group_split(spark, sf_dir):
    return splits.group_split(entries(spark, sf_dir), 0.25).select(*KEY, "split")


@query("walk_forward_folds", "E3", ENTRIES + """, b AS (SELECT min(event_date) AS lo, max(event_date) AS hi FROM entries),
f AS (SELECT i AS fold, CAST(lo + to_months(CAST(12 + (i-1)*3 AS INTEGER)) AS DATE) AS st, CAST(lo + to_months(CAST(12 + i*3 AS INTEGER)) AS DATE) AS en, hi FROM b, range(1,6) t(i)),
x AS (SELECT fold, event_date AS d, CASE WHEN event_date >= st AND event_date < en THEN 'test' WHEN event_date < st - 7 THEN 'train' END AS part FROM f, entries WHERE en <= hi)
SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE part='train') AS n_train, count(*) FILTER (WHERE part='test') AS n_test, min(d) FILTER (WHERE part='train') AS train_from, max(d) FILTER (WHERE part='train') AS train_to,
 min(d) FILTER (WHERE part='test') AS test_from, max(d) FILTER (WHERE part='test') AS test_to, max(d) FILTER (WHERE part='train') < min(d) FILTER (WHERE part='test') AS ordered FROM x GROUP BY 1""")
def walk_forward_folds(spark, sf_dir):
    folds = splits.walk_forward(entries(spark, sf_dir).select(*KEY, "event_date"), "event_date", gap_days=7)
    return splits.fold_check(folds, "event_date")


@query("split_overlap", "U5", ENTRIES + ", x AS (SELECT entity, CASE WHEN event_date < DATE '1997-01-01' THEN 'train' WHEN event_date < DATE '1999-01-01' THEN 'val' ELSE 'test' END AS split FROM entries) SELECT entity, count(DISTINCT split) AS n_parts FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_overlap(spark, sf_dir):
    return splits.overlap(splits.time_split(entries(spark, sf_dir), "event_date", "1997-01-01", "1999-01-01"), key="entity")


_RECOUNT = ", c AS (SELECT a.event, a.entity, count(b.outcome) AS n, count(*) FILTER (WHERE b.outcome = 1) AS wins, count(*) FILTER (WHERE b.outcome <= 3) AS in3 FROM entries a LEFT JOIN entries b ON a.entity = b.entity AND b.day < a.day GROUP BY 1, 2)"


@query("earlier_counts", "E12", ENTRIES + _RECOUNT + " SELECT event, entity, n, wins, in3 FROM c")
def earlier_counts(spark, sf_dir):
    """Earlier starts, wins and places of every entry, without the history operators."""
    return quality.recount(entries(spark, sf_dir).select(*KEY, "day", "outcome"))


_LATE = "SELECT a.event, a.entity, count(b.outcome) AS n, count(*) FILTER (WHERE b.outcome = 1) AS wins, count(*) FILTER (WHERE b.outcome <= 3) AS in3 FROM entries a LEFT JOIN entries b ON a.entity = b.entity AND b.day <= a.day GROUP BY 1, 2"


@query("leak_check", "E12", ENTRIES + _RECOUNT + f""", late AS ({_LATE}), n AS (SELECT count(*) AS n FROM entries)
SELECT 'record' AS history, f AS feature, n AS n_rows, 0::BIGINT AS n_different, 0::BIGINT AS n_leaks FROM n, (VALUES ('h_n_starts'), ('h_n_wins'), ('h_n_in3')) v(f)
UNION ALL SELECT 'same_day', f, count(*), count(*) FILTER (WHERE gap <> 0), count(*) FILTER (WHERE gap > 0) FROM (
  SELECT unnest([{{'f': 'h_n_starts', 'gap': late.n - c.n}}, {{'f': 'h_n_wins', 'gap': late.wins - c.wins}}, {{'f': 'h_n_in3', 'gap': late.in3 - c.in3}}], recursive := true)
  FROM late JOIN c USING (event, entity)) GROUP BY f""")
def leak_check(spark, sf_dir):
    """The record against a second count, and a history that counts the event's own day, which must be caught."""
    df = entries(spark, sf_dir).select(*KEY, "day", "outcome")
    counted = quality.recount(df)
    columns = {"h_n_starts": "n", "h_n_wins": "wins", "h_n_in3": "in3"}
    right = quality.leaks(history.career(df), counted, columns).withColumn("history", F.lit("record"))
    o = F.col("outcome")
    upto = Window.partitionBy("entity").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    late = df.select(*KEY, F.count(o).over(upto).alias("h_n_starts"), F.count(F.when(o == 1, 1)).over(upto).alias("h_n_wins"), F.count(F.when(o <= 3, 1)).over(upto).alias("h_n_in3"))
    wrong = quality.leaks(late, counted, columns).withColumn("history", F.lit("same_day"))
    return right.unionByName(wrong).select("history", "feature", "n_rows", "n_different", "n_leaks")
