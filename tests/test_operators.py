"""Hand-computed expectations on small frames, and brute-force properties."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from raceframe.functions import columns as C
from raceframe.operators import asof, backtest, catalogue, evaluate, grouping, history, memo, quality, relative, scenario
from raceframe.sources import odds, tables, upsert


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- as-of history ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def results(spark):
    races = spark.createDataFrame(
        [("R1", "2024-01-01", "東京", "芝", 1600), ("R2", "2024/01/08", "東京", "芝", 1600), ("R3", "20240115", "中山", "ダ", 1200)],
        "race_id string, date string, place string, course_type string, distance int",
    )
    res = spark.createDataFrame(
        [("R1", "A", 1, "X"), ("R1", "B", 3, "Y"), ("R2", "A", 2, "X"), ("R3", "A", None, "X"), ("R3", "B", 1, "X")],
        "race_id string, horse_id string, finish_order int, jockey_id string",
    )
    return tables.load_results(
        tables.conform(res, tables.schema_of("race_results")), tables.conform(races, tables.schema_of("races"))
    )


def test_asof_counts_only_earlier_days(results):
    got = {(r.event, r.entity): r for r in history.career(results).collect()}
    assert set(got) == {("R1", "A"), ("R1", "B"), ("R2", "A"), ("R3", "B")}
    assert got["R1", "A"].h_n_starts == 0 and got["R1", "A"].h_win_rate is None and got["R1", "A"].h_is_first_run == 1
    assert (got["R2", "A"].h_n_starts, got["R2", "A"].h_n_wins, got["R2", "A"].h_win_rate) == (1, 1, 1.0)
    assert (got["R3", "B"].h_n_starts, got["R3", "B"].h_best_finish) == (1, 3)


def test_asof_target_without_outcome(spark):
    df = spark.createDataFrame(
        [("R1", "A", "X", 1, 1), ("R2", "A", "X", 8, 2), ("R3", "A", "X", 15, None)],
        "event string, entity string, actor string, day int, outcome int",
    )
    got = {r.event: r for r in history.career(df).collect()}
    assert (got["R3"].h_n_starts, got["R3"].h_n_wins, got["R3"].h_win_rate, got["R3"].h_is_first_run) == (2, 1, 0.5, 0)
    pair = {r.event: r for r in history.conditional(df, None, ["actor", "entity"], "jh_").collect()}
    assert pair["R3"].jh_n_starts == 2


def test_unknown_condition_has_no_starts(spark):
    df = spark.createDataFrame(
        [("1", "A", 1, 1, "良"), ("2", "A", 2, 1, None), ("3", "A", 3, 2, None), ("4", "A", 4, 1, "良")],
        "event string, entity string, day int, outcome int, going string",
    )
    got = {r.event: r for r in history.conditional(df, "going", suffix="_track").collect()}
    assert got["3"].h_n_starts_track == 0 and got["3"].h_win_rate_track is None
    assert got["4"].h_n_starts_track == 1 and got["4"].h_win_rate_track == 1.0


def _random_runs(seed, n=120):
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        day, ent = r.randint(1, 25), r.choice("ABC")
        event = day * 10 + r.randint(0, 4)
        out[event, ent] = (event, ent, day, r.choice([None, 1, 2, 3, 4, 12]))
    return list(out.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_recent_runs_match_brute_force(spark, seed):
    data = _random_runs(seed)
    df = spark.createDataFrame(data, "event int, entity string, day int, outcome int").repartition(3)
    strict = {(r.event, r.entity): [x.event for x in r.recent] for r in history.recent_date_strict(df, 3, ["outcome"]).collect()}
    by_row = {(r.event, r.entity): [x.event for x in r.recent] for r in history.recent_row_strict(df, 3, ["outcome"]).collect()}
    for e, h, d, _ in data:
        past = sorted([(y, x) for x, k, y, o in data if k == h and y < d and o is not None], reverse=True)
        assert strict[e, h] == [x for _, x in past[:3]]
        prev = sorted([(y, x) for x, k, y, _ in data if k == h and (y, x) < (d, e)], reverse=True)
        assert by_row[e, h] == [x for _, x in prev[:3]]


def test_prior_rows_match_brute_force(spark):
    data = _random_runs(5)
    df = spark.createDataFrame(data, "event int, entity string, day int, outcome int").repartition(3)
    got = history.prior_rows(df, {"n": ("count", F.col("outcome")), "s": ("sum", F.col("outcome")), "m": ("max", F.col("outcome"))})
    for r in got.collect():
        past = [o for x, k, y, o in data if k == r.entity and (y, x) < (r.day, r.event) and o is not None]
        assert (r.n, r.s, r.m) == (len(past), sum(past) if past else None, max(past) if past else None)


# --- groups -----------------------------------------------------------------------------------


def test_ranks_do_not_depend_on_the_size_limit(spark):
    r = random.Random(3)
    data = [(r.choice("ABC"), i, r.choice([-2.5, 0.0, 0.1, 0.1000001, 3.0, 900.0, None])) for i in range(200)]
    df = spark.createDataFrame(data, "event string, entity int, v double").filter("v IS NOT NULL")
    sized = grouping.with_group_stats(df, ["event"], n=F.count(F.lit(1)))
    for kind in ("row_number", "rank", "average"):
        for down in (False, True):
            a = grouping.rank_in_group(sized, ["event"], "v", "k", descending=down, ties=["entity"], size="n", kind=kind)
            b = grouping.rank_in_group(sized, ["event"], "v", "k", descending=down, ties=["entity"], size="n", kind=kind, hot_rows=5)
            assert rows(a, "event", "entity", "k") == rows(b, "event", "entity", "k")


def test_rows_of_unknown_group_size_are_kept(spark):
    df = spark.createDataFrame([("E", 1, 1.0, None), ("E", 2, 3.0, None)], "event string, entity int, v double, n long")
    assert rows(relative.zscores(df, ["v"], size="n"), "entity") == [(1,), (2,)]
    assert rows(relative.normalize(df, "v", size="n"), "entity", "v") == [(1, 0.25), (2, 0.75)]


def test_rank_pct_is_the_average_rank_over_known_values(spark):
    df = spark.createDataFrame([("E", 1, 1.0, 4), ("E", 2, 1.0, 4), ("E", 3, 5.0, 4), ("E", 4, None, 4)], "event string, entity int, v double, n long")
    for size in (None, "n"):
        got = dict(rows(relative.rank_pct(df, ["v"], "pct_", size=size), "entity", "pct_v"))
        assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}


def test_asof_join_matches_brute_force(spark):
    r = random.Random(8)
    at = lambda: datetime(2024, 1, r.randint(1, 5), r.randint(0, 23), r.randint(0, 59))
    obs = [(r.choice("AB"), at(), float(i)) for i in range(60)]
    probes = [(r.choice("ABC"), at(), i) for i in range(40)]
    got = asof.asof_join(
        spark.createDataFrame(probes, "k string, asked timestamp, id int"), spark.createDataFrame(obs, "k string, ts timestamp, v double"),
        ["k"], "asked", "ts", ["v"], ["id"],
    )
    found = {x.id: x.v for x in got.collect()}
    for k, t, i in probes:
        seen = [(s, v) for kk, s, v in obs if kk == k and s <= t]
        assert found[i] == (max(seen)[1] if seen else None)


def test_latest_at_or_before_the_cutoff(spark):
    df = spark.createDataFrame(
        [("R", 1, datetime(2024, 1, 1, 20), 3.0), ("R", 1, datetime(2024, 1, 1, 21), 2.5), ("R", 1, datetime(2024, 1, 1, 22), 2.0)],
        "event string, no int, at timestamp, odds double",
    )
    assert asof.latest(df, ["event", "no"], "at", ["odds"]).first().odds == 2.0
    assert asof.latest(df, ["event", "no"], "at", ["odds"], F.lit("2024-01-01 21:00:00").cast("timestamp")).first().odds == 2.5
    base = spark.createDataFrame([("R", 1, 9.0), ("R", 2, 8.0)], "event string, no int, odds double")
    got = rows(asof.override(base, df.filter("odds = 2.5"), ["event", "no"], ["odds"], ("snapshot", "base")), "no", "odds", "source")
    assert got == [(1, 2.5, "snapshot"), (2, 8.0, "base")]


# --- evaluation ---------------------------------------------------------------------------------


def test_ranking_metrics(spark):
    schema = "event string, entity string, p double, y int"
    df = spark.createDataFrame(
        [("1", "a", 0.6, 1), ("1", "b", 0.4, 0), ("2", "a", 0.5, 0), ("2", "b", 0.3, 1), ("3", "a", 0.9, 0)], schema
    )
    r = evaluate.ranking_metrics(df, "p", "y").first()
    assert (r.n_races, r.n_entries, r.top1_hit_rate, r.top3_hit_rate, r.mrr) == (2, 5, 0.5, 1.0, 0.75)
    empty = evaluate.ranking_metrics(df.limit(0), "p", "y").first()
    assert (empty.n_races, empty.mrr, empty.avg_field_size) == (0, 0.0, 0.0)
    assert rows(evaluate.rank_histogram(df, "p", "y"), "rank", "n") == [("1", 1), ("2", 1)]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "p double, y int")
    assert evaluate.roc_auc(df, "p", "y").first().auc == pytest.approx(3.5 / 4)
    assert evaluate.roc_auc(df.filter("y = 1"), "p", "y").first().auc is None


def test_returns_of_bets(spark):
    bets = spark.createDataFrame([("1", "a", 1, 1, "s"), ("2", "b", 2, 4, "s"), ("3", "c", 3, 2, "s")], "event string, entity string, no int, outcome int, strategy string")
    pay = spark.createDataFrame([("1", "単勝", "1", 350), ("1", "複勝", "1", 150), ("3", "複勝", "3", 200)], "event string, bet_type string, combination string, payout int")
    got = backtest.roi(backtest.settle(bets, pay, "no", {"単勝": 1, "複勝": 3}), ["strategy", "bet_type"])
    assert rows(got, "bet_type", "n_bets", "n_hits", "return_total") == [("単勝", 3, 1, 350.0), ("複勝", 3, 2, 350.0)]


def test_sweep_gives_every_combination(spark):
    df = spark.createDataFrame([(0.1, 0.5), (0.3, 0.1), (0.5, None)], "p double, g double")
    got = backtest.threshold_sweep(df, {"p": [0.2, 0.4, 0.9], "g": [0.0, 0.3]}, {"n": F.lit(1)})
    assert rows(got, "p_th", "g_th", "n") == [(0.2, 0.0, 1), (0.2, 0.3, 0), (0.4, 0.0, 0), (0.4, 0.3, 0), (0.9, 0.0, 0), (0.9, 0.3, 0)]
    one = backtest.threshold_sweep(df, {"p": [0.2, 0.4]}, {"n": F.lit(1)})
    assert rows(one, "p_th", "n") == [(0.2, 2), (0.4, 1)]


def test_drawdown_over_days(spark):
    df = spark.createDataFrame([("s", 1, 1, 50.0), ("s", 2, 1, -80.0), ("s", 3, 2, -40.0), ("s", 4, 3, 200.0)], "strategy string, event int, day int, profit double")
    got = backtest.profit_curve(df)
    assert rows(got, "event", "cumulative", "peak", "drawdown") == [(1, 50.0, 50.0, 0.0), (2, -30.0, 50.0, 80.0), (3, -70.0, 50.0, 120.0), (4, 130.0, 130.0, 0.0)]


# --- sources ----------------------------------------------------------------------------------------


def test_odds_layouts(spark):
    df = spark.createDataFrame(
        [("a", '{"data":{"odds":{"1":{"odds":"1.5","popular":"2"},"2":{"odds":"1.5"},"x":{"odds":"3"}}}}'),
         ("b", '{"data":{"1":{"odds":"1,234.5"},"2":{"odds":"0.5"},"3":{"odds":"2.0"}}}'), ("c", '{"odds":{"4":"7.5"}}'), ("d", "{}")],
        "event string, payload string",
    ).withColumn("observed_at", F.lit("2024-01-01").cast("timestamp"))
    got = rows(odds.parse_odds_json(df, "payload"), "event", "horse_no", "win_odds", "popularity")
    assert got == [("a", 1, 1.5, 2), ("a", 2, 1.5, 1), ("b", 1, 1234.5, 2), ("b", 3, 2.0, 1), ("c", 4, 7.5, 1)]


def test_upsert_is_idempotent(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, v double")
    s = spark.createDataFrame([(2, None, 5.0), (3, "c", 6.0)], "k int, name string, v double")
    once = upsert.upsert(t, s, ["k"], skip_null=True)
    assert rows(once, "k", "name", "v") == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", 6.0)]
    assert rows(upsert.upsert(once, s, ["k"], skip_null=True), "k", "name", "v") == rows(once, "k", "name", "v")
    assert rows(upsert.upsert(t, s, ["k"]), "k")[1] == (2,) and upsert.upsert(t, s, ["k"]).filter("k = 2").first().name is None
    with pytest.raises(ValueError):
        upsert.create_table(t.union(t), str(tmp_path / "x"), ["k"])
    upsert.create_table(t, str(tmp_path / "y"), ["k"])
    with pytest.raises(ValueError):
        upsert.create_table(t, str(tmp_path / "y"), ["k"], "append")


def test_parsing(spark):
    df = spark.createDataFrame([("(3,5),1=2", "502(-4)", "1:34.5", "1,230", "1-2-x-4")], "c string, w string, t string, a string, p string")
    r = df.select(
        C.corner_order("c").alias("c"), C.weight_of("w").alias("w"), C.weight_change_of("w").alias("d"), C.seconds_of("t").alias("t"),
        C.amount_of("a").alias("a"), C.positions("p").alias("p"), C.seconds_of(F.lit("59.8")).alias("s"),
    ).first()
    assert [tuple(x) for x in r.c] == [(3, 1), (5, 2), (1, 3), (2, 3)]
    assert (r.w, r.d, r.t, r.a, r.p, r.s) == (502, -4, 94.5, 1230, [1, 2, 4], 59.8)


def test_invalid_results(spark):
    df = spark.createDataFrame([(1, "正常"), (None, "中"), (None, "除"), (4, "3(降)"), (2, None)], "o int, s string")
    assert rows(quality.valid_targets(df, "o", "s"), "o") == [(1,), (2,)]
    assert dict(rows(quality.invalid_breakdown(df, "o", "s"), "status", "n"))["(invalid)"] == 3


def test_feature_safety(spark):
    names = ["win_odds", "v4_bridge_market_x", "h_body_weight_z", "target_win", "horse_id", "h_win_rate", "umaban"]
    df = catalogue.with_safety(spark.createDataFrame([(n,) for n in names], "feature string"))
    assert dict(rows(df, "feature", "safety_label")) == {
        "win_odds": "unsafe", "v4_bridge_market_x": "unsafe", "h_body_weight_z": "unsafe", "target_win": "warn",
        "horse_id": "warn", "h_win_rate": "safe", "umaban": "warn",
    }


# --- scenarios and memos ------------------------------------------------------------------------------


def test_one_key_with_most_rows(spark):
    """A key with nearly all rows gives the same history as the same rows under many keys."""
    data = [(d * 10 + i, "HOT", d, 1 + (d + i) % 5) for d in range(1, 30) for i in range(4)] + [(999, "COLD", 5, 1)]
    df = spark.createDataFrame(data, "event int, entity string, day int, outcome int").repartition(5)
    got = {r.event: r for r in history.career(df).filter("entity = 'HOT'").collect()}
    for e, _, d, _ in data[:-1]:
        past = [o for _, k, y, o in data if k == "HOT" and y < d]
        assert (got[e].h_n_starts, got[e].h_n_wins) == (len(past), past.count(1))


def test_scenario_sums(spark):
    e = spark.createDataFrame(
        [("R", i, 12, i % 8 + 1, s, 1 / 12, 0.4) for i, s in enumerate(["逃げ", "SENKO", None, "差し"] * 3)],
        "event string, entity int, field_size long, frame_no int, run_style string, base_win double, base_in3 double",
    )
    s = spark.createDataFrame([("R", "a", "H", "外")], "event string, scenario string, pace string, bias string")
    roles = spark.createDataFrame(
        [("R", "a", 1, "front"), ("R", "a", 2, "stalker"), ("R", "a", 3, "weak")], "event string, scenario string, entity int, role string"
    )
    out = scenario.scenario_adjust(e, s, roles)
    got = out.agg(F.sum("adj_win"), F.sum("adj_in3")).first()
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(3.0)
    by = {r.entity: r for r in out.collect()}
    assert by[1].run_style_label == "逃げ" and "SCENARIO_FRONT_RUNNER" in by[1].reasons
    assert by[2].run_style_label == "先行" and "MARKED_WEAK" in by[3].reasons


def test_memo_negation_intensity_and_conflict(spark):
    rules = [memo.Rule("lane_bias", "inner", "内伸び", "内伸び"), memo.Rule("lane_bias", "outer", "外伸び", "外伸び"), memo.Rule("pace", "H", "ハイペース", "ハイ")]
    docs = spark.createDataFrame(
        [(1, "かなり内伸び。外伸びではない"), (2, "内伸び、ハイペース、外伸びと外伸び"), (3, "  "), (4, None), (5, "内伸びか疑問")], "doc int, text string"
    )
    m = memo.matches(docs, "doc", "text", rules)
    assert rows(m, "doc", "value", "position", "is_negated", "intensity") == [
        (1, "inner", 3, False, 1.3), (1, "outer", 7, True, 1.0), (2, "H", 4, False, 1.0), (2, "inner", 0, False, 1.0),
        (2, "outer", 10, False, 1.0), (2, "outer", 14, False, 1.0), (5, "inner", 0, True, 1.0),
    ]
    assert rows(memo.suggestions(m, "doc"), "doc", "value", "score") == [(1, "inner", 1.3), (2, "H", 1.0), (2, "outer", 2.0)]
    pairs = [("lane_bias.inner", "lane_bias.outer", "x")]
    assert rows(memo.conflicts(m, "doc", pairs), "doc") == [(2,)]
    assert "negated.lane_bias.outer" in [r.chip for r in memo.chips(m, "doc", rules, pairs).filter("doc = 1").collect()]


def test_markdown_report_keeps_the_order(spark, tmp_path):
    from raceframe.sources.reports import save_report

    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "k int, v string").coalesce(1)
    save_report(df, str(tmp_path / "md"), "md")
    got = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert sorted(got) == sorted(["| k | v |", "|---|---|", "| 3 | c |", "| 1 |  |", "| 2 | b |"])


def test_ndcg_with_text_ids(spark):
    df = spark.createDataFrame(
        [("1", "a", 0.6, 0), ("1", "b", 0.4, 1), ("2", "a", 0.5, 1), ("2", "b", 0.5, 0), ("3", "a", 1.0, 1)], "event string, entity string, p double, y int"
    )
    r = evaluate.ndcg(df, "p", "y").first()
    half = 1 / 1.584962500721156
    assert r.n_events == 2 and r.ndcg == pytest.approx((half + (1 + half) / 2) / 2) and r.top1_accuracy == 0.5


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("kind", ["row_number", "rank", "average"])
def test_ranks_keep_rows_without_value_or_key(spark, kind, down):
    inf, nan = float("inf"), float("nan")
    values = [0.5, None, 0.2, nan, inf, -inf, None, 0.0, -0.0, 1e-300, nan, 0.5]
    df = spark.createDataFrame([(g, i, v) for g in (1, None) for i, v in enumerate(values)], "event int, entity int, v double")
    sized = grouping.with_group_stats(df, ["event"], n=F.count(F.lit(1)))
    assert sized.filter("n = 12").count() == 24
    plain = grouping.rank_in_group(sized, ["event"], "v", "k", descending=down, ties=["entity"], size="n", kind=kind)
    for spread in (
        grouping.rank_in_group(sized, ["event"], "v", "k", descending=down, ties=["entity"], size="n", kind=kind, hot_rows=1),
        grouping.rank_in_group(df, ["event"], "v", "k", descending=down, ties=["entity"], kind=kind),
    ):
        ranked = [{(r.event, r.entity): r.k for r in x.collect()} for x in (plain, spread)]
        assert ranked[0] == ranked[1] and len(ranked[1]) == 24


def test_auc_ignores_rows_without_a_score(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (None, 1), (0.2, 0), (0.1, 0)], "p double, win int")
    assert evaluate.roc_auc(df, "p", "win").first().auc == 1.0


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_equal_the_percentiles_of_whole_groups(spark, keys):
    rng = random.Random(5)
    special = [None, 0.0, -0.0, float("inf"), float("-inf"), float("nan"), 1e-310, -1e300]
    data = [("wide", rng.gauss(0, 1) * 10 ** rng.randint(-3, 3)) for _ in range(3000)]
    data += [("close", 0.5 + k * 2.0**-40) for k in range(999)] + [("same", 0.25)] * 500 + [("one", -7.5), ("none", None)]
    data += [(None, rng.random()) for _ in range(400)] + [("few", float(rng.randint(1, 3))) for _ in range(700)]
    if keys:
        data += [("special", v) for v in special] + [("special", float(k)) for k in range(5)]
    shares = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    df = spark.createDataFrame(data, "g string, v double")
    want = {r[0]: r[1] for r in df.groupBy(F.lit("all") if not keys else F.col("g")).agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).collect()}
    out = grouping.quantiles(df, keys, "v", shares, "q")
    got = {(r["g"] if keys else "all"): r["q"] for r in out.collect()}
    assert got.keys() == {k for k, v in want.items() if v is not None}
    for k, q in got.items():
        assert q == pytest.approx(want[k], rel=0, abs=0, nan_ok=True), k
    empty = [r["q"] for r in grouping.quantiles(df.limit(0), keys, "v", shares, "q").collect()]
    assert empty == ([] if keys else [[None] * len(shares)])
