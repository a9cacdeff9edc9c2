"""What travels between tasks, and how many tasks there are."""

import random

from pyspark.sql import functions as F

from raceframe.operators import asof, event, history, models, scenario
from raceframe.session import FINER, PER_PART, configure

SCHEMA = "event long, entity long, day int, outcome int, last3f double, prize long, weight int, change int, corner1 int, field_size int, style string"


def runs(spark, n=60):
    rng = random.Random(2)
    rows = [
        (i, rng.choice([1, 2, None]), rng.randint(0, 40), rng.choice([1, 2, 5, None]), rng.random(), i, rng.choice([450, 460, None]), i % 3, rng.randint(1, 9), 9, rng.choice(["逃げ", "差し", "不明"]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_values_of_the_last_runs_travel_in_their_place(spark):
    df = runs(spark)
    for out in (
        history.recent_form(df), history.weight_form(df, "change"), history.base_recent_form(df), history.speed_form(df, 5), event.style_profile(df, "style"),
        history.prize_form(df),
    ):
        above = out._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
        assert "recent#" not in above


def test_rows_without_a_key_keep_their_defaults(spark):
    df = runs(spark)
    base = {r.event: r for r in history.base_recent_form(df).collect()}
    speed = {r.event: r for r in history.speed_form(df, 5).collect()}
    styles = {r.event: r for r in event.style_profile(df, "style").collect()}
    unknown = [r.event for r in df.collect() if r.entity is None]
    assert unknown and len(base) == len(speed) == len(styles) == 60
    for e in unknown:
        assert (base[e].perf_finish_mean, base[e].perf_finish_std, base[e].perf_last3f_mean) == (10.0, 0.0, 37.0)
        assert (speed[e].early_speed_index, speed[e].late_speed_index) == (0.5, 0.5)
        assert styles[e].main_style == "不明" and styles[e].avg_pos_rel is None


def test_last_runs_of_both_kinds_go_back_as_text(spark):
    from raceframe.plans import all_queries

    out = all_queries().QUERIES["last_runs_clean"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "recent#" not in plan.split("Join LeftOuter")[0]


def test_safe_features_meet_their_event_in_one_shuffle(spark):
    long = spark.createDataFrame(
        [(1, 1, f, v, f"2024-01-01 {h:02}:00:00") for f, v, h in (("horse_weight", 1.0, 9), ("horse_weight", 3.0, 10), ("horse_weight", 2.0, 10), ("horse_weight", 9.0, 15), ("finish_time", 5.0, 8))],
        "event long, entity long, feature string, value double, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    starts = spark.createDataFrame([(1, "2024-01-01 15:00:00")], "event long, start string").withColumn("start", F.col("start").cast("timestamp"))
    out = asof.safe_features(long, starts, "paddock")
    assert out.columns == ["event", "entity", "feature", "level", "seen_at", "value"]
    assert [(r.feature, r.level, r.seen_at.hour, r.value) for r in out.collect()] == [("horse_weight", "paddock", 10, 3.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastExchange" not in plan


def test_importance_reads_scores_that_were_made_once(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i // 8, i, rng.random(), rng.random()) for i in range(400)], "event long, entity long, good double, noise double")
    df = df.withColumn("win", (F.col("good") > 0.8).cast("int"))
    model = models.fit_logistic(df, ["good", "noise"], "win")
    out = models.permutation_importance(model, df, ["good", "noise"], "win", repeats=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "UDF" not in plan
    assert {r.feature: r["rank"] for r in out.collect()} == {"good": 1, "noise": 2}


def test_shuffles_grow_with_the_tables(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        assert int(configure(spark, 500).conf.get(name)) == PER_PART * 500
    finally:
        assert int(configure(spark).conf.get(name)) == own


def test_roles_meet_the_entries_before_the_scenarios_multiply_them(spark):
    data = [(v, e) for v in (1, 2, None) for e in (1, 2, 2, None)]
    told = [(1, "a", 1, "front"), (1, "b", 1, "weak"), (1, "a", 2, None), (2, None, 1, "front"), (2, "a", None, "front"), (2, "b", 2, "front"), (2, "b", 2, "front")]
    named = [(v, s) for v in (1, 2, 3) for s in ("a", "b", None)] + [(2, "b")]
    entries = spark.createDataFrame(data, "event long, entity long")
    roles = spark.createDataFrame(told, "event long, scenario string, entity long, role string")
    out = scenario.with_roles(entries, spark.createDataFrame(named, "event long, scenario string"), roles, ["front", "weak"])
    holds = lambda v, s, e, r: None not in (v, s, e) and (v, s, e, r) in told
    wanted = [(v, s, e, holds(v, s, e, "front"), holds(v, s, e, "weak")) for v, e in data for w, s in named if v == w and v is not None]
    got = [tuple(r) for r in out.select("event", "scenario", "entity", "is_front", "is_weak").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join " in x and "scenario#" in x]
