"""As-of records and the wide feature table against plain Python, on NULL keys, NULL conditions and same-day rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from raceframe.operators import features, grouping, history, models, profiles, quality, records

SCHEMA = "event long, entity long, actor string, owner string, day int, outcome long, last3f double, prize long, weight int, surface string"


def rows(seed, n=260):
    rng = random.Random(seed)
    out = []
    for event in range(n // 6):
        day = rng.randint(0, 60)
        for entity in rng.sample(range(14), 6):
            out.append((event, entity, rng.choice(["a", "b", "", None, "hot", "hot"]), rng.choice(["x", "x", "y", None]), day, rng.choice([None, 1, 2, 3, 4, 9]),
                        rng.choice([None, 33.5, 36.25]), rng.choice([None, 0, 500]), rng.choice([None, 440, 470]), rng.choice(["t", "d", None])))
    return out


def rate(past, test):
    return sum(1 for r in past if test(r[5])) / len(past) if past else None


def same(got, want, name):
    assert got == want or (got is not None and want is not None and abs(got - want) < 1e-9), (name, got, want)


@pytest.mark.parametrize("seed", [1, 2])
def test_records_equal_plain_python(spark, seed):
    data = rows(seed)
    wanted = [
        records.Record("h_", ["entity"], {"_s": "surface"}, full=True, detailed=["_s"]), records.Record("a_", ["actor"], {"_s": "surface"}, days=7),
        records.Record("p_", ["owner", "actor"]),
    ]
    got = {(r["event"], r["entity"]): r for r in records.records(spark.createDataFrame(data, SCHEMA), wanted).collect()}
    assert len(got) == len(data)
    for row in data:
        event, entity, actor, owner, day = row[:5]
        told = got[event, entity]
        ran = [r for r in data if r[4] < day and r[5] is not None]
        for prefix, past in (
            ("h_", [r for r in ran if r[1] == entity]), ("a_", None if actor is None else [r for r in ran if r[2] == actor]),
            ("p_", None if actor is None or owner is None else [r for r in ran if (r[2], r[3]) == (actor, owner)]),
        ):
            n = None if past is None else len(past)
            same(told[f"{prefix}n_starts"], n, prefix)
            same(told[f"{prefix}win_rate"], None if past is None else rate(past, lambda o: o == 1), prefix)
            same(told[f"{prefix}in3_rate"], None if past is None else rate(past, lambda o: o <= 3), prefix)
            if prefix != "p_":
                alike = None if past is None else [r for r in past if row[9] is not None and r[9] == row[9]]
                same(told[f"{prefix}n_starts_s"], None if past is None else len(alike), prefix)
                same(told[f"{prefix}win_rate_s"], rate(alike, lambda o: o == 1) if alike else None, prefix)
            if prefix == "a_":
                late = None if past is None else [r for r in past if r[4] >= day - 7]
                same(told["a_recent7d_n_starts"], None if past is None else len(late), "recent")
                same(told["a_recent7d_in3_rate"], rate(late, lambda o: o <= 3) if late else None, "recent")
            if prefix == "h_":
                outcomes, weights, prizes = [r[5] for r in past], [r[8] for r in past if r[8] is not None], [r[7] for r in past if r[7] is not None]
                same(told["h_avg_finish"], statistics.mean(outcomes) if outcomes else None, "mean")
                same(told["h_std_finish"], statistics.stdev(outcomes) if len(outcomes) > 1 else None, "std")
                same(told["h_worst_finish"], max(outcomes, default=None), "worst")
                same(told["h_is_first_run"], int(not past), "first")
                same(told["h_std_body_weight"], statistics.stdev(weights) if len(weights) > 1 else None, "weight")
                same(told["h_total_prize"], sum(prizes), "prize")
                sections = [r[6] for r in past if row[9] is not None and r[9] == row[9] and r[6] is not None]
                same(told["h_avg_last3f_s"], statistics.mean(sections) if sections else None, "sections")


def test_records_shuffle_count_does_not_grow_with_conditions(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    count = lambda wanted: records.records(df, wanted)._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    few = count([records.Record("h_", ["entity"], {"_s": "surface"})])
    many = count([records.Record(f"r{i}_", [k], {"_s": "surface", "_w": "weight", "_p": "prize"}) for i, k in enumerate(("entity", "actor", "owner"))])
    assert few == many


def test_last_runs_share_their_shuffles_and_keep_order(spark):
    data = rows(4)
    lists = {"runs": (3, ["outcome", "weight"], F.col("outcome").isNotNull()), "weights": (2, ["weight"], F.col("weight").isNotNull())}
    got = {(r["entity"], r["day"]): r for r in history.recent_lists(spark.createDataFrame(data, SCHEMA), ["entity"], lists).collect()}
    assert set(got) == {(r[1], r[4]) for r in data}
    for (entity, day), told in got.items():
        past = sorted((r for r in data if r[1] == entity and r[4] < day), key=lambda r: (r[4], r[0]), reverse=True)
        assert [x["outcome"] for x in told["runs"]] == [r[5] for r in past if r[5] is not None][:3]
        assert [(x["day"], x["weight"]) for x in told["weights"]] == [(r[4], r[8]) for r in past if r[8] is not None][:2]


def test_feature_table_without_history_rows_or_attributes(spark):
    schema = SCHEMA + ", event_date date, distance int, going string, place string, race_class string, field_size long, post long, change int"
    empty = spark.createDataFrame([], schema)
    table = features.feature_table(empty, "change")
    assert table.count() == 0 and {"h_n_starts", "jh_n_combos", "t_recent30d_n_entries", "sex_id", "h_running_style_id"} <= set(table.columns)
    assert not {"h_body_weight", "target_win", "outcome"} & set(features.usable_columns(table, "target_win"))
    one = spark.createDataFrame([(1, 1, None, None, 5, 1, 33.0, 9, 450, "t", None, 1200, "良", "東京", "G1", 1, 1, 2)], schema)
    row = features.feature_table(one, "change").first()
    assert (row["h_n_starts"], row["h_total_prize"], row["j_n_starts"], row["h_is_first_run"], row["target_win"], row["sex_id"]) == (0, 0, None, 1, 1, None)


def test_profile_rules_need_their_columns(spark):
    with pytest.raises(ValueError):
        profiles.apply_rules(spark.range(1), profiles.TAG_RULES)


def test_second_count_catches_a_planted_leak(spark):
    data = rows(5)
    df = spark.createDataFrame(data, SCHEMA)
    counted = quality.recount(df, bucket_days=10)
    got = {(r.event, r.entity): (r.n, r.wins, r.in3) for r in counted.collect()}
    for event, entity, *_, in data:
        day = next(r[4] for r in data if r[:2] == (event, entity))
        past = [r[5] for r in data if r[1] == entity and r[4] < day and r[5] is not None]
        assert got[event, entity] == (len(past), past.count(1), sum(o <= 3 for o in past))
    told = history.career(df)
    columns = {"h_n_starts": "n", "h_n_wins": "wins", "h_n_in3": "in3"}
    assert all((r.n_rows, r.n_different, r.n_leaks) == (len(data), 0, 0) for r in quality.leaks(told, counted, columns).collect())
    planted = told.withColumn("h_n_wins", F.when(F.col("event") == 3, F.col("h_n_wins") + 1).otherwise(F.col("h_n_wins")))
    found = {r.feature: (r.n_different, r.n_leaks) for r in quality.leaks(planted, counted, columns).collect()}
    assert found == {"h_n_starts": (0, 0), "h_n_wins": (6, 6), "h_n_in3": (0, 0)}


def test_dense_numbers_have_no_gaps(spark):
    values = [f"id{k % 700}" for k in range(900)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "name string")
    got = {r.name: r.n for r in grouping.dense_ids(df, "name", "n", buckets=64).collect()}
    assert set(got) == set(values) - {None} and sorted(got.values()) == list(range(700))
    assert grouping.dense_ids(df.filter("false"), "name", "n").count() == 0


def test_affinity_of_text_and_large_ids(spark):
    rng = random.Random(3)
    data = [(f"u{rng.randrange(12)}", (1 << 40) + rng.randrange(9), rng.randint(1, 9)) for _ in range(300)] + [(None, 5, 1), ("u1", None, 1)]
    out = models.pair_affinity(spark.createDataFrame(data, "rider string, horse long, outcome int"), "rider", "horse").collect()
    assert {(r.rider, r.horse) for r in out} == {(a, b) for a, b, _ in data if a is not None and b is not None}
    assert all(1 <= r.affinity <= 5 for r in out)
