"""Steps whose shuffles and blocks do not add up with the table."""

import random

from pyspark.sql import functions as F
from test_disk import entries

from raceframe.operators import grouping, models, records, relative
from raceframe.plans import base
from raceframe.session import configure


def test_prior_sends_rows_once_and_equals_plain_python(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), i, rng.choice([1, 2, None])) for i in range(80)]
    df = configure(spark).createDataFrame(rows, "k long, c string, day int, event long, v long")
    first = lambda d: (d is not None, d or 0)
    want = []
    for k, c, day, event, _ in rows:
        before = [r[4] for r in rows if r[:2] == (k, c) and (first(r[2]), r[3]) < (first(day), event) and r[4] is not None]
        want.append((event, len(before), sum(before) if before else None, max(before, default=None)))
    measures = {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    for hot_rows in (0, 12, grouping.CROWDED):
        out = grouping.prior(df, ["k", "c"], "day", [F.col("event")], measures, hot_rows=hot_rows)
        assert sorted(map(tuple, out.select("event", "n", "s", "m").collect())) == sorted(want), hot_rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(__place") == 1 and "coalesce(k" not in plan


def test_blocks_of_the_factor_model_grow_in_number(spark, monkeypatch):
    assert (models.factor_blocks(0), models.factor_blocks(10_000_000), models.factor_blocks(216_000_000)) == (10, 10, 216)
    given = {}

    def watched(**options):
        given.update(options)
        return als(**options)

    als = models.ALS
    monkeypatch.setattr(models, "ALS", watched)
    monkeypatch.setattr(models, "BLOCK_ROWS", 4)
    df = spark.createDataFrame([(i % 7, i % 11, i % 6 + 1) for i in range(60)], "actor long, entity long, outcome long")
    assert models.pair_affinity(df, "actor", "entity").count() == 60 and given["numUserBlocks"] == given["numItemBlocks"] == 15


def test_records_are_stored_one_after_the_other(spark, tmp_path):
    wanted = [records.Record("h_", ["entity"], {"_s": "surface"}, full=True, detailed=["_s"]), records.Record("j_", ["actor"], {"_s": "surface"}, days=3), records.Record("p_", ["owner", "actor"])]
    found = []

    def store(df, name):
        path = str(tmp_path / f"{name}-{len(found)}")
        df.write.parquet(path)
        found.append({r.b for r in spark.read.parquet(path).select("b").collect()})
        return spark.read.schema(df.schema).parquet(path)

    look = lambda df: sorted(map(repr, df.collect()))
    df = entries(configure(spark))
    for hot_rows in (1, 100):
        assert look(records.records(df, wanted, hot_rows, store)) == look(records.records(df, wanted, hot_rows))
    assert found == [{0}, {1}, {2}] * 2


def test_tables_made_in_turns_have_all_rows(spark):
    assert (base.slices(0), base.slices(1_800_001), base.slices(10**9)) == (1, 2, 6)
    build = lambda s, d: s.range(40).select(F.when(F.col("id") > 3, F.col("id")).alias("entity"), F.col("id").alias("n"))
    out = base.stored(spark, "nowhere", "turns", build, parts=3)
    assert sorted(r.n for r in out.collect()) == list(range(40))


def test_draws_measured_in_turns_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i // 8, i, rng.random(), rng.random()) for i in range(200)], "event long, entity long, good double, noise double")
    df = df.withColumn("win", (F.col("good") > 0.8).cast("int"))
    model = models.fit_logistic(df, ["good", "noise"], "win")
    look = lambda: sorted((r.feature, r["rank"], r.n_repeats, round(r.delta_auc, 9), round(r.delta_mrr, 9)) for r in models.permutation_importance(model, df, ["good", "noise"], "win", repeats=2).collect())
    at_once = look()
    drawn, made = models.permuted_rows, []
    monkeypatch.setattr(models, "DRAWN_ROWS", 1)
    monkeypatch.setattr(models, "permuted_rows", lambda df, key, features, *more: made.append(list(features)) or drawn(df, key, features, *more))
    assert look() == at_once and made == [["good"], ["noise"]]


def test_ranks_of_large_groups_are_stored_column_by_column(spark, tmp_path):
    df = configure(spark).createDataFrame([(1, 1, 2.0, 1.0), (1, 2, None, 3.0), (1, 3, 4.0, 3.0), (2, 1, 1.0, None)], "event long, entity long, x double, y double")
    found = []

    def store(table, name):
        found.append(name)
        table.write.parquet(str(tmp_path / name))
        return spark.read.schema(table.schema).parquet(str(tmp_path / name))

    look = lambda table: sorted(map(repr, table.collect()))
    assert look(relative.relative_features(df, ["x", "y"], {"y"}, store=store)) == look(relative.relative_features(df, ["x", "y"], {"y"}))
    assert found == ["rank-x", "rank-y"]
