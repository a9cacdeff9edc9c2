"""Written documents, the compacted table, split guards, clean last runs, permutations and split counts."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from raceframe.operators import history, models, splits
from raceframe.sources import reports
from raceframe.streaming import observations

SCHEMA = "k long, kind string, at long, v double"
LOOK = (["k", "kind"], "at", ["v"])


def folders(path):
    return sum(n.startswith("bucket=") for _, names, _ in os.walk(path) for n in names)


def test_compacted_table_stays_bounded_and_replays(spark, tmp_path):
    rng = random.Random(2)
    table, best = str(tmp_path / "table"), {}
    schema = StructType.fromDDL(SCHEMA)
    for epoch in range(12):
        rows = [(rng.choice([1, 2, 3, 40 + epoch, None]), rng.choice(["a", None]), rng.randint(0, 100), rng.random()) for _ in range(30)] if epoch != 5 else []
        batch = spark.createDataFrame(rows, SCHEMA)
        observations.merge_batch(batch, epoch, table, *LOOK, buckets=4)
        if epoch in (3, 7):  # the same batch again, as after a lost commit
            observations.merge_batch(batch, epoch, table, *LOOK, buckets=4)
        for k, kind, at, v in rows:
            best[k, kind] = max(best.get((k, kind), (-1, 0)), (at, v))
        got = {(r.k, r.kind): (r["at"], r.v) for r in observations.compacted_table(spark, table, schema).collect()}
        assert got == best
        assert folders(table) <= 4
    assert observations.compacted_table(spark, str(tmp_path / "none"), schema).count() == 0


def test_half_written_batch_is_not_seen_and_written_again(spark, tmp_path):
    table, schema = str(tmp_path / "table"), StructType.fromDDL(SCHEMA)
    observations.merge_batch(spark.createDataFrame([(1, "a", 1, 1.0), (2, "a", 1, 2.0)], SCHEMA), 0, table, *LOOK, buckets=2)
    late = spark.createDataFrame([(1, "a", 5, 9.0)], SCHEMA)
    late.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table}/batch=1")
    os.remove(f"{table}/batch=1/_SUCCESS")
    read = lambda: {(r.k, r.v) for r in observations.compacted_table(spark, table, schema).collect()}
    assert read() == {(1, 1.0), (2, 2.0)}
    observations.merge_batch(late, 1, table, *LOOK, buckets=2)
    assert read() == {(1, 9.0), (2, 2.0)}


def test_documents_by_date(spark, tmp_path):
    path = str(tmp_path / "documents")
    rows = [(f"2024-01-0{1 + e % 3}", e, r, f"p{e}", e * 10 + r) for e in range(9) for r in range(1, 2 + e)]
    df = spark.createDataFrame(rows, "day string, event long, rank long, place string, entity long").withColumn("day", F.to_date("day"))
    reports.write_event_documents(df, path, "day", ["place"], ["entity"], "rank")
    assert sorted(n for n in os.listdir(path) if n.startswith("day=")) == [f"day=2024-01-0{k}" for k in (1, 2, 3)]
    schema = StructType.fromDDL("day date, event long, rank long, place string, entity long")
    got = {(str(r.day), r.event, r["rank"], r.place, r.entity) for r in reports.read_event_documents(spark, path, schema).collect()}
    assert got == {(d, e, r, None, x) for d, e, r, _, x in rows} | {(d, e, 0, p, None) for d, e, r, p, _ in rows if r == 1}
    assert reports.read_event_documents(spark, path, schema, ("2024-01-02", "2024-01-02")).select("event").distinct().count() == 3


def test_overlap_raises(spark):
    sound = spark.createDataFrame([(1, "train"), (1, "train"), (2, "test"), (None, "test")], "event long, split string")
    assert splits.require_disjoint(sound).count() == 4
    with pytest.raises(ValueError, match="event in more than one part of split: 2"):
        splits.require_disjoint(sound.unionByName(spark.createDataFrame([(2, "val")], "event long, split string")))


def test_last_runs_without_some(spark):
    rng = random.Random(8)
    rows = [(e, rng.choice([1, 2, None]), rng.randint(0, 30), rng.random() < 0.4 or None) for e in range(90)]
    df = spark.createDataFrame(rows, "event long, entity long, day int, late boolean")
    got = {r.event: [x.event for x in r.recent] for r in history.last_runs(df, 3, [], left_out=F.col("late")).collect()}
    for event, entity, day, _ in rows:
        past = sorted(((d, e) for e, n, d, late in rows if entity is not None and n == entity and d < day and not late), reverse=True)
        assert got[event] == [e for _, e in past[:3]], event


def test_permuted_rows_keep_values_and_differ_between_repeats(spark):
    df = spark.createDataFrame([(i // 4, i, float(i), float(i % 5) if i % 7 else None) for i in range(400)], "event long, entity long, a double, b double")
    rows = models.permuted_rows(df, ["event", "entity"], ["a", "b"], repeats=2, rows=100).collect()
    of = {}
    for r in rows:
        of.setdefault((r.feature, r.repeat), []).append((r.entity, r.value))
    assert set(of) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert all(sorted(v for _, v in of["a", k]) == [float(i) for i in range(400)] for k in (1, 2))
    moved = [sum(e != v for e, v in of["a", k]) for k in (1, 2)]
    assert min(moved) > 380 and dict(of["a", 1]) != dict(of["a", 2])
    assert all(sum(v is None for _, v in of["b", k]) == 58 for k in (1, 2))


def test_split_counts_and_importance_of_a_planted_feature(spark):
    rng = random.Random(4)
    rows = [(i // 8, i, rng.random(), rng.random(), 0.0) for i in range(800)]
    df = spark.createDataFrame(rows, "event long, entity long, good double, noise double, flat double").withColumn("win", (F.col("good") > 0.8).cast("int"))
    names = ["good", "noise", "flat"]
    model = models.fit_trees(df, names, "win", rounds=2, depth=2)
    got = {r.feature: r for r in models.importance(model, names, "v", spark).collect()}
    trees = model.stages[-1]
    assert sum(r.split for r in got.values()) == (trees.totalNumNodes - trees.getNumTrees) // 2
    assert got["good"]["rank"] == got["good"].split_rank == 1 and got["flat"].split == 0
    loss = {r.feature: r for r in models.permutation_importance(model, df, names, "win", repeats=2).collect()}
    assert loss["good"]["rank"] == 1 and loss["good"].delta_auc > 0.2 and abs(loss["flat"].delta_auc) < 1e-9 and all(r.n_repeats == 2 for r in loss.values())
