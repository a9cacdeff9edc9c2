"""What queries leave on disk: shuffle files of steps that have ended, and runs that travel where numbers would do."""

import time

from pyspark.sql import functions as F

from raceframe.operators import features, history
from raceframe.session import configure

SCHEMA = "event long, entity long, actor string, owner string, day int, outcome long, last3f double, prize long, weight int, surface string"
REST = "event_date date, distance int, going string, place string, race_class string, field_size long, post long, change int"
ROWS = [
    (1, 1, "a", "x", 5, 2, 33.0, 9, 450, "t"), (2, 1, "a", "x", 6, 1, None, None, 452, "t"), (2, 1, "b", "x", 6, 4, 36.0, 7, None, "d"), (3, 1, None, "x", 9, None, 34.0, 5, 455, None),
    (4, 1, "a", None, None, 3, 35.0, 4, 460, "t"), (5, None, "a", "x", 7, 1, 33.5, 2, 440, "d"), (6, 1, "a", "x", 12, 3, 35.5, 8, 451, "t"), (7, 2, "b", "x", 12, 1, 35.0, 1, 444, "t"),
]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark, tmp_path):
    before = shuffle_files(configure(spark))
    spark.range(20_000).groupBy(F.pmod(F.hash("id"), F.lit(500)).alias("k")).count().write.parquet(str(tmp_path / "t"))
    left = None
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("count")).first()[0] == 20_000


def test_a_table_read_twice_has_its_rows_again(spark):
    df = configure(spark).range(3_000).groupBy(F.pmod("id", F.lit(7)).alias("k")).count().groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    first = sorted(df.collect())
    time.sleep(1)
    assert sorted(df.collect()) == first == [(428, 3), (429, 4)]


def joined_types(plan):
    children = plan.children()
    children = [children.apply(i) for i in range(children.size())]
    own = [c.output().apply(i).dataType().typeName() for c in children for i in range(c.output().size())] if plan.nodeName() == "Join" else []
    return own + [t for c in children for t in joined_types(c)]


def entries(spark):
    return spark.createDataFrame([(*r, None, 1200, "良", "東京", "G1", 1, 1, 2) for r in ROWS], f"{SCHEMA}, {REST}")


def test_numbers_travel_to_the_rows_in_place_of_runs(spark):
    every = list(features.recent_columns("change"))
    table = features.feature_table(entries(spark), "change", columns=["event", "entity", *every])
    joined = joined_types(table._jdf.queryExecution().optimizedPlan())
    assert joined and "array" not in joined


def test_recent_columns_equal_those_made_at_the_rows(spark):
    df = entries(spark)
    ran = F.col("outcome").isNotNull()
    lists = {"runs": (5, ["outcome", "last3f", "prize"], ran), "weights": (3, ["weight", "change"], ran & F.col("weight").isNotNull())}
    recent = features.recent_columns("change")
    at_rows = recent | {"h_recent3_total_prize": F.when(F.size("runs") > 0, recent["h_recent3_total_prize"]).when(F.col("entity").isNotNull(), 0.0)}
    want = df.join(history.recent_lists(df, ["entity"], lists), ["entity", "day"], "left").withColumns(at_rows)
    look = lambda table, names: sorted(map(repr, table.select("event", "entity", *names).collect()))
    for names in ([*recent], ["h_recent3_avg_finish", "h_days_since_last"], ["h_recent3_avg_last3f"], ["h_recent3_total_prize"], ["h_days_since_last"]):
        assert look(features.feature_table(df, "change", columns=["event", "entity", *names]), names) == look(want, names), names
