"""The entries are made in one pass, the same for events of any size, and tasks stay small."""

import pytest
from pyspark.sql import functions as F

from raceframe.plans import base

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines that repeat, an event and a part that are there twice, and keys that are unknown."""
    at = tmp_path_factory.mktemp("tables")
    lines = [(e, (e * 5 + i * 3) % 11, i % 3, i, 1.0 + i, 10.0 * ((i * 7) % 5), 0.01 * i, 0.02, "R" if i % 2 else "N", "O") for e in range(1, 9) for i in range(e + 1)]
    lines += lines[:4] + [(3, None, 1, 9, 2.0, 5.0, 0.0, 0.0, None, None), (None, 4, 1, 1, 2.0, 5.0, 0.0, 0.0, "N", "F")]
    orders = [(e, e * 3, "FOP"[e % 3], f"1997-01-{e:02d}", f"{e % 5 + 1}-X") for e in (1, 2, 3, 4, 5, 6, 6, 7)]
    parts = [(k, f"Brand#{k % 3}") for k in (0, 1, 2, 2, 3, 5, 6, 7, 8)]
    spark.createDataFrame(lines, LINE).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(orders, ORDERS.replace("timestamp", "string")).withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    return str(at)


def test_events_of_any_size_give_the_same_entries(spark, tables, monkeypatch):
    found = {}
    for most in (1_000_000, 3):
        monkeypatch.setattr(base, "HOT_ROWS", most)
        rows = base._entries(spark, tables)
        sizes = rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min("field_size").alias("a"), F.max("field_size").alias("b"), F.sum("p").alias("p")).collect()
        assert {r.event for r in sizes} == set(range(1, 8))
        assert all(r.n == r.a == r.b and abs(r.p - 1) < 1e-9 for r in sizes)
        # Copies of an event or a part are equal in every value that ranks them.
        found[most] = sorted(map(str, rows.drop("outcome", "post", "popularity", "corner1", "corner4", "passing").collect()))
        ranks = rows.groupBy("event").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in ("outcome", "post", "popularity")], F.max("field_size").alias("n")).collect()
        assert all(r[c] == list(range(1, r.n + 1)) for r in ranks for c in ("outcome", "post", "popularity"))
    assert found[1_000_000] == found[3]


def test_entries_are_the_only_table_written(spark, tables, monkeypatch):
    names = []
    monkeypatch.setattr(base, "stored", lambda s, d, name, build, partition_by=(): names.append(name) or build(s, d))
    assert base.entries(spark, tables).count() > 0
    assert names == ["entries"]


def test_shuffles_begin_finer_than_the_session_asks(spark):
    """So that what a task sorts fits its memory however many rows there are."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 5 * wanted
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
