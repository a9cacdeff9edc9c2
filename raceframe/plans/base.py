"""The supplied tables in the roles of event, entity, actor and owner."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceframe.operators.grouping import HOT_ROWS, Rank, group_ranks
from raceframe.session import work_dir

_tables: dict[tuple[str, str, str], str] = {}
_parts: dict[tuple[str, str], int] = {}
# Rows of a wide table that are made at a time; each turn reads its sources again, so turns are few.
SLICE_ROWS, MOST_SLICES = 1_800_000, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """The number of parts in which the line table is read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _parts:
        _parts[key] = table(spark, sf_dir, "lineitem").rdd.getNumPartitions()
    return _parts[key]


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a step's result to a path of its own and read it back; its shuffle files are gone then."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(rows: int) -> int:
    """In how many parts a table of so many rows is made, so that only one part is shuffled at a time."""
    return min(MOST_SLICES, max(1, math.ceil(rows / SLICE_ROWS)))


def stored(spark: SparkSession, sf_dir: str, name: str, build, partition_by: Sequence[str] = (), parts: int = 1) -> DataFrame:
    """Write a derived table once per application and read it back.

    The written copy cuts the lineage, so a lost executor costs a re-read, and it
    gives the queries column pruning and pushed filters on derived columns.  ``parts``
    above 1 writes it in that many turns, by a hash of the entity.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        path = f"{work_dir(spark)}/{name}-{zlib.crc32(sf_dir.encode()):08x}"
        df = build(spark, sf_dir)
        for k in range(parts):
            part = df if parts == 1 else df.filter(F.pmod(F.xxhash64("entity"), F.lit(parts)) == k)
            part.write.mode("append" if k else "overwrite").partitionBy(*partition_by).parquet(path)
        _tables[key] = path
    return spark.read.parquet(_tables[key])


def r6(c: Column | str) -> Column:
    """Six decimals, so that sums taken in another order still compare equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (event, entity) of the line table, with the brand."""
    line = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(
            F.min(
                F.struct(
                    "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                )
            ).alias("r")
        )
        .select(
            F.col("l_orderkey").alias("event"),
            F.col("l_partkey").alias("entity"),
            "r.*",
        )
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), "p_brand")
    return line.join(part, "entity", "left")


def _sized(spark: SparkSession, sf_dir: str, line: DataFrame) -> DataFrame:
    """Events as supplied, with the number of their entries and the sum of their quantities.

    A repeated event or part repeats the entries, so the copies count.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event"), "o_orderdate", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.count(F.lit(1)).over(Window.partitionBy("o_orderkey")).alias("__copies"),
    )
    totals = line.groupBy("event").agg(F.count(F.lit(1)).alias("__n"), F.sum("l_quantity").alias("__s"))
    copies = F.col("__copies")
    return orders.join(totals, "event").select(
        *[c for c in orders.columns if c != "__copies"], (F.col("__n") * copies).alias("field_size"), (F.col("__s") * copies).alias("__q"),
    )


def _described(rows: DataFrame) -> DataFrame:
    """The columns of an entry, from those of the tables and its ranks."""
    date = F.to_date("o_orderdate")
    cust = F.col("o_custkey") % 5
    pri = F.substring("o_orderpriority", 1, 1)
    cls = F.col("event") % 9
    names = ["G1", "GII", "G3", "オープン", "3勝クラス", "2勝クラス", "1勝クラス", "未勝利", "新馬"]
    return rows.select(
        "event", "entity", F.col("l_suppkey").alias("actor"), F.col("p_brand").alias("owner"),
        date.alias("event_date"),
        F.unix_date(date).alias("day"),
        F.when(F.col("o_orderstatus") == "F", "芝").when(F.col("o_orderstatus") == "O", "ダ").otherwise("障").alias("surface"),
        F.when(pri == "1", "東京").when(pri == "2", "中山").when(pri == "3", "京都").when(pri == "4", "阪神").otherwise("小倉").alias("place"),
        F.when(cust == 0, "良").when(cust == 1, "稍重").when(cust == 2, "重").when(cust == 3, "不良").alias("going"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (cls + 1).cast("int")).alias("race_class"),
        (1000 + 100 * (F.col("event") % 25)).cast("int").alias("distance"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        (33 + F.col("l_quantity") / 8).alias("last3f"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("prize"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R"), None)
        .otherwise((400 + F.col("l_quantity")).cast("int")).alias("weight"),
        "odds",
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        "field_size", (F.col("l_quantity") / F.col("__q")).alias("p"),
        "outcome", "post", "popularity",
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their ranks, from one shuffle by event: joined, ranked and described where they arrive.

    Texts and dates are made last, so that rows are narrow while they are sorted.  Events
    above ``HOT_ROWS`` entries take the spread-out way.  Their numbers, of which there is at
    most one per ``HOT_ROWS`` rows, are broadcast, so that without any nothing is read for them.
    """
    line = _lines(spark, sf_dir)
    events = _sized(spark, sf_dir, line)
    odds = 1.25 + F.round(F.col("l_discount") * 100) / 2 + F.round(F.col("l_tax") * 100) * 1.5
    ranks = [
        Rank("l_extendedprice", "outcome", True, ("entity",)), Rank("l_linenumber", "post", False, ("entity",)),
        Rank("odds", "popularity", False, ("entity",)),
    ]
    large = events.filter(F.col("field_size") > HOT_ROWS)
    of_large = line.join(F.broadcast(large.select("event").distinct()), "event", "left_semi")
    ways = [(line, events.filter(F.col("field_size") <= HOT_ROWS), False), (of_large, large, True)]
    ordinary, hot = (
        _described(group_ranks(rows.join(at, "event").withColumn("odds", odds), ["event"], ranks, spread)) for rows, at, spread in ways
    )
    n = F.col("field_size")
    c1 = 1 + (F.col("post") * 3 + F.col("entity")) % n
    c2 = 1 + (F.col("post") + F.col("outcome")) % n
    c4 = 1 + (F.col("outcome") + F.col("entity")) % n
    return ordinary.unionByName(hot).select(
        "*", c1.alias("corner1"), c4.alias("corner4"),
        F.concat_ws("-", c1.cast("string"), c2.cast("string"), c4.cast("string")).alias("passing"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (event, entity), stored once per application."""
    return stored(spark, sf_dir, "entries", _entries)


ENTRIES = """
WITH dedup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey,
      l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
    FROM lineitem) WHERE rn = 1
), entries0 AS (
  SELECT l_orderkey AS event, l_partkey AS entity, l_suppkey AS actor, p_brand AS owner,
    CAST(o_orderdate AS DATE) AS event_date,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day,
    CASE o_orderstatus WHEN 'F' THEN '芝' WHEN 'O' THEN 'ダ' ELSE '障' END AS surface,
    CASE substr(o_orderpriority,1,1) WHEN '1' THEN '東京' WHEN '2' THEN '中山' WHEN '3' THEN '京都' WHEN '4' THEN '阪神' ELSE '小倉' END AS place,
    CASE o_custkey % 5 WHEN 0 THEN '良' WHEN 1 THEN '稍重' WHEN 2 THEN '重' WHEN 3 THEN '不良' END AS going,
    CASE o_orderkey % 9 WHEN 0 THEN 'G1' WHEN 1 THEN 'GII' WHEN 2 THEN 'G3' WHEN 3 THEN 'オープン' WHEN 4 THEN '3勝クラス'
      WHEN 5 THEN '2勝クラス' WHEN 6 THEN '1勝クラス' WHEN 7 THEN '未勝利' ELSE '新馬' END AS race_class,
    CAST(1000 + 100 * (o_orderkey % 25) AS INTEGER) AS distance,
    l_linenumber AS line, l_extendedprice AS price, l_quantity AS qty,
    33 + l_quantity / 8 AS last3f,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS prize,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN NULL ELSE CAST(400 + l_quantity AS INTEGER) END AS weight,
    CAST(1.25 AS DOUBLE) + round(l_discount * 100) / 2 + round(l_tax * 100) * CAST(1.5 AS DOUBLE) AS odds,
    CAST(round(l_tax * 100) AS INTEGER) AS tax, l_returnflag AS flag, l_linestatus AS status,
    count(*) OVER (PARTITION BY l_orderkey) AS field_size,
    l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS outcome,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS post
  FROM dedup JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey
), entries AS (
  SELECT *, row_number() OVER (PARTITION BY event ORDER BY odds, entity) AS popularity,
    1 + (post * 3 + entity) % field_size AS corner1,
    1 + (outcome + entity) % field_size AS corner4,
    CAST(1 + (post * 3 + entity) % field_size AS VARCHAR) || '-' || CAST(1 + (post + outcome) % field_size AS VARCHAR)
      || '-' || CAST(1 + (outcome + entity) % field_size AS VARCHAR) AS passing
  FROM entries0
)
"""
