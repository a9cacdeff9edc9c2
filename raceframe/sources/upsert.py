"""Keyed writing without a table format: merge as a join, then write the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceframe.operators.grouping import top_per_group


def last_per_key(src: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of every key in the order of arrival."""
    return top_per_group(src, keys, [F.col(c).desc() for c in order], 1)


def upsert(
    target: DataFrame, src: DataFrame, keys: Sequence[str], skip_null: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Target with the source merged in by key; ``src`` has one row per key.

    A matched row takes the source values.  ``skip_null`` keeps the target value
    where the source is NULL, ``keep`` names columns that never change once set.
    """
    keys = list(keys)
    values = [c for c in target.columns if c not in keys]
    new = src.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in values if c in src.columns], F.lit(True).alias("__hit"))
    joined = target.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    out = []
    for c in values:
        if c not in src.columns:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c))
        elif skip_null:
            out.append(F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*keys, *out).select(*target.columns)


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key occurs twice."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1)
    if bad:
        raise ValueError(f"duplicate key {bad[0].asDict()}")


def create_table(df: DataFrame, path: str, keys: Sequence[str], if_exists: str = "fail", partition_by: Sequence[str] = ()) -> None:
    """Write a keyed table; ``if_exists`` is fail, replace or append."""
    modes = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
    if if_exists not in modes:
        raise ValueError(f"if_exists must be one of {sorted(modes)}")
    rows = df
    if if_exists == "append":
        spark = df.sparkSession
        present = spark.read.parquet(path)
        check_unique(df.select(*keys).unionByName(present.select(*keys)), keys)
    else:
        check_unique(df, keys)
    writer = rows.write.mode(modes[if_exists])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def merge_into(path: str, out_path: str, src: DataFrame, keys: Sequence[str], skip_null: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Merge a batch into a stored table and write the new version beside it.

    The table being read is never overwritten, so a failed job leaves it whole.
    """
    spark = src.sparkSession
    upsert(spark.read.parquet(path), src, keys, skip_null, keep).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)
