"""Signed feature hashing of ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hashed(df: DataFrame, token: Column, weight: Column, bits: int) -> DataFrame:
    """Sum of signed weights per (entity, index), scaled to length 1.

    Index and sign are the low bits of the first 64 bits of the digest, so three
    hex digits of it are enough.
    """
    low = F.conv(F.substring(F.sha2(token, 256), 14, 3), 16, 10).cast("int")
    n = 1 << bits
    sign = F.when(F.shiftright(low, bits).bitwiseAND(1) == 0, 1.0).otherwise(-1.0)
    cells = df.select("entity", (low % n).alias("idx"), (sign * weight).alias("w"))
    summed = cells.groupBy("entity", "idx").agg(F.sum("w").alias("w"))
    # at most 2^bits rows per entity
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("entity")))
    return summed.select("entity", "idx", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("value"))


def hash_ancestors(ancestors: DataFrame, bits: int = 9) -> DataFrame:
    """Sparse vector of all ancestors: (entity, generation, position, ancestor_id, ancestor_name)."""
    who = F.coalesce(F.when(F.col("ancestor_id") != "", F.col("ancestor_id")), F.col("ancestor_name"))
    token = F.concat(F.lit("gen"), F.col("generation").cast("string"), F.lit(":"), F.col("position"), F.lit(":"), who)
    weight = 1 / F.sqrt(F.col("generation").cast("double"))
    return _hashed(ancestors.filter(who.isNotNull()), token, weight, bits)


def hash_direct(parents: DataFrame, bits: int = 7) -> DataFrame:
    """Sparse vector of direct ancestors: (entity, role, name)."""
    token = F.concat("role", F.lit(":"), "name")
    return _hashed(parents.filter(F.col("name").isNotNull()), token, F.lit(1.0), bits)


def dense(vectors: DataFrame, bits: int) -> DataFrame:
    """One array of 2^bits floats per entity."""
    cells = F.map_from_entries(F.collect_list(F.struct("idx", "value")))
    per = vectors.groupBy("entity").agg(cells.alias("m"))
    values = F.transform(
        F.sequence(F.lit(0), F.lit((1 << bits) - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)).cast("float"),
    )
    return per.select("entity", values.alias("vector"))
