"""A growing log of observations, kept as the latest one per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceframe.operators.asof import latest
from raceframe.operators.history import ratio


def observation_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Observations as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _since_last_full(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """Rows of the newest full batch and of all batches after it."""
    rows = spark.read.parquet(table)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    newest = rows.agg(F.coalesce(F.max(F.when(F.col("full") == 1, F.col("batch"))), F.lit(-1))).scalar()
    return rows.filter(F.col("batch") >= newest)


def keep_latest(
    stream: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str], table: str, checkpoint: str,
    cutoff: Column | None = None, full_every: int = 50,
):
    """Start a query that keeps the latest observation per key, and return it.

    No observation is dropped for being late, and the stream keeps no state: repeats change
    no latest row.  A batch writes the latest row of the keys it saw; every ``full_every``
    batches one holds all keys.  A batch has its own folder, so running it again after a
    failure gives the same table.
    """
    seen = stream.select(*keys, at, *fields)
    if cutoff is not None:
        seen = seen.filter(F.col(at) <= cutoff)

    def write(batch: DataFrame, epoch: int) -> None:
        full = int((epoch + 1) % full_every == 0)
        rows = batch
        if full and epoch > 0:
            before = _since_last_full(batch.sparkSession, table, epoch)
            rows = before.select(*batch.columns).unionByName(batch)
        latest(rows, keys, at, fields).write.mode("overwrite").parquet(f"{table}/full={full}/batch={epoch}")

    return (
        seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_table(spark: SparkSession, table: str, keys: Sequence[str], at: str, fields: Sequence[str]) -> DataFrame:
    """Latest observation per key; batches before the newest full one are pruned as partitions."""
    return latest(_since_last_full(spark, table), keys, at, fields)


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, at = _folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def _held(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """Committed batches, oldest first, with the buckets each of them still has."""
    batches = sorted(int(n.split("=")[1]) for n in _names(spark, table) if n.startswith("batch="))
    found = {b: _names(spark, f"{table}/batch={b}") for b in batches}
    return {b: [int(n.split("=")[1]) for n in names if n.startswith("bucket=")] for b, names in found.items() if "_SUCCESS" in names}


def _newest(held: dict[int, list[int]]) -> dict[int, int]:
    """The newest batch of every bucket."""
    return {bucket: batch for batch, buckets in held.items() for bucket in buckets}


def _read(spark: SparkSession, table: str, where: dict[int, int], schema: T.StructType) -> DataFrame:
    """The rows of one batch of each of the buckets given."""
    paths = [f"{table}/batch={batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, epoch: int, table: str, keys: Sequence[str], at: str, fields: Sequence[str], buckets: int = 64) -> None:
    """Bring a batch into a table of ``buckets`` key buckets, one row per key, and remove what it replaces.

    Only the buckets with a key of the batch are written anew, under the batch's number.  Spark
    marks the batch's folder when all of it is there; until then readers and a second run
    see the buckets of earlier batches, which are removed only afterwards.  A batch that is
    already marked is not merged again.  The table holds at most one folder per bucket and,
    while a batch is written, the ones it replaces.
    """
    spark = batch.sparkSession
    held = _held(spark, table)
    if epoch not in held:
        rows = batch.select(*keys, at, *fields, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        before = {bucket: b for bucket, b in _newest(held).items() if bucket in touched}
        old = _read(spark, table, before, rows.drop("bucket").schema)
        old = old.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged = latest(rows.unionByName(old), [*keys, "bucket"], at, fields)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={epoch}")
        held = _held(spark, table)
    newest = _newest(held)
    for number, own in held.items():
        stale = [bucket for bucket in own if newest[bucket] > number]
        whole = len(stale) == len(own) and number < max(held)
        for path in [f"{table}/batch={number}"] if whole else [f"{table}/batch={number}/bucket={bucket}" for bucket in stale]:
            files, place = _folder(spark, path)
            files.delete(place, True)


def keep_compacted(
    stream: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str], table: str, checkpoint: str,
    cutoff: Column | None = None, buckets: int = 64,
):
    """Start a query that keeps the latest observation per key in a table of bounded size, and return it.

    As ``keep_latest``, but a batch rewrites the key buckets it touches and the older
    copies go, so that storage and reading follow the number of keys, not of batches.
    """
    seen = stream.select(*keys, at, *fields)
    if cutoff is not None:
        seen = seen.filter(F.col(at) <= cutoff)
    return (
        seen.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, table, keys, at, fields, buckets))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def compacted_table(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The rows of a compacted table: of every bucket its newest committed batch."""
    return _read(spark, table, _newest(_held(spark, table)), schema)


def completeness(observed: DataFrame, expected: DataFrame, key: str, want: str) -> DataFrame:
    """Observed against expected number per key, flagged below half."""
    have = observed.groupBy(key).agg(F.count(F.lit(1)).alias("n_observed"))
    out = expected.select(key, want).join(have, key, "left").fillna(0, subset=["n_observed"])
    return out.withColumns(
        {"rate": ratio(F.col("n_observed"), F.col(want)), "incomplete": F.col("n_observed") * 2 < F.col(want)}
    )
