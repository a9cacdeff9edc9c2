"""Session settings and the shared work folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The joins that bring group statistics back to the rows must be split even
    # when a later step could have reused their partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Generated methods above this many bytes are not compiled by the JVM, and rows of many
    # columns would run in its interpreter; beyond the limit the steps run one by one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A task's rows are held several times at once while they are sorted and put into windows:
    # with tasks of this size (compressed) they stay in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # Shuffle files go when the step that wrote them has ended, not when the driver next collects
    # garbage: else those of the entries and feature tables lie on disk while models are fitted.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
# Shuffles begin with this many times the session's partitions, and with so many per part of
# a file that is read; those below the size above are put together again.
FINER, PER_PART = 5, 16


def configure(spark: SparkSession, parts: int = 0) -> SparkSession:
    """Apply the settings the operators count on to a running session.

    ``parts`` is the number of parts in which the largest table is read, so that tasks behind
    a shuffle do not grow with the table.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(FINER * partitions, PER_PART * parts))
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: ``spark.checkpoint.dir`` of the session, else its warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/raceframe-{spark.sparkContext.applicationId}"
