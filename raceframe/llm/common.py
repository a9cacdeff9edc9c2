"""Steps that several operators share: settings, written tables, components."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Batches sent to Python are bounded in rows and in bytes, so that long texts do not
# add up in a worker.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Generated methods above this many bytes are not compiled by the JVM; without this limit
    # long expressions would run in its interpreter.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Long expressions would otherwise be spelled out in every plan that the driver keeps.
    "spark.sql.maxPlanStringLength": "10000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when the step that wrote them has ended, not when the driver next collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators count on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *, few: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage.

    ``few`` is for results much smaller than what they come from: their rows are gathered
    into files of a useful size instead of a file per task.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if few else df
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_value(spark: SparkSession, value):
    """Broadcast an object together with the code of its class, so that executors need no copy of it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def loaded(sent):
    """The object that ``by_value`` sent."""
    return pickle.loads(sent.value)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node: columns ``node`` and ``component``.

    ``edges`` holds long columns ``a`` and ``b``; direction, repeats and loops do not
    matter.  Alternates the two star steps until nothing changes: first every larger
    neighbour of a node is linked to the node's smallest neighbour, then every smaller
    one.  Each step aggregates before it shuffles and joins on the node, so a node with
    very many neighbours is split by the skew join.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = written(edges.filter("a <> b").select(high, low).distinct(), "links", few=True)
    state = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        near = links.join(least, "a")
        links = written(
            near.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .unionByName(least.withColumnRenamed("m", "b")).distinct(), "links", few=True,
        )
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
