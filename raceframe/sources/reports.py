"""Reports and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from raceframe.operators.grouping import rank_in_group


def save_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a report as CSV, JSON lines or a Markdown table."""
    if kind == "md":
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        head = df.sparkSession.createDataFrame(
            [(-2, "| " + " | ".join(df.columns) + " |"), (-1, "|" + "---|" * len(df.columns))], "i long, value string"
        )
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
        # ids grow with the partition and the row, so the rows keep their order
        body = df.select(F.monotonically_increasing_id().alias("i"), line)
        head.unionByName(body).orderBy("i").select("value").write.mode("overwrite").text(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError("kind must be csv, json or md")


def event_documents(df: DataFrame, attributes: Sequence[str], fields: Sequence[str], rank: str, page: int = 1000) -> DataFrame:
    """One JSON document per event with its entries by rank.

    An event of more than ``page`` entries gives several numbered parts, so that a
    document stays bounded.
    """
    part = F.floor((F.col(rank) - 1) / page).cast("int")
    entries = F.sort_array(F.collect_list(F.struct(F.col(rank), *[F.col(f) for f in fields])))
    per = df.withColumn("part", part).groupBy("event", "part", *attributes).agg(entries.alias("entries"))
    body = F.to_json(F.struct("event", *attributes, "entries"))
    return per.select("event", "part", *attributes, F.size("entries").cast("long").alias("n_entries"), body.alias("document"))


def write_event_documents(df: DataFrame, path: str, date: str, attributes: Sequence[str], fields: Sequence[str], rank: str) -> None:
    """Write the events as documents of JSON lines, in folders by date.

    A document is a line with the event and its attributes and a line per entry by rank
    (``rank`` 0 marks the first).  Rows are dealt by ranges of (date, event, rank) and
    sorted, and the writer cuts them into lines, so a document is never held in memory; one that
    is larger than a task goes on in the next file.
    """
    kind = df.schema[rank].dataType
    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in fields]
    head = F.struct(F.lit(0).cast(kind).alias(rank), *attributes, *none)
    entry = F.struct(F.col(rank), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in attributes], *fields)
    lines = F.explode(F.when(F.col(rank) == 1, F.array(head, entry)).otherwise(F.array(entry)))
    rows = df.repartitionByRange(date, "event", rank).sortWithinPartitions(date, "event", rank)
    rows.select(date, "event", lines.alias("line")).select(date, "event", "line.*").write.mode("overwrite").partitionBy(date).json(path)


def read_event_documents(spark: SparkSession, path: str, schema: StructType, dates: tuple[str, str] | None = None) -> DataFrame:
    """The lines of written documents; ``dates`` reads the folders of a span of days alone."""
    rows = spark.read.schema(schema).json(path)
    date = schema.names[0]
    return rows if dates is None else rows.filter(F.col(date).between(*[F.lit(d).cast("date") for d in dates]))


def day_summary(documents: DataFrame, date: str) -> DataFrame:
    """Events, documents and entries per day."""
    return documents.groupBy(date).agg(
        F.count_distinct("event").alias("n_events"), F.count(F.lit(1)).alias("n_documents"), F.sum("n_entries").alias("n_entries")
    )


def ranked_entries(df: DataFrame, p: str, size: str | None = None) -> DataFrame:
    """Entries with their rank by falling prediction."""
    return rank_in_group(df, ["event"], p, "rank", descending=True, ties=["entity"], size=size)
