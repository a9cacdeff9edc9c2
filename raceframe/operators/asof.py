"""Latest observation at a time of decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.functions.columns import availability_level, level_order


def latest(df: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str], cutoff: Column | None = None) -> DataFrame:
    """Latest observation per key, at or before the cutoff."""
    seen = df if cutoff is None else df.filter(F.col(at) <= cutoff)
    newest = F.max(F.struct(at, *fields)).alias("__o")
    return seen.groupBy(*keys).agg(newest).select(*keys, f"__o.{at}", *[f"__o.{f}" for f in fields])


def asof_join(
    probes: DataFrame, observations: DataFrame, keys: Sequence[str], probe_at: str, seen_at: str,
    fields: Sequence[str], probe_id: Sequence[str], chunk_seconds: int = 86_400,
) -> DataFrame:
    """For every probe the latest observation of its key at or before its own time.

    Time is cut into chunks.  A window finds the latest observation within the
    chunk, and the newest of each earlier chunk is carried forward, so a key with
    very many observations is spread over its chunks.
    """
    keys = list(keys)
    seen = F.struct(F.col(seen_at).alias("at"), *[F.col(f) for f in fields])

    def cut(c: str) -> Column:
        return F.floor(F.unix_timestamp(c) / chunk_seconds).alias("__chunk")

    obs = observations.select(*keys, F.col(seen_at).alias("__at"), cut(seen_at), seen.alias("__o"))
    asks = probes.select(*keys, *probe_id, F.col(probe_at).alias("__at"), cut(probe_at))
    both = asks.withColumn("__ask", F.lit(1)).unionByName(obs.withColumn("__ask", F.lit(0)), allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, "__chunk").orderBy("__at", "__ask", "__o").rowsBetween(Window.unboundedPreceding, 0)
    )
    local = both.withColumn("__in", F.last("__o", ignorenulls=True).over(inside)).filter("__ask = 1")
    newest = both.groupBy(*keys, "__chunk").agg(F.max("__o").alias("__newest"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*keys, "__chunk", F.last("__newest", ignorenulls=True).over(before).alias("__before"))
    found = local.join(carried, [*keys, "__chunk"], "left").withColumn("__v", F.coalesce("__in", "__before"))
    return found.select(
        *keys, *probe_id, F.col("__at").alias(probe_at), F.col("__v.at").alias(seen_at),
        *[F.col(f"__v.{f}").alias(f) for f in fields],
    )


def override(base: DataFrame, snapshot: DataFrame, keys: Sequence[str], fields: Sequence[str], tags: tuple[str, str]) -> DataFrame:
    """Snapshot values where present, base values else, with a tag that tells which."""
    snap = snapshot.select(*keys, *[F.col(f).alias(f"__s_{f}") for f in fields], F.lit(True).alias("__hit"))
    joined = base.join(snap, list(keys), "left")
    new = {f: F.coalesce(F.col(f"__s_{f}"), F.col(f)) for f in fields}
    source = F.when(F.col("__hit"), tags[0]).otherwise(tags[1]).alias("source")
    return joined.withColumns(new).select(*base.columns, source)


def decision_time(start: str | Column, level: str) -> Column:
    """Time at which features up to a level are taken: the day before at 15:00, 09:00, -30 or -5 minutes."""
    at = F.col(start) if isinstance(start, str) else start
    day = F.date_trunc("day", at)
    return {
        "pre_race": day - F.expr("INTERVAL 9 HOURS"),
        "morning": day + F.expr("INTERVAL 9 HOURS"),
        "paddock": at - F.expr("INTERVAL 30 MINUTES"),
        "just_before": at - F.expr("INTERVAL 5 MINUTES"),
    }[level]


def safe_features(long: DataFrame, events: DataFrame, level: str) -> DataFrame:
    """Latest value of every allowed feature per entry at the time of decision.

    ``long`` has event, entity, feature, value, seen_at; ``events`` has event, start.
    Observations meet their event in one shuffle and are cut down where they arrive: a
    feature has one level, which is told last.
    """
    of = availability_level("feature")
    cut = events.select("event", decision_time("start", level).alias("__cut"))
    allowed = long.filter(level_order(of) <= level_order(F.lit(level)))
    seen = allowed.join(cut.hint("shuffle_hash"), "event").filter(F.col("seen_at") <= F.col("__cut"))
    found = latest(seen, ["event", "entity", "feature"], "seen_at", ["value"])
    return found.select("event", "entity", "feature", of.alias("level"), "seen_at", "value")
