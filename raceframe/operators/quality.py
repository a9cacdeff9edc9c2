"""Coverage, completeness and integrity of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.functions.columns import availability_level, failure_category, invalid_status, level_order
from raceframe.operators.grouping import top_per_group
from raceframe.operators.history import ratio


def table_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """Per column: type, rows, NULL rate, distinct values, smallest and largest value.

    All columns share one aggregation.  Distinct values are estimated by a sketch
    unless ``exact``; the exact count copies every row once per column.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    count = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in columns:
        aggs += [
            F.count(c).alias(f"{c}__n"), count(F.col(c)).alias(f"{c}__d"),
            F.min(F.col(c)).cast("string").alias(f"{c}__lo"), F.max(F.col(c)).cast("string").alias(f"{c}__hi"),
        ]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col("__rows").alias("n_rows"),
                ratio(F.col("__rows") - F.col(f"{c}__n"), F.col("__rows")).alias("null_rate"),
                F.col(f"{c}__d").alias("n_distinct"), F.col(f"{c}__lo").alias("min_value"), F.col(f"{c}__hi").alias("max_value"),
            )
            for c in columns
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def year_coverage(df: DataFrame, date: str = "event_date") -> DataFrame:
    """Events, entries and distinct entities, actors and owners per year."""
    distinct = {"n_events": "event", "n_entities": "entity", "n_actors": "actor", "n_owners": "owner"}
    return df.groupBy(F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("n_entries"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()]
    )


def invalid_breakdown(df: DataFrame, outcome: str, status: str) -> DataFrame:
    """Rows per invalid status, rows without an outcome, and the total of both, with its rate."""
    bad = invalid_status(status)
    none = F.col(outcome).isNull()
    kinds = F.array_compact(
        F.array(
            F.lit("(all)"), F.when(bad, F.col(status)), F.when(none, F.lit("(NULL finish_order)")),
            F.when(bad | none, F.lit("(invalid)")),
        )
    )
    per = df.select(F.explode(kinds).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return per.withColumn("rate", ratio(F.col("n"), total))


def valid_targets(df: DataFrame, outcome: str, status: str) -> DataFrame:
    """Rows that may become targets."""
    return df.filter(F.col(outcome).isNotNull() & ~invalid_status(status))


def generation_coverage(ancestors: DataFrame, entity: str = "entity") -> DataFrame:
    """Ancestors known per generation against the 2^generation that every entity has."""
    n = ancestors.select(F.count_distinct(entity)).scalar()
    out = ancestors.groupBy("generation").agg(F.count(F.lit(1)).alias("n"))
    expected = (n * F.pow(F.lit(2), F.col("generation"))).cast("long")
    return out.withColumn("expected", expected).withColumn("coverage", ratio(F.col("n"), F.col("expected")))


def child_coverage(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Per key: expected rows, child rows present, and full, partial or missing."""
    want = parents.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    have = children.groupBy(key).agg(F.count(F.lit(1)).alias("present"))
    out = want.join(have, key, "left").fillna(0, subset=["present"])
    state = F.when(F.col("present") == 0, "missing").when(F.col("present") < F.col("expected"), "partial").otherwise("full")
    return out.withColumn("state", state)


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Totals of a child coverage."""
    def of(s: str) -> Column:
        return F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}")

    return coverage.agg(
        F.count(F.lit(1)).alias("n_keys"), of("full"), of("partial"), of("missing"),
        F.sum("expected").alias("expected"), F.sum("present").alias("present"),
        (F.sum("present") / F.sum("expected")).alias("rate"),
    )


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """Keep the last (or first) row per key in the given order."""
    return top_per_group(df, keys, [F.col(c).desc() if last else F.col(c).asc() for c in order], 1)


def activity(df: DataFrame, key: str, date: str) -> DataFrame:
    """Number of rows and last date per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(date).alias("last_date"))


def ids_between(df: DataFrame, key: str, date: str, first_year: int, last_year: int) -> DataFrame:
    """Distinct keys seen in a range of years; the range is a plain filter on the date."""
    low, high = F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date")
    return df.filter(F.col(date).between(low, high)).select(key).distinct()


def progress(df: DataFrame, group: str, status: str) -> DataFrame:
    """Counts by state and the share of success per group."""
    states = ["success", "failed", "pending", "skipped"]
    counts = [F.count(F.when(F.col(status) == s, 1)).alias(s) for s in states]
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumn("progress_pct", F.col("success") / F.col("total") * 100)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of several columns, as (column, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def failure_counts(df: DataFrame, message: str) -> DataFrame:
    """Failures per category of their message."""
    return df.filter(F.col(message).isNotNull()).groupBy(failure_category(message).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def missing_keys(keys: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that are not in the other table."""
    return keys.select(key).distinct().join(known.select(key), key, "left_anti")


def incomplete(parents: DataFrame, children: DataFrame, key: str, expected: str) -> DataFrame:
    """Parents with fewer children than they should have."""
    have = children.groupBy(key).agg(F.count(F.lit(1)).alias("present"))
    out = parents.select(key, expected).join(have, key, "left").fillna(0, subset=["present"])
    return out.filter(F.col("present") < F.col(expected))


def referential_integrity(links: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Distinct keys and how many of them exist in the referenced table, per link."""
    out = None
    for name, (left, lkey, right, rkey) in links.items():
        have = left.select(F.col(lkey).alias("k")).filter("k IS NOT NULL").distinct()
        known = right.select(F.col(rkey).alias("k"), F.lit(1).alias("hit")).distinct()
        one = have.join(known, "k", "left").agg(F.count(F.lit(1)).alias("n_keys"), F.count("hit").alias("n_matched"))
        one = one.select(F.lit(name).alias("link"), "n_keys", "n_matched", ratio("n_matched", "n_keys").alias("match_rate"))
        out = one if out is None else out.unionByName(one)
    return out


def level_violations(names: DataFrame, name: str, max_level: str) -> DataFrame:
    """Columns that are known only after the allowed level."""
    level = availability_level(name)
    out = names.withColumn("level", level)
    late = level_order("level") > level_order(F.lit(max_level))
    return out.filter(late).withColumn("fatal", F.col("level") == "result")


def number_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: rows that are NULL or NaN, and rows that are infinite."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [
            F.count(F.when(v.isNull() | F.isnan(v), 1)).alias(f"{c}__nan"),
            F.count(F.when(F.abs(v) == float("inf"), 1)).alias(f"{c}__inf"),
        ]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__nan").alias("n_nan"), F.col(f"{c}__inf").alias("n_inf")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def recount(df: DataFrame, key: str = "entity", bucket_days: int = 365) -> DataFrame:
    """(event, entity, n, wins, in3): what the key had done on earlier days, counted a second way.

    A self-join in buckets of days: whole earlier buckets come in as one total each, and only
    days of the row's own bucket are paired.  It shares no step with the history operators,
    so it can check them.  A NULL key has no rows.
    """
    o = F.col("outcome")
    ran = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), "day", F.floor(F.col("day") / bucket_days).alias("b"), "outcome")
    measures = {"n": F.count(o), "wins": F.count(F.when(o == 1, 1)), "in3": F.count(F.when(o <= 3, 1))}
    daily = ran.groupBy("k", "b", "day").agg(*[c.alias(m) for m, c in measures.items()])
    total = daily.groupBy("k", "b").agg(*[F.sum(m).alias(m) for m in measures])
    earlier = total.select("k", F.col("b").alias("b0"), *measures)
    before = total.select("k", "b").join(earlier, "k").filter("b0 < b").groupBy("k", "b").agg(*[F.sum(m).alias(f"{m}0") for m in measures])
    other = daily.select("k", "b", F.col("day").alias("day0"), *measures)
    inside = daily.select("k", "b", "day").join(other, ["k", "b"]).filter("day0 < day").groupBy("k", "b", "day").agg(*[F.sum(m).alias(f"{m}1") for m in measures])
    days = daily.select("k", "b", "day").join(before, ["k", "b"], "left").join(inside, ["k", "b", "day"], "left")
    told = days.select("k", "day", *[(F.coalesce(f"{m}0", F.lit(0)) + F.coalesce(f"{m}1", F.lit(0))).cast("long").alias(m) for m in measures])
    return df.select("event", "entity", F.col(key).alias("k"), "day").join(told, ["k", "day"]).select("event", "entity", *measures)


def leaks(features: DataFrame, counted: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row per feature: rows compared, rows that differ from the second count, and rows that know too much.

    ``columns`` maps a feature of ``features`` to a column of ``counted``; NULL counts as 0.
    """
    both = features.select("event", "entity", *columns).join(counted, ["event", "entity"])
    gap = lambda f, c: F.coalesce(F.col(f), F.lit(0)) - F.col(c)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), gap(f, c).cast("long").alias("gap")) for f, c in columns.items()])
    return both.select(F.explode(rows).alias("r")).groupBy(F.col("r.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("r.gap") != 0, 1)).alias("n_different"), F.count(F.when(F.col("r.gap") > 0, 1)).alias("n_leaks"),
    )
