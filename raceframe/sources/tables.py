"""Schemas, reading and conforming of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables, their columns and keys.
SCHEMAS = {
    "races": "race_id string, date string, place string, course_type string, distance int, track_condition string, race_class string, grade string, race_no int, course_turn string, course_inout string, start_time string, head_count int",
    "race_results": "race_id string, horse_id string, finish_order int, finish_status string, frame_no int, horse_no int, jockey_id string, trainer_id string, sex string, age int, weight double, passing_order string, last_3f double, win_odds double, popularity int, body_weight int, body_weight_diff int, prize_money double",
    "payouts": "race_id string, bet_type string, combination string, payout int",
    "corners": "race_id string, corner_1 string, corner_2 string, corner_3 string, corner_4 string",
    "lap_times": "race_id string, lap_index int, distance_m int, time_sec double",
    "horse_laps": "race_id string, horse_id string, section_m int, time_sec double, position int",
    "short_comments": "race_id string, horse_id string, comment string",
    "horse_past_runs": "horse_id string, race_date string, race_name string, finish int, passing string, last_3f double, jockey string, surface string, distance int, prize double",
    "horses": "horse_id string, horse_name string, sex string, birth_date string, sire_id string, dam_id string",
    "jockeys": "jockey_id string, jockey_name string, affiliation string",
    "trainers": "trainer_id string, trainer_name string, affiliation string",
    "horse_pedigree": "horse_id string, generation int, position string, ancestor_id string, ancestor_name string",
    "fetch_status": "entity_type string, entity_id string, status string, error_message string, retry_count int",
    "odds_snapshots": "race_id string, horse_no int, observed_at timestamp, win_odds double, popularity int, source string",
}
KEYS = {
    "races": ["race_id"], "race_results": ["race_id", "horse_id"], "payouts": ["race_id", "bet_type", "combination"],
    "corners": ["race_id"], "lap_times": ["race_id", "lap_index"], "horse_laps": ["race_id", "horse_id", "section_m"],
    "short_comments": ["race_id", "horse_id"], "horse_past_runs": ["horse_id", "race_date", "race_name"],
    "horses": ["horse_id"], "jockeys": ["jockey_id"], "trainers": ["trainer_id"],
    "horse_pedigree": ["horse_id", "generation", "position"], "fetch_status": ["entity_type", "entity_id"],
    "odds_snapshots": ["race_id", "horse_no", "observed_at"],
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table with a fixed schema; only the columns used are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with header and a fixed schema."""
    return spark.read.schema(schema).csv(path, header=True)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in order; a missing one is a NULL of its type."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def load_results(results: DataFrame, races: DataFrame) -> DataFrame:
    """Results with the attributes of their event in engine names, ready for the history operators.

    Rows without outcome or date are dropped, dates normalised, codes looked up and
    a missing field size counted.
    """
    from raceframe.functions import columns as C
    from raceframe.functions import constants as K
    from raceframe.operators.grouping import with_group_stats

    races = races.select(
        F.col("race_id").alias("event"), C.normalize_date("date").alias("event_date"), "place", F.col("course_type").alias("surface"),
        F.col("track_condition").alias("going"), "distance", "race_class", "grade", "head_count",
    )
    rows = results.select(
        F.col("race_id").alias("event"), F.col("horse_id").alias("entity"), F.col("jockey_id").alias("actor"),
        F.col("trainer_id").alias("owner"), F.col("finish_order").alias("outcome"), F.col("finish_status").alias("status"),
        F.col("last_3f").alias("last3f"), F.col("body_weight").alias("weight"), "body_weight_diff",
        F.col("prize_money").alias("prize"), F.col("win_odds").alias("odds"), "popularity", F.col("horse_no").alias("post"),
    )
    joined = rows.join(races, "event")
    joined = with_group_stats(joined, ["event"], __n=F.count(F.lit(1)))
    joined = joined.filter(F.col("outcome").isNotNull() & F.col("event_date").isNotNull())
    return joined.withColumns(
        {
            "day": F.unix_date("event_date"), "field_size": F.coalesce("head_count", "__n"),
            "dist_cat": C.distance_step("distance"), "place_id": C.code("place", K.PLACE_CODES),
            "surface_id": C.code("surface", K.SURFACE_CODES), "going_id": C.code("going", K.GOING_CODES),
            "grade_id": C.code("grade", K.GRADE_CODES), "class_id": C.class_id("race_class"),
        }
    ).drop("__n")


def load_features(df: DataFrame, date: str, start: str, end: str, columns: list[str], label: str | None = None) -> DataFrame:
    """Rows of a date range with the given columns; a label that is not 0 or 1 is dropped."""
    out = df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if label:
        out = out.filter(F.col(label).isin(0, 1))
    return out.select(*columns)


def load_for_events(df: DataFrame, keys: DataFrame, key: str = "event") -> DataFrame:
    """Rows of the listed events; Spark broadcasts the list only when its size allows."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def bridge(base: DataFrame, other: DataFrame, keys: list[str], columns: list[str], prefix: str) -> DataFrame:
    """Columns of another feature table under a prefix, one row per key."""
    taken = other.groupBy(*keys).agg(*[F.max(c).alias(f"{prefix}{c}") for c in columns])
    return base.join(taken, keys, "left")


