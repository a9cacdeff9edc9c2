"""Odds payloads as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.operators.grouping import rank_in_group

_ENTRY = "struct<odds:string,tanso:string,win_odds:string,popular:string,ninki:string,popularity:string>"


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def parse_odds_json(df: DataFrame, payload: str, event: str = "event", at: str = "observed_at") -> DataFrame:
    """One row per number of a payload: odds between 1 and 9999 and the popularity.

    Three layouts are read: numbers below data.odds, below data, or below odds.  A
    popularity that is not given is the minimum rank of the odds.
    """
    outer = F.coalesce(
        F.get_json_object(payload, "$.data.odds"), F.get_json_object(payload, "$.data"), F.get_json_object(payload, "$.odds")
    )
    entries = df.select(event, at, F.explode(F.from_json(outer, "map<string,string>")).alias("key", "text"))
    entries = entries.filter(F.col("key").rlike(r"^\d+$"))
    s = F.from_json("text", _ENTRY)
    odds = F.coalesce(_number(F.coalesce(s["odds"], s["tanso"], s["win_odds"])), _number(F.col("text")))
    given = F.coalesce(s["popular"], s["ninki"], s["popularity"]).try_cast("int")
    rows = entries.select(event, at, F.col("key").try_cast("int").alias("horse_no"), odds.alias("win_odds"), given.alias("__given"))
    rows = rows.filter(F.col("win_odds").between(1.0, 9999.0))
    ranked = rank_in_group(rows, [event, at], "win_odds", "__rank", kind="rank")
    return ranked.select(event, at, "horse_no", "win_odds", F.coalesce("__given", "__rank").cast("int").alias("popularity"))
